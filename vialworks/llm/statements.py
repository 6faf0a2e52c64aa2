"""A model of a corpus of short statements: its words, how sentences start, go on and end.

All counts run over the whole corpus: equal statements (digits masked, codes taken off) are counted first, with a
partial step, then their word sequences are. What is kept for use in the tasks are sequences with a share of at least
`min_share` of the statements, so the size of the model is bounded by the longest statement / min_share entries,
however large the corpus is.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vialworks.session import checkpoint

CODE = re.compile(r"^(?:EU)?[HP]\d{3}[A-Za-z]{0,2}(?:\s*\+\s*[HP]\d{3})*[:.]?\s+")
CODE_JVM = r"^(?:EU)?[HP][0-9]{3}[A-Za-z]{0,2}(?:\s*\+\s*[HP][0-9]{3})*[:.]?\s+"
DIGITS = re.compile(r"\d+")
TOKEN = re.compile(r"[^\W_]+|\.{2,}|…|(?<=\s)-(?=\s)|[^\w\s]|_")
STOPS = ".!?。"
ORDERS = (1, 2, 3, 4, 5)
#: A dash between blanks is a token of its own kind.
DASH = " - "


def tokens(text: str) -> list[str]:
    if " - " not in text and not text.startswith("- ") and not text.endswith(" -"):
        return TOKEN.findall(text)
    out = []
    for m in TOKEN.finditer(text):
        t = m.group()
        if t == "-":
            a, b = m.span()
            if (a == 0 or text[a - 1].isspace()) and (b == len(text) or text[b].isspace()):
                t = DASH
        out.append(t)
    return out


def sentences(toks: list[str]) -> list[list[str]]:
    """The token lists of the sentences, each with its stop if it has one."""
    out, at = [], 0
    for i, t in enumerate(toks):
        if t in STOPS and not (0 < i < len(toks) - 1 and toks[i - 1] == "0" and toks[i + 1][0] == "0"):
            out.append(toks[at : i + 1])
            at = i + 1
    if at < len(toks):
        out.append(toks[at:])
    return out


@dataclass
class Model:
    """What the tasks need: counts by sequence of words, joined by a blank."""

    total: int = 0
    words: dict[str, int] = field(default_factory=dict)
    ends: dict[str, int] = field(default_factory=dict)
    inner: dict[str, int] = field(default_factory=dict)
    starts: dict[str, int] = field(default_factory=dict)
    repeated: frozenset[str] = frozenset()  # open lines with a page mark that recur
    word_share: float = 5e-4

    def __post_init__(self) -> None:
        least = max(2, self.word_share * self.total)
        self.lexicon = {w for w, n in self.words.items() if n >= least}
        self.starters = {w for w, n in self.starts.items() if n >= least}
        self.prefixes = {w[:i] for w in self.lexicon for i in range(1, len(w))}
        self.repairs: dict[str, str | None] = {}
        self.kept: set[str] = set()  # words that a repair leaves as they are
        self._near: dict[str, list[str]] | None = None

    def complete(self, sentence: list[str], certain: float = 0.5, support: int = 2) -> bool:
        """True if the corpus' sentences end where this one does, judged by the longest ending it has seen."""
        n = len(sentence)
        for k in sorted(ORDERS, reverse=True):
            if k > n:
                continue
            gram = " ".join(sentence[n - k :])
            e, i = self.ends.get(gram, 0), self.inner.get(gram, 0)
            if e + i >= support:
                return e > certain * (e + i)
        return False

    def repair(self, word: str) -> str | None:
        """The word of the lexicon that a damaged word most likely was; None if there is none."""
        if word in self.lexicon:
            return word
        if word not in self.repairs:
            if len(self.repairs) > 200_000:
                self.repairs.clear()
            self.repairs[word] = self._nearest(word)
        return self.repairs[word]

    def _nearest(self, word: str) -> str | None:
        if self._near is None:
            self._near = {}
            for w in self.lexicon:
                if len(w) > 1:
                    for v in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
                        self._near.setdefault(v, []).append(w)
        variants = {word}
        for a, b in CONFUSED:
            variants.add(word.replace(a, b))
            i = word.find(a)
            while i >= 0:
                variants.add(word[:i] + b + word[i + len(a) :])
                i = word.find(a, i + 1)
        known = [v for v in variants if v in self.lexicon]
        if known:
            return max(known, key=lambda w: (self.words[w], w))
        options: set[str] = set()
        for x in variants:
            for v in {x, *(x[:i] + x[i + 1 :] for i in range(len(x)))}:
                options.update(self._near.get(v, ()))
        options = {w for w in options if min(len(w), len(word)) >= 2 and abs(len(w) - len(word)) <= 2}
        return max(options, key=lambda w: (w[0] == word[0], w[-1] == word[-1], self.words[w], w)) if options else None


#: What optical recognition writes for what, in the order they are undone.
CONFUSED = [("rn", "m"), ("vv", "w"), ("cl", "d"), ("ii", "u"), ("li", "h"), ("ri", "n"), ("0", "o"), ("5", "s"), ("9", "g"), ("6", "b"), ("!", "i"), ("@", "a"), ("7F", "가"), ("01", "이"), ("먼", "면"), ("옴", "음"), ("엄", "업"), ("잇", "있")]


def items(df: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """(key, field_name, item_no, item): one row per element of the list fields that isn't null."""
    parts = [F.struct(F.lit(f).alias("f"), c.alias("xs")) for f, c in fields.items()]
    long = df.select(key, F.explode(F.array(*parts)).alias("p")).select(key, F.col("p.f").alias("field_name"), F.posexplode("p.xs").alias("pos", "item"))
    return long.where("item is not null").select(key, "field_name", (F.col("pos") + 1).alias("item_no"), "item")


def learn(texts: DataFrame, item: str = "item", min_share: float = 5e-5, word_share: float = 5e-4) -> Model:
    """The model of all statements of one line that are written in letters, digits and common marks only.

    The last word of an open statement, which lacks a stop, may be a part only and doesn't count as a word; its end
    counts as an end, as what is cut off there goes on in more statements than it is cut in. Open statements with a
    page mark don't count.
    """
    t = F.col("t")
    plain = t.rlike(r"^[\p{L}\p{N} .,:;()/'’!?。+%&-]+$") & ~t.rlike(r"\.\.|  |[a-z]!| - | [.,;:]")
    masked = texts.select(F.regexp_replace(F.regexp_replace(F.trim(item), CODE_JVM, ""), "[0-9]+", "0").alias("t"))
    different = checkpoint(masked.groupBy("t").agg(F.count(F.lit(1)).alias("n")))  # the patterns below then meet each text once
    closed = t.rlike("[.!?。]$")
    corpus = different.where(plain & (closed | ~t.rlike(PAGE_JVM)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, int] = {}
        get = sums.get
        for pdf in batches:
            for t, n in zip(pdf.t, pdf.n, strict=True):
                toks = tokens(t)
                sums["N"] = get("N", 0) + n
                for s in sentences(toks):
                    body = s[:-1] if s[-1] in STOPS else s
                    m = len(body)
                    if not m:
                        continue
                    for w in s if s[-1] in STOPS else s[:-1]:
                        sums["W" + w] = get("W" + w, 0) + n
                    sums["S" + body[0]] = get("S" + body[0], 0) + n
                    for k in ORDERS:
                        for i in range(m - k + 1):
                            key = ("I" if i + k < m else "E") + " ".join(body[i : i + k])
                            sums[key] = get(key, 0) + n
            if len(sums) > 500_000:
                yield pd.DataFrame({"g": list(sums), "n": list(sums.values())})
                sums.clear()
        yield pd.DataFrame({"g": list(sums), "n": list(sums.values())})

    grams = checkpoint(corpus.mapInPandas(count, "g string, n long").groupBy("g").agg(F.sum("n").alias("n")))
    total = grams.where("g = 'N'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(2, min_share * total)
    parts: dict[str, dict[str, int]] = {"W": {}, "E": {}, "I": {}, "S": {}}
    for r in grams.where((F.col("n") >= least) & (F.col("g") != "N")).toLocalIterator():
        parts[r.g[0]][r.g[1:]] = r.n
    heads = different.where((F.col("n") >= max(5, least)) & ~closed & (F.length("t") <= 120) & t.rlike(PAGE_JVM))
    repeated = frozenset(r.t for r in heads.select("t").toLocalIterator())
    return Model(total, parts["W"], parts["E"], parts["I"], parts["S"], repeated, word_share)


#: Shapes of page marks.
PAGE = re.compile(r"(?i)\bpage\s*\d|\bp\.\s*\d|\bsheet\s+\d|\d+\s*/\s*\d+\s*(?:$|페이지|쪽)|제?\s*\d+\s*(?:쪽|페이지)(?![가-힣])|쪽\s*\d+|^\W*\d+\W*$|-\s+\d+\s+-|\[\d+\]|\|\s*\d+\s*$")
PAGE_JVM = r"(?i)\bpage\s*[0-9]|\bp\.\s*[0-9]|\bsheet\s+[0-9]|[0-9]+\s*/\s*[0-9]+\s*(?:$|페이지|쪽)|제?\s*[0-9]+\s*(?:쪽|페이지)(?![가-힣])|쪽\s*[0-9]+|^\W*[0-9]+\W*$|-\s+[0-9]+\s+-|\[[0-9]+\]|\|\s*[0-9]+\s*$"
#: A line of numbers and marks between them.
NUMBERS_ONLY = re.compile(r"[\W\d]*\d[\W\d]*")
LINES = re.compile(r"\r\n|[\n\r\f\v]")
NOISE = re.compile(r"[\r\n\f\v\t\u00ad\u200b]|[^\W\d_]?[~|@!`¦°■□¬$*^<>=\\{}#]|\S\s{2,}\S|\s[.,;:]|(?<!\.)\.\.(?!\.)|…\s*\S|\s-\s|�\s*\S")


@dataclass(frozen=True)
class Line:
    """A line of a list of statements, as the labeller and the judges of its end see it."""

    coded: bool
    toks: tuple[str, ...]
    fixed: tuple[str, ...]
    foreign: int  # tokens out of the lexicon, without the last one of an open line
    paged: bool
    closed: bool
    marked: bool  # ends in an omission mark
    ended: bool  # closed, or ends where sentences end
    sure: bool  # the same, under a strict threshold
    starter: bool
    noisy: bool  # holds marks or blanks that statements don't have
    headish: bool  # may be a page's head or foot
    features: tuple  # by KINDS, without those that depend on the list
    number: int  # of the features


_NUMBERS: dict[tuple, int] = {}


TAIL = re.compile(r"\s*(?:\.{2,}|…|�)+\s*$")
_MARK = re.compile(r"[~|`¦°■□¬$\u00ad\u200b]|(?<=\w)[!@](?=\w)|\s\.\.\s|(?<=\w)[-¬] +(?=\w)")


def _unmarked(c: str) -> str:
    """A line without stray marks; marks that stand for a letter become it."""
    c = re.sub(r"(?<=\w)!(?=\w)", "i", re.sub(r"(?<=\w)@(?=\w)", "a", c))
    c = re.sub(r"(?<=\w)[-¬] +(?=\w)", "", c)
    return re.sub(r"\s+(?:~~|\.\.)\s+|[~|`¦°■□¬$\u00ad\u200b]", lambda m: " " if m.group()[0].isspace() else "", c)


def read_line(c: str, coded: bool, model: Model) -> Line:
    """c: the line without its code, its digits masked."""
    toks = tokens(c)
    lexicon = model.lexicon
    foreign = sum(t not in lexicon and t not in STOPS for t in toks)
    odd = foreign or "  " in c or " ." in c or " ," in c or " ;" in c or " :" in c or ".." in c or not c.isprintable()
    starter = bool(toks) and toks[0] in model.starters
    if not odd and toks and toks[-1] in STOPS and (len(toks) < 2 or toks[-2] != "0"):  # a plain whole statement
        features = (0, False, False, coded, starter or coded, True, len(toks) < 6, False)
        return Line(coded, tuple(toks), tuple(toks), 0, False, True, False, True, True, starter, False, False, features, _NUMBERS.setdefault(features, len(_NUMBERS)))
    plain = tokens(_unmarked(c)) if odd and _MARK.search(c) else toks
    marked = bool(toks) and (toks[-1] in ("…", "..", "�") or toks[-1].startswith(".."))
    fixed = [t if t in lexicon else model.repair(t) or t for t in plain] if odd else toks
    last = sentences(fixed)[-1] if fixed else []
    closed = bool(last) and last[-1] in STOPS and not marked
    if closed and len(last) > 1 and last[-2] == "0" and not model.complete(last[:-1]):
        closed, last = False, last[:-1]  # a number cut before its fraction
    ended = sure = closed
    if not closed and not marked and last:
        cut_word = plain[-1] not in lexicon and (plain[-1] in model.prefixes or fixed[-1] == plain[-1])
        ended = not cut_word and model.complete(last)
        sure = ended and model.complete(last, certain=0.9)
    paged = not closed and PAGE.search(c) is not None
    if foreign and (marked or not (closed or ended or (paged and toks[-1] not in model.prefixes))):  # without a word that may be a part
        foreign = sum(t not in lexicon and t not in STOPS for t in toks[: -2 if marked else -1])
    paged = paged and (foreign > 0 or NUMBERS_ONLY.fullmatch(c) is not None)  # heads and feet hold words or marks that statements don't
    starter = bool(fixed) and fixed[0] in model.starters
    share = foreign / max(1, len(toks))
    noisy = bool(odd) and NOISE.search(TAIL.sub("", c)) is not None
    headish = (paged or foreign > 0) and not coded
    features = (0 if not foreign else 1 if share < 0.34 else 2, noisy, paged, coded, starter or coded, closed, len(toks) < 6, headish and c in model.repeated)
    return Line(coded, tuple(toks), tuple(fixed), foreign, paged, closed, marked, ended, sure, starter, noisy, headish, features, _NUMBERS.setdefault(features, len(_NUMBERS)))


def bridged(a: Line, b: Line, model: Model) -> bool:
    """True if the end of a and the start of b follow each other inside known sentences."""
    if not a.fixed or not b.fixed or a.closed or a.marked or b.coded:
        return False
    gram = f"{' '.join(a.fixed[-2:])} {b.fixed[0]}"
    if gram in model.inner or gram in model.ends:
        return True
    # a sentence of which only the first word stands in a
    return len(a.fixed) > 1 and a.fixed[-2] in STOPS and a.fixed[-1] in model.starters and (f"{a.fixed[-1]} {b.fixed[0]}") in model.inner


HEAD, BODY, MORE = "header", "body", "break"
#: A line is a page's head or foot, the start of a statement, or goes on with one; the latter two whole or damaged.
STATES = ((HEAD, False), (BODY, False), (BODY, True), (MORE, False), (MORE, True))
#: trace: how many words are out of the lexicon (none, some, many), and a + where marks or line breaks show.
KINDS = {
    "trace": ("0", "1", "2", "0+", "1+", "2+"), "inside": (False, True), "page": (False, True), "coded": (False, True), "starter": (False, True),
    "closed": (False, True), "short": (False, True), "repeated": (False, True), "place": ("only", "first", "inner", "last"), "bridge": (False, True),
}
_WHOLE = (0.9997, 0.0001, 0.0001, 0.00005, 0.00003, 0.00002)
_DAMAGED = (0.002, 0.35, 0.1, 0.35, 0.15, 0.048)
_BODY = ((0.98, 0.02), (0.99, 0.01), (0.7, 0.3), (0.05, 0.95), (0.08, 0.92), (0.7, 0.3), (0.97, 0.03), (0.2, 0.25, 0.3, 0.25), (0.98, 0.02))
_MORE = ((0.5, 0.5), (0.99, 0.01), (0.999, 0.001), (0.75, 0.25), (0.3, 0.7), (0.5, 0.5), (0.99, 0.01), (0.001, 0.001, 0.5, 0.498), (0.25, 0.75))
#: What is known of the states before anything is seen: the chance of a feature, by its values in the order of KINDS.
PRIOR = {
    (HEAD, False): ((0.01, 0.15, 0.4, 0.01, 0.13, 0.3), (0.6, 0.4), (0.08, 0.92), (0.999, 0.001), (0.8, 0.2), (0.98, 0.02), (0.3, 0.7), (0.5, 0.5), (0.1, 0.3, 0.3, 0.3), (0.97, 0.03)),
    (BODY, False): (_WHOLE, *_BODY), (BODY, True): (_DAMAGED, *_BODY), (MORE, False): (_WHOLE, *_MORE), (MORE, True): (_DAMAGED, *_MORE),
}
#: The chance of a state after a statement that has ended, and after one that is open.
PRIOR_MOVE = {False: (0.03, 0.9, 0.05, 0.01, 0.01), True: (0.06, 0.44, 0.05, 0.3, 0.15)}
#: How far back, over headers, the line may lie that a line goes on with.
REACH = 4


@dataclass
class Labeller:
    """A hidden Markov model over the lines of a list of statements, decoded by Viterbi.

    A state is a line's label (STATES) and the line that a statement before it ended with, so a header between two
    halves doesn't part them, and whether a line goes on with the words before it is judged for each way to read the
    lines. A state's chance depends on the label before and on whether the statement before is still open; what a line
    shows (KINDS: layout, place in the list, repetition in the corpus, words) depends on its state. Both are learned
    from unlabelled lists by Baum-Welch, starting from PRIOR, which also counts as lines seen.
    """

    emit: dict[tuple, tuple[float, ...]] = field(default_factory=dict)  # logarithms by (state number, kind number)
    move: dict[tuple[int, bool], tuple[float, ...]] = field(default_factory=dict)  # by (state before or -1, open)
    memory: dict[tuple, list[tuple[str, bool]]] = field(default_factory=dict)
    seen: dict[tuple, tuple[float, ...]] = field(default_factory=dict)
    plain: dict[tuple[int, ...], list[tuple[str, bool]]] = field(default_factory=dict)

    @classmethod
    def prior(cls) -> Labeller:
        m = cls()
        m.emit = {(y, k): tuple(math.log(p) for p in PRIOR[s][k]) for y, s in enumerate(STATES) for k in range(len(KINDS))}
        m.move = {(y, o): tuple(math.log(p) for p in PRIOR_MOVE[o]) for y in range(-1, len(STATES)) for o in (False, True)}
        return m

    @classmethod
    def fit(cls, lists: list[tuple[list[Line], list[int]]], model: Model, rounds: int = 5, weight: float = 0.5) -> Labeller:
        """Baum-Welch over the different readings of the lists, each counted as often as it occurs. The prior weighs as
        much as `weight` lines in every line of a state that is expected, and 50 lines at least."""
        m = cls.prior()
        counts: dict[tuple, int] = {}
        for lines, broken in lists:
            if lines:
                key = m.key(lines, broken, model)
                counts[key] = counts.get(key, 0) + 1
        for _ in range(rounds):
            emit = {k: [0.0] * len(v) for k, v in m.emit.items()}
            move = {k: [0.0] * len(v) for k, v in m.move.items()}
            for key, n in counts.items():
                m._expect(key, n, emit, move)
            new = cls()
            for (y, k), seen in emit.items():
                w = max(50.0, weight * sum(seen))
                new.emit[y, k] = tuple(math.log((c + w * p) / (sum(seen) + w)) for c, p in zip(seen, PRIOR[STATES[y]][k], strict=True))
            for (y, o), seen in move.items():
                new.move[y, o] = tuple(math.log((c + 20 * p) / (sum(seen) + 20)) for c, p in zip(seen, PRIOR_MOVE[o], strict=True))
            m = new
        return m

    @staticmethod
    def key(lines: list[Line], broken: list[int], model: Model) -> tuple:
        """What the labels of a list depend on: of each line its features, whether it ends a statement, and whether it
        goes on with each of the lines before it that may be the last of a statement."""
        out = []
        n = len(lines)
        for t, line in enumerate(lines):
            bridges = []
            for i in range(t - 1, max(-1, t - 1 - REACH), -1):
                bridges.append(bridged(lines[i], line, model))
                if not lines[i].headish:
                    break
            place = "only" if n == 1 else "first" if t == 0 else "last" if t == n - 1 else "inner"
            f = line.features
            trace = f"{f[0]}+" if f[1] or broken[t] else str(f[0])
            out.append(((trace, broken[t] > 1, *f[2:], place), line.ended or line.marked, tuple(bridges)))
        return tuple(out)

    def _at(self, features: tuple, bridge: bool) -> tuple[float, ...]:
        got = self.seen.get((features, bridge))
        if got is None:
            if len(self.seen) > 100_000:
                self.seen.clear()
            at = [kinds.index(v) for kinds, v in zip(KINDS.values(), (*features, bridge), strict=True)]
            got = self.seen[features, bridge] = tuple(sum(self.emit[y, k][v] for k, v in enumerate(at)) for y in range(len(STATES)))
        return got

    def _steps(self, key: tuple, t: int, last: int) -> tuple[tuple[float, ...], bool]:
        """What line t shows by state, and whether the statement that line `last` belongs to is open."""
        features, _, bridges = key[t]
        back = t - 1 - last
        return self._at(features, last >= 0 and back < len(bridges) and bridges[back]), last >= 0 and not key[last][1]

    def _expect(self, key: tuple, n: int, emit: dict, move: dict) -> None:
        """Adds the expected counts of a list that occurs n times (forward and backward pass over states and last lines)."""
        ahead: list[dict[tuple[int, int], float]] = []
        scales = []
        now = {(-1, -1): 1.0}
        for t in range(len(key)):
            new: dict[tuple[int, int], float] = {}
            for (y0, last), p in now.items():
                at, o = self._steps(key, t, last)
                for y, m in enumerate(self.move[y0, o]):
                    s = (y, last if y == 0 else t)
                    new[s] = new.get(s, 0.0) + p * math.exp(m + at[y])
            scale = sum(new.values())
            now = {s: p / scale for s, p in new.items()}
            ahead.append(now)
            scales.append(scale)
        behind = dict.fromkeys(now, 1.0)
        for t in range(len(key) - 1, -1, -1):
            features, _, _ = key[t]
            before = ahead[t - 1] if t else {(-1, -1): 1.0}
            back: dict[tuple[int, int], float] = {}
            for (y0, last), p in before.items():
                at, o = self._steps(key, t, last)
                bridges = key[t][2]
                b = last >= 0 and t - 1 - last < len(bridges) and bridges[t - 1 - last]
                total = 0.0
                for y, m in enumerate(self.move[y0, o]):
                    w = math.exp(m + at[y]) * behind[y, last if y == 0 else t] / scales[t]
                    total += w
                    g = n * p * w
                    move[y0, o][y] += g
                    for k, (kinds, v) in enumerate(zip(KINDS.values(), (*features, b), strict=True)):
                        emit[y, k][kinds.index(v)] += g
                back[y0, last] = total
            behind = back

    def label(self, lines: list[Line], model: Model, broken: list[int] | None = None) -> list[tuple[str, bool]]:
        """(label, damaged) of every line. broken: 1 for the first line of an item with line breaks, 2 for a later one."""
        plain: tuple[int, ...] | None = None
        if (broken is None or not any(broken)) and all(x.closed and not x.headish for x in lines):  # closed lines go on with none
            plain = tuple([x.number for x in lines])
            got = self.plain.get(plain)
            if got is not None:
                return got
        key = self.key(lines, broken or [0] * len(lines), model)
        got = self.memory.get(key)
        if got is None:
            if len(self.memory) > 100_000:
                self.memory.clear()
            got = self.memory[key] = self._decode(key)
        if plain is not None:
            if len(self.plain) > 100_000:
                self.plain.clear()
            self.plain[plain] = got
        return got

    def _decode(self, key: tuple) -> list[tuple[str, bool]]:
        best: dict[tuple[int, int], tuple[float, tuple]] = {(-1, -1): (0.0, ())}  # the path as links
        for t in range(len(key)):
            new: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (y0, last), (score, path) in best.items():
                at, o = self._steps(key, t, last)
                for y, m in enumerate(self.move[y0, o]):
                    s, to = score + m + at[y], (y, last if y == 0 else t)
                    if to not in new or s > new[to][0]:
                        new[to] = (s, (path, y))
            if len(new) > 4 * REACH:  # a run of headers longer than any page has: the likeliest lines before it
                keep = sorted(new, key=lambda x: -new[x][0])[: 4 * REACH]
                new = {s: new[s] for s in keep}
            best = new
        _, path = max(best.values(), key=lambda x: x[0])
        out = []
        while path:
            path, y = path
            out.append(STATES[y])
        return out[::-1]


@dataclass
class Reader:
    """Reads lists of statements into labelled lines; keeps the lines it has seen, up to a bounded number."""

    model: Model
    labeller: Labeller | None = None
    seen: dict[tuple[str, bool], Line] = field(default_factory=dict)

    def lines(self, statements: list[str | None]) -> tuple[list[int], list[str], list[Line], list[int]]:
        """Item numbers, texts, lines of a list, and where each stands in an item with line breaks (0: in none, 1: first,
        2: later); blank lines and nulls are left out."""
        numbers, texts, out, broken = [], [], [], []
        seen, mask, code = self.seen, DIGITS.sub, CODE.match
        for no, text in enumerate(statements, 1):
            if not text:
                continue
            split = not text.isprintable() and LINES.search(text) is not None
            for part in LINES.split(text) if split else (text,):
                bare = part.strip()
                if not bare:
                    continue
                m = code(bare) if bare[0] in "HPE" else None
                coded = m is not None
                c = mask("0", bare[m.end() :] if coded else bare)
                line = seen.get((c, coded))
                if line is None:
                    if len(seen) > 200_000:
                        seen.clear()
                    line = seen[c, coded] = read_line(c, coded, self.model)
                numbers.append(no)
                texts.append(bare)
                out.append(line)
                broken.append(0 if not split else 2 if len(numbers) > 1 and numbers[-2] == no else 1)
        return numbers, texts, out, broken

    def read(self, statements: list[str | None]) -> tuple[list[int], list[str], list[Line], list[tuple[str, bool]]]:
        numbers, texts, lines, broken = self.lines(statements)
        return numbers, texts, lines, self.labeller.label(lines, self.model, broken) if lines else []


def train(df: DataFrame, key: str, fields: dict[str, Column], sample: int = 2_000, **shares: float) -> tuple[Model, Labeller]:
    """The model of all statements, and the labeller, fitted to the lists of a sample of at most `sample` rows.

    The sample is the rows with the least hashes of their key, so it is the same however the table is partitioned.
    """
    model = learn(items(df, key, fields), **shares)
    reader = Reader(model)
    picked = df.select(F.xxhash64(key).alias("__h"), *[c.alias(f) for f, c in fields.items()])
    share = 1.5 * sample / max(1, df.count())
    if share < 1:  # what can be among the least hashes, but for a chance beyond reckoning
        picked = picked.where(F.col("__h") < F.lit(int(-(1 << 63) + share * (1 << 64))))
    lists = [reader.lines(list(x))[2:] for row in picked.orderBy("__h").limit(sample).drop("__h").collect() for x in row if x]
    return model, Labeller.fit(lists, model)


def rows_of_lists(batch: pa.RecordBatch, first: int) -> Iterator[tuple[int, int, list[str | None]]]:
    """(column, row, strings) of every list column from `first` on and every row whose list isn't null or empty."""
    for c in range(first, batch.num_columns):
        column = batch.column(c)
        strings = column.values.to_pylist()
        offsets = column.offsets.to_pylist()
        valid = column.is_valid().to_pylist() if column.null_count else None
        for r in range(batch.num_rows):
            if offsets[r] < offsets[r + 1] and (valid is None or valid[r]):
                yield c, r, strings[offsets[r] : offsets[r + 1]]
