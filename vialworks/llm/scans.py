"""Statements read from scanned pages: which items the scan damaged, and the repaired statements.

Method: sequence labelling of the lines of each list by a hidden Markov model (statements.Labeller) as header, body
or break, the latter two whole or damaged, from layout features: page marks, place in the list, repetition of the line
in the corpus, line breaks inside an item, the share of words out of the corpus' lexicon, stray marks, whether the line
starts as statements start, ends in a stop, is short, and whether it continues the words before it. Every case comes
from the labels. Statements are put together from them; damaged words become the nearest word of the lexicon.

Defined results: null and empty items are no case and give no statement. A statement that is merely cut off is no
case. A list of headers only gives no statement. Statements are numbered from 1 within their list.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vialworks.llm.statements import CODE, DIGITS, HEAD, LINES, MORE, PAGE, STOPS, TOKEN, Labeller, Model, Reader, read_line, rows_of_lists, tokens, train

_INNER_PAGE = re.compile(r"\s-\s\d+\s-\s")
_MARKS = re.compile(r"\s*(?:~~|\.\.)\s+|[~|@`¦°■□¬$­​]")
_BREAK = re.compile(r"(?<=\w)[-¬] +(?=\w)")
_WORD = re.compile(r"[^\W_]+")
#: What a line must hold before it is searched for page text inside, and a mark of numbers alone.
_INNER_MARK = re.compile(r"(?i)\bpage\b|\bp\.\s*\d|\bsheet\b|\d\s*/\s*\d|쪽\s*\d|\d\s*(?:쪽|페이지)|-\s+\d+\s+-|\[\d+\]|\|\s*\d")
_MARK_ONLY = re.compile(r"-\s*\d+\s*-|\[\d+\]|\d+\s*/\s*\d+\s*(?:페이지|쪽)?")
_NUMBERS = re.compile(r"\W*\d+\W+\d+\W*")


def damaged(statements: list[str | None], reader: Reader) -> list[int]:
    """The numbers of the items of a list that must be repaired, joined with a neighbour or removed."""
    numbers, _, _, labels = reader.read(statements)
    out = set()
    before = None
    for no, (y, bad) in zip(numbers, labels, strict=True):
        if y == HEAD or bad:
            out.add(no)
        if y == MORE and before is not None:
            out.update((no, before))
        if y != HEAD:
            before = no
    return sorted(out)


def _mend(text: str, model: Model) -> str:
    """A statement with its marks taken out, its spaces put right and its damaged words repaired."""
    m = CODE.match(text)
    head, body = (text[: m.end()].strip() + " ", text[m.end() :]) if m else ("", text)
    if " - " in body or not body.isprintable():
        body = _INNER_PAGE.sub(" ", body)
    if _MARKS.search(body):
        body = _MARKS.sub(lambda m: " " if m.group()[0].isspace() else "", body)
    if "-" in body or "¬" in body:
        body = _BREAK.sub("", body)

    def fix(m: re.Match) -> str:
        w = m.group()
        if w.isdigit() or re.sub(r"\d+", "0", w) in model.lexicon:
            return w
        return model.repair(re.sub(r"\d+", "0", w)) or w

    if not model.kept.issuperset(words := _WORD.findall(body)):  # else every word stays as it is
        if len(model.kept) > 200_000:
            model.kept.clear()
        model.kept.update(w for w in words if fix(_WORD.match(w)) == w)
        body = _WORD.sub(fix, body)
    return head + " ".join(body.split()).replace(" .", ".").strip()


def page_span(text: str, model: Model, labeller: Labeller) -> tuple[int, int] | None:
    """Where in a line the text of a page's head or foot stands: its first and last place, None if there is none.

    The line is parted at every place where its words don't follow each other in the corpus. Of the parts that hold a
    page mark and that the labeller takes for a header, the one counts after which the rest goes on best: as known
    words over the gap, or as a whole statement before or after it; of several the one that leaves the fewest words out
    of the lexicon, then the shortest. At the edge of a line the
    rest may go on in another line, so there it only has to be known words up to the gap.
    """
    m = CODE.match(text)
    at = m.end() if m else 0
    body = text[at:]
    masked = DIGITS.sub("0", body)
    toks, spans = tokens(masked), [x.span() for x in TOKEN.finditer(body)]
    n = len(toks)
    if n != len(spans) or n < 2:
        return None
    fixed = [t if t in model.lexicon else model.repair(t) or t for t in toks]

    def known(*ts: str) -> bool:
        g = " ".join(ts)
        return g in model.inner or g in model.ends

    # a stop parts sentences, so what follows it is no break
    breaks = [0, *(i for i in range(1, n) if toks[i] not in STOPS and (fixed[i - 1] in STOPS or not known(fixed[i - 1], fixed[i]))), n]
    if len(breaks) == 2:
        return None
    strange = [0]
    for t in toks:
        strange.append(strange[-1] + (t not in model.lexicon and t not in STOPS))

    def rest(i: int, j: int) -> int:
        """How well the line goes on without its words i to j; 0 if it doesn't."""
        left, right = fixed[:i], fixed[j:]
        if left and right:
            if left[-1] in STOPS:
                return 2 if right[0] in model.starters else 0
            if toks[i - 1] == "-" and i > 1:
                return 3 if toks[i - 2] + toks[j] in model.lexicon else 0
            if toks[j] in STOPS:
                return 2 if model.complete(left) else 0
            if i == 1 and strange[1] and j in breaks and toks[j] in model.lexicon and any(w.endswith(toks[0]) for w in model.lexicon):
                return 2  # the end of a word that the line before begins
            if j == n - 1 and toks[j] not in model.lexicon and toks[j] in model.prefixes and i in breaks:
                return 2  # the begin of a word that is cut or goes on in the next line
            return 2 * (len(left) > 1 and known(*left[-2:], right[0])) + (len(right) > 1 and known(left[-1], *right[:2])) or int(n - (j - i) <= 3 and known(left[-1], right[0]))
        if not left and right[0] in model.starters and right[0] != "0" and (len(right) == 1 or known(*right[:2])):
            return 1
        if not left and m:  # a statement starts behind a code
            return 0
        if _MARK_ONLY.fullmatch(body[spans[i][0] : spans[j - 1][1]]):
            return 2
        whole = (strange[j] - strange[i] >= 2 and 4 * (strange[j] - strange[i]) >= j - i)
        return int(bool(whole and i in breaks and j in breaks and (left or toks[0] == "0" or toks[0] not in model.lexicon)))

    blank = [i in (0, n) or body[spans[i][0] - 1].isspace() for i in range(n + 1)]
    # where three words follow each other as in the corpus there is no page text
    words = [t in model.lexicon and t[0].isalpha() for t in toks]
    body_at = [i for i in range(n - 2) if sum(words[i : i + 3]) > 1 and known(*fixed[i : i + 3])]
    best = None
    for i in sorted({*breaks[:-1], *(i for i in range(n) if blank[i] and toks[i] in ("0", "[", "|", "-", " - "))}):
        for j in range(i + 1, n + 1):
            if any(i <= k <= j - 3 for k in body_at):
                break
            if (i, j) == (0, n) or not (blank[i] and blank[j]) or not (j in breaks or j < n and known(fixed[i - 1], fixed[j])):
                continue
            part = body[spans[i][0] : spans[j - 1][1]]
            if not PAGE.search(part) and not _NUMBERS.fullmatch(part):
                continue
            foreign = strange[j] - strange[i]
            if not foreign and not (_NUMBERS.fullmatch(part) and 0 < i and j < n):
                continue
            score = rest(i, j)
            if not score:
                continue
            if foreign:
                c = [DIGITS.sub("0", x) for x in (body[: spans[i][0]].strip(), part, body[spans[j - 1][1] :].strip())]
                lines = [read_line(x, k == 0 and m is not None, model) for k, x in enumerate(c) if x]
                if labeller.label(lines, model)[1 if c[0] else 0][0] != HEAD:
                    continue
            found = (score, strange[j] - strange[i], i - j, at + spans[i][0], at + spans[j - 1][1])
            best = max(best, found) if best else found
    return best[3:] if best else None


def without_pages(text: str, reader: Reader) -> str:
    """A line without the page text that stands inside it."""
    low = text.lower()
    if not ("/" in low or "쪽" in low or "페이지" in low or "page" in low or "sheet" in low or "p." in low or "-" in low or "[" in low or "|" in low):
        return text
    if _MARK_ONLY.fullmatch(text):
        return ""
    while _INNER_MARK.search(text):
        span = page_span(text, reader.model, reader.labeller)
        if span is None:
            break
        a, b = text[: span[0]].rstrip(), text[span[1] :].lstrip()
        text = f"{a}{b}" if not a or b[:1] in STOPS else f"{a} {b}".rstrip()
    return text


def reassemble(statements: list[str | None], reader: Reader) -> list[str]:
    """The clean statements of a list: headers removed, in lines of their own or inside a line, broken lines joined,
    words repaired."""
    _, texts, _, labels = reader.read(statements)
    bare = [t if y == HEAD else without_pages(t, reader) for t, (y, _) in zip(texts, labels, strict=True)]
    if bare != texts:
        _, texts, _, labels = reader.read(bare)
    out: list[str] = []
    for text, (y, _) in zip(texts, labels, strict=True):
        if y == HEAD:
            continue
        if y == MORE and out:
            before = out[-1].rstrip()
            a = before.rsplit(None, 1)[-1] if before else ""
            b = text.split(None, 1)[0]
            whole = a.rstrip("-¬­") + b
            plain = re.sub(r"\d+", "0", whole.rstrip(".,;:"))
            if a[-1:] in "-¬­" or (plain in reader.model.lexicon and not (a in reader.model.lexicon and b.rstrip(".,;:") in reader.model.lexicon)):
                out[-1] = before.rstrip("-¬­") + text
            else:
                out[-1] = f"{before} {text}"
        else:
            out.append(text)
    return [x for x in (_mend(t, reader.model) for t in out) if x]


def _run(df: DataFrame, key: str, fields: dict[str, Column], sample: int, schema: T.StructType, each, trained: tuple[Model, Labeller] | None = None) -> DataFrame:
    model, labeller = trained or train(df, key, fields, sample)
    shared = df.sparkSession.sparkContext.broadcast((model, labeller))  # bounded by the model's shares
    names = list(fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*shared.value)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            rows = [(keys[r], names[c - 1], *x) for c, r, xs in rows_of_lists(batch, 1) for x in each(xs, reader)]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t.type) for x, t in zip(zip(*rows, strict=True), arrow, strict=True)] if rows else [pa.array([], t.type) for t in arrow], schema=arrow)

    return df.select(F.col(key).alias("__key"), *[c.alias(f) for f, c in fields.items()]).mapInArrow(run, schema)


def _schema(df: DataFrame, key: str, *more: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("field_name", T.StringType()), *(T.StructField(n, t) for n, t in more)])


def find_damaged(df: DataFrame, key: str, fields: dict[str, Column], sample: int = 2_000, trained: tuple[Model, Labeller] | None = None) -> DataFrame:
    """(key, field_name, item_no): every item that the scan damaged. trained: a model that `train` has made already."""
    return _run(df, key, fields, sample, _schema(df, key, ("item_no", T.IntegerType())), lambda xs, r: [(i,) for i in damaged(xs, r)], trained)


def clean_statements(df: DataFrame, key: str, fields: dict[str, Column], sample: int = 2_000, trained: tuple[Model, Labeller] | None = None) -> DataFrame:
    """(key, field_name, statement_no, statement): the repaired statements of every list."""
    return _run(df, key, fields, sample, _schema(df, key, ("statement_no", T.IntegerType()), ("statement", T.StringType())), lambda xs, r: list(enumerate(reassemble(xs, r), 1)), trained)
