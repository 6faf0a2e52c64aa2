"""Several values packed in one field, split into one row per value with its place.

Method: dictionary-guided segmentation. Values that stand alone beyond doubt (elements of JSON lists, of numbered
lists and of quoted parts) are counted over the whole table; those that occur in at least `min_rows` places become
known values. A multi-pattern automaton finds the known values in a cell and dynamic programming picks the cover of the
cell with the least unknown text; delimiters inside a covered value, inside quotes, parentheses or a telephone number
are protected. Up to `most` known values are broadcast as one automaton; beyond that every different cell gets an
automaton of those known values only that occur in it, found by a join of its parts with all known values, so a value
is protected however rare it is in a large table.

Defined results: null, empty and blank cells and cells with fewer than two values give no row. An empty place keeps
its number and gives no row. Unclosed quotes and parentheses protect nothing. Very long cells are split like any
other; the work is linear in their length but for the automaton's matches. Equal rows are split independently.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vialworks.session import checkpoint

_PHONE = re.compile(
    r"(?<![\d])(?:\+\d{1,3}[- ]\d{1,3}-\d{3,4}-\d{4}|\(0\d{1,2}\) ?\d{3,4}-\d{4}|0\d{1,2}\) ?\d{3,4} ?- ?\d{4}|0\d{1,2}\.\d{3,4}\.\d{4}|0\d{1,2}-\d{3,4}-\d{4})(?!\d)"
)
_CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"
_DELIMITER = re.compile(r"\r\n|(?<=\s)\+(?=\s)|[,;|/\n\r\t、，·；｜／]")
_BULLET = re.compile(r"^[•‣▪◦*·-]\s+|^[•‣▪]")
_QUOTED = re.compile(r'"((?:[^"]|"")*)"')


def _close(text: str, at: int) -> int:
    """The place after the parenthesis that closes the one at `at`; 0 if none does."""
    depth = 0
    for i in range(at, len(text)):
        if text[i] in "(（[":
            depth += 1
        elif text[i] in ")）]":
            depth -= 1
            if not depth:
                return i + 1
    return 0


def _protected(text: str) -> bytearray:
    """1 for every character that belongs to quotes, parentheses or a telephone number."""
    inside = bytearray(len(text))
    for m in _PHONE.finditer(text):
        inside[m.start() : m.end()] = b"\1" * (m.end() - m.start())
    i, n = 0, len(text)
    while i < n:
        if inside[i]:
            i += 1
        elif text[i] == '"' and (m := _QUOTED.match(text, i)):
            inside[i : m.end()] = b"\1" * (m.end() - i)
            i = m.end()
        elif text[i] in "(（[" and (end := _close(text, i)):
            inside[i:end] = b"\1" * (end - i)
            i = end
        else:
            i += 1
    return inside


def _clean(value: str) -> str:
    value = value.strip().strip("　")
    value = _BULLET.sub("", value).strip()
    if len(value) > 1 and value[0] == value[-1] == '"' and (m := _QUOTED.fullmatch(value)):
        value = m.group(1)
    return value.replace('""', '"').strip() if '""' in value else value.strip()


def _numbered(text: str) -> list[str] | None:
    """The values of a list whose places are numbered 1, 2, 3 ... or bulleted; None if it is no such list."""
    if text[0] == _CIRCLED[0]:
        return [x.rstrip(" ,;\n\t") for x in re.split(f"[{_CIRCLED}]", text)[1:]]
    for opening, closing in (("(", ")"), ("", ")"), ("", ".")):
        if text.startswith(f"{opening}1{closing} "):
            values, at, k = [], len(opening) + 3, 2
            while True:
                m = re.compile(rf"(?<=[\s,;]){re.escape(f'{opening}{k}{closing}')}\s").search(text, at)
                values.append(text[at : m.start() if m else len(text)].strip().rstrip(",;").rstrip())
                if not m:
                    return values if len(values) > 1 else None
                at, k = m.end(), k + 1
    if text[0] in "•‣▪" and len(parts := re.split(r"[•‣▪]", text)[1:]) > 1:
        return [x.strip().rstrip(",;").rstrip() for x in parts]
    if text.startswith("- ") and len(lines := re.split(r"\r\n|\n|\r", text)) > 1 and all(x.startswith("- ") for x in lines if x.strip()):
        return [x[2:] for x in lines]
    return None


def sure_values(text: str | None) -> list[str]:
    """Values of a cell whose extent is beyond doubt: elements of a JSON list, a numbered list, or quoted parts."""
    text = (text or "").strip()
    if not text:
        return []
    if text[0] == "[" and text[-1] == "]":
        try:
            got = json.loads(text)
            return [x.strip() for x in got if isinstance(x, str) and x.strip()]
        except ValueError:
            pass
    if (got := _numbered(text)) is not None:
        return [x for x in map(_clean, got) if x]
    return [x for x in (_clean(m.group(0)) for m in _QUOTED.finditer(text)) if x] if '"' in text else []


class Dictionary:
    """Known values and the automaton that finds them."""

    def __init__(self, values: list[str]):
        import ahocorasick

        self.values = set(values)
        self.automaton = ahocorasick.Automaton()
        for v in self.values:
            self.automaton.add_word(v, len(v))
        if self.values:
            self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [(end + 1 - n, end + 1) for end, n in self.automaton.iter(text)] if self.values else []


def _cover(text: str, inside: bytearray, known: Dictionary) -> list[str]:
    """The parts of `text` under the cover with the least unknown text, then the fewest parts."""
    cuts = [(m.start(), m.end()) for m in _DELIMITER.finditer(text) if not inside[m.start()]]
    if not cuts:
        return [text]
    starts = [0, *(b for _, b in cuts)]
    ends = [*(a for a, _ in cuts), len(text)]
    n = len(starts)
    # a known value spans the atoms i..j if it fills them from the first to the last
    spans: dict[int, list[int]] = {}
    if known.values:
        first = {s + len(text[s:e]) - len(text[s:e].lstrip()): i for i, (s, e) in enumerate(zip(starts, ends, strict=True))}
        last = {s + len(text[s:e].rstrip()): i for i, (s, e) in enumerate(zip(starts, ends, strict=True))}
        for a, b in known.spans(text):
            if a in first and b in last and last[b] > first[a]:
                spans.setdefault(first[a], []).append(last[b])
    if not spans:
        return [text[s:e] for s, e in zip(starts, ends, strict=True)]
    best: list[tuple[int, int, int]] = [(0, 0, 0)] * n + [(0, 0, n)]  # unknown characters, parts, next atom
    for i in range(n - 1, -1, -1):
        atom = text[starts[i] : ends[i]].strip()
        options = [(best[i + 1][0] + (0 if atom in known.values else len(atom)), best[i + 1][1] + 1, i + 1)]
        options += [(best[j + 1][0], best[j + 1][1] + 1, j + 1) for j in spans.get(i, ())]
        best[i] = min(options)
    parts, i = [], 0
    while i < n:
        j = best[i][2]
        parts.append(text[starts[i] : ends[j - 1]])
        i = j
    return parts


def _by_blanks(part: str, known: Dictionary) -> list[str]:
    """A part that holds several contacts or several known values with only blanks between them."""
    phones = [m.span() for m in _PHONE.finditer(part)]
    if len(phones) > 1:
        cuts = [0]
        for (_, a), (b, _) in zip(phones, phones[1:], strict=False):
            while (m := re.compile(r"\s*(?=[(（])").match(part, a)) and (end := _close(part, m.end())) and end <= b:
                a = end
            cuts.append(a)
        pieces = [part[a:b] for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True)]
        return pieces if all(re.match(r"\s", x) for x in pieces[1:]) else [part]
    words = part.split()
    if len(words) > 1 and known.values and part.strip() not in known.values and not phones:
        best: list[list[str] | None] = [[]] + [None] * len(words)
        for j in range(1, len(words) + 1):
            for i in range(j):
                if best[i] is not None and (v := " ".join(words[i:j])) in known.values:
                    best[j] = min(filter(None, (best[j], [*best[i], v])), key=len)
        if best[-1]:
            return best[-1]
    return [part]


def split_cell(text: str | None, known: Dictionary) -> list[tuple[int, str]]:
    """(place from 1, value) of each value of a cell with two or more; else nothing."""
    text = (text or "").strip()
    if not text:
        return []
    places: list[str] | None = None
    if text[0] == "[" and text[-1] == "]":
        try:
            got = json.loads(text)
            if isinstance(got, list) and all(isinstance(x, str) for x in got):
                places = [x.strip() for x in got]
        except ValueError:
            pass
    if places is None:
        got = _numbered(text)
        if got is None:
            got = [y for x in _cover(text, _protected(text), known) for y in (_by_blanks(x, known) if x.strip() else [x])]
        places = [_clean(x) for x in got]
    found = [(i, x) for i, x in enumerate(places, 1) if x]
    return found if len(found) > 1 else []


def count_values(df: DataFrame, fields: list[str], min_rows: int = 3) -> DataFrame:
    """(field_name, item_value, n): the known values of each field, from a count over all rows with a partial step."""

    def sure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts: dict[tuple[str, str], int] = {}
            for f in fields:
                for text in pdf[f]:
                    for v in sure_values(text):
                        counts[f, v] = counts.get((f, v), 0) + 1
            yield pd.DataFrame([(f, v, n) for (f, v), n in counts.items()], columns=["field_name", "item_value", "n"])

    structured = F.lit(False)
    for f in fields:
        structured |= F.coalesce(F.col(f).rlike(r'^\s*(\[|\(?1[).]|[①•‣▪-])|"'), F.lit(False))
    seen = df.select(*fields).where(structured).mapInPandas(sure, "field_name string, item_value string, n long")
    return seen.groupBy("field_name", "item_value").agg(F.sum("n").alias("n")).where(F.col("n") >= min_rows)


def parts_of(text: str, atoms: int, words: int) -> set[str]:
    """The parts of a cell that may be known values: runs of up to `atoms` parts between delimiters, and of up to `words`
    words."""
    inside = _protected(text)
    cuts = [(m.start(), m.end()) for m in _DELIMITER.finditer(text) if not inside[m.start()]]
    starts, ends = [0, *(b for _, b in cuts)], [*(a for a, _ in cuts), len(text)]
    out = {text[starts[i] : ends[j]].strip() for i in range(len(starts)) for j in range(i, min(len(starts), i + atoms))}
    for s, e in zip(starts, ends, strict=True):
        ws = text[s:e].split()
        out.update(" ".join(ws[i:j]) for i in range(len(ws)) for j in range(i + 1, min(len(ws), i + words) + 1))
    return out - {""}


def split_values(df: DataFrame, key: str, fields: list[str], min_rows: int = 3, most: int = 50_000) -> DataFrame:
    """(key, field_name, item_no, item_value) of every value in cells of `fields` that hold two or more.

    At most `most` known values are brought to the driver and broadcast; where there are more, none are.
    """
    known = checkpoint(count_values(df, fields, min_rows))
    kind = df.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, field_name string, item_no int, item_value string"
    if known.limit(most + 1).count() <= most:
        dictionary: dict[str, list[str]] = {f: [] for f in fields}
        for r in known.collect():
            dictionary[r.field_name].append(r.item_value)
        shared = df.sparkSession.sparkContext.broadcast(dictionary)

        def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            one = {f: lru_cache(1 << 12)(lambda text, k=Dictionary(v): split_cell(text, k)) for f, v in shared.value.items()}
            for pdf in batches:
                rows = [(k, f, i, v) for f in fields for k, text in zip(pdf[key], pdf[f], strict=True) if text for i, v in one[f](text)]
                yield pd.DataFrame(rows, columns=[key, "field_name", "item_no", "item_value"])

        return df.select(key, *fields).mapInPandas(split, schema)

    sizes = known.agg(F.max(F.size(F.split("item_value", r"[,;|/\n\r\t、，·；｜／+]"))).alias("a"), F.max(F.size(F.split("item_value", r"\s+"))).alias("w")).first()
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("cell")) for f in fields])).alias("x"), F.col(key).alias("__key")).select("__key", "x.*").where("cell <> ''")

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(f, c, p) for f, c in zip(pdf.field_name, pdf.cell, strict=True) for p in parts_of(c.strip(), sizes.a, sizes.w)]
            yield pd.DataFrame(rows, columns=["field_name", "cell", "item_value"])

    different = cells.select("field_name", "cell").distinct()
    found = different.mapInPandas(spread, "field_name string, cell string, item_value string").join(known, ["field_name", "item_value"]).groupBy("field_name", "cell").agg(F.collect_set("item_value").alias("known"))

    def split_with(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(f, c, i, v) for f, c, ks in zip(pdf.field_name, pdf.cell, pdf.known, strict=True) for i, v in split_cell(c, Dictionary([] if ks is None else list(ks)))]
            yield pd.DataFrame(rows, columns=["field_name", "cell", "item_no", "item_value"])

    values = different.join(found, ["field_name", "cell"], "left").mapInPandas(split_with, "field_name string, cell string, item_no int, item_value string")
    return cells.join(values, ["field_name", "cell"]).select(F.col("__key").alias(key), "field_name", "item_no", "item_value")
