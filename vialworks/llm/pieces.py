"""Oversized texts cut into pieces under a token limit, at natural boundaries, with an overlap.

Method: the tokens before every chunk of a text (a word with the white space before it) are summed up; the chunk
starts are sorted boundaries of a class (paragraph, line, sentence, clause, word). A binary search finds the last
boundary under the limit, the strongest class first as long as the piece is at least `fill` of the limit; the next
piece starts at the last boundary that repeats at least `overlap` tokens, or at a natural one a little before. A chunk too long to be passed over whole is
cut at token ends that are also character ends: the hard cut, taken only where no word boundary serves.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vialworks.llm.bpe import Encoder, encoder

PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, HARD = range(6)
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n|\r\n\s*\r\n|\f")
UNIT = 16
_CHUNK = re.compile(r"\s*\S+|\s+$")


def _tokenised(e: Encoder, text: str) -> tuple[list[str], list[bytes]]:
    """The chunks of a text and their packed ids."""
    chunks = _CHUNK.findall(text)
    get, chunk = e.chunks.get, e.chunk
    return chunks, [get(c) or chunk(c) for c in chunks]


def _units(e: Encoder, text: str, chunks: list[str], packed: list[bytes], unit: int) -> tuple[list[int], list[int], list[int]]:
    """Character starts, tokens before, and boundary class of every unit of a text, and a last entry for its end. A chunk
    of more than two units is cut at token ends that are also character ends."""
    starts, before, kinds = [0], [0], [PARAGRAPH]
    at = total = 0
    last = ""
    for chunk, ids in zip(chunks, packed, strict=True):
        n = len(ids) // 4
        body = chunk.lstrip()
        space = chunk[: len(chunk) - len(body)]
        if at:
            if space in ("", " "):
                kind = SENTENCE if last and last in ".!?。！？…" else CLAUSE if last and last in ",;:、，；：" else WORD
            elif "\n" in space or "\r" in space or "\f" in space:
                kind = PARAGRAPH if _PARAGRAPH.search(space) else LINE
            else:
                kind = SENTENCE if last and last in ".!?。！？…" else CLAUSE if last and last in ",;:、，；：" else WORD
            starts.append(at)
            before.append(total)
            kinds.append(kind)
        if n > 2 * unit:  # places inside where a hard cut is possible
            data = chunk.encode("utf-8", "surrogatepass")
            byte = done = chars = seen = 0
            for k, size in enumerate(e.sizes_of(ids)[:-1], 1):
                byte += size
                if k - done >= unit and (data[byte] & 0xC0) != 0x80:
                    chars += len(data[seen:byte].decode("utf-8", "surrogatepass"))
                    seen = byte
                    starts.append(at + chars)
                    before.append(total + k)
                    kinds.append(HARD)
                    done = k
        elif not n:
            continue
        at += len(chunk)
        total += n
        last = body[-1:] or last
    starts.append(len(text))
    before.append(total)
    kinds.append(PARAGRAPH)
    return starts, before, kinds


def unit_of(limit: int, overlap: int) -> int:
    """Tokens between two places for a hard cut: few enough that a piece can repeat the overlap whole and still go on."""
    return max(1, min(UNIT, (limit - overlap) // 4))


def cut(e: Encoder, text: str, limit: int, overlap: int, fill: float = 0.5, only_oversized: bool = False) -> list[tuple[int, int, int, int]]:
    """(start, end, tokens, repeated tokens) of the pieces of a text, in order. One piece if the text is within the
    limit, none where `only_oversized`."""
    if not text or (only_oversized and len(text) * 4 <= limit):  # a token holds a byte at least
        return []
    chunks, packed = _tokenised(e, text)
    total = sum(map(len, packed)) // 4
    if total <= limit:
        return [] if only_oversized else [(0, len(text), total, 0)]
    starts, before, kinds = _units(e, text, chunks, packed, unit_of(limit, overlap))
    last = len(starts) - 1
    classes = np.array(kinds, np.int8)
    by_kind = [np.flatnonzero(classes <= kind).tolist() for kind in range(HARD + 1)]
    slack = min(overlap // 2, (limit - overlap) // 4)
    out, s, done = [], 0, 0
    while True:
        top = bisect_right(before, before[s] + limit) - 1
        end = top
        if top < last:
            end = 0
            least = before[s + 1] + overlap  # so that the next piece repeats the overlap and starts behind this one
            for kind in range(HARD + 1):
                b = by_kind[kind][bisect_right(by_kind[kind], top) - 1]
                if b > done and before[b] >= least and (before[b] - before[s] >= fill * limit or kind >= WORD):
                    end = b
                    break
            end = end or max(top, s + 1)
        n = before[end] - before[s]
        if kinds[s] == HARD or kinds[end] == HARD:  # the pair rules may join tokens over a hard cut in another way
            n = e.count(text[starts[s] : starts[end]])
            while n > limit and end > s + 1:
                end -= 1
                n = e.count(text[starts[s] : starts[end]])
        out.append((starts[s], starts[end], n, max(0, before[done] - before[s]) if out else 0))
        if end == last:
            return out
        done = end
        if not overlap:
            s = end
            continue
        back = bisect_right(before, before[end] - overlap) - 1
        near = bisect_left(before, before[end] - overlap - slack)  # a natural start with a little more overlap
        for kind in (PARAGRAPH, LINE, SENTENCE):
            b = by_kind[kind][bisect_right(by_kind[kind], back) - 1]
            if b >= near and b > s:
                back = b
                break
        s = max(s + 1, min(back, end))


def split_texts(df: DataFrame, key: str, text: str, path: str, limit: int, overlap: int = 0, only_oversized: bool = False) -> DataFrame:
    """(key, piece_no, start_char, end_char, n_tokens, repeated_tokens, piece) of every text, pieces numbered from 1.

    Defined results: null and empty texts give no piece; a text within the limit gives one, or none where
    `only_oversized`. Pieces are exact parts of the text: without what they repeat they join to the text again. Every
    piece but the first repeats at least `overlap` tokens of the one before, up to half as many more where a paragraph,
    line or sentence starts there; `repeated_tokens` says how many. A single unit longer than the limit can't occur:
    hard cuts lie at most a few tokens apart. Every text is tokenised once; no shuffle.
    """
    if not 0 <= overlap <= limit - 16 or limit < 4 * UNIT:
        raise ValueError(f"need 0 <= overlap <= limit - 16 and a limit of {4 * UNIT} or more")
    kind = df.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, piece_no int, start_char int, end_char int, n_tokens int, repeated_tokens int, piece string"
    numbers = [pa.int32()] * 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            rows: list[tuple] = []
            which: list[int] = []
            for r, t in enumerate(batch.column(1).to_pylist()):
                if t:
                    for i, (a, b, n, again) in enumerate(cut(e, t, limit, overlap, only_oversized=only_oversized), 1):
                        rows.append((i, a, b, n, again, t[a:b]))
                        which.append(r)
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(which, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, [*numbers, pa.string()], strict=True)]],
                names=[key, "piece_no", "start_char", "end_char", "n_tokens", "repeated_tokens", "piece"],
            )

    return df.select(F.col(key), F.col(text)).mapInArrow(run, schema)
