"""Scalar functions on catalogue texts, all of built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vialworks.functions.keys import search_key

#: Initial consonants of Hangul syllables, in their order.
INITIALS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
#: Words for pictograms.
PICTOGRAMS = {
    "GHS01": "explosive explosion 폭발성", "GHS02": "flame flammable 인화성", "GHS03": "oxidizer oxidizing 산화성",
    "GHS04": "gas cylinder 고압가스", "GHS05": "corrosion corrosive 부식성", "GHS06": "skull skullcrossbones 급성독성",
    "GHS07": "exclamation irritant harmful 유해자극성 느낌표 감탄부호", "GHS08": "health healthhazard 건강유해성", "GHS09": "environment aquatic 환경유해성",
}
PICTOGRAM_OF = {w: code for code, words in PICTOGRAMS.items() for w in words.split()}
#: The pictogram that a hazard code asks for.
REQUIRED = {
    "GHS01": "H200 H201 H202 H203 H204 H240 H241", "GHS02": "H220 H221 H222 H223 H224 H225 H226 H228 H242 H250 H251 H252 H260 H261",
    "GHS03": "H270 H271 H272", "GHS04": "H280 H281", "GHS05": "H290 H314 H318", "GHS06": "H300 H301 H310 H311 H330 H331",
    "GHS07": "H302 H312 H332 H315 H317 H319 H335 H336", "GHS08": "H304 H334 H340 H341 H350 H351 H360 H361 H370 H371 H372 H373", "GHS09": "H400 H410 H411",
}


def _words(text: str) -> Column:
    return F.array(*[F.lit(w) for w in text.split()])


def valid_cas(c: Column) -> Column:
    """True for a registry number with the right check digit."""
    d = F.regexp_replace(c, "-", "")
    n = F.length(d)
    total = F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0), lambda a, i: a + F.substring(d, n - i, F.lit(1)).cast("int") * i)
    return F.coalesce(F.when(c.rlike("^[0-9]{2,7}-[0-9]{2}-[0-9]$"), total % 10 == F.substring(d, n, F.lit(1)).cast("int")), F.lit(False))


def extract_cas(c: Column) -> Column:
    """All valid registry numbers that stand as whole words, in their order."""
    return F.filter(F.regexp_extract_all(c, F.lit(r"(?<![0-9A-Za-z_-])[0-9]{2,7}-[0-9]{2}-[0-9](?![0-9A-Za-z_-])"), F.lit(0)), valid_cas)


def initials(c: Column) -> Column:
    """Every Hangul syllable as its initial consonant, everything else in lower case."""
    out = F.transform(F.split(F.lower(c), ""), lambda x: F.when(x.between("가", "힣"), F.substring(F.lit(INITIALS), ((F.ascii(x) - 44032) / 588).cast("int") + 1, F.lit(1))).otherwise(x))
    return F.array_join(out, "")


def bigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of two-character sequences; 0 where a text has fewer than two characters."""
    grams = lambda c: F.when(F.length(c) >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))
    x, y = grams(a), grams(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def pictogram(c: Column) -> Column:
    """The pictogram code of a code or a word for it; null for anything else."""
    v = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    named = reduce(lambda acc, kv: acc.when(v.isin(*kv[1].split()), F.lit(kv[0])), PICTOGRAMS.items(), F.when(v.rlike("^ghs0[1-9]$"), F.upper(v)))
    return named


def pictograms(c: Column) -> Column:
    """Pictogram codes of a list, distinct and in order."""
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(c, pictogram))))


def required_pictograms(hazards: Column) -> Column:
    """Pictograms that a list of hazard codes asks for; the skull, the corrosion mark and the respiratory sensitiser take
    the exclamation mark's reasons away."""
    def any_of(text: str) -> Column:
        return F.arrays_overlap(hazards, _words(text))

    mark = F.array_intersect(hazards, _words(REQUIRED["GHS07"]))
    mark = F.when(any_of(REQUIRED["GHS06"]), F.array().cast("array<string>")).otherwise(mark)
    mark = F.when(any_of(REQUIRED["GHS05"]), F.array_except(mark, _words("H315 H319"))).otherwise(mark)
    mark = F.when(F.array_contains(hazards, "H334"), F.array_except(mark, _words("H315 H317 H319"))).otherwise(mark)
    parts = [F.when(F.size(mark) > 0 if g == "GHS07" else any_of(text), F.lit(g)) for g, text in REQUIRED.items()]
    return F.array_compact(F.array(*parts))


def signal_word(c: Column) -> Column:
    """The signal word in Korean: danger, warning, none stated; '' for anything else. Blanks and brackets don't count."""
    v = search_key(c)
    return (
        F.when(v.isin("위험", "danger"), F.lit("위험")).when(v.isin("경고", "warning"), F.lit("경고"))
        .when(v.isin("해당없음", "신호어없음", "notapplicable", "none"), F.lit("해당없음")).otherwise("")
    )


def csv_cell(c: Column) -> Column:
    """A cell as a spreadsheet may safely read it: a leading sign that starts a formula gets an apostrophe, then quotes."""
    v = F.coalesce(c, F.lit(""))
    v = F.when(v.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), v)).otherwise(v)
    return F.when(v.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)
