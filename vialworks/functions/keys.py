"""Text keys under which catalogue values are compared. They differ on purpose; each operator names the one it uses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = r"\s\x{3000}\x{a0}"


def _without(c: Column, marks: str) -> Column:
    return F.regexp_replace(F.lower(c), f"[{_BLANK}{marks}]", "")


def search_key(c: Column) -> Column:
    """For searching: without blanks, brackets, dashes and slashes, and without `.pdf` anywhere."""
    return _without(F.regexp_replace(F.lower(c), r"\.pdf", ""), r"()\[\]{}<>（）［］｛｝_\-/\\")


def page_key(c: Column) -> Column:
    """For the lists of substances and registers: as `search_key`, but `.pdf` and full-width brackets stay."""
    return _without(c, r"()\[\]{}_\-/\\")


def match_key(c: Column) -> Column:
    """For matching documents: without a trailing `.pdf`, blanks, brackets, dashes, slashes and . , : ;"""
    return _without(F.regexp_replace(F.lower(c), r"\.pdf$", ""), r"()\[\]{}<>_\-/\\.,:;")


def word_key(c: Column) -> Column:
    """Letters and digits of any script only."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def name_key(c: Column) -> Column:
    return _without(c, r",，/\\_\-()（）")


def path_key(c: Column) -> Column:
    """A path with forward slashes and without leading ones."""
    return F.regexp_replace(F.replace(F.trim(c), F.lit("\\"), F.lit("/")), "^/+", "")


def paragraph_key(c: Column) -> Column:
    return F.regexp_replace(c, f"[{_BLANK},.·ㆍ∙]", "")


def line_key(c: Column) -> Column:
    """A line with single blanks and every number as #, the same for a header on every page."""
    return F.regexp_replace(F.trim(F.regexp_replace(c, f"[{_BLANK}]+", " ")), "[0-9]+", "#")


def item_key(c: Column) -> Column:
    return F.regexp_replace(c, f"[{_BLANK}.,·/]", "")


def base_name(c: Column) -> Column:
    return F.element_at(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), -1)


def identity_key(c: Column) -> Column:
    """`hash:` and the hash for 64 hexadecimal digits, else the search key of the file's name."""
    return F.when(c.rlike("^[a-fA-F0-9]{64}$"), F.concat(F.lit("hash:"), F.lower(c))).otherwise(search_key(base_name(c)))


def pdf_path(c: Column) -> Column:
    """A path under `pdf/` unless it is an address or lies there already."""
    p = path_key(c)
    return F.when(p == "", F.lit("")).when(p.rlike("^(https?:|pdf/)"), p).otherwise(F.concat(F.lit("pdf/"), p))


def first_filled(*cols: Column) -> Column:
    """The first value that isn't null or blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols])
