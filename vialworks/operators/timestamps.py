"""Mixed timestamp formats and zones, normalised to UTC microseconds.

Method: every text is read into a local wall-clock time and, where it names one, a zone. A value without a zone
takes the zone of its source. Where a source's zone is unknown it is estimated: of the candidate offset histories
(all that the zone database knows, each once), the one with the fewest violations is taken. A violation is a value
that would lie after its ingestion, or before the value that precedes it in a sequence. The conversion itself
(daylight saving, repeated and skipped local times) runs in the JVM by `to_utc_timestamp`.

Defined results: null, empty, stand-ins, partial dates and dates that do not exist give null (or no row where the
operator drops nulls). A zone that nobody knows, misspelt or ambiguous, or an offset beyond 14 hours counts as none,
so the value takes the zone of its source. Extra columns pass through; the operators only add the columns they are
told to add.
"""

from __future__ import annotations

import datetime as dt
import re
import unicodedata
import zoneinfo
from decimal import Decimal, InvalidOperation
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vialworks.operators.ordered import previous

EPOCH = dt.date(1970, 1, 1).toordinal()
SHEET_DAY_ZERO = dt.date(1899, 12, 30).toordinal()
DAY_US = 86_400_000_000

#: Fixed offsets of zone abbreviations, in minutes.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "KST": 540, "JST": 540, "CET": 60, "CEST": 120, "WET": 0, "WEST": 60,
    "EET": 120, "EEST": 180, "BST": 60, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420,
    "MDT": -360, "PST": -480, "PDT": -420,
}
MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}

_LEAD = re.compile(
    r"^(?:(?:최종\s*)?개정\s*(?:일자|일)?\s*[:：]?|(?:rev(?:ision|\.)?|ver(?:sion|\.)?|제)\s*\d+\s*(?:판|차)?\s*[-:：]?|revised\s*:?)\s*(?=[\d(])",
    re.I,
)
_WEEKDAY = re.compile(r"^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+", re.I)
_DATE = (
    r"(?:(?P<y>\d{4})\s*(?:-|\.|/|년)\s*(?P<m>\d{1,2})\s*(?:-|\.|/|월)\s*(?P<d>\d{1,2})(?!\d)\s*(?:일|\.(?!\d))?"
    r"|(?P<p>\d{1,2})(?P<sep>[-./])(?P<q>\d{1,2})(?P=sep)(?P<r>\d{4}|\d{2})(?!\d)"
    r"|(?P<d2>\d{1,2})[\s/-]+(?:(?P<mn>[A-Za-z]{3,9})\.?|(?P<mk>\d{1,2})월)[\s/,-]+(?P<y2>\d{4}|\d{2})(?!\d)"
    r"|(?P<mn3>[A-Za-z]{3,9})\.?\s+(?P<d3>\d{1,2}),?\s+(?P<y3>\d{4})(?!\d)"
    r"|(?P<y4>\d{4})(?P<m4>\d{2})(?P<d4>\d{2})(?=T))"
)
_TIME = (
    r"(?:[T\s]\s*(?:(?P<ko>오전|오후)\s*)?(?P<h>\d{1,2})(?::|시\s*)?(?P<mi>\d{2}|(?<=시\s)\d{1,2}|(?<=시)\d{1,2})(?:분)?"
    r"(?:(?::|\s*)?(?P<s>\d{1,2})초?(?:[.,](?P<f>\d+))?)?\s*(?P<ap>[AaPp]\.?[Mm]\b\.?)?)?"
)
_HOUR = r"(?:(?:T(?P<h1>\d{1,2})(?![\d:])|[T\s]\s*(?:(?P<ko1>오전|오후)\s*)?(?P<h2>\d{1,2})시|\s+(?P<h3>\d{1,2})\s*(?P<ap3>[AaPp]\.?[Mm]\b\.?)))"
_ZONE = r"\s*(?P<z>Z|(?:UTC|GMT)?[+-]\d{1,2}(?::?\d{2})?|[A-Z]{2,5}|[A-Za-z]+/[A-Za-z0-9_/+-]+)?(?:\[(?P<zid>[A-Za-z0-9_/+-]+)\])?"
_WHOLE = re.compile(_DATE + f"(?:{_HOUR}|{_TIME})" + _ZONE + r"\s*")
_TIME_FIRST = re.compile(r"(?P<t>(?:(?:오전|오후)\s*)?\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?(?:\s*[AaPp]\.?[Mm]\b\.?)?)(?P<z>\s*(?:Z|[+-]\d{2}:?\d{2}|[A-Z]{2,5}))?[,\s]+(?P<d>.*\d.*)")


def _days(y: int, m: int, d: int) -> int | None:
    try:
        return dt.date(y, m, d).toordinal() - EPOCH
    except ValueError:
        return None


def _ordered(a: int, b: int, c: str, order: str) -> int | None:
    """Days of an all-digit date of three places. The source's order decides where the digits leave it open."""
    if len(c) == 4:
        first = ("MDY",) if order == "MDY" else ("DMY",)
        kinds = (*first, "DMY", "MDY")
    else:
        kinds = (order, "YMD", "DMY", "MDY")
    for kind in kinds:
        y, m, d = {"YMD": (a, b, int(c)), "DMY": (int(c), b, a), "MDY": (int(c), a, b)}[kind]
        days = _days(y + 2000 if y < 100 else y, m, d)
        if days is not None:
            return days
    return None


def _digits(text: str, order: str) -> tuple[int, str | None] | None:
    """An all-digit value, perhaps with a fraction."""
    whole, _, part = text.partition(".")
    n = len(whole)
    if part and n != 5:
        return None
    if n == 5:
        if not 20_000 <= int(whole) <= 80_000:
            return None
        try:
            rest = int(Decimal("0." + (part or "0")) * DAY_US)
        except InvalidOperation:
            return None
        return (int(whole) + SHEET_DAY_ZERO - EPOCH) * DAY_US + rest, None
    if n in (8, 12, 14) and whole[:2] in ("19", "20"):
        days = _days(int(whole[:4]), int(whole[4:6]), int(whole[6:8]))
        h, mi, s = (int(whole[8:10] or 0), int(whole[10:12] or 0), int(whole[12:14] or 0))
        if days is not None and h < 24 and mi < 60 and s < 60:
            return days * DAY_US + ((h * 60 + mi) * 60 + s) * 1_000_000, None
        if n != 12:
            return None
    if n == 6:
        days = _ordered(int(whole[:2]), int(whole[2:4]), whole[4:], order)
        return None if days is None else (days * DAY_US, None)
    if n in (9, 10):
        return int(whole) * 1_000_000, "UTC"
    if n in (12, 13):
        return int(whole) * 1_000, "UTC"
    if n == 16:
        return int(whole), "UTC"
    if n == 19:
        return int(whole) // 1_000, "UTC"
    return None


@lru_cache(1)
def _zone_names() -> dict[str, str]:
    return {z.lower(): z for z in zoneinfo.available_timezones()}


def _zone(text: str) -> tuple[int, str | None]:
    """(minutes to take off, zone that remains) of a zone as written; (0, None) for one that nobody knows."""
    if text in ABBREVIATIONS:
        return ABBREVIATIONS[text], "UTC"
    m = re.fullmatch(r"(?:UTC|GMT)?([+-])(\d{1,2}):?(\d{2})?", text)
    if m:
        minutes = int(m[2]) * 60 + int(m[3] or 0)
        return ((minutes if m[1] == "+" else -minutes), "UTC") if minutes <= 14 * 60 and int(m[3] or 0) < 60 else (0, None)
    return 0, _zone_names().get(text.lower()) if "/" in text else None


@lru_cache(1 << 16)
def read_timestamp(text: str | None, order: str | None) -> tuple[int, str | None] | None:
    """(local microseconds since 1970, zone or None) of a text that denotes a full calendar date; else None."""
    if not text:
        return None
    text = unicodedata.normalize("NFKC", text).strip()
    order = order if order in ("DMY", "MDY", "YMD") else "YMD"
    if re.fullmatch(r"\d+(?:\.\d+)?", text) and text.isascii():
        return _digits(text, order)
    text = _LEAD.sub("", text)
    if text.startswith("(") and text.endswith(")"):
        text = text[1:-1].strip()
    first = _TIME_FIRST.fullmatch(text)
    if first:
        text = f"{first['d']} {first['t']}{first['z'] or ''}"
    got = _WHOLE.fullmatch(_WEEKDAY.sub("", text))
    if not got:
        return None
    g = got.groupdict()
    if g["y"]:
        days = _days(int(g["y"]), int(g["m"]), int(g["d"]))
    elif g["p"]:
        days = _ordered(int(g["p"]), int(g["q"]), g["r"], order)
    elif g["y4"]:
        days = _days(int(g["y4"]), int(g["m4"]), int(g["d4"]))
    else:
        y = int(g["y2"] or g["y3"])
        name = g["mn"] or g["mn3"]
        month = MONTHS.get(name[:3].lower(), 0) if name else int(g["mk"])
        days = _days(y + 2000 if y < 100 else y, month, int(g["d2"] or g["d3"]))
    if days is None:
        return None
    h, mi, s = int(g["h"] or g["h1"] or g["h2"] or g["h3"] or 0), int(g["mi"] or 0), int(g["s"] or 0)
    half = g["ko"] or g["ko1"] or (g["ap"] or g["ap3"] or "").replace(".", "").lower()
    if half:
        if not 1 <= h <= 12:
            return None
        h = h % 12 + (12 if half in ("오후", "pm") else 0)
    if h > 23 or mi > 59 or s > 59:
        return None
    us = days * DAY_US + ((h * 60 + mi) * 60 + s) * 1_000_000 + int(((g["f"] or "") + "000000")[:6])
    for written in (g["z"], g["zid"]):
        off, zone = _zone(written) if written else (0, None)
        if zone is not None:
            return us - off * 60_000_000, zone
    return us, None


@F.pandas_udf(T.StructType([T.StructField("local_us", T.LongType()), T.StructField("zone", T.StringType())]))
def _read(texts: pd.Series, orders: pd.Series) -> pd.DataFrame:
    got = [read_timestamp(a, b) or (None, None) for a, b in zip(texts, orders, strict=True)]
    return pd.DataFrame({"local_us": pd.array([a for a, _ in got], "Int64"), "zone": [b for _, b in got]})


def known_zones(spark: SparkSession) -> list[str]:
    """The zone names that both Python and the JVM know, so none can fail a job."""
    mine = zoneinfo.available_timezones()
    try:
        mine &= set(spark._jvm.java.time.ZoneId.getAvailableZoneIds())
    except AttributeError:  # a session without a JVM of its own: names that have been stable for long
        mine = {z for z in mine if "/" in z or z == "UTC"}
    return sorted(mine)


def to_utc_us(local_us: Column, zone: Column) -> Column:
    """UTC microseconds of a local time: the first of a repeated one, a skipped one moved forward by the skip."""
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local_us), zone))


@lru_cache(4)
def offset_histories(preferred: tuple[str, ...] = ("UTC", "Asia/Seoul", "Europe/Berlin", "America/Chicago", "America/New_York", "Europe/London"), years: tuple[int, int] = (1995, 2038)) -> tuple[str, ...]:
    """One zone for each different history of offsets between two years; of several the preferred or first by name."""
    marks = [dt.datetime(y, m, d, 12, tzinfo=dt.UTC) for y in range(*years) for m in range(1, 13) for d in (1, 15)]
    names = [*preferred, *sorted(z for z in zoneinfo.available_timezones() if "/" in z and not z.startswith(("Etc/", "SystemV/", "US/", "Canada/", "Mexico/", "Brazil/", "Chile/")))]
    seen: dict[tuple, str] = {}
    for name in names:
        zone = zoneinfo.ZoneInfo(name)
        seen.setdefault(tuple(m.astimezone(zone).utcoffset() for m in marks), name)
    return tuple(seen.values())


#: No offset is larger, so values that lie further apart violate an order under every candidate or under none.
REACH_US = 16 * 3_600_000_000


def estimate_zones(
    df: DataFrame, source: str, local_us: str, ingested_us: str | None, candidates: list[str] | None = None,
    known_us: str | None = None, sequence: tuple[list[str], list[str]] | None = None,
) -> DataFrame:
    """The candidate with the fewest violations for each source: (source, zone_id, violations, evidence).

    local_us: wall-clock times of values without a zone. Two kinds of violation are counted: a value after its
    ingestion, and, given `sequence` (columns of a group, columns of its order, which end in something unique), a value
    before the one that precedes it. Beside values of its own source a source is compared with neighbours whose instant
    is known (`known_us`), be it from another source or from a zone in the text; other sources' open values say nothing.
    evidence: the values and neighbours near enough to tell candidates apart; without any, every candidate does equally
    and the first one is returned with evidence 0. Ties go to the smaller total lag, then to the earlier candidate.
    Sources are null-safe; rows whose local time is null don't count. Rows are reduced in every task before the shuffle.
    """
    candidates = list(candidates or offset_histories())
    s, local = F.col(source), F.col(local_us)
    used = df.withColumn("__known", F.col(known_us) if known_us else F.lit(None).cast("long")).withColumn("__in", F.col(ingested_us) if ingested_us else F.lit(None).cast("long"))
    checks = used.where(local.isNotNull() & (F.abs(F.col("__in") - local) <= REACH_US)).select(s.alias("s"), local.alias("lo"), F.lit(None).cast("long").alias("hi"), F.col("__in").alias("at"), F.lit(True).alias("after"))
    if sequence:
        group, order = sequence
        at = F.coalesce("__known", local)  # near the instant, and enough to find the pairs worth a look
        p = previous(used.where(at.isNotNull()).select(*group, *order, s.alias("__s"), local.alias("__l"), "__known"), group, order, ["__s", "__l", "__known"])
        same = F.col("__s").eqNullSafe(F.col("prev.__s"))
        near = lambda a, b: F.abs(a - b) <= REACH_US
        p = p.where("prev is not null")
        before = p.where(F.col("prev.__l").isNotNull() & ~same & near(F.col("__known"), F.col("prev.__l"))).select(F.col("prev.__s").alias("s"), F.col("prev.__l").alias("lo"), F.lit(None).cast("long").alias("hi"), F.col("__known").alias("at"), F.lit(True).alias("after"))
        behind = p.where(F.col("__l").isNotNull() & ~same & near(F.col("prev.__known"), F.col("__l"))).select(F.col("__s").alias("s"), F.col("__l").alias("lo"), F.lit(None).cast("long").alias("hi"), F.col("prev.__known").alias("at"), F.lit(False).alias("after"))
        own = p.where(F.col("__l").isNotNull() & F.col("prev.__l").isNotNull() & same & near(F.col("__l"), F.col("prev.__l"))).select(F.col("__s").alias("s"), F.col("prev.__l").alias("lo"), F.col("__l").alias("hi"), F.lit(None).cast("long").alias("at"), F.lit(True).alias("after"))
        checks = checks.unionByName(before).unionByName(behind).unionByName(own)
    k = F.posexplode(F.array(*[F.lit(z) for z in candidates])).alias("k", "zone_id")
    tried = checks.select("*", k).withColumn("a", to_utc_us(F.col("lo"), F.col("zone_id"))).withColumn("b", F.coalesce("at", to_utc_us(F.col("hi"), F.col("zone_id"))))
    lag = F.when(F.col("after"), F.col("b") - F.col("a")).otherwise(F.col("a") - F.col("b"))
    sums = tried.groupBy("s", "k", "zone_id").agg(F.sum((lag < 0).cast("long")).alias("violations"), F.sum(F.greatest(lag, F.lit(0)).cast("double")).alias("lag"), F.count(F.lit(1)).alias("evidence"))
    best = sums.groupBy("s").agg(F.min(F.struct("violations", "lag", "k", "zone_id", "evidence")).alias("m"))
    every = df.groupBy(s.alias("__src")).agg(F.lit(1))
    return every.join(best, F.col("__src").eqNullSafe(F.col("s")), "left").select(
        F.col("__src").alias(source), F.coalesce("m.zone_id", F.lit(candidates[0])).alias("zone_id"), F.coalesce("m.violations", F.lit(0)).alias("violations"), F.coalesce("m.evidence", F.lit(0)).alias("evidence")
    )


def read_local(df: DataFrame, value: str, source: str, zones: DataFrame, out: str = "__read") -> DataFrame:
    """`df` with `out`, a struct of what the text in `value` says (local_us, zone or null), and `__zone`, the zone of its
    source, null where it isn't known. zones: (dataSource, zone_id, date_order), one row a source."""
    known = known_zones(df.sparkSession)
    sure = lambda c: F.when(c.isin(known), c)
    z = zones.select(F.col("dataSource").alias("__src"), sure(F.col("zone_id")).alias("__zone"), F.col("date_order").alias("__order"))
    got = df.join(z, df[source] == F.col("__src"), "left").withColumn(out, _read(F.col(value), F.col("__order")))
    return got.withColumn(out, F.struct(F.col(out).local_us.alias("local_us"), sure(F.col(out).zone).alias("zone"))).drop("__src", "__order")


def normalise_timestamps(
    df: DataFrame, value: str, source: str, zones: DataFrame, ingested: str | None = None, out: str = "utc_us",
    candidates: tuple[str, ...] | None = None, sequence: tuple[list[str], list[str]] | None = None,
) -> DataFrame:
    """`df` with `out`, the UTC microseconds of the text in `value`, or null where it holds no full date.

    zones: (dataSource, zone_id, date_order), one row a source. Sources whose zone_id is null or unknown, and sources
    that zones doesn't list, get the zone that `estimate_zones` finds from the column `ingested` (a timestamp) and from
    `sequence`; without both, UTC.
    """
    kept = df.columns
    listed = zones.where(F.col("zone_id").isin(known_zones(df.sparkSession))).select(F.col("dataSource").alias("__listed"))
    df = read_local(df, value, source, zones)
    if ingested is not None or sequence is not None:
        open_sources = df.select(source).distinct().join(F.broadcast(listed), F.col(source) == F.col("__listed"), "left_anti")
        if not open_sources.limit(1).isEmpty():
            named = F.coalesce(F.col("__read.zone"), F.col("__zone"))
            rows = df.withColumn("__l", F.when(named.isNull(), F.col("__read.local_us"))).withColumn("__k", F.when(named.isNotNull(), to_utc_us(F.col("__read.local_us"), named)))
            if ingested is not None:
                rows = rows.withColumn("__i", F.unix_micros(F.col(ingested).cast("timestamp")))
            found = estimate_zones(rows, source, "__l", "__i" if ingested is not None else None, list(candidates) if candidates else None, "__k", sequence)
            found = found.join(open_sources.select(F.col(source).alias("__open")), F.col(source).eqNullSafe(F.col("__open"))).select(F.col(source).alias("__src2"), F.col("zone_id").alias("__est"))
            df = df.join(found, df[source].eqNullSafe(F.col("__src2")), "left").withColumn("__zone", F.coalesce("__zone", "__est"))
    zone = F.coalesce(F.col("__read.zone"), F.col("__zone"), F.lit("UTC"))
    return df.select(*[F.col(f"`{c}`") for c in kept], to_utc_us(F.col("__read.local_us"), zone).alias(out))
