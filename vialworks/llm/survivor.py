"""The best representative of each group of duplicate records, field by field.

Method: currency reasoning. From the rows with a timestamp the precedence of values is learned: how often value u is
followed by value v in the same group, over all groups. Where rows of a group lack timestamps, the learned
precedences and the known times give a partial order of its values, and the topologically latest one, which no
other value of the group follows, is the most current. Rules that come before currency (usable first, trusted first)
and after it (the first row) belong to the same order.

Every step is an aggregation with a partial step (max of an ordered struct), so a group that holds a third of all
rows is reduced in every task before the shuffle; no window or list over a group is built.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vialworks.session import checkpoint

#: Stand-ins for a missing value, compared in lower case without blanks around.
STAND_INS = (
    "-", "--", "—", "?", "??", ".", "x", "xx", "xxx", "n/a", "na", "n.a.", "#n/a", "none", "null", "nil", "nan", "tbd", "tba", "unknown", "empty",
    "#ref!", "#value!", "#name?", "#div/0!", "(빈칸)", "빈칸", "미정", "미상", "없음", "해당 없음", "해당없음", "자료없음", "자료 없음",
    "미등록", "확인중", "확인 중", "file not found", "not found", "see pdf", "n.d.",
)


def stand_in(value: Column) -> Column:
    """True for null, blank and stand-in values."""
    v = F.lower(F.regexp_replace(F.coalesce(value, F.lit("")), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return (v == "") | v.isin(*STAND_INS)


def squeezed(value: Column) -> Column:
    """Letters and digits of a name only, in lower case."""
    return F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"[^\p{L}\p{N}]", "")


def lost_end(name: Column, witness: Column) -> Column:
    """True for a name that ends in an omission mark or an open parenthesis, or that `witness`, a longer writing of the
    same name such as its file name, goes on with a part of the same word, or with further words."""
    n, w = squeezed(name), squeezed(F.regexp_replace(witness, r"(?i)(_\d+)?\.[a-z0-9]{2,4}$", ""))
    n = F.regexp_replace(n, r"^(개정|신규|구|rev|new|old)(?=.)", "")
    marked = name.rlike(r"(\.\.+|…)[\s\p{Z}]*$") | ((F.length(F.regexp_replace(name, r"[^(（]", "")) > F.length(F.regexp_replace(name, r"[^)）]", ""))))
    cut = (F.length(n) > 0) & (F.length(w) > F.length(n)) & F.startswith(w, n)
    return F.coalesce(marked, F.lit(False)) | F.coalesce(cut, F.lit(False))


def finished_pdf(path: Column) -> Column:
    """True for the path of a finished PDF file: a file name before `.pdf`, no temporary or partial file."""
    return path.rlike(r"(?i)^\s*\S.*\.pdf\s*$") & ~path.rlike(r"(?i)(^|[/\\])(~\$|\.~|\.)[^/\\]*$") & ~path.rlike(r"(?i)(^|[/\\])\.pdf\s*$")


@dataclass(frozen=True)
class Field:
    """How a field's survivor is found. value: what is merged; usable: whether it can be taken at all; before: columns
    that come before currency, greatest first (such as trust); at: the time at which the value was current, null where
    it isn't known; after: columns that decide between equals, the last of them unique."""

    value: Column
    usable: Column
    before: tuple[Column, ...]
    at: Column
    after: tuple[Column, ...]


def survivors(df: DataFrame, group: str, row: str, fields: dict[str, Field], learned: dict[str, DataFrame] | None = None) -> DataFrame:
    """(group, field_name, row): for every group with two or more rows, the row each field's value is taken from.

    The usable rows of a group are in a partial order: by `before`, then by their times, a missing time being the
    earliest, then by `after`. Where `learned` holds a precedence for a field (older, newer; closed by `transitive`), a
    value that lacks a time, or meets one that does, is followed by every value of the same rank in `before` that the
    precedence puts behind it; the row of a topologically latest value wins. Should the two orders contradict each other
    so that every value is followed, times alone decide. A field without a usable row gives no row. Groups whose key is
    null are left out.
    """
    learned = learned or {}
    known = df.where(F.col(group).isNotNull())
    plain = {f: x for f, x in fields.items() if f not in learned}
    rank = lambda x: F.struct(*[p.alias(f"b{i}") for i, p in enumerate(x.before)], x.at.isNotNull().alias("timed"), x.at.alias("at"), *[p.alias(f"a{i}") for i, p in enumerate(x.after)], F.col(row).alias("row"))
    best = [F.max(F.when(x.usable, rank(x))).alias(f"b{k}") for k, x in enumerate(plain.values())]
    g = known.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *best).where("n >= 2")
    out = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"b{k}.row").alias("row")) for k, f in enumerate(plain)])
    parts = [g.select(group, F.explode(out).alias("x")).where("x.row is not null").select(group, "x.field_name", F.col("x.row").alias(row))] if plain else []
    for f, order in learned.items():
        x = fields[f]
        values = known.where(x.usable).select(group, x.value.alias("v"), F.struct(*[p.alias(f"b{i}") for i, p in enumerate(x.before)]).alias("tier"), rank(x).alias("r")).groupBy(group, "tier", "v").agg(F.max("r").alias("r"))
        tops = values.groupBy(group).agg(F.max("tier").alias("top"))
        values = values.join(tops, group).where(F.col("tier").eqNullSafe(F.col("top"))).select(group, "v", "r")
        a, b = values.select(group, F.col("v").alias("older"), F.col("r.timed").alias("ta")), values.select(group, F.col("v").alias("newer"), F.col("r.timed").alias("tb"))
        followed = a.join(order.select("older", "newer"), "older").join(b, [group, "newer"]).where("not (ta and tb)").select(group, F.col("older").alias("v"), F.lit(True).alias("followed")).distinct()
        ranked = values.join(followed, [group, "v"], "left").groupBy(group).agg(F.max(F.struct(F.col("followed").isNull().alias("last"), "r")).alias("m"))
        counts = known.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select(group)
        parts.append(ranked.join(counts, group).select(group, F.lit(f).alias("field_name"), F.col("m.r.row").alias(row)))
    return reduce(DataFrame.unionByName, parts)


def sure_order(learned: DataFrame, min_share: float = 0.8, min_count: int = 2) -> DataFrame:
    """(older, newer): the learned pairs that are sure, closed transitively. learned: (older, newer, n)."""
    back = learned.select(F.col("older").alias("newer"), F.col("newer").alias("older"), F.col("n").alias("m"))
    share = F.col("n") >= min_share * (F.col("n") + F.coalesce("m", F.lit(0)))
    return transitive(learned.join(back, ["older", "newer"], "left").where((F.col("n") >= min_count) & share))


def precedence(df: DataFrame, group: str, value: str, at: str, block: int = 1_000) -> DataFrame:
    """(older, newer, n): how many groups show `older` strictly before `newer`, by the last time each value was seen
    before the other's first. All ordered pairs of a group count; groups with more than `block` values are salted."""
    spans = df.where(F.col(group).isNotNull() & F.col(value).isNotNull() & F.col(at).isNotNull()).groupBy(group, value).agg(F.min(at).alias("first"), F.max(at).alias("last"))
    several = spans.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / block).alias("salts"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    s = spans.join(several, group)
    a = s.select(group, F.expr(f"pmod(xxhash64(`{value}`), salts)").alias("salt"), F.col(value).alias("older"), "last")
    b = s.select(group, F.explode(F.expr("sequence(0L, salts - 1)")).alias("salt"), F.col(value).alias("newer"), "first")
    return a.join(b, [group, "salt"]).where("last < first").groupBy("older", "newer").agg(F.count(F.lit(1)).alias("n"))


def transitive(edges: DataFrame) -> DataFrame:
    """(older, newer): every pair that a path of edges joins. Paths double each round, until a round adds none; values
    that precede each other both ways are in no order and left out."""
    known = checkpoint(edges.select("older", "newer").distinct())
    n = known.count()
    while n:
        step = known.select(F.col("older").alias("mid"), F.col("newer").alias("end"))
        longer = known.join(step, F.col("newer") == F.col("mid")).select("older", F.col("end").alias("newer"))
        known = checkpoint(known.unionByName(longer).distinct())
        before, n = n, known.count()
        if n == before:
            break
    back = known.select(F.col("older").alias("newer"), F.col("newer").alias("older"))
    return known.join(back, ["older", "newer"], "left_anti")


def latest_values(df: DataFrame, group: str, value: str, at: str, learned: DataFrame, min_share: float = 0.8, min_count: int = 2) -> DataFrame:
    """(group, value, basis): the most current value of every group.

    The order of a group's values is that of their times, where both have one, and of the learned precedence, closed
    transitively, where it says with at least `min_share` and `min_count` that one follows the other. Of the values
    that no other follows, one with a time is taken first, then the smallest; where the two orders contradict each
    other so that none is left, the latest in time, then the smallest.
    basis: `only` for a group with a single value; `time` for the value with the latest time where precedence doesn't
    say otherwise; `precedence` where it decided; `smallest` where neither did.
    """
    values = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(group, value).agg(F.max(at).alias("at"))
    sure = sure_order(learned, min_share, min_count)
    a = values.select(group, F.col(value).alias("older"), F.col("at").alias("older_at"))
    b = values.select(group, F.col(value).alias("newer"), F.col("at").alias("newer_at"))
    # only learned pairs meet, so no group is paired with itself in full
    beaten = a.join(sure, "older").join(b, [group, "newer"]).where("older_at is null or newer_at is null").select(group, F.col("older").alias(value), F.lit(True).alias("beaten")).distinct()
    last = values.groupBy(group).agg(F.max("at").alias("last"))
    rank = values.join(beaten, [group, value], "left").join(last, group).select(
        group, value, F.coalesce("beaten", F.lit(False)).alias("beaten"), F.col("at").isNull().alias("untimed"), F.coalesce(F.col("at") < F.col("last"), F.lit(False)).alias("early"),
    )
    ranked = rank.groupBy(group).agg(
        F.min(F.struct((F.col("beaten") | F.col("early")).alias("followed"), "untimed", "early", F.col(value).alias("v"))).alias("best"),
        F.min(F.struct("untimed", "early", F.col(value).alias("v"))).alias("by_time"), F.count(F.lit(1)).alias("n"), F.count_if("beaten").alias("n_beaten"),
        F.count_if(~F.col("beaten") & ~F.col("early")).alias("n_last"),
    )
    basis = (
        F.when(F.col("n") == 1, F.lit("only")).when(~F.col("best.untimed") & (F.col("best.v") == F.col("by_time.v")), F.lit("time"))
        .when((F.col("n_beaten") > 0) & (F.col("n_last") > 0) & ~((F.col("n_last") > 1) & F.col("best.untimed")), F.lit("precedence")).otherwise(F.lit("smallest"))
    )
    return ranked.select(group, F.col("best.v").alias(value), basis.alias("basis"))
