"""Relational operators of a catalogue: inversion, priority joins, grouping, elections, snapshot diffs, checks.

All work on any table with the named columns. Equalities joined by OR are written as one equi-join on (kind, key)
pairs with a priority, never as an OR condition; ties are always broken by something unique.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vialworks.functions import keys, text


def registry_number(c: Column) -> Column:
    """A valid registry number without the label before it; null for anything else."""
    v = F.regexp_replace(F.trim(c), r"(?i)^CAS\s*(No\.?|번호)?\s*[:.]?\s*", "")
    return F.when(text.valid_cas(v), v)


def flag_state(c: Column) -> Column:
    """`marked` for a text that begins with a circle, `unstated` for a blank one, `cleared` for any other."""
    v = F.trim(F.coalesce(c, F.lit("")))
    return F.when(v == "", "unstated").when(v.rlike("^[○Oo●ㅇ]"), "marked").otherwise("cleared")


def clumsy_name(c: Column) -> Column:
    """True for a name that shouldn't stand for a substance: lists of names, names with numbers, very long ones."""
    return c.rlike(r";|KE-[0-9]|[0-9]{2,7}-[0-9]{2}-[0-9]") | (F.length(c) > 40)


def substances(rows: DataFrame, product: str, cas: str, name: str, flags: dict[str, Column]) -> DataFrame:
    """Products by substance: one row per valid registry number with its rows, products, main name, spellings and flags.

    The main name is one that isn't clumsy, then the most frequent, then the smallest. A flag counts as marked, cleared
    (another text) or unstated (blank) per row. Rows are reduced by (number, name) before names are elected, so a
    substance that holds many rows is no large group.
    """
    ok = rows.withColumn("__cas", registry_number(F.col(cas))).where("__cas is not null")
    counts = [F.count_if(flag_state(v) == s).alias(f"{f}_{s}") for f, v in flags.items() for s in ("marked", "cleared", "unstated")]
    total = ok.groupBy("__cas").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(product).alias("n_products"), *counts)
    n = keys.first_filled(F.col(name))
    names = ok.select("__cas", n.alias("__name")).where("__name is not null").groupBy("__cas", "__name").agg(F.count(F.lit(1)).alias("c"))
    order = F.struct(clumsy_name(F.col("__name")).alias("clumsy"), (-F.col("c")).alias("m"), F.col("__name").alias("v"))
    main = names.groupBy("__cas").agg(F.min(order).getField("v").alias("main_name"), F.count(F.lit(1)).alias("n_names"), F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x.v), " / ").alias("spellings"))
    return total.join(main, "__cas", "left").withColumnRenamed("__cas", "cas_no").withColumn("n_names", F.coalesce("n_names", F.lit(0)))


def priority_join(left: DataFrame, left_id: str, left_keys: list[tuple[str, Column]], right: DataFrame, right_id: str, right_keys: list[tuple[str, Column]]) -> DataFrame:
    """(left_id, right_id, matched_by): the first match of every left row: the first kind of key that finds a row, then
    the smallest right_id. Null and empty keys match nothing."""
    def spread(df: DataFrame, i: str, ks: list[tuple[str, Column]]) -> DataFrame:
        parts = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(kind).alias("kind"), k.alias("key")) for p, (kind, k) in enumerate(ks)])
        return df.select(i, F.explode(parts).alias("x")).where("x.key is not null and x.key <> ''").select(i, "x.p", "x.kind", "x.key")

    first = spread(right, right_id, right_keys).groupBy("kind", "key").agg(F.min(right_id).alias(right_id))
    hits = spread(left, left_id, left_keys).join(first, ["kind", "key"])
    return hits.groupBy(left_id).agg(F.min(F.struct("p", right_id, "kind")).alias("m")).select(left_id, f"m.{right_id}", F.col("m.kind").alias("matched_by"))


def key_overlap(left: DataFrame, left_id: str, left_keys: list[Column], right: DataFrame, right_id: str, right_keys: list[Column]) -> DataFrame:
    """(left_id, right_id): pairs that share any key, each once."""
    spread = lambda df, i, ks: df.select(i, F.explode(F.array_distinct(F.array_compact(F.array(*ks)))).alias("key")).where("key <> ''")
    return spread(left, left_id, left_keys).join(spread(right, right_id, right_keys), "key").select(left_id, right_id).distinct()


def prefixed(prefix: str, key: Column) -> Column:
    """A key of a kind; null for a null or blank one, so blanks never meet."""
    return F.concat(F.lit(prefix), F.nullif(F.trim(key), F.lit("")))


def duplicate_groups(df: DataFrame, key: Column, member: str, kind: str) -> DataFrame:
    """(kind, key, members, first_member): groups of two and more rows with an equal key."""
    g = df.select(key.alias("key"), F.col(member).alias("m")).where("key is not null and key <> ''").groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("m").alias("first_member"))
    return g.where("members > 1").select(F.lit(kind).alias("kind"), "key", "members", "first_member")


def elect(df: DataFrame, group: Column, order: list[Column], keep: list[str]) -> DataFrame:
    """The least row of every group under `order`, as one aggregation of an ordered struct; order ends in something unique."""
    row = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct(*keep).alias("row"))
    return df.select(group.alias("__g"), row.alias("__r")).groupBy("__g").agg(F.min("__r").alias("__m")).select("__m.row.*")


def count_by_vocabulary(df: DataFrame, value: str, vocabulary: list[str]) -> DataFrame:
    """(value, n) for every word of a closed vocabulary, 0 where it doesn't occur. One aggregation, no join."""
    counts = df.agg(*[F.count_if(F.col(value) == v).alias(f"c{i}") for i, v in enumerate(vocabulary)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(v).alias("value"), F.col(f"c{i}").alias("n")) for i, v in enumerate(vocabulary)])).alias("x")).select("x.*")


def snapshot_diff(old: DataFrame, new: DataFrame, path: str, digest: str) -> DataFrame:
    """(path, status, candidates): unchanged, changed_same_path, new_file, moved_or_renamed_candidate, deleted_from_source.

    A path that is gone stays deleted even if its content lies elsewhere; a new path with known content is a candidate
    for a move. candidates: the files of the same content on the other side of a gone or new path. Paths are unique.
    """
    o, n = old.select(F.col(path).alias("p"), F.col(digest).alias("od")), new.select(F.col(path).alias("p"), F.col(digest).alias("nd"))
    count = lambda df, c, out: df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias(f"__{out}")).agg(F.count(F.lit(1)).alias(out))
    both = o.join(n, "p", "full_outer").join(count(o, "od", "in_old"), F.col("nd") == F.col("__in_old"), "left").join(count(n, "nd", "in_new"), F.col("od") == F.col("__in_new"), "left")
    gone, fresh = F.col("nd").isNull() & F.col("od").isNotNull(), F.col("od").isNull()
    status = F.when(gone, "deleted_from_source").when(F.col("od") == F.col("nd"), "unchanged").when(~fresh, "changed_same_path").when(F.col("in_old") > 0, "moved_or_renamed_candidate").otherwise("new_file")
    found = F.when(gone, F.coalesce("in_new", F.lit(0))).when(fresh, F.coalesce("in_old", F.lit(0))).otherwise(0)
    return both.select(F.col("p").alias(path), status.alias("status"), found.cast("bigint").alias("candidates"))


def lookalikes(df: DataFrame, key: str, name: str, least: int = 6, share: float = 0.3) -> DataFrame:
    """(key, partners, prefix): how many other rows have a name that begins alike, for at least `least` letters and
    `share` of the shorter name, and the longest such beginning.

    No pairs are made: names are counted by (beginning, length), and every name looks up the counts of its own
    beginnings of the lengths that matter, so the work is linear in the letters of the names.
    """
    need = lambda n: F.greatest(F.lit(least), F.ceil(n * share)).cast("int")
    names = df.select(F.col(key), F.lower(name).alias("n")).where(F.length("n") >= least)
    distinct = names.groupBy("n").agg(F.count(F.lit(1)).alias("copies")).withColumn("len", F.length("n"))
    heads = distinct.select("n", "len", "copies", F.explode(F.sequence(F.lit(least), "len")).alias("t")).select("n", "len", "copies", "t", F.expr("substring(n, 1, t)").alias("head"))
    # a name of length L is counted under every beginning that a longer name could need of it
    counts = heads.where(F.col("t") <= need(F.col("len"))).groupBy("head", "t", F.col("len").alias("other")).agg(F.sum("copies").alias("c"))
    met = heads.where(F.col("t") <= need(F.col("len"))).join(counts, ["head", "t"]).where(F.col("t") == need(F.least("len", "other")))
    per = met.groupBy("n").agg((F.sum("c") - 1).alias("partners"))
    # a beginning counts if it is long enough for the name itself or for the shortest name that has it
    shared = heads.groupBy("head", "t").agg(F.sum("copies").alias("c"), F.min("len").alias("shortest")).where("c > 1")
    longest = heads.join(shared, ["head", "t"]).where(F.col("t") >= share * F.least("len", "shortest")).groupBy("n").agg(F.max("t").alias("prefix"))
    return names.join(per, "n").where("partners > 0").join(longest, "n").select(key, "partners", "prefix")


def guarded_patch(df: DataFrame, key: str, value: str, patches: DataFrame) -> DataFrame:
    """`df` with `value` replaced where a patch (key, before, after) names the present value; null equals null only."""
    p = patches.select(F.col("key").alias("__k"), F.col("before").alias("__b"), F.col("after").alias("__a"))
    j = df.join(p, (df[key] == F.col("__k")) & df[value].eqNullSafe(F.col("__b")), "left")
    return j.select(*[F.when(F.col("__k").isNotNull(), F.col("__a")).otherwise(F.col(c)).alias(c) if c == value else F.col(c) for c in df.columns], F.col("__k").isNotNull().alias("patched"))


def violations(df: DataFrame, subject: str, checks: list[tuple[str, str, Column]]) -> DataFrame:
    """(severity, code, subject): one row for every check that a row fails. checks: (severity, code, failing)."""
    found = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(sev).alias("severity"), F.lit(code).alias("code"))) for sev, code, bad in checks]))
    return df.select(F.col(subject).cast("string").alias("subject"), F.explode(found).alias("v")).select("v.severity", "v.code", "subject")


def library_fingerprint(df: DataFrame, path: str, digest: str) -> DataFrame:
    """(files, fingerprint): a digest over all files, which doesn't depend on their order.

    The digests of the single entries are added up modulo 2^256 in four parts, with a partial step, so no list of all
    files is gathered in one task.
    """
    entry = F.sha2(F.concat_ws("\n", F.col(path), F.col(digest)), 256)
    part = [F.conv(F.substring(entry, 8 * i + 1, 8), 16, 10).cast("decimal(20,0)") for i in range(8)]
    sums = df.agg(F.count(F.lit(1)).alias("files"), *[F.sum(p).cast("decimal(38,0)").alias(f"s{i}") for i, p in enumerate(part)])
    return sums.select("files", F.sha2(F.concat_ws(".", *[F.coalesce(F.col(f"s{i}").cast("string"), F.lit("0")) for i in range(8)]), 256).alias("fingerprint"))


