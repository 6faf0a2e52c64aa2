"""Items of varying length packed into containers of fixed capacity.

Method: exact-complement hashing. Only the histogram of lengths is brought to the driver (at most `capacity` rows,
however many items there are). On it, combinations of one, two or three lengths that exactly fill the gap beside a
length are looked up by their sum and consumed as often as the counts allow; what is left is placed best-fit,
longest first, whole classes of equal containers at a time. The plan is a list of container patterns with
multiplicities; items find their container by their rank among the items of their length. Ranks are computed in as
many salted runs as a length needs to keep each of bounded size, so a length that holds most of the items is no hot
group, and looked up in the plan by binary search.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vialworks.session import checkpoint

#: Items of one length that are ranked in one sorted run.
RUN = 100_000


def _fill(c: np.ndarray, gap: int, most: int) -> tuple[int, ...] | None:
    """One, two or three lengths up to `most` with the sum `gap`, all available in the counts c; None if there are none."""
    if gap <= 0:
        return None
    if gap <= most and c[gap]:
        return (gap,)
    xs = np.flatnonzero(c[: min(most, gap) + 1])
    if not len(xs):
        return None
    ys = gap - xs
    ok = (xs <= ys) & (ys <= most)
    ok[ok] = np.where(xs[ok] == ys[ok], c[xs[ok]] >= 2, c[ys[ok]] >= 1)
    if ok.any():
        x = int(xs[ok][np.argmax(np.minimum(c[xs[ok]], c[ys[ok]]))])
        return (x, gap - x)
    for x in xs[::-1]:
        rest = gap - int(x)
        ys = xs[xs <= min(int(x), rest)]
        zs = rest - ys
        ok = (zs >= 1) & (ys >= zs)
        if not ok.any():
            continue
        for y, z in zip(ys[ok][::-1].tolist(), zs[ok][::-1].tolist(), strict=True):
            need = {int(x): 0, y: 0, z: 0}
            for v in (int(x), y, z):
                need[v] += 1
            if all(c[v] >= k for v, k in need.items()):
                return (int(x), y, z)
    return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a container, number of such containers): a packing of counts[s] items of each length s."""
    c = np.zeros(capacity + 1, np.int64)
    for s, n in counts.items():
        if s > 0:
            c[s] += n
    out: list[tuple[tuple[int, ...], int]] = []
    if c[capacity]:
        out.append(((capacity,), int(c[capacity])))
        c[capacity] = 0
    for a in range(capacity - 1, 0, -1):
        while c[a]:
            c[a] -= 1
            got = _fill(c, capacity - a, a)
            c[a] += 1
            if got is None:
                break
            whole = (a, *got)
            times = min(int(c[v]) // whole.count(v) for v in set(whole))
            out.append((whole, times))
            for v in whole:
                c[v] -= times
    # best fit of the rest: classes of equal open containers, by their free space
    free: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    gaps: list[int] = []

    def put(gap: int, pattern: tuple[int, ...], times: int) -> None:
        if gap == 0:
            out.append((pattern, times))
            return
        if gap not in free:
            free[gap] = []
            insort(gaps, gap)
        free[gap].append((pattern, times))

    for s in range(capacity, 0, -1):
        n = int(c[s])
        while n:
            k = bisect_left(gaps, s)
            if k == len(gaps):
                each = capacity // s
                if n >= each:
                    put(capacity - each * s, (s,) * each, n // each)
                if n % each:
                    put(capacity - (n % each) * s, (s,) * (n % each), 1)
                break
            gap = gaps[k]
            pattern, times = free[gap].pop()
            if not free[gap]:
                del free[gap]
                gaps.pop(k)
            each = min(gap // s, max(1, n // times))
            used = min(times, n // each)
            if used < times:
                put(gap, pattern, times - used)
            put(gap - each * s, pattern + (s,) * each, used)
            n -= used * each
    return out + [x for xs in free.values() for x in xs]


#: More than there are items of one length.
STRIDE = 1 << 44


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (length * STRIDE + first rank) and first container of every run of items of a length that go into
    consecutive containers. Their number depends on the plan's patterns, not on the items."""
    rows, taken, container = [(0, 1)], {}, 1
    for pattern, times in patterns:
        for s in pattern:
            rows.append((s * STRIDE + taken.get(s, 0), container))
            taken[s] = taken.get(s, 0) + times
        container += times
    rows.sort()
    return np.array([a for a, _ in rows], np.int64), np.array([b for _, b in rows], np.int64)


def pack(items: DataFrame, key: str, size: str, capacity: int, run: int = RUN) -> DataFrame:
    """(key, part_no, part_size, container_no): every item, divided only if it is longer than `capacity`.

    run: items of one length that are ranked together, whatever their number in all.

    Defined results: a longer item becomes parts of the capacity and a rest, numbered from 1. Null and non-positive
    sizes count as 0; such items take no space and are in container 1. Repeated keys are items of their own, placed
    independently. Containers are numbered from 1 without gaps. An empty table gives an empty result.
    """
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long")
    last = F.greatest(F.ceil(n / capacity), F.lit(1)).cast("int")
    parts = checkpoint(
        items.select(F.col(key), n.alias("__n"), F.explode(F.sequence(F.lit(1), last)).alias("part_no"), last.alias("__last"))
        .select(key, "part_no", F.when(F.col("part_no") < F.col("__last"), F.lit(capacity)).otherwise(F.col("__n") - (F.col("__last") - 1) * capacity).cast("int").alias("part_size"))
    )
    spark = items.sparkSession
    counts = {r.part_size: r.n for r in parts.groupBy("part_size").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity + 1 rows
    keys, first = _slots(plan({s: c for s, c in counts.items() if s > 0}, capacity))
    salts = spark.createDataFrame([(s, -(-c // run)) for s, c in counts.items()], "part_size int, __salts bigint")
    salted = parts.join(F.broadcast(salts), "part_size").withColumn("__salt", F.pmod(F.xxhash64(F.col(key), F.col("part_no")), F.col("__salts")))
    cells = salted.groupBy("part_size", "__salt").agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy("part_size").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)  # one row a run
    offsets = cells.select("part_size", "__salt", F.coalesce(F.sum("__c").over(w), F.lit(0)).alias("__off"))
    ranked = salted.withColumn("__rank", F.row_number().over(Window.partitionBy("part_size", "__salt").orderBy(key, "part_no")))

    @F.pandas_udf("bigint")
    def container(sizes: pd.Series, ranks: pd.Series) -> pd.Series:
        at = sizes.to_numpy(np.int64) * STRIDE + ranks.to_numpy(np.int64)
        k = np.searchsorted(keys, at, "right") - 1
        return pd.Series(np.where(sizes.to_numpy() > 0, first[k] + at - keys[k], 1))

    placed = ranked.join(offsets, ["part_size", "__salt"])
    return placed.select(key, "part_no", "part_size", container("part_size", F.col("__off") + F.col("__rank") - 1).alias("container_no"))
