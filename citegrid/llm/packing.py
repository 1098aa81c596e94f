"""Packing: length buckets of least padding, and batches of a token budget inside each."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, written

BUCKETS = 12
TOKENS_PER_BATCH = 8192
GROUP_ROWS = 100_000


def token_count(text: Column) -> Column:
    """Words and marks of a text; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{N}\p{M}]+|[^\p{L}\p{N}\p{M}\s]")), F.lit(0)).cast("long")


def _least_before(value: np.ndarray, slope: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each j > 0 the least value[i] - slope[i] * x[j] over i < j, and that i; place 0 has none.

    x and slope ascend, so the best i never moves back as j grows: the middle j of every stretch
    bounds the search of both halves. Stretches of one depth are searched together.
    """
    m = len(x)
    best, at = np.zeros(m, value.dtype), np.zeros(m, np.int64)
    left, right, low, high = (np.array([v]) for v in (1, m, 0, m - 1))
    while len(left):
        mid = (left + right) // 2
        n = np.minimum(high, mid - 1) - low + 1
        edge = np.cumsum(n) - n
        i = np.arange(int(n.sum())) + np.repeat(low - edge, n)
        cost = value[i] - slope[i] * np.repeat(x[mid], n)
        least = np.minimum.reduceat(cost, edge)
        hit = np.flatnonzero(cost == np.repeat(least, n))
        first = i[hit[np.searchsorted(hit, edge)]]
        best[mid], at[mid] = least, first
        left, right, low, high = (np.concatenate(v) for v in ((left, mid + 1), (mid, right), (low, first), (first, high)))
        some = left < right
        left, right, low, high = left[some], right[some], low[some], high[some]
    return best, at


def best_bounds(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Bounds, ascending, that minimise padding: sum of count * (bound of its bucket - length).

    Exact dynamic program over all distinct lengths, in O(buckets * m * log m) steps. Sums past 64 bits are taken as doubles.
    """
    m = len(lengths)
    if not m:
        return []
    kind = np.int64 if max(lengths) * sum(counts) < 1 << 61 else np.float64
    x, total = np.array(lengths, dtype=kind), np.cumsum(np.array(counts, dtype=kind))
    best, back = x * total, []
    for _ in range(1, min(buckets, m)):
        # the last bucket holds lengths i+1..j and is padded to x[j]; sums of lengths are the same for any choice
        least, at = _least_before(best, total, x)
        new = least + x * total
        worse = new >= best
        worse[0] = True
        back.append(np.where(worse, -1, at))
        best = np.where(worse, best, new)
    bounds, j = [], m - 1
    for at in reversed(back):
        if at[j] >= 0:
            bounds.append(lengths[j])
            j = int(at[j])
    return sorted([*bounds, lengths[j]])


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = TOKENS_PER_BATCH) -> DataFrame:
    """(doc_id, text) -> doc_id, n_tokens, bucket, bucket_tokens, batch, place: one row per row.

    The histogram covers all rows and has every length; it goes to the driver (m different lengths
    take a corpus of m * m / 2 tokens or more, so they are few beside the rows).
    A batch holds as many texts as fit the budget when padded to bucket_tokens, at least one, so
    a text longer than the budget has a batch of its own and stays whole. Rows of a bucket are
    numbered in hashed groups of bounded size, so no task orders a whole bucket. Empty and null
    texts have no tokens and share batches of bucket_tokens 1 or more. Repeated rows and null ids
    get places of their own, and are dealt to groups like any others: the number of a row, fixed
    as the lengths are written, is part of the hash. Further columns are ignored; an empty table gives no rows.
    """
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), token_count(F.col("text").cast("string")).alias("n_tokens"), F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("_h"))
    return _packed(counted, buckets, budget)


def _packed(counted: DataFrame, buckets: int, budget: int) -> DataFrame:
    counted = written(counted, "lengths")
    cells = sorted((r.n_tokens, r.n) for r in counted.groupBy(F.greatest("n_tokens", F.lit(1)).alias("n_tokens")).agg(F.count("*").alias("n")).collect())
    bounds = best_bounds([t for t, _ in cells], [n for _, n in cells], buckets) or [1]
    size = [0] * len(bounds)
    for length, n in cells:
        size[bisect_left(bounds, length)] += n
    bucket = F.lit(len(bounds) - 1)
    for i in range(len(bounds) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= bounds[i], i).otherwise(bucket)
    groups = F.element_at(F.array(*[F.lit(-(-n // GROUP_ROWS) or 1) for n in size]), F.col("bucket") + 1)
    rows = counted.withColumn("bucket", bucket).withColumn("bucket_tokens", F.element_at(F.array(*[F.lit(int(b)).cast("long") for b in bounds]), F.col("bucket") + 1))
    rows = rows.withColumn("_g", F.pmod("_h", groups).cast("int"))
    # rows / GROUP_ROWS groups at most: few enough to number on the way, by a window over their counts alone
    sums = rows.groupBy("bucket", "_g").agg(F.count("*").alias("_n"))
    sums = sums.withColumn("_before", F.sum("_n").over(Window.partitionBy("bucket").orderBy("_g")) - F.col("_n")).drop("_n")
    spread = F.pmod(F.shiftright("_h", 17), F.lit(64)).cast("int")  # groups split anew, so that tasks stay even
    rows = rows.withColumn("_s", spread)
    small = rows.groupBy("bucket", "_g", "_s").agg(F.count("*").alias("_n"))
    small = small.withColumn("_within", F.sum("_n").over(Window.partitionBy("bucket", "_g").orderBy("_s")) - F.col("_n")).drop("_n")
    offsets = small.join(sums, ["bucket", "_g"])
    at = F.row_number().over(Window.partitionBy("bucket", "_g", "_s").orderBy("_h", "n_tokens")) - 1
    rows = rows.withColumn("_at", at).join(offsets, ["bucket", "_g", "_s"]).withColumn("_at", F.col("_at") + F.col("_within") + F.col("_before"))
    room = F.greatest(F.lit(1).cast("long"), F.expr(f"{int(budget)} div bucket_tokens"))
    return rows.select("doc_id", "n_tokens", "bucket", "bucket_tokens", F.floor(F.col("_at") / room).alias("batch"), (F.col("_at") % room).alias("place"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
