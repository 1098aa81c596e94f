"""Joins of spans by overlap, for spans of the caller's: in buckets of the text, so that no pair is compared that lies far apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 1024


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether [a_start, a_end) and [b_start, b_end) overlap; an empty span overlaps what it lies inside of. Null where a bound is null."""
    return (a_start < b_end) & (b_start < a_end)


def _buckets(width: int) -> Column:
    """The buckets that a span lies in; none if a bound is null or the end before the start."""
    first, last = F.floor(F.col("start") / width), F.floor(F.greatest(F.col("start"), F.col("end") - 1) / width)
    return F.when(F.col("start") <= F.col("end"), F.sequence(first, last))


def _spans(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).alias("_key"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).filter("_key is not null")


def overlapping(left: DataFrame, right: DataFrame, key: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """All pairs of rows with one key whose spans (start, end) overlap: key, left and right (structs of all columns).

    Both sides stand in every bucket of `width` that their span touches and meet there; a pair is
    kept in its first common bucket, so none comes twice. Spans without a key or a bound, or with
    the end before the start, overlap nothing; rows that repeat make a pair each. A text that
    holds most spans is many buckets, not one key; the pairs are as many as the overlaps.
    """
    sides = [df.select(F.col(key).alias("_key"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).withColumn("bucket", F.explode(_buckets(width))) for df, name in ((left, "left"), (right, "right"))]
    a, b = sides[0].alias("a"), sides[1].alias("b")
    meet = (F.col("a._key") == F.col("b._key")) & (F.col("a.bucket") == F.col("b.bucket"))
    first = F.floor(F.greatest("a.start", "b.start") / width) == F.col("a.bucket")
    return a.join(b, meet & first & overlaps(*[F.col(x) for x in ("a.start", "a.end", "b.start", "b.end")])).select(F.col("a._key").alias(key), "left", "right")


def _met(left: DataFrame, right: DataFrame, key: str, width: int) -> DataFrame:
    """(_key, start, end) of the different spans of left that overlap any of right: in each bucket one sweep, no pairs.

    Going through a bucket by place, a span of left looks at its end how far the spans of right
    that began before it reach; one that reaches beyond its start overlaps it. What lies outside
    the bucket does not matter there, so bounds are clipped to it: a bucket has at most
    width + 1 different starts of right, and (width + 2)^2 different spans of left, however many cross it.
    """
    own, other = (_spans(df, key).distinct().withColumn("bucket", F.explode(_buckets(width))) for df in (left, right))
    low = F.col("bucket") * width
    own = own.withColumns({"from": F.greatest(F.col("start"), low - 1), "to": F.least(F.col("end"), low + width)})
    asks = own.select("_key", "bucket", F.col("to").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("reach"), "from").distinct()
    tells = other.groupBy("_key", "bucket", F.greatest(F.col("start"), low - 1).alias("at")).agg(F.max("end").alias("reach")).select("_key", "bucket", "at", F.lit(1).alias("side"), "reach", F.lit(None).cast("long").alias("from"))
    before = Window.partitionBy("_key", "bucket").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = asks.unionByName(tells).withColumn("reach", F.max("reach").over(before))
    hits = swept.filter((F.col("side") == 0) & (F.col("reach") > F.col("from"))).select("_key", "bucket", "from", F.col("at").alias("to"))
    return own.join(hits, ["_key", "bucket", "from", "to"], "left_semi").select("_key", "start", "end").distinct()


def _by_span(left: DataFrame, right: DataFrame, how: str, key: str, width: int) -> DataFrame:
    met = _met(left, right, key, width).withColumnsRenamed({"start": "_start", "end": "_end"})
    packed = left.select(F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_row"))
    at = lambda c: F.col("_row").getField(c)
    return packed.join(met, (at(key) == F.col("_key")) & (at("start") == F.col("_start")) & (at("end") == F.col("_end")), how).select("_row.*")


def overlapped(left: DataFrame, right: DataFrame, key: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """The rows of left whose span overlaps any of right: all their columns, rows that repeat as often as they stand. See overlapping() for what overlaps nothing."""
    return _by_span(left, right, "left_semi", key, width)


def clear(left: DataFrame, right: DataFrame, key: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """The rows of left whose span overlaps none of right; also those without a key or a bound."""
    return _by_span(left, right, "left_anti", key, width)


def merged(spans: DataFrame, key: str = "doc_id", width: int = 1 << 16) -> DataFrame:
    """key, start, end of the least number of spans that cover the same places; spans that touch are one, empty ones go.

    Of the spans with one start the longest counts, so a stretch of `width` places is at most as
    many rows in one window; a row for each stretch hands on how far the ones before it reach and
    where the run that is open began. So a key with most of the rows is many stretches.
    """
    by = Window.partitionBy("_key", "bucket").orderBy("start")
    own = _spans(spans, key).filter("start < end").groupBy("_key", "start").agg(F.max("end").alias("end")).withColumn("bucket", F.floor(F.col("start") / width))
    earlier = Window.partitionBy("_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    reach = own.groupBy("_key", "bucket").agg(F.max("end").alias("_far")).withColumn("_far", F.max("_far").over(earlier))
    far = F.greatest("_far", F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    own = own.join(reach, ["_key", "bucket"]).withColumn("_head", F.when(F.coalesce(F.col("start") > far, F.lit(True)), F.col("start")))
    open_ = own.groupBy("_key", "bucket").agg(F.max("_head").alias("_open")).withColumn("_open", F.last("_open", ignorenulls=True).over(earlier))
    head = F.last("_head", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = own.withColumn("_run", head).join(open_, ["_key", "bucket"]).withColumn("_run", F.coalesce("_run", "_open"))
    return runs.groupBy("_key", "_run").agg(F.max("end").alias("end")).select(F.col("_key").alias(key), F.col("_run").alias("start"), "end")
