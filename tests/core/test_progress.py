"""Progress: counts that equal those of the result, told while a run goes and from a stream."""

import time

import pytest
from citegrid.engine import Engine
from citegrid.operators.progress import Progress
from citegrid.streaming.watch import check_stream
from pyspark.sql import functions as F

TEXT = "Ames v. Bell, 12 U.S. 34 (9th Cir. 1999); Roe v. Doe, 12 F.3d 34 (9th Cir. 1850)."


def briefs(spark, n, parts):
    return spark.range(0, n, 1, parts).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "none here").otherwise(TEXT).alias("text"))


@pytest.mark.parametrize("isolated", [False, True])
def test_counts_equal_the_result(spark, isolated):
    progress = Progress(spark)
    engine = Engine(progress=progress, isolated=isolated)
    docs = briefs(spark, 200, 7)
    found = engine.check(docs)
    rows = found.collect()
    want = {"documents": 200, "citations": Engine().citations(docs).count(), "partitions": 7}
    assert progress.counts == want and progress.findings() == len(rows) > 0
    found.count()  # the same plan again
    assert progress.counts["documents"] == 200
    engine.check(docs).collect()  # another one
    assert progress.counts["documents"] == 400 and progress.findings() == 2 * len(rows)
    empty = Progress(spark)
    assert Engine(progress=empty).check(docs.limit(0)).count() == 0 and empty.counts["documents"] == 0 and empty.findings() == 0


def test_told_while_it_goes(spark):
    told = []
    slow = F.pandas_udf(lambda x: time.sleep(0.4) or x, "string")
    with Progress(spark, told.append, every=0.05) as progress:
        docs = briefs(spark, 24, 24).withColumn("text", slow("text"))
        Engine(progress=progress).citations(docs).write.format("noop").mode("overwrite").save()
    assert told[-1] == progress.counts and told[-1]["documents"] == 24 and told[-1]["partitions"] == 24
    assert len(told) > 2 and [t["documents"] for t in told] == sorted(t["documents"] for t in told)


def test_progress_of_a_stream(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    told = []
    engine = Engine(progress=Progress(spark, told.append))
    for k in range(2):
        briefs(spark, 30, 2).write.mode("append").parquet(source)
        check_stream(spark, source, sink, str(tmp_path / "c"), engine).awaitTermination()
    assert [t["documents"] for t in told] == [30, 60]
    assert engine.progress.findings() == spark.read.parquet(sink).count() > 0
