"""Checking of documents as they arrive: each micro-batch is checked like a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..engine import Engine


def check_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, engine: Engine | None = None, once: bool = True):
    """Parquet files (doc_id, text) that land in source -> findings in sink. A batch writes to a folder of its own, so one that is done again leaves one copy. An engine's progress is told after each batch."""
    engine = engine or Engine()

    def each(batch: DataFrame, number: int) -> None:
        engine.check(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")
        if engine.progress is not None:
            engine.progress.report()

    stream = spark.readStream.schema("doc_id long, text string").parquet(source).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()
