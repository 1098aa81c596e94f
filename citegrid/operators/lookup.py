"""Lookups against a client of the caller's: each key asked once, within a rate, answers kept for later runs."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..stored import stored
from .annotate import MAX_LOOKUPS

CLUSTER = "struct<case_name:string,year:int,court_id:string,url:string>"
ANSWER = f"key string, status int, clusters array<{CLUSTER}>, asked_at double"
FINAL = [200, 300, 404]  # statuses that tell something about the key; any other is a failure
PATIENCE = 5
MARGIN = 0.001

#: key -> (status, clusters: dicts of case_name, year, court_id, url). It is sent to the tasks, and may raise.
Client = Callable[[str], tuple[int, list[dict]]]

_KIND = pa.list_(pa.struct([("case_name", pa.string()), ("year", pa.int32()), ("court_id", pa.string()), ("url", pa.string())]))


def wanted_keys(cites: DataFrame, most: int = MAX_LOOKUPS) -> DataFrame:
    """(key): the keys that documents ask for, each once: of a document the first `most` different ones in order of use."""
    keys = cites.filter("kind = 'case-reporter' AND resource_key IS NOT NULL").groupBy("doc_id", "resource_key").agg(F.min("idx").alias("first"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("first"))
    return keys.withColumn("nth", nth).filter(F.col("nth") <= most).select(F.col("resource_key").alias("key")).distinct()


def _asking(client: Client, gap: float, patience: int):
    def run(batches):
        failures, due = 0, time.monotonic() + gap  # also before the first: a task may follow another one in its place
        for batch in batches:
            for key in batch.column(0).to_pylist():
                if failures >= patience:  # the other side is down or has had enough
                    status, clusters, at = None, [], None
                else:
                    time.sleep(max(0.0, due - time.monotonic()))
                    due, at = time.monotonic() + gap, time.time()
                    try:
                        status, clusters = client(key)
                    except Exception:  # noqa: BLE001 - one request that fails must not end the others
                        status, clusters = 0, []
                    failures = 0 if status in FINAL else failures + 1
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([status], pa.int32()), pa.array([[{n: c.get(n) for n in ("case_name", "year", "court_id", "url")} for c in clusters]], _KIND), pa.array([at], pa.float64())], ["key", "status", "clusters", "asked_at"])

    return run


def kept_answers(spark: SparkSession, store: str) -> DataFrame:
    """The answers in a store, the last of each key; none if there is no store yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], ANSWER)
    rows = spark.read.schema(f"{ANSWER}, run string").option("basePath", store).parquet(store)
    return rows.groupBy("key").agg(F.max_by(F.struct("status", "clusters", "asked_at"), "asked_at").alias("a")).select("key", "a.*")


def answers(keys: DataFrame, client: Client, store: str, most: int = 60, seconds: float = 60.0, lanes: int = 4, run: str | None = None, patience: int = PATIENCE) -> DataFrame:
    """(key) -> key, status, clusters, asked_at: of each different key the kept answer, or that of the client now.

    What the store has is not asked again. The rest is dealt over `lanes` tasks, each of which
    starts a request every seconds * lanes / most (and a millisecond), so that together they start
    no more than `most` in any window of `seconds`. Answers are written as they come, once, and the
    final ones (FINAL) added to the store as the part `run`; a run that is repeated under its name
    replaces its own part alone. Failures (other statuses; 0 if the client raised) are returned,
    not kept; after `patience` of them in a row a lane asks nothing more (status null). A task that
    is lost begins anew and may ask its keys twice: requests must be safe to repeat. Null keys are
    left out; an empty table asks nothing.
    """
    spark = keys.sparkSession
    wanted = keys.select(F.col("key").cast("string").alias("key")).filter("key is not null").distinct()
    kept = stored(kept_answers(spark, store).join(wanted, "key", "left_semi"))
    gap = seconds * lanes / most + MARGIN
    new = wanted.join(kept.select("key"), "key", "left_anti").repartition(lanes, "key")
    fresh = stored(new.mapInArrow(_asking(client, gap, patience), ANSWER))
    final = fresh.filter(F.col("status").isin(FINAL))
    if final.limit(1).count():
        final.write.mode("overwrite").parquet(f"{store.rstrip('/')}/run={run or uuid.uuid4().hex}")
    return kept.unionByName(fresh)


def lookups(cites: DataFrame, client: Client, store: str, most_keys: int = MAX_LOOKUPS, **rate) -> DataFrame:
    """Answers for Engine(lookups=...): to the keys of citations, within the ceiling for each document. rate: most, seconds, lanes, run, patience of answers()."""
    return answers(wanted_keys(cites, most_keys), client, store, **rate).select("key", "status", "clusters")
