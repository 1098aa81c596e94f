"""What a run has done so far, told while it goes."""

from __future__ import annotations

import threading
from collections.abc import Callable
from itertools import count

from pyspark import AccumulatorParam, TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class _Latest(AccumulatorParam):
    """(pass, partition) -> counts. A partition that is done again says the same again, so it counts once."""

    def zero(self, value):
        return {}

    def addInPlace(self, a, b):
        a.update(b)
        return a


class Progress:
    """Documents and citations of the tasks that have ended, findings of the actions that have; give it to an Engine.

    As a context manager it calls tell(counts) whenever the counts have changed, looking every so
    many seconds, and once at the end. counts is a dict: documents (read by the parser), citations
    (rows it gave, refusals and unknown shapes aside), partitions (that it finished). The driver
    keeps one small entry per partition. A partition that is not read to its end (under a limit)
    does not count; nor does one whose task was lost until it is done again, and then once. Each plan
    that Engine makes is a pass of its own, but one that is run twice counts once.
    """

    def __init__(self, spark: SparkSession, tell: Callable[[dict], None] | None = None, every: float = 1.0):
        self.tell, self.every, self.spark = tell, every, spark
        self._done = spark.sparkContext.accumulator({}, _Latest())
        self._passes, self._found = count(), []
        self._told, self._stop, self._thread = None, threading.Event(), None

    @property
    def counts(self) -> dict:
        seen = list(dict(self._done.value).values())
        return {"documents": sum(d for d, _ in seen), "citations": sum(c for _, c in seen), "partitions": len(seen)}

    def findings(self) -> int:
        """Findings of all checks so far. It waits for those that were planned and did not run yet."""
        return sum(o.get["n"] for o in self._found)

    def counted(self, run: Callable, cites: Callable[[object], int]) -> Callable:
        """run, a function of mapInArrow over documents, that reports its rows in and, by cites(batch), the citations out."""
        done, number = self._done, next(self._passes)

        def told(batches):
            documents = citations = 0

            def seen():
                nonlocal documents
                for batch in batches:
                    documents += batch.num_rows
                    yield batch

            for out in run(seen()):
                citations += cites(out)
                yield out
            done.add({(number, TaskContext.get().partitionId()): (documents, citations)})

        return told

    def observed(self, findings: DataFrame) -> DataFrame:
        seen = Observation()
        self._found.append(seen)
        return findings.observe(seen, F.count(F.lit(1)).alias("n"))

    def report(self) -> None:
        """Tells the counts if they have changed."""
        now = self.counts
        if self.tell and now != self._told:
            self._told = now
            self.tell(now)

    def _watch(self) -> None:
        while not self._stop.wait(self.every):
            self.report()

    def __enter__(self) -> Progress:
        self._stop.clear()
        self._thread = threading.Thread(target=self._watch, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, *error) -> None:
        self._stop.set()
        self._thread.join()
        self.report()
