"""What the operators share: tables written to the shared folder, word shingles, connected components."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAX_WORDS = 100_000
_FUNNEL_EDGES = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Where it is unset, one of our own, on a local master alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="citegrid-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """A new folder for tables or archives, below the one folder of this application (see forget)."""
    return f"{shared_dir(spark)}/citegrid-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def forget(spark: SparkSession) -> None:
    """Deletes all that this application wrote to the shared folder. Results that are still to be read need it: call this after they are stored."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/citegrid-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and outlives any executor."""
    path = f"{own_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [x or "" for x in batch.column(name).to_pylist()]


def pieces_of(batches, rows: int = 512):
    """Arrow batches cut to a bounded number of rows, so that long texts do not pile up in a worker. At the end a worker gives back what it no longer uses."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
    give_back()


def give_back() -> None:
    """Returns freed memory to the system: workers are kept, and idle ones would hold it beside the work of others."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


BITMAP_BITS = 26


def bitmap_of(df: DataFrame, key: str) -> DataFrame:
    """(_page, _bits): a bitmap over the low BITMAP_BITS bits of a long column, in pages of 4 kB; 8 MB at most for any number of rows."""
    spot = F.col(key).bitwiseAND((1 << BITMAP_BITS) - 1) + 1
    return df.select(F.bitmap_bucket_number(spot).alias("_page"), F.bitmap_bit_position(spot).alias("_bit")).groupBy("_page").agg(F.bitmap_construct_agg("_bit").alias("_bits"))


def maybe_in(df: DataFrame, key: str, bitmap: DataFrame) -> DataFrame:
    """The rows of df whose key may be among those of the bitmap (some others pass too); nothing is shuffled."""
    spot = F.col(key).bitwiseAND((1 << BITMAP_BITS) - 1) + 1
    met = df.withColumn("_at", F.bitmap_bit_position(spot).cast("int")).join(F.broadcast(bitmap), F.bitmap_bucket_number(spot) == F.col("_page"))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.expr("_at div 8 + 1").cast("int"), F.lit(1))), 16, 10).cast("int")
    return met.filter(byte.bitwiseAND(F.expr("shiftleft(1, _at % 8)")) != 0).drop("_page", "_bits", "_at")


def bitmap_array(bitmap: DataFrame) -> np.ndarray:
    """A collected bitmap as booleans."""
    out = np.zeros((1 << BITMAP_BITS) // 8, np.uint8)
    got = bitmap.toArrow()
    for page, bits in zip(got.column("_page").to_pylist(), got.column("_bits").to_pylist(), strict=True):
        out[(page - 1) * 4096 : page * 4096] = np.frombuffer(bits, np.uint8)
    return out


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    spot = (keys & np.uint64((1 << BITMAP_BITS) - 1)).astype(np.int64)
    return (bitmap[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < _MAX_WORDS:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_WORDS = WordHashes()


def known_words() -> WordHashes:
    """The hashes that this worker remembers, from one task to the next."""
    return _WORDS


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every run of k words, in order; of the whole sequence where it has fewer words."""
    n = len(h)
    if n == 0:
        return h
    size = min(k, n)
    acc = h[: n - size + 1] + np.uint64(size)
    for j in range(1, size):
        acc = mix(acc) + h[j : n - size + 1 + j]
    return mix(acc)


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of an edge list and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return nodes, nodes[label]
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, again := label[label]):
            label = again


def _contracted(batches):
    """Edges (a, b) of a partition -> a star forest with the same components, in bounded chunks."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def squeeze():
        nodes, root = contract(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        keep = nodes != root
        return nodes[keep], root[keep]

    for batch in batches:
        held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        n += batch.num_rows
        if n > 4_000_000:
            held = [squeeze()]
            n = 2_000_000 + len(held[0][0]) // 2
    if held:
        nodes, root = squeeze()
        for at in range(0, len(nodes), 65_536):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[at : at + 65_536], pa.int64()), pa.array(root[at : at + 65_536], pa.int64())], ["a", "b"])


def components(edges: DataFrame, funnel_edges: int = _FUNNEL_EDGES) -> DataFrame:
    """(a, b) links -> (node, component): the smallest node that each linked node reaches.

    Each partition first contracts its links to a star forest. While more than funnel_edges
    remain, rounds of large and small stars, whose joins AQE splits at hot nodes, bring every
    node to its smallest; a remainder below that count (some 32 MB) is contracted by one task.
    Empty input gives an empty result; self-links and repeats do nothing.
    """
    edges = written(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b").mapInArrow(_contracted, "a long, b long"), "forest")
    while True:
        n = edges.count()
        if n <= funnel_edges:
            return edges.coalesce(1).mapInArrow(_contracted, "a long, b long").select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(_roots(edges)) if n else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = low.groupBy("a").agg(F.min("b").alias("m"))
        small = low.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m")).filter("a <> b").distinct()
        new = written(small, "stars")
        same = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if same == new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first():
            return new.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(new.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        edges = new


def _roots(edges: DataFrame) -> DataFrame:
    """Smallest nodes of the components: no link leads down from them after full contraction."""
    final = edges.coalesce(1).mapInArrow(_contracted, "a long, b long")
    return final.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
