"""Substring dedup on words: seeds from winnowed anchors, extended both ways to maximal repeats."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, pieces_of, read_table, shingle_hashes, written

LENGTH = 35
GRAM = 8
CHUNK = 1 << 18
GROUP = 2048  # contexts of an anchor that one task extends against each other
BATCH = 8192
_SEEN = 100_000


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def seeds(h: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, place, start, count): runs of windows of `length` words with one anchor.

    The anchor of a window is the first of its grams with the smallest hash, so equal windows have
    equal anchors, at the same place within them.
    """
    n = len(h) - length + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none, none
    g = shingle_hashes(h, gram)
    width = length - gram + 1
    place = np.concatenate([at + np.arange(m) + np.lib.stride_tricks.sliding_window_view(g[at : at + m + width - 1], width).argmin(axis=1) for at in range(0, n, CHUNK) for m in [min(CHUNK, n - at)]])
    start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    count = np.diff(np.concatenate([start, [n]]))
    return g[place[start]], place[start], start, count


def extended(group: np.ndarray, words: np.ndarray, low: np.ndarray, high: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """contexts x (length - gram + 1) booleans: at [i, l] that the window with l words before its anchor is in context i and in another one of its group.

    Row i of words has the words around the anchor, which begins at column length - gram; low and
    high bound l. Matches grow from the anchor one word at a time: contexts that still agree after
    l words to the left form a class, so do those that agree in the words to the right; a window
    repeats where two contexts share both classes. Nothing is compared in pairs.
    """
    m, width = words.shape
    before = width - length  # words before the anchor
    _, w = np.unique(words, return_inverse=True)
    w = w.reshape(m, width)
    size = int(w.max(initial=0)) + 1
    left = [np.unique(group, return_inverse=True)[1]]
    for l in range(before):
        left.append(np.unique(left[-1] * size + w[:, before - 1 - l], return_inverse=True)[1])
    right = [np.zeros(m, np.int64)]
    for r in range(length):
        right.append(np.unique(right[-1] * size + w[:, before + r], return_inverse=True)[1])
    out = np.zeros((m, before + 1), bool)
    for l in range(before + 1):
        own = np.flatnonzero((low <= l) & (l <= high))
        _, at, n = np.unique(left[l][own] * m + right[length - l][own], return_inverse=True, return_counts=True)
        out[own, l] = n[at] > 1
    return out


_SEEDS = "tid binary, doc_id long, anchor long, piece long, start int, count int, place int"


def _seeds_of(batches):
    """Seeds of whole texts; copies of a text that this task has met give none."""
    seen: set[bytes] = set()
    for batch in pieces_of(batches):
        out = []
        for tid, doc, data in zip(*(batch.column(c).to_pylist() for c in ("tid", "doc_id", "data")), strict=True):
            if tid in seen or not data:
                continue
            if len(seen) < _SEEN:
                seen.add(tid)
            h = hashes(data.split())
            anchor, place, start, count = seeds(h)
            if len(start):
                raw = h.astype("<u8").tobytes()
                piece = [xxhash.xxh3_64_intdigest(raw[8 * s : 8 * (s + c + LENGTH - 1)]) - (1 << 63) for s, c in zip(start.tolist(), count.tolist(), strict=True)]
                out.append((tid, doc, anchor.view(np.int64), np.array(piece, np.int64), start, count, place))
        if out:
            n = [len(x[2]) for x in out]
            ids = np.repeat(np.arange(len(out)), n)
            cols = [pa.array([x[0] for x in out], pa.binary()).take(pa.array(ids)), pa.array([x[1] for x in out], pa.int64()).take(pa.array(ids))]
            cols += [pa.array(np.concatenate([x[k] for x in out]).astype(np.int64 if k < 4 else np.int32)) for k in range(2, 7)]
            yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in _SEEDS.split(", ")])


_CONTEXTS = "anchor long, piece long, tid binary, place int, low int, high int, words binary, start int, one long, two long"


def _contexts(batches):
    """Of every wanted seed its context (words: hashes of the words around its anchor), or, where its anchor has too many, each of its windows by two hashes."""
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int64())
    before = LENGTH - GRAM
    for batch in pieces_of(batches, 64):
        rows = []
        for tid, data, wanted in zip(*(batch.column(c).to_pylist() for c in ("tid", "data", "wanted")), strict=True):
            h = hashes(data.split())
            around = np.concatenate([np.zeros(before, np.uint64), h, np.zeros(LENGTH, np.uint64)])
            for x in wanted:
                s, c, p = x["start"], x["count"], x["place"]
                if x["split"]:
                    own = h[s : s + c + LENGTH - 1]
                    one, two = shingle_hashes(own, LENGTH).view(np.int64).tolist(), shingle_hashes(mix(own + np.uint64(LENGTH)), LENGTH).view(np.int64).tolist()
                    rows += [(x["anchor"], x["piece"], tid, p, None, None, None, s + k, a, b) for k, (a, b) in enumerate(zip(one, two, strict=True))]
                else:
                    rows.append((x["anchor"], x["piece"], tid, p, p - s - c + 1, p - s, around[p : p + before + LENGTH].astype("<u8").tobytes(), s, None, None))
            if len(rows) >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _CONTEXTS.split(", ")])
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _CONTEXTS.split(", ")])


_RANGES = "tid binary, start int, count int"


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first column, number) of the runs of true columns in each row."""
    wide = np.zeros((flags.shape[0], flags.shape[1] + 2), np.int8)
    wide[:, 1:-1] = flags
    step = np.diff(wide, axis=1)
    row, first = np.nonzero(step == 1)
    _, end = np.nonzero(step == -1)
    return row, first, end - first


def _extensions(batches):
    """Repeated windows among the contexts of each anchor; rows come sorted by anchor and piece."""
    held: list[tuple] = []

    def close():
        group, tid, place, low, high, words = (list(c) for c in zip(*held, strict=True))
        flags = extended(np.array(group), np.frombuffer(b"".join(words), "<u8").reshape(len(held), -1), np.array(low), np.array(high))
        row, first, number = _runs(flags)
        if len(row):
            # a run of l from first on is a run of starts that ends at place - first
            start = np.array(place)[row] - first - number + 1
            return pa.RecordBatch.from_arrays([pa.array(tid, pa.binary()).take(pa.array(row)), pa.array(start.astype(np.int32)), pa.array(number.astype(np.int32))], ["tid", "start", "count"])
        return None

    last = None
    for batch in pieces_of(batches):
        for anchor, piece, *row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "piece", "tid", "place", "low", "high", "words")), strict=True):
            if len(held) >= BATCH and anchor != held[-1][0]:
                if (out := close()) is not None:
                    yield out
                held = []
            if (anchor, piece) != last:  # rows that repeat a text and its doc_id bring their contexts again
                held.append((anchor, *row))
            last = (anchor, piece)
    if held and (out := close()) is not None:
        yield out


_RESULT = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, kept string"


def _without(batches):
    for batch in pieces_of(batches):
        rows = []
        for doc, data, copies, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "data", "copies", "found")), strict=True):
            words = data.split()
            spans: list[list[int]] = []
            for s, e in [(0, len(words))] if copies and len(words) >= LENGTH else sorted((x["start"], x["start"] + x["count"] + LENGTH - 1) for x in found or ()):
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = max(e, spans[-1][1])
                else:
                    spans.append([s, e])
            edges = [0, *(x for span in spans for x in span), len(words)]
            kept = b" ".join(w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b])
            rows.append((doc, len(words), [{"start": s, "end": e} for s, e in spans], kept.decode()))
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_words", "spans", "kept"])


def remove_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_words, spans (removed runs of words, end exclusive), kept (the other words, joined by one space).

    Each word in a run of LENGTH words that also starts anywhere else, same text included, is
    removed; runs never cross texts. Seeds are winnowed anchors with the windows around them: an
    anchor that stands at two places joins the texts it stands in. Contexts of an anchor that are
    equal as a whole repeat as they are; distinct ones are extended from the anchor to both sides
    in one task, up to GROUP of them, and the runs of windows found are the maximal repeats. Where
    more contexts share an anchor their windows meet by two 64-bit hashes instead: at most
    LENGTH - GRAM + 1 rows a context, and no group is gathered. Equal texts of LENGTH words or more
    go whole. Null texts are empty; fewer than LENGTH words stay. Repeated rows and null ids give a
    row each; further columns are ignored; an empty table gives no rows.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), data.alias("data"))
    docs = docs.withColumn("tid", F.unhex(F.substring(F.sha2("data", 256), 1, 32)))
    at = F.xxhash64("tid", "start")
    found = written(docs.mapInArrow(_seeds_of, _SEEDS), "seeds")
    # small sides of joins are written first: Spark can split a hot key only where both sides are plain exchanges
    shared = written(found.groupBy("anchor").agg(F.min(at).alias("a"), F.max(at).alias("b")).filter("a <> b").select("anchor"), "shared")
    met = written(found.join(shared, "anchor"), "met")
    distinct = met.groupBy("anchor", "piece").agg((F.min(at) != F.max(at)).alias("many"), F.min(F.struct("tid", "doc_id", "start", "count", "place")).alias("o"))
    distinct = written(distinct.select("anchor", "piece", "many", "o.*"), "contexts")
    groups = written(distinct.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor", (F.col("n") > GROUP).alias("split")), "groups")
    wanted = distinct.join(groups, "anchor").groupBy("tid", "doc_id").agg(F.collect_list(F.struct("anchor", "piece", "start", "count", "place", "split")).alias("wanted"))
    # of the copies of a text the one with the least doc_id gives its contexts: all have the same
    one = docs.join(wanted.withColumnsRenamed({"tid": "_tid", "doc_id": "_doc"}), (F.col("tid") == F.col("_tid")) & F.col("doc_id").eqNullSafe(F.col("_doc")))
    cut = written(one.select("tid", "data", "wanted").mapInArrow(_contexts, _CONTEXTS), "cut")
    by_task = cut.filter("words is not null").select("anchor", "piece", "tid", "place", "low", "high", "words").repartition(parts, "anchor").sortWithinPartitions("anchor", "piece").mapInArrow(_extensions, _RANGES)
    alone = cut.filter("words is null").select("tid", "start", "one", "two")
    twice = written(alone.groupBy("one", "two").agg(F.min(at).alias("a"), F.max(at).alias("b")).filter("a <> b").select("one", "two"), "twice")
    by_hash = alone.join(twice, ["one", "two"]).select("tid", "start", F.lit(1).alias("count"))
    whole = met.join(distinct.filter("many").select("anchor", "piece"), ["anchor", "piece"]).select("tid", "start", "count")
    ranges = by_task.unionByName(by_hash).unionByName(whole).groupBy("tid").agg(F.collect_set(F.struct("start", "count")).alias("found"))
    copies = docs.select("tid").groupBy("tid").count().filter("count > 1").select("tid", F.lit(True).alias("copies"))
    facts = written(ranges.join(copies, "tid", "full"), "found")
    return docs.join(facts, "tid", "left").select("doc_id", "data", F.coalesce("copies", F.lit(False)).alias("copies"), "found").mapInArrow(_without, _RESULT)


def op13_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_passages(read_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
c AS (SELECT doc_id, k, w[k + 1 : k + 1034] AS part FROM (SELECT doc_id, w, unnest(range(0, greatest(1, len(w)), 1000)) AS k FROM t)),
g AS (SELECT doc_id, k + j AS i, hash(part[j + 1 : j + 35]) AS x FROM (SELECT doc_id, k, part, unnest(range(0, least(1000, len(part) - 34))) AS j FROM c)),
m AS (SELECT x FROM g GROUP BY x HAVING count(*) > 1),
f AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 35, true) AS new FROM g SEMI JOIN m USING (x)),
r AS (SELECT doc_id, min(i) AS s, max(i) + 35 AS e FROM (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM f) GROUP BY doc_id, run),
k AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM r),
p AS (SELECT doc_id, s, w[before + 1 : s] AS part FROM k JOIN t USING (doc_id) UNION ALL SELECT doc_id, len(w), w[coalesce(e, 0) + 1 :] FROM t LEFT JOIN (SELECT doc_id, max(e) AS e FROM r GROUP BY doc_id) USING (doc_id)),
o AS (SELECT doc_id, coalesce(string_agg(array_to_string(part, ' '), ' ' ORDER BY s) FILTER (len(part) > 0), '') AS kept FROM p GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce((SELECT sum(e - s) FROM r WHERE r.doc_id = t.doc_id), 0) AS BIGINT) AS n_removed, sha256(kept) AS kept_sha256 FROM t JOIN o USING (doc_id)
"""
