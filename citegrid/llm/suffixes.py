"""Suffix-array dedup: removal of every byte of a long string that stands anywhere else."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, pieces_of, read_table, written

LENGTH = 200
GRAM = 48
CHUNK = 1 << 20
BATCH_BYTES = 2 << 20
BLOCK_BYTES = 4 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(int(_BASE), -1, 1 << 64)
    up, down = np.full(n, _BASE), np.full(n, np.uint64(inverse))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


# hashes keep their high bits; the low ones hold a place within a chunk
_HIGH = np.uint64(0xFFFFFFFFFFE00000)
_UP, _DOWN = _powers(CHUNK + 2 * LENGTH)


def window_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all strings of k symbols, by sums of powers."""
    n = len(b)
    up, down = (_UP, _DOWN) if n <= len(_UP) else _powers(n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)])
    return mix((sums[k:] - sums[:-k]) * down[: n - k + 1])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x)
    m = -(-n // w) * w
    padded = np.full(m, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = x
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def pieces(data: bytes, length: int = LENGTH, gram: int = GRAM):
    """(anchor, piece hash, start, count, again): stretches of starts of length-byte strings with one anchor.

    The anchor of a string is the smallest hash of its grams, so equal strings have equal anchors
    wherever they stand; a stretch with its bytes start .. start + count + length - 2 is a piece.
    again tells that the anchor stands in it more than once, as in periodic texts.
    """
    b = np.frombuffer(data, np.uint8)
    width = length - gram + 1
    for at in range(0, max(0, len(b) - length + 1), CHUNK):
        part = b[at : at + CHUNK + length - 1]
        h = window_hashes(part, gram) & _HIGH
        place = np.arange(len(h), dtype=np.uint64)
        low = sliding_min(h | place, width)  # the first place of the smallest hash
        right = ~sliding_min(h | (~place & ~_HIGH), width) & ~_HIGH  # and the last
        left, low = low & ~_HIGH, low & _HIGH
        edge = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        end = np.concatenate([edge[1:], [len(low)]])
        again = left[edge] != right[end - 1]
        for a, s, c, g in zip(low[edge].view(np.int64).tolist(), (edge + at).tolist(), (end - edge).tolist(), again.tolist(), strict=True):
            yield a, xxhash.xxh3_64_intdigest(data[s : s + c + length - 1]) - (1 << 63), s, c, g


def two_stage(x: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array of symbols x (uint8), right for the first `depth` symbols of each suffix.

    Suffixes smaller than their successors are sorted directly; scans of the buckets of first
    symbols, in order, then induce all others from their successors.
    """
    n = len(x)
    differ = np.flatnonzero(x[:-1] != x[1:])
    rising = np.zeros(n, dtype=bool)  # the last suffix is larger than its (empty) successor
    if len(differ):
        nxt = np.searchsorted(differ, np.arange(n))
        inner = nxt < len(differ)
        d = differ[nxt[inner]]
        rising[inner] = x[d] < x[d + 1]
    seeds = _sorted_directly(x, np.flatnonzero(rising), depth)
    first = x[seeds]
    cut = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
    waiting[x[n - 1]].append(np.array([n - 1]))
    out = []

    def induce(found: np.ndarray, c: int) -> np.ndarray:
        """Deals the falling predecessors of found to their buckets; returns those of this same bucket."""
        before = found[found > 0] - 1
        before = before[~rising[before]]
        symbol = x[before]
        order = np.argsort(symbol, kind="stable")
        before, symbol = before[order], symbol[order]
        edge = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]])) if len(symbol) else np.empty(0, np.int64)
        same = before[:0]
        for i, s in enumerate(edge):
            group = before[s : edge[i + 1] if i + 1 < len(edge) else len(before)]
            if symbol[s] == c:
                same = group
            else:
                waiting[symbol[s]].append(group)
        return same

    for c in range(256):
        wave = np.concatenate(waiting[c]) if waiting[c] else None
        while wave is not None and len(wave):
            out.append(wave)
            wave = induce(wave, c)
        own = seeds[cut[c] : cut[c + 1]]
        if len(own):
            out.append(own)
            induce(own, c)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def _words8(x: np.ndarray, depth: int) -> np.ndarray:
    """At each place the next eight symbols as one number; zeros follow the end."""
    padded = np.concatenate([x, np.zeros(depth + 8, np.uint8)]).astype(np.uint64)
    w = padded
    for step in (1, 2, 4):
        w = (w[:-step] << np.uint64(8 * step)) | w[step:]
    return w


def _sorted_directly(x: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """starts by the first depth symbols of their suffixes, eight at a time; groups that agree to the end are left."""
    if not len(starts):
        return starts
    w = _words8(x, depth)
    whole = window_hashes(np.concatenate([x, np.zeros(depth, np.uint8)]), depth)
    out = starts[np.argsort(w[starts], kind="stable")]
    key = w[out]
    group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    open_ = np.arange(len(out))
    for at in range(8, depth, 8):
        h = whole[out[open_]]
        g = group[open_]
        edge = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        size = np.diff(np.concatenate([edge, [len(g)]]))
        mixed = (np.minimum.reduceat(h, edge) != np.maximum.reduceat(h, edge)) & (size > 1)
        stay = np.repeat(mixed, size)
        open_ = open_[stay]
        if not len(open_):
            break
        g, place = g[stay], out[open_]
        key = w[place + at]
        order = np.argsort(key, kind="stable")
        order = order[np.argsort(g[order], kind="stable")]
        out[open_] = place[order]
        key, g = key[order], g[order]
        group[open_] = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (g[1:] != g[:-1])]))
    return out


def repeated_starts(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each part the starts of strings of `length` bytes that also start elsewhere in the parts.

    Adjacent suffixes with a common prefix of `length` symbols are compared to the end.
    """
    x = np.zeros(sum(map(len, parts)) + len(parts) + 1, np.uint8)
    bounds = np.zeros(len(parts) + 1, dtype=np.int64)
    at = 1
    for i, p in enumerate(parts):
        x[at : at + len(p)] = np.frombuffer(p, np.uint8) + 1  # UTF-8 has no byte above 0xF4, so 0 parts the parts
        bounds[i] = at
        at += len(p) + 1
    bounds[-1] = at
    valid = np.zeros(len(x), dtype=bool)
    for i, p in enumerate(parts):
        valid[bounds[i] : bounds[i] + max(0, len(p) - length + 1)] = True
    sa = two_stage(x, length)
    sa = sa[valid[sa]]
    w = _words8(x, length)
    left, right = sa[:-1], sa[1:]
    for t in [*range(0, length - 8, 8), length - 8]:
        same = w[left + t] == w[right + t]
        left, right = left[same], right[same]
    marked = np.zeros(len(x), dtype=bool)
    marked[left] = marked[right] = True
    return [np.flatnonzero(marked[bounds[i] : bounds[i] + len(p)]) for i, p in enumerate(parts)]


_OCC = "tid binary, doc_id long, anchor long, piece long, start int, count int, again boolean"


def _occurrences(batches):
    for batch in pieces_of(batches):
        rows = [(tid, doc, *p) for tid, doc, data in zip(*(batch.column(c).to_pylist() for c in ("tid", "doc_id", "data")), strict=True) if len(data) >= LENGTH for p in pieces(data)]
        if rows:
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()), strict=True)], [x.split()[0] for x in _OCC.split(", ")])


_CUT = "anchor long, piece long, many boolean, tid binary, start int, data binary"


def _extract(batches):
    """One row per wanted piece, with its bytes."""
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int32(), pa.binary())
    for batch in pieces_of(batches):
        rows = [(p["anchor"], p["piece"], p["many"], tid, p["start"], data[p["start"] : p["start"] + p["count"] + LENGTH - 1]) for tid, data, wanted in zip(batch.column("tid").to_pylist(), batch.column("data").to_pylist(), batch.column("wanted").to_pylist(), strict=True) for p in wanted]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _CUT.split(", ")])


_RANGES = "tid binary, start int, count int"


def _ranges(at: np.ndarray) -> list[tuple[int, int]]:
    if not len(at):
        return []
    edge = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
    return list(zip(at[edge].tolist(), np.diff(np.concatenate([edge, [len(at)]])).tolist(), strict=True))


def _sorted_groups(batches):
    """Suffix arrays over batches of pieces; rows come sorted by anchor and pair of blocks, each pair of a split anchor alone."""
    held: list[tuple] = []
    size, key, last = 0, None, None

    def close():
        rows = [(tid, start + s, c) for (many, tid, start, _), marks in zip(held, repeated_starts([h[3] for h in held]), strict=True) if not many for s, c in _ranges(marks)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.binary(), pa.int32(), pa.int32()), strict=True)], ["tid", "start", "count"])

    for batch in pieces_of(batches):
        for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "low", "high", "blocks", "piece", "many", "tid", "start", "data")), strict=True):
            new = row[:4]
            if new != key and held and (size >= BATCH_BYTES or new[3] > 1 or key[3] > 1):
                yield from close()
                held, size = [], 0
            if (*new, row[4]) != last:  # rows that repeat a text and its doc_id bring their pieces again
                held.append(row[5:])
                size += len(row[8])
            key, last = new, (*new, row[4])
    if held:
        yield from close()


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def kept_bytes(data: bytes, starts: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """(removed bytes, removed runs, remaining bytes) once all strings that begin in the (start, count) stretches go."""
    out, end, removed, runs = [], 0, 0, 0
    for s, e in sorted((s, s + c + LENGTH - 1) for s, c in starts):
        if s > end or not runs:
            out.append(data[end:s])
            runs += 1
            removed += e - s
            end = e
        elif e > end:
            removed += e - end
            end = e
    return removed, runs, b"".join([*out, data[end:]])


def _removed(batches):
    for batch in pieces_of(batches):
        rows = []
        for doc, data, copies, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "data", "copies", "found")), strict=True):
            starts = [(0, len(data) - LENGTH + 1)] if copies and len(data) >= LENGTH else [(x["start"], x["count"]) for x in found or ()]
            n, runs, rest = kept_bytes(data, starts)
            rows.append((doc, len(data), n, runs, hashlib.sha256(rest).hexdigest()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 4 else pa.int64()) for i, c in enumerate(zip(*rows, strict=True))], [x.split()[0] for x in _RESULT.split(", ")])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row's UTF-8 bytes.

    Every byte in a LENGTH-byte string that also starts anywhere else, same text included, is
    removed; matches stay within texts. Strings meet by their anchors: an anchor with two
    occurrences or more, in one text or several, makes candidates of its pieces. A piece that stands twice as a whole is
    repeated as it is; the distinct pieces of an anchor are put in suffix arrays by two-stage
    sorting, in blocks of bounded size and all pairs of blocks for a common anchor, and the
    adjacent common prefixes tell which strings repeat. Equal texts of LENGTH bytes or more are
    removed whole. Null texts are empty; texts under LENGTH bytes keep all. Repeated rows and
    null ids give a row each; further columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), data.alias("data"))
    docs = docs.withColumn("tid", F.unhex(F.substring(F.sha2("data", 256), 1, 32)))
    occ = written(docs.mapInArrow(_occurrences, _OCC), "pieces").withColumn("at", F.xxhash64("tid", "start"))
    shared = occ.groupBy("anchor").agg(F.min("at").alias("a"), F.max("at").alias("b"), F.max("again").alias("again")).filter("a <> b or again").select("anchor")
    occ = written(occ.join(shared, "anchor").drop("at"), "shared")
    at = F.xxhash64("tid", "start")
    distinct = occ.groupBy("anchor", "piece").agg((F.min(at) != F.max(at)).alias("many"), F.max("again").alias("again"), F.min(F.struct("tid", "start", "count")).alias("o"), F.min(F.struct("tid", "doc_id")).alias("d"))
    distinct = written(distinct.select("anchor", "piece", "many", "again", "o.*", F.col("d.doc_id").alias("doc_id")), "distinct")
    sizes = distinct.groupBy("anchor").agg(F.count("*").alias("n"), F.sum(F.col("count") + LENGTH).alias("bytes"), F.max(F.col("again") & ~F.col("many")).alias("own")).filter("n > 1 or own").select("anchor", F.ceil(F.col("bytes") / BLOCK_BYTES).cast("int").alias("blocks"))
    wanted = distinct.join(sizes.select("anchor"), "anchor").groupBy("tid", "doc_id").agg(F.collect_list(F.struct("anchor", "piece", "many", "start", "count")).alias("wanted"))
    # of the copies of a text the one with the least doc_id gives its pieces: all have the same
    one = docs.select("tid", "doc_id", "data").join(wanted.withColumnsRenamed({"tid": "_tid", "doc_id": "_doc"}), (F.col("tid") == F.col("_tid")) & F.col("doc_id").eqNullSafe(F.col("_doc")))
    cut = one.select("tid", "data", "wanted").mapInArrow(_extract, _CUT).join(sizes, "anchor")
    cut = cut.withColumn("block", F.pmod(F.xxhash64("piece"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    found = cut.repartition(parts, "anchor", "low", "high").sortWithinPartitions("anchor", "low", "high", "piece").mapInArrow(_sorted_groups, _RANGES)
    whole = occ.join(distinct.filter("many").select("anchor", "piece"), ["anchor", "piece"]).select("tid", "start", "count")
    found = written(found.unionByName(whole).groupBy("tid").agg(F.collect_set(F.struct("start", "count")).alias("found")), "found")
    copies = docs.select("tid").groupBy("tid").count().filter("count > 1").select("tid", F.lit(True).alias("copies"))
    facts = found.join(copies, "tid", "full")
    return docs.join(facts, "tid", "left").select("doc_id", "data", F.coalesce("copies", F.lit(False)).alias("copies"), "found").mapInArrow(_removed, _RESULT)


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"))


ORACLE = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, k, substr(h, 2 * k + 1, 8398) AS part FROM (SELECT doc_id, h, unnest(range(0, greatest(1, length(h) // 2), 4000)) AS k FROM h)),
g AS (SELECT doc_id, k + j AS i, hash(substr(part, 2 * j + 1, 400)) AS x FROM (SELECT doc_id, k, part, unnest(range(0, least(4000, length(part) // 2 - 199))) AS j FROM c)),
m AS (SELECT x FROM g GROUP BY x HAVING count(*) > 1),
f AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200, true) AS new FROM g SEMI JOIN m USING (x)),
r AS (SELECT doc_id, min(i) AS s, max(i) + 200 AS e FROM (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM f) GROUP BY doc_id, run),
k AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM r),
t AS (SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) || substr(any_value(h), 2 * max(e) + 1) AS kept, sum(e - s) AS gone, count(*) AS runs FROM k JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(runs, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM h LEFT JOIN t USING (doc_id)
"""
