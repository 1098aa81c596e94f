"""Near copies of documents: fast similarity sketching, banding, exact verification."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, bitmap_of, components, known_words, maybe_in, mix, pieces_of, read_table, shingle_hashes, texts_of, written

COORDINATES = 128
BLOCK_ROWS = 1024
SKETCH_ROWS = 8192
SALTS = 32
BLOCK_SHINGLES = 2_000_000
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def word_set(text: str, k: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text: words between ASCII whitespace, A-Z lower-cased."""
    return np.unique(shingle_hashes(words.of(text.encode("utf-8", "surrogatepass").lower().split()), k))


def fast_sketch(sets: list[np.ndarray], t: int = COORDINATES) -> np.ndarray:
    """Fast similarity sketches, one row of t coordinates per set.

    In round i < t every element of a set goes to a hashed bin with a hashed value; in round
    t + j every element goes to bin j, so all bins are full after 2t rounds at the latest. The
    round is the high byte of a value, so a bin keeps its smallest value of the first round
    that reached it. A set leaves the rounds once its bins are full. Empty sets keep _NONE.
    """
    out = np.full((len(sets), t), _NONE)
    flat = out.reshape(-1)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    owner, items = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets) if sets else np.empty(0, np.uint64)
    for i in range(2 * t):
        if not len(items):
            break
        h = mix(items + _STEP * np.arange(i + 1, i + 2, dtype=np.uint64))
        value = (h >> np.uint64(8)) | np.uint64(i << 56)
        place = (h & np.uint64(t - 1)).astype(np.int64) if i < t else np.int64(i - t)
        np.minimum.at(flat, owner * t + place, value)
        stay = (out == _NONE).any(axis=1)[owner]
        owner, items = owner[stay], items[stay]
    return out


def band_rows(similarity: float, t: int = COORDINATES, miss: float = 1e-6) -> int:
    """The most rows a band may have for a pair at the threshold to share no band with probability miss at most."""
    return max(r for r in range(1, t + 1) if r == 1 or (1 - similarity**r) ** (t // r) <= miss)


def band_keys(sketches: np.ndarray, rows: int) -> np.ndarray:
    n = sketches.shape[1] // rows
    acc = np.tile(np.arange(1, n + 1, dtype=np.uint64), (len(sketches), 1))
    for j in range(rows):
        acc = mix(acc + sketches[:, j : n * rows : rows])
    return acc


def marks_of(sketches: np.ndarray) -> np.ndarray:
    """The low byte of each coordinate: enough to tell how many agree."""
    return (sketches & np.uint64(0xFF)).astype(np.uint8)


def least_agreement(num: int, den: int, t: int = COORDINATES) -> float:
    """Coordinates that agree in all but a vanishing part of the pairs at the threshold: seven standard deviations below it."""
    p = num / den
    return t * p - 7 * (t * p * (1 - p)) ** 0.5


def _features(k: int, rows: int):
    def run(batches):
        words = known_words()
        for batch in pieces_of(batches):
            sets = [word_set(t, k, words) for t in texts_of(batch)]
            sketches = fast_sketch(sets)
            keys, marks = band_keys(sketches, rows).view(np.int64), marks_of(sketches)
            some = [len(s) > 0 for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([x if y else None for x, y in zip(keys, some, strict=True)], pa.list_(pa.int64())),
                    pa.array([x.tobytes() if y else None for x, y in zip(marks, some, strict=True)], pa.binary()),
                ],
                ["doc_id", "n_shingles", "set_id", "bands", "marks"],
            )

    return run


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted sets have den * intersection >= num * union."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return den * both >= num * (len(a) + len(b) - both)


def plausible(marks: np.ndarray, sizes: np.ndarray, i: int, rest: np.ndarray, num: int, den: int, least: float) -> np.ndarray:
    """Those of rest that may be similar enough to row i by sizes and sketches, the likeliest first."""
    low, high = np.minimum(sizes[rest], sizes[i]), np.maximum(sizes[rest], sizes[i])
    rest = rest[den * low >= num * high]
    agree = (marks[rest] == marks[i]).sum(axis=1)
    order = np.argsort(-agree, kind="stable")
    return rest[order][agree[order] >= least]


def _open(root: np.ndarray, comps: np.ndarray, side: np.ndarray, i: int) -> np.ndarray:
    """Rows after i that may bring something new: not joined yet, of another component, and of the other side if there are two."""
    rest = np.arange(i + 1, len(root))
    return rest[(root[rest] != root[i]) & (comps[rest] != comps[i]) & ((side[rest] != side[i]) | (side[0] == side[-1]))]


def link_block(ids: np.ndarray, comps: np.ndarray, side: np.ndarray, sets: list[np.ndarray], marks: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links (of ids) that join all rows of different comps that links join, between the two sides or within the one there is.

    Rows come sorted by side. Only pairs not yet joined are looked at: first by sketches, then by the full sets.
    """
    root, sizes, least, out = np.unique(comps, return_inverse=True)[1], np.array([len(s) for s in sets]), least_agreement(num, den), []
    for i in range(len(ids) - 1):
        for j in plausible(marks, sizes, i, _open(root, comps, side, i), num, den, least):
            if root[j] != root[i] and linked(sets[i], sets[j], num, den):
                root[root == root[j]] = root[i]
                out.append((ids[i], ids[j]))
    return out


def candidate_block(ids: np.ndarray, comps: np.ndarray, side: np.ndarray, sizes: np.ndarray, marks: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """A forest of ids that joins all rows of different comps that plausible pairs join: at most a link a row, never the pairs."""
    root, least, out = np.arange(len(ids)), least_agreement(num, den), []
    for i in range(len(ids) - 1):
        near = plausible(marks, sizes, i, _open(root, comps, side, i), num, den, least)
        if len(near):
            trees, first = np.unique(root[near], return_index=True)
            out += [(ids[i], ids[j]) for j in near[first]]
            root[np.isin(root, trees)] = root[i]
    return out


def _groups(batches, key: tuple[str, ...], columns: tuple[str, ...]):
    """The rows of sorted batches, a group of one key at a time."""
    held, last = [], None
    for batch in pieces_of(batches):
        for row in zip(*(batch.column(c).to_pylist() for c in (*key, *columns)), strict=True):
            if row[: len(key)] != last:
                if held:
                    yield held
                held, last = [], row[: len(key)]
            held.append(row[len(key) :])
    if held:
        yield held


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pairs, strict=True)], ["a", "b"])


def _marks(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, COORDINATES)


def _plausible_pairs(num: int, den: int):
    """Pairs whose sketches agree as those of similar sets do."""

    def run(batches):
        least = least_agreement(num, den)
        for batch in pieces_of(batches, 4096):
            if batch.num_rows:
                agree = (_marks(batch.column("ma").to_pylist()) == _marks(batch.column("mb").to_pylist())).sum(axis=1)
                yield batch.select(["a", "b"]).filter(pa.array(agree >= least))

    return run


def _verified_stars(k: int, num: int, den: int):
    """Links to the centre of each group; its text comes first."""

    def run(batches):
        words, centre, key, out = known_words(), [], None, []
        for batch in pieces_of(batches):
            for b, salt, a, text in zip(*(batch.column(c).to_pylist() for c in ("b", "salt", "a")), texts_of(batch), strict=True):
                if (b, salt) != key:
                    key, centre = (b, salt), []
                own = word_set(text, k, words)
                if a == b:
                    centre.append(own)
                elif any(linked(own, c, num, den) for c in centre):
                    out.append((a, b))
            if out:
                yield _edges(out)
                out = []

    return run


def _candidates(num: int, den: int):
    def run(batches):
        for rows in _groups(batches, ("grp", "low", "high"), ("block", "node", "comp", "size", "marks")):
            block, ids, comps, sizes, marks = zip(*rows, strict=True)
            if pairs := candidate_block(np.array(ids), np.array(comps), np.array(block), np.array(sizes), _marks(list(marks)), num, den):
                yield _edges(pairs)

    return run


def _verified_blocks(k: int, num: int, den: int):
    def run(batches):
        words = known_words()
        for rows in _groups(batches, ("grp", "low", "high"), ("block", "node", "comp", "text")):
            block, ids, comps, texts = zip(*rows, strict=True)
            sets = [word_set(t or "", k, words) for t in texts]
            if pairs := link_block(np.array(ids), np.array(comps), np.array(block), sets, marks_of(fast_sketch(sets)), num, den):
                yield _edges(pairs)

    return run


def block_pairs(rows: DataFrame, most_rows: int, most_size: int) -> DataFrame:
    """(grp, comp, node, size, ...) -> the rows with block, low, high: dealt to pairs of blocks of bounded size.

    All pairs of blocks of a group are there but those within one component: a component that
    fills more than a block has blocks of its own, which meet only those of others. So a group
    that is one large component and a few strays costs each of its rows once.
    """
    counts = rows.groupBy("grp", "comp").agg(F.greatest(F.ceil(F.count("*") / most_rows), F.ceil(F.sum("size") / most_size)).cast("int").alias("pieces"), F.count("*").alias("_n"), F.sum("size").alias("_size"))
    small = F.col("pieces") == 1
    counts = written(counts, "counts")
    parts = F.greatest(F.ceil(F.sum(F.when(small, F.col("_n"))) / most_rows), F.ceil(F.sum(F.when(small, F.col("_size"))) / most_size)).cast("int")
    plans = counts.groupBy("grp").agg(F.coalesce(parts, F.lit(0)).alias("parts"), F.collect_list(F.when(~small, F.struct("comp", "pieces"))).alias("large"))
    name = lambda comp, i: F.concat_ws(":", comp, i.cast("string"))
    all_ = F.concat(
        F.when(F.col("parts") > 0, F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: name(F.lit(""), i))).otherwise(F.array().cast("array<string>")),
        F.flatten(F.transform("large", lambda x: F.transform(F.sequence(F.lit(0), x["pieces"] - 1), lambda i: name(x["comp"].cast("string"), i)))),
    )
    plans = plans.select("grp", "parts", all_.alias("blocks"))
    met = rows.join(counts.select("grp", "comp", "pieces"), ["grp", "comp"]).join(plans, "grp")
    own = F.when(F.col("pieces") > 1, name(F.col("comp").cast("string"), F.pmod(F.xxhash64("node"), F.col("pieces")))).otherwise(name(F.lit(""), F.pmod(F.xxhash64("comp"), F.col("parts"))))
    met = met.withColumn("block", own)
    others = F.filter("blocks", lambda x: (F.col("pieces") == 1) | ~F.startswith(x, F.concat(F.col("comp").cast("string"), F.lit(":"))))
    return met.withColumn("_other", F.explode(others)).withColumn("low", F.least("block", "_other")).withColumn("high", F.greatest("block", "_other")).drop("_other", "blocks", "parts", "pieces")


def near_components(docs: DataFrame, k: int = 3, num: int = 85, den: int = 100) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, component_id, kept: classes of near copies.

    Documents link where their sets of k-word shingles have den * intersection >= num * union;
    component_id is the smallest doc_id reachable. Equal sets are one node. Nodes that share a
    band are first held against the least node of the band, on the full sets, and what links is
    one component. Only in bands where components still differ are the sketches of their nodes
    compared, and only nodes with a plausible partner in another component send their texts, to
    be checked in blocks of bounded size; so no link is lost, no pair is emitted, and bands that
    unlike texts share by chance do not grow into one cluster. A text that is null, empty or
    without words has an empty set, links with nothing and is its own component. Rows that
    repeat a doc_id are one document, which links all that any of its texts links. A null doc_id
    takes the component of an equal set, else null, and is not kept. Further columns are
    ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    feats = written(docs.mapInArrow(_features(k, band_rows(num / den)), "doc_id long, n_shingles long, set_id binary, bands array<long>, marks binary"), "features")
    nodes = feats.filter("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    # equal sets meet their node by salted keys, so that a large group of copies is dealt over many tasks
    copies = nodes.filter("n > 1").select("set_id", "rep", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rep = F.when(F.col("set_id").isNotNull(), F.coalesce("rep", "doc_id"))
    named = feats.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(copies, ["set_id", "salt"], "left")
    own = F.col("doc_id") == rep
    named = written(named.select("doc_id", "n_shingles", rep.alias("rep"), F.when(own, F.col("bands")).alias("bands"), F.when(own, F.col("marks")).alias("marks")), "named")
    reps = named.filter("bands is not null").select(F.col("rep").alias("node"), F.col("n_shingles").alias("size"), "marks")
    keys = named.filter("bands is not null").select("rep", F.explode("bands").alias("key")).distinct()
    shared = keys.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("top")).filter("low < top").select("key", "low")
    met = written(keys.join(shared, "key").select("key", F.col("rep").alias("node"), "low"), "met")
    stars = met.filter("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()
    of = lambda name: reps.select(F.col("node").alias(name), F.col("marks").alias(f"m{name}"))
    stars = written(stars.join(of("a"), "a").join(of("b"), "b").select("a", "b", "ma", "mb").mapInArrow(_plausible_pairs(num, den), "a long, b long").distinct(), "stars")
    salts = stars.groupBy("b").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("n"))
    spokes = stars.join(salts, "b").select("b", F.pmod(F.xxhash64("a"), F.col("n")).cast("int").alias("salt"), "a")
    spokes = spokes.unionByName(salts.select("b", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("salt"), F.col("b").alias("a")))
    # a bitmap keeps texts that nobody asks for out of the shuffle
    spokes = written(spokes, "spokes")
    asked = lambda rows, name: maybe_in(docs, "doc_id", written(bitmap_of(rows.select(name), name), "bitmap"))
    stars = asked(spokes, "a").join(spokes, F.col("doc_id") == F.col("a")).select("b", "salt", "a", "text").repartition(parts, "b", "salt").sortWithinPartitions("b", "salt", F.col("a") != F.col("b"))
    confirmed = written(stars.mapInArrow(_verified_stars(k, num, den), "a long, b long"), "confirmed")
    found = written(components(confirmed), "found").withColumnRenamed("component", "comp")
    met = met.join(found, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    open_ = met.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("key")
    rows = written(met.join(open_, "key").withColumnRenamed("key", "grp").join(reps, "node"), "open")
    rows = block_pairs(rows, SKETCH_ROWS, 1 << 60).select("grp", "low", "high", "block", "node", "comp", "size", "marks")
    forest = rows.repartition(parts, "grp", "low", "high").sortWithinPartitions("grp", "low", "high", "block").mapInArrow(_candidates(num, den), "a long, b long").distinct()
    members = components(forest).select("node", F.col("component").alias("grp")).join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    members = written(members.join(reps.groupBy("node").agg(F.max("size").alias("size")), "node"), "members")
    blocks = block_pairs(members, BLOCK_ROWS, BLOCK_SHINGLES).select("grp", "low", "high", "block", "node", "comp")
    blocks = asked(members, "node").join(blocks, F.col("doc_id") == F.col("node")).select("grp", "low", "high", "block", "node", "comp", "text")
    links = blocks.repartition(parts, "grp", "low", "high").sortWithinPartitions("grp", "low", "high", "block", "node").mapInArrow(_verified_blocks(k, num, den), "a long, b long")
    # texts under one doc_id are one document
    twice = named.filter("doc_id is not null and rep is not null").groupBy("doc_id").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).filter("x < y").select("doc_id")
    same = named.join(twice, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    final = components(confirmed.unionByName(links).unionByName(same))
    return (
        named.join(final, named.rep == final.node, "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )


def op7_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(read_table(spark, sf_dir, "documents"))


ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles FROM s),
e AS (SELECT doc_id, hash(unnest(s)) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n_shingles + y.n_shingles - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT a AS doc_id, any_value(n_shingles) AS n_shingles, min(b) AS component_id, a = min(b) AS kept FROM r JOIN n ON n.doc_id = a GROUP BY a
"""
