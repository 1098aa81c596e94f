"""Phrase collocation mining: merged count-min sketches, exact counts of what they let through, scores and subsumption."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, mix, pieces_of, read_table, shingle_hashes, written

LONGEST = 4
MIN_COUNT = 30
TOP = 2000
SUBSUMED = 80
ROWS = 2
MOST_BITS = 26
BLOCK_BITS = 18
TEXT_BYTES = 4 << 20
_SALTS = 64

# A-Z in lower case, the ends of pieces as \n, tabs as spaces
_PLAIN = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\n\x0b\x0c\r\t", bytes(range(97, 123)) + b"\n" * 10 + b" ")


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Words:
    """The words of a block of texts (plain ones): number of each word in `vocabulary`, its piece, and the number of its language in `langs`."""

    def __init__(self, texts: list[tuple[str, bytes]]):
        known, langs = _Numbers({b"": 0, b"\n": 1}), _Numbers()
        numbers, lang = [], []
        for name, data in texts:
            tokens = data.replace(b"\n", b" \n ").split(b" ")
            tokens.append(b"\n")
            numbers.append(np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens)))
            lang.append(langs[name])
        every = np.concatenate(numbers)
        of = np.repeat(np.array(lang), [len(x) for x in numbers])
        piece = np.cumsum(every == 1)
        own = every > 1
        self.word, self.piece, self.lang = every[own], piece[own], of[own]
        self.vocabulary, self.langs = list(known), list(langs)

    def hashes(self) -> np.ndarray:
        """A hash of each word and its language."""
        word = np.fromiter(map(xxhash.xxh3_64_intdigest, self.vocabulary), np.uint64, len(self.vocabulary))
        lang = np.array([xxhash.xxh3_64_intdigest(x.encode(), 1) for x in self.langs], np.uint64)
        return mix(word[self.word] + lang[self.lang])

    def within(self, k: int) -> np.ndarray:
        """At each start of k words whether they stand in one piece."""
        return self.piece[: len(self.piece) - k + 1] == self.piece[k - 1 :]


def _parts(data: bytes):
    """A long plain text in parts that end with pieces."""
    at = 0
    while len(data) - at > TEXT_BYTES:
        end = data.rfind(b"\n", at, at + TEXT_BYTES) + 1 or data.find(b"\n", at + TEXT_BYTES) + 1 or len(data)
        yield data[at:end]
        at = end
    if at < len(data) or not at:
        yield data[at:]


def _blocks(batches):
    held, size = [], 0
    for batch in pieces_of(batches):
        for lang, data in zip(batch.column("lang").to_pylist(), batch.column("data").to_pylist(), strict=True):
            for part in _parts(data.translate(_PLAIN)):
                held.append((lang, part))
                size += len(part)
                if size >= TEXT_BYTES:
                    yield Words(held)
                    held, size = [], 0
    if held:
        yield Words(held)


def cells(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each hash in every row of a sketch."""
    return [((mix(h + np.uint64(r)) if r else h) >> np.uint64(64 - bits)).astype(np.int64) for r in range(ROWS)]


def _sketch(bits: int, least: int, longest: int):
    """A count-min sketch of the n-grams of a partition, in compressed blocks: a bitmap of the cells in use, and their counts. Counts stop at `least`, which is all that is asked of them."""
    kind = np.min_scalar_type(least)
    block = 1 << min(bits, BLOCK_BITS)

    def run(batches):
        table = np.zeros((ROWS, 1 << bits), kind)
        for words in _blocks(batches):
            h = words.hashes()
            for k in range(1, longest + 1):
                if len(h) < k:
                    continue
                grams, n = np.unique(shingle_hashes(h, k)[words.within(k)], return_counts=True)
                for row, at in zip(table, cells(grams, bits), strict=True):
                    spot, which = np.unique(at, return_inverse=True)
                    row[spot] = np.minimum(row[spot] + np.bincount(which, n, len(spot)), least)
        pack = zstandard.ZstdCompressor(1)
        for r, row in enumerate(table):
            for b, part in enumerate(row.reshape(-1, block)):
                if part.any():
                    some = part > 0
                    spots, values = pack.compress(np.packbits(some).tobytes()), pack.compress(part[some].tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([b], pa.int32()), pa.array([spots], pa.binary()), pa.array([values], pa.binary())], ["row", "block", "spots", "values"])
        del table
        give_back()

    return run


def _merged(bits: int, least: int):
    """Sketches added up, block by block as they come sorted, -> one bit for each cell that reaches `least`."""
    kind = np.min_scalar_type(least)

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        key, total = None, None

        def close():
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], ["row", "block", "cells"])

        for batch in batches:
            for row, block, spots, values in zip(*(batch.column(c).to_pylist() for c in ("row", "block", "spots", "values")), strict=True):
                some = np.unpackbits(np.frombuffer(unpack.decompress(spots), np.uint8)).astype(bool)
                part = np.zeros(len(some), np.int64)
                part[some] = np.frombuffer(unpack.decompress(values), kind)
                if (row, block) != key:
                    if key:
                        yield close()
                    key, total = (row, block), part
                else:
                    total = np.minimum(total + part, least)
        if key:
            yield close()

    return run


def passing(table: np.ndarray, grams: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    """Those places in `at` whose n-gram may be frequent by every row of the merged sketch."""
    keep = np.ones(len(at), bool)
    for bitmap, cell in zip(table, cells(grams[at], bits), strict=True):
        keep &= (bitmap[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
    return at[keep]


_COUNTS = "lang string, phrase string, size int, n long"


def _counted(shared, bits: int, longest: int):
    """Exact counts, block by block, of the n-grams that the merged sketch lets through; size 0 counts all words of a language."""

    def run(batches):
        table = shared.value
        for words in _blocks(batches):
            if not len(words.word):
                continue
            h = words.hashes()
            names = [w.decode() for w in words.vocabulary]
            out = [(i, "", 0, n) for i, n in enumerate(np.bincount(words.lang).tolist()) if n]
            number = words.lang * len(names) + words.word  # equal n-grams have equal numbers, and only they
            open_ = np.ones(len(h), bool)
            for k in range(1, min(longest, len(h)) + 1):
                if k > 1:  # an n-gram is no more frequent than its parts
                    open_ = open_[:-1] & open_[1:] & words.within(k)
                at = passing(table, shingle_hashes(h, k), np.flatnonzero(open_), bits)
                open_ = np.zeros(len(open_), bool)
                open_[at] = True
                _, first, which, n = np.unique(number[at] * len(names) + words.word[at + k - 1] if k > 1 else number[at], return_index=True, return_inverse=True, return_counts=True)
                number = np.zeros(len(open_), np.int64)
                number[at] = which
                start = at[first]
                spelled = zip(*(words.word[start + j].tolist() for j in range(k)), strict=True)
                out += zip(words.lang[start].tolist(), (" ".join([names[w] for w in ws]) for ws in spelled), [k] * len(start), n.tolist(), strict=True)
            lang, phrase, size, n = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([words.langs[i] for i in lang], pa.string()), pa.array(phrase, pa.string()), pa.array(size, pa.int32()), pa.array(n, pa.int64())], ["lang", "phrase", "size", "n"])

    return run


def sketch_bits(text_bytes: int) -> int:
    """A cell for each 16 bytes of text, so that few rare n-grams share one; 2^26 cells a row at most, of a byte each in a task and a bit each when merged."""
    return min(MOST_BITS, max(10, math.ceil(math.log2(max(1, text_bytes) / 16))))


def counts(texts: DataFrame, least: int = MIN_COUNT, longest: int = LONGEST) -> DataFrame:
    """(lang, data) -> (lang, phrase, size, n) of all phrases of up to `longest` words that occur `least` times in a language, and (lang, '', 0, all its words).

    Each partition makes a count-min sketch of all its n-grams; the sketches are added up cell by
    cell. Sums never fall below the true counts, so all that is frequent passes; what passes is
    counted exactly, and what was let through by chance falls away. The merged sketch is sent out
    as ROWS bitmaps of at most 8 MB. It spares the shuffle of rare n-grams while text / (16 x cells)
    is small against `least`; beyond that more is let through and counted, and the result is the same.
    """
    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = sketch_bits(texts.agg(F.sum(F.length("data"))).first()[0] or 0)
    sketches = texts.mapInArrow(_sketch(bits, least, longest), "row int, block int, spots binary, values binary")
    merged = sketches.repartition(parts, "row", "block").sortWithinPartitions("row", "block").mapInArrow(_merged(bits, least), "row int, block int, cells binary").toArrow()
    table = np.zeros((ROWS, (1 << bits) // 8), np.uint8)
    for row, block, data in zip(*(merged.column(c).to_pylist() for c in ("row", "block", "cells")), strict=True):
        table[row, block * len(data) : (block + 1) * len(data)] = np.frombuffer(data, np.uint8)
    shared = spark.sparkContext.broadcast(table)
    exact = texts.mapInArrow(_counted(shared, bits, longest), _COUNTS).groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))
    return written(exact.filter((F.col("size") == 0) | (F.col("n") >= least)), "counts")


def _part(words: Column, start: Column | int, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def scored(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, size, n) with all parts of its phrases -> (lang, phrase, size, a, l, r, score) of those of two words or more, by their weakest cut (ties: the first)."""
    words = F.split("phrase", " ", -1)
    cuts = frequent.filter("size > 1").withColumnRenamed("n", "a").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns({"first": _part(words, 1, F.col("k")), "rest": _part(words, F.col("k") + 1, F.col("size") - F.col("k"))})
    part = frequent.filter("size > 0").select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), F.col("n").alias("_n"))
    for name, count in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(part, (F.col("lang") == F.col("_lang")) & (F.col(name) == F.col("_phrase"))).withColumn(count, F.col("_n")).drop("_lang", "_phrase", "_n", name)
    score = F.expr("CAST(2000000 * CAST(a AS decimal(25,0)) AS decimal(38,0)) div (CAST(l AS decimal(25,0)) + r)")
    least = cuts.withColumn("score", score).groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("_cut"))
    return least.select("lang", "phrase", "size", "a", "_cut.l", "_cut.r", "_cut.score")


def subsuming(frequent: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, most): for phrases inside longer ones the count of the most frequent of those."""
    words = F.split("phrase", " ", -1)
    inner = [F.struct(F.lit(i + 1).alias("i"), F.lit(m).alias("m")) for n in range(3, longest + 1) for m in range(2, n) for i in range(n - m + 1)]
    which = F.filter(F.array(*inner), lambda x: x["i"] + x["m"] - 1 <= F.col("size")) if inner else F.array()
    spots = frequent.filter("size > 2").withColumn("x", F.explode(F.array_distinct(F.filter(which, lambda x: x["m"] < F.col("size")))))
    return spots.select("lang", _part(words, F.col("x.i"), F.col("x.m")).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("most"))


def phrases(docs: DataFrame, least: int = MIN_COUNT, top: int = TOP, longest: int = LONGEST, subsumed: int = SUBSUMED) -> DataFrame:
    """(text, lang) -> lang, rank, phrase, a, l, r, n, score: the `top` phrases of each language by score, then a, then phrase.

    Words are parted by spaces and tabs within pieces, which end at .,;:!? and line ends; A-Z are
    lower-cased. a, l, r count a phrase of 2 to `longest` words and the two parts of its weakest cut,
    n all words; score = floor(2000000 a / (l + r)) in decimals. A phrase goes where a longer
    one that holds it has `subsumed` % of its count. Null languages are `und`, null texts empty;
    repeated rows and ids count as they stand; further columns are ignored; an empty table gives
    no rows. Languages are ranked in salted parts first, so that no task sorts all of one.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("data"))
    found = counts(texts, least, longest)
    frequent = found.filter("size > 0")
    best = scored(frequent).join(subsuming(frequent, longest), ["lang", "phrase"], "left").filter(f"most IS NULL OR 100 * CAST(most AS decimal(30,0)) < {subsumed} * CAST(a AS decimal(30,0))")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(_SALTS))
    best = best.withColumn("_salt", salt).withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).filter(F.col("_rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return best.join(found.filter("size = 0").select("lang", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(read_table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, row_number() OVER () AS id, regexp_extract_all(t, '[^ 	]+') AS ws FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?
-
]')) AS t FROM d)),
w AS (SELECT lang, id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM p),
x AS (SELECT lang, w, lead(w) OVER q AS w2, lead(w, 2) OVER q AS w3, lead(w, 3) OVER q AS w4 FROM w WINDOW q AS (PARTITION BY id ORDER BY i)),
g AS (SELECT lang, CASE k WHEN 1 THEN w WHEN 2 THEN w || ' ' || w2 WHEN 3 THEN w || ' ' || w2 || ' ' || w3 ELSE w || ' ' || w2 || ' ' || w3 || ' ' || w4 END AS phrase, k FROM x, range(1, 5) r(k)),
f AS MATERIALIZED (SELECT lang, phrase, k, count(*) AS n FROM g WHERE phrase IS NOT NULL GROUP BY ALL),
c AS MATERIALIZED (SELECT lang, phrase, string_split(phrase, ' ') AS ws, k AS size, n AS a FROM f WHERE k > 1 AND n >= 30),
cut AS (SELECT c.lang, c.phrase, size, a, j, l.n AS l, r.n AS r, CAST(2000000 * CAST(a AS HUGEINT) // (l.n + r.n) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, size)) AS j FROM c) c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(ws[1:j], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(ws[j + 1 :], ' ')),
s AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
o AS (SELECT lang, array_to_string(ws[i : i + m - 1], ' ') AS phrase, max(a) AS most FROM (SELECT *, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM c)) GROUP BY ALL),
t AS (SELECT lang, sum(n) AS n FROM f WHERE k = 1 GROUP BY lang)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank, s.phrase, a, l, r, CAST(t.n AS BIGINT) AS n, score
FROM s JOIN t ON t.lang = s.lang LEFT JOIN o ON o.lang = s.lang AND o.phrase = s.phrase WHERE most IS NULL OR 100 * CAST(most AS HUGEINT) < 80 * a QUALIFY rank <= 2000
"""
