"""Document fingerprints: consistent weighted sampling in column expressions alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table

SAMPLES = 32
STRETCH_BYTES = 16 << 20
KEY_BYTES = 7


def terms(text: Column) -> Column:
    """Sorted hashes of the words of a text, repeats kept."""
    return F.sort_array(F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w)))


def sample_values(samples: int) -> dict[str, Column]:
    """Over (term, ln_weight): the logarithm a of each sample's value.

    As in consistent weighted sampling, r and exp(c) are Gamma(2, 1) and b is uniform, all drawn
    from the term's hash: t = floor(ln w / r + b), ln a = c - r (t - b + 1). Two texts have the
    same smallest a in a sample with a probability of their generalised Jaccard similarity,
    weights being counts. A Gamma(4, 1) variable split by a Beta(2, 2) one, the median of three
    uniform ones, gives both Gammas for one logarithm. What stands twice is computed once.
    """
    unit = lambda h, i: (F.shiftrightunsigned(h, 21 * i).bitwiseAND((1 << 21) - 1) + F.lit(0.5)) / float(1 << 21)
    out = {}
    for k in range(samples):
        h, g, q = (F.xxhash64("term", F.lit(3 * k + i)) for i in range(3))
        x, y, z = unit(g, 1), unit(g, 2), unit(q, 0)
        both = -F.log(unit(h, 0) * unit(h, 1) * unit(h, 2) * unit(g, 0))
        share = F.greatest(F.least(x, y), F.least(F.greatest(x, y), z))
        r, c, b = both * share, F.log(both * (1 - share)), unit(q, 1)
        out[f"a{k}"] = c - r * (F.floor(F.col("ln_weight") / r + b) - b + 1)
    return out


def fingerprints(docs: DataFrame, keys: list[str], texts: str, samples: int = SAMPLES) -> DataFrame:
    """Rows with an array `texts` of strings -> one row per key and `kind` (place in the array), fp: array of 32-bit values, null for no term.

    keys must tell the rows apart; if docs is already partitioned by some of them, nothing is shuffled.
    """
    # outer forms: no filter on the arrays is inferred, which would build them twice
    rows = docs.select(*keys, F.posexplode_outer(texts).alias("kind", "_text")).withColumn("_s", terms(F.col("_text"))).drop("_text")
    rows = rows.withColumn("_p", F.filter(F.sequence(F.lit(0), F.greatest(F.size("_s") - 1, F.lit(0))), lambda i: (i == 0) | (F.get(F.col("_s"), i) != F.get(F.col("_s"), i - 1))))
    rows = rows.select(*keys, "kind", "_s", "_p", F.posexplode_outer("_p").alias("_i", "_at"))
    rows = rows.select(*keys, "kind", F.get("_s", F.col("_at")).alias("term"), F.log((F.coalesce(F.get("_p", F.col("_i") + 1), F.size("_s")) - F.col("_at")).cast("double")).alias("ln_weight"))
    values = sample_values(samples)
    # The fold gives the term as it is. It keeps this step out of whole-stage code, which would
    # be one method too long for the JVM to compile; a step of its own is cut into short ones.
    rows = rows.select(*keys, "kind", F.aggregate(F.array("term"), F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x)).alias("term"), *[x.alias(name) for name, x in values.items()])
    out = rows.groupBy(*keys, "kind").agg(*[F.min(F.when(F.col("term").isNotNull(), F.col(x))).alias(x) for x in values])
    fp = F.array(*[F.xxhash64(f"a{k}").bitwiseAND(0xFFFFFFFF) for k in range(samples)])
    return out.select(*keys, "kind", F.when(F.col("a0").isNotNull(), fp).alias("fp"))


def printed(fp: Column) -> Column:
    """A fingerprint as hex digits; the empty string for a text without terms."""
    return F.coalesce(F.array_join(F.transform(fp, lambda v: F.lpad(F.hex(v), 8, "0")), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples: estimates generalised Jaccard similarity. Two texts without terms are alike, one is not."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a).cast("double")
    return F.when(a.isNull() | b.isNull(), (a.isNull() & b.isNull()).cast("double")).otherwise(same)


def order_key(doc_id: Column, text: Column) -> Column:
    """A string that orders rows by doc_id, nulls first, then by the first bytes of the text."""
    number = F.coalesce(F.lpad(F.hex(doc_id.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"), F.lit(""))
    return F.concat(number, F.lit("."), F.hex(F.substring(text.cast("binary"), 1, KEY_BYTES)))


def quantiles(keys: list[tuple[str, int]], n: int) -> list[str]:
    """At most n - 1 keys that cut the sorted (key, count) list evenly; a key with more than a share stands alone."""
    total, cuts, seen = sum(c for _, c in keys), [], 0
    for i, (key, count) in enumerate(keys):
        if i and (seen * n // total > (seen - keys[i - 1][1]) * n // total or count * n > total):
            cuts.append(key)
        seen += count
    return cuts


def _listed(values: list[str]) -> Column:
    """Strings without commas as one folded array."""
    return F.split(F.lit(",".join(values)), ",")


def place(key: Column, cuts: list[str]) -> Column:
    """How many cuts are not above the key: a look among every step-th cut, then among the step cuts from there."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) + 1
    below = lambda xs: F.size(F.filter(xs, lambda c: c <= key))
    base = (F.greatest(below(_listed(cuts[::step])), F.lit(1)) - 1) * step
    return base + below(F.slice(_listed(cuts), base + 1, step))


def edited_fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, text) -> fingerprints of each text and of its edited text, with their likeness and that to the next text.

    The edited text has its last floor(n_chars / 2) code points replaced by as many first ones
    (or all) of the next document in descending doc_id; after the last comes the first. Null
    texts are empty. Rows that repeat a doc_id follow each other by descending text; null ids
    come last. Further columns are ignored; an empty table gives no rows.

    Texts move once: to stretches of doc_id (and, where an id repeats or is null, of the first
    bytes of the text), cut at quantiles of a sample of keys and dealt by range, so that tasks are
    even; there a window finds each next text. The stretches follow the size of the corpus
    (STRETCH_BYTES). The first row of every stretch also goes, as a guest, to the end of the one
    before. Only rows that agree in id and in those bytes stay in one stretch.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    n = max(4 * parts, -(-(size or 0) // STRETCH_BYTES))
    docs = docs.withColumn("_k", order_key(F.col("doc_id"), F.col("text")))
    some = docs.select("_k").filter(F.pmod(F.xxhash64("_k"), F.lit(max(1, rows // (32 * n)))) == 0).groupBy("_k").count().collect()
    cuts = quantiles(sorted((r["_k"], r["count"]) for r in some), n)
    docs = docs.withColumn("_b", place(F.col("_k"), cuts))
    tops = sorted(tuple(r) for r in docs.groupBy("_b").agg(F.max("_k")).collect())
    host, top = [""] * (len(cuts) + 1), [""] * (len(cuts) + 1)
    for i, (b, key) in enumerate(tops):
        host[b], top[b] = str(tops[(i + 1) % len(tops)][0]), key
    guest = F.when(F.col("_k") == F.get(_listed(top), F.col("_b")), F.get(_listed(host), F.col("_b")).cast("int"))
    seats = F.array_compact(F.array(F.struct(F.col("_b").alias("_b"), F.lit(0).alias("_guest")), F.when(guest.isNotNull(), F.struct(guest.alias("_b"), F.lit(1).alias("_guest")))))
    rows = docs.withColumn("_seats", seats).select("doc_id", "text", F.inline_outer("_seats")).repartitionByRange(max(parts, -(-n // 4)), "_b")
    order = Window.partitionBy("_b").orderBy("_guest", F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    rows = rows.withColumn("_next", F.lead("text").over(order)).withColumn("_row", F.row_number().over(order))
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), size - half), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), half))
    rows = rows.select("_b", "_row", "_guest", "doc_id", size.cast("long").alias("n_chars"), "text", F.when(F.col("_guest") == 0, edited).alias("_edited"))
    rows = rows.select("_b", "_row", "_guest", "doc_id", "n_chars", F.sha2(F.col("_edited"), 256).alias("edited_sha256"), F.array_compact(F.array("text", "_edited")).alias("_texts"))
    keys = ["_b", "_row", "_guest", "doc_id", "n_chars", "edited_sha256"]
    found = fingerprints(rows, keys, "_texts", samples)
    found = found.groupBy(*keys).agg(F.first(F.when(F.col("kind") == 0, F.col("fp")), ignorenulls=True).alias("_own"), F.first(F.when(F.col("kind") == 1, F.col("fp")), ignorenulls=True).alias("_other"))
    found = found.withColumn("_next", F.lead("_own").over(Window.partitionBy("_b").orderBy("_row"))).filter("_guest = 0")
    return found.select("doc_id", "n_chars", "edited_sha256", printed(F.col("_own")).alias("fingerprint"), printed(F.col("_other")).alias("edited_fingerprint"), likeness(F.col("_own"), F.col("_other")).alias("near_edited"), likeness(F.col("_own"), F.col("_next")).alias("near_next"))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(read_table(spark, sf_dir, "documents"))
