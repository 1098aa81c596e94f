"""Quality: a sparse ensemble of rules over text statistics, compiled to column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

SAMPLE_ROWS = 6000
TREES = 24
DEPTH = 3
THRESHOLD = 0.7
FEATURES = ("log_words", "word_length", "upper", "digits", "marks", "symbols", "stops", "distinct", "repeats", "line_repeats", "long_words")


def statistics(docs: DataFrame) -> DataFrame:
    """docs with the columns of FEATURES, doubles, of the whole text; null is empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    n = F.greatest(F.length("_t"), F.lit(1)).cast("double")
    share = lambda pattern: F.length(F.regexp_replace("_t", pattern, "")) / n
    docs = docs.withColumn("_t", text).withColumn("_w", F.filter(F.split("_t", r"\s+"), lambda w: w != ""))
    docs = docs.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: F.length(x) > 0)).withColumn("_m", F.greatest(F.size("_w"), F.lit(1)).cast("double"))
    return docs.withColumns(
        {
            "log_words": F.log1p(F.size("_w").cast("double")),
            "word_length": n / F.col("_m"),
            "upper": share(r"[^\p{Lu}]+"),
            "digits": share(r"[^0-9]+"),
            "marks": share(r"[^!?;:|]+"),
            "symbols": share(r"[^#$%&*<>{}=+~^@\\|_]+"),
            "stops": share(r"[^.]+"),
            "distinct": F.size(F.array_distinct("_w")) / F.col("_m"),
            "repeats": F.size(F.filter(F.arrays_zip(F.col("_w").alias("a"), F.slice("_w", 2, 1 << 30).alias("b")), lambda x: x["a"] == x["b"])) / F.col("_m"),
            "line_repeats": 1 - F.size(F.array_distinct("_l")) / F.greatest(F.size("_l"), F.lit(1)),
            "long_words": F.size(F.filter("_w", lambda w: F.length(w) > 24)) / F.col("_m"),
        }
    ).drop("_t", "_w", "_l", "_m")


def _tree(x: np.ndarray, g: np.ndarray, depth: int, cuts: list[np.ndarray], path: tuple, out: list, least: int) -> None:
    """Grows a regression tree on residuals and gathers every path as a conjunction of (feature, above, cut)."""
    if path:
        out.append(path)
    if depth == 0 or len(g) < 2 * least:
        return
    best = (1e-9, None)
    for f, cut in enumerate(cuts):
        if not len(cut):
            continue
        cell = np.searchsorted(cut, x[:, f], side="left")  # x <= cut[i] falls in cells 0..i
        n, s = np.cumsum(np.bincount(cell, minlength=len(cut) + 1))[:-1], np.cumsum(np.bincount(cell, g, len(cut) + 1))[:-1]
        ok = (n >= least) & (len(g) - n >= least)
        gain = np.where(ok, s**2 / np.maximum(n, 1) + (g.sum() - s) ** 2 / np.maximum(len(g) - n, 1) - g.sum() ** 2 / len(g), 0)
        i = int(gain.argmax())
        if gain[i] > best[0]:
            best = (gain[i], (f, float(cut[i])))
    if best[1] is None:
        return
    f, c = best[1]
    above = x[:, f] > c
    _tree(x[~above], g[~above], depth - 1, cuts, (*path, (f, False, c)), out, least)
    _tree(x[above], g[above], depth - 1, cuts, (*path, (f, True, c)), out, least)


def _holds(rule: tuple, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(x[:, f] > c) == above for f, above, c in rule])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 300) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal gradient steps; the intercept is not shrunk."""
    n, m = x.shape
    a = np.hstack([np.ones((n, 1)), x])
    step = 4 * n / max(np.linalg.norm(a, 2) ** 2, 1e-9)
    w = v = np.zeros(m + 1)
    t = 1.0
    for _ in range(rounds):
        new = v - step * (a.T @ (_sigmoid(a @ v) - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = new + (t - 1) / s * (new - w), new, s
    return float(w[0]), w[1:]


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, penalty: float = 0.002, seed: int = 7) -> tuple[float, list[tuple[float, tuple]]]:
    """(intercept, [(weight, rule)]): rules with a weight other than 0. Without rows, or with one class, there are none."""
    if not len(y):
        return 0.0, []
    base = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(base / (1 - base)))
    if y.min() == y.max():
        return start, []
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 49))) for f in range(x.shape[1])]
    score, rules = np.full(len(y), start), []
    for _ in range(trees):
        rows = rng.random(len(y)) < 0.6
        paths: list[tuple] = []
        hidden = rng.random(len(cuts)) < 0.3  # each tree sees some of the statistics
        _tree(x[rows], (y - _sigmoid(score))[rows], depth, [c[:0] if h else c for c, h in zip(cuts, hidden, strict=True)], (), paths, 10)
        new = [p for p in dict.fromkeys(paths) if p not in rules]
        rules += new
        for p in (p for p in new if len(p) == depth):
            at = _holds(p, x)
            if at.any():
                q = _sigmoid(score[at])
                score[at] += 0.3 * (y[at] - q).sum() / max((q * (1 - q)).sum(), 1.0)
    if not rules:
        return start, []
    on = np.stack([_holds(p, x) for p in rules], axis=1).astype(np.float64)
    b, w = lasso_logistic(on, y.astype(np.float64), penalty)
    return b, [(float(k), p) for k, p in zip(w, rules, strict=True) if abs(k) > 1e-6]


def compiled(model: tuple[float, list[tuple[float, tuple]]]) -> Column:
    """The model as one column expression over FEATURES."""
    total = F.lit(model[0])
    for weight, rule in model[1]:
        test = None
        for f, above, cut in rule:
            one = F.col(FEATURES[f]) > cut if above else F.col(FEATURES[f]) <= cut
            test = one if test is None else test & one
        total = total + F.when(test, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def part_of(doc_id: Column, parts: int) -> Column:
    """crc32 of doc_id as text, modulo parts; a null id falls in part 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(0))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held: int, rows: int) -> DataFrame:
    """docs joined to at most `rows` labelled ids outside the held-out part, chosen by hash; of repeated ids the largest label counts."""
    ids = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).filter("_id is not null and _y is not null")
    ids = ids.filter(part_of(F.col("_id"), parts) != held).groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    return docs.join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).drop("_id")


def one_per_id(measured: DataFrame) -> DataFrame:
    """Of the rows of each doc_id the least one, without the id: no more rows than labelled ids were drawn."""
    rest = [c for c in measured.columns if c != "doc_id"]
    return measured.groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("r")).orderBy(F.xxhash64("doc_id"), "doc_id").select("r.*")


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[float, list[tuple[float, tuple]]]:
    """Learns from a bounded sample of labelled rows whose part (of 4) is not 2; only their statistics reach the driver.

    Of texts that repeat a doc_id one row counts; null and empty texts have the statistics of an
    empty one; without labels, or with one class, there are no rules and the base rate is all.
    """
    sample = labelled_sample(docs.select("doc_id", "text"), labels, "quality", 4, 2, rows)
    got = one_per_id(statistics(sample).select("doc_id", "_y", *FEATURES)).toArrow()
    x = np.stack([got.column(f).to_numpy() for f in FEATURES], axis=1) if got.num_rows else np.zeros((0, len(FEATURES)))
    return fit_rules(x, got.column("_y").to_numpy())


def score_quality(docs: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; null and empty texts have the statistics of an empty text.

    Whole texts are read, however long. Rows that repeat an id, or have none, give rows each;
    further columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = statistics(docs).select("doc_id", (part_of(F.col("doc_id"), 4) == 2).alias("held_out"), compiled(model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_quality(docs: DataFrame, model, threshold: float = 0.5) -> DataFrame:
    """The rows whose score reaches threshold, with their columns: below THRESHOLD, so that doubtful rows stay.

    Columns may have the names of statistics; a row repeated stays as often as it stands, rows
    without an id or text are scored as any other; an empty table stays empty.
    """
    free = [c for c in docs.columns if c not in ("text",)]
    packed = docs.select("text", F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(free)]).alias("_rest")) if free else docs
    out = statistics(packed).filter(compiled(model) >= threshold)
    return out.select(*[F.col("text") if c == "text" else F.col(f"_rest.c{free.index(c)}").alias(c) for c in docs.columns])


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, read_table(spark, sf_dir, "labels")))
