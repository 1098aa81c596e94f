"""Toxicity: Levenshtein automata over a trie of learned terms, with scores of the words around."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces_of, read_table, texts_of, written
from .quality import labelled_sample, one_per_id, part_of

SAMPLE_ROWS = 12000
LEAST_DOCS = 6
HINT_LIFT = 1.5
HINT_DEVIATIONS = 5
OWN_SHARE = 0.75
LONG_TERM = 9
WINDOW = 8
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W\d_]+")
# Words that report or quote what others said, and that address the reader. They are known
# of the languages and not learned, as labels of whole texts do not tell which words quote; how much a
# quoted or addressed term counts is learned.
REPORTING = frozenset("said says wrote called calling quote quoted reported word term dit disait écrit citation mot sagte schrieb zitat wort dijo escribió cita palabra".split())
ADDRESS = frozenset("you your yours youre tu te toi ton vous votre du dich dir dein sie ihr tú ti usted tus".split())
_QUOTES = frozenset("\"“”„«»‘’")


class Trie:
    """Terms by letters. A node's mark: 1 for a whole word, 2 for a stem that any ending may follow, 4 for a stem that only hints."""

    def __init__(self, words: list[str], stems: list[str], hints: list[str] = ()):
        self.root: dict = {}
        for mark, terms in ((1, words), (2, stems), (4, hints)):
            for term in terms:
                node = self.root
                for c in term:
                    node = node.setdefault(c, {})
                node[""] = node.get("", 0) | mark

    def exact(self, word: str) -> int:
        """2 for a term, 3 for a word with the stem of a hint alone, 0 for neither."""
        node, hint = self.root, 0
        for i, c in enumerate(word):
            node = node.get(c)
            if node is None:
                return hint
            mark = node.get("", 0)
            if mark & 2 or (mark & 1 and i == len(word) - 1):
                return 2
            if mark & 4:
                hint = 3
        return hint


class LevenshteinAutomaton:
    """States are rows of edit distances to the prefixes of a word, cut at k + 1."""

    def __init__(self, word: str, k: int):
        self.word, self.k = word, k

    def start(self) -> tuple[int, ...]:
        return tuple(min(i, self.k + 1) for i in range(len(self.word) + 1))

    def step(self, state: tuple[int, ...], c: str) -> tuple[int, ...]:
        new = [min(state[0] + 1, self.k + 1)]
        for i, w in enumerate(self.word):
            new.append(min(new[-1] + 1, state[i] + (w != c), state[i + 1] + 1, self.k + 1))
        return tuple(new)

    def alive(self, state: tuple[int, ...]) -> bool:
        return min(state) <= self.k

    def accepts(self, state: tuple[int, ...]) -> bool:
        return state[-1] <= self.k


def misspelled(trie: Trie, word: str, k: int = 1) -> bool:
    """Whether the automaton of the word and the trie of whole words share a path to a final state."""
    auto = LevenshteinAutomaton(word, k)
    todo = [(trie.root, auto.start())]
    while todo:
        node, state = todo.pop()
        if node.get("", 0) & 1 and auto.accepts(state):
            return True
        todo += [(child, s) for c, child in node.items() if c and auto.alive(s := auto.step(state, c))]
    return False


def edits_of(term: str) -> int:
    """How many edits still tell a misspelled term: none for short words, two for long ones."""
    return 0 if len(term) < 5 else 1 if len(term) < LONG_TERM else 2


class Matcher:
    """Tells words apart: 2 a term, 1 a misspelled term, 3 a hint, 0 none of them. Answers are remembered up to a bound."""

    def __init__(self, words: list[str], stems: list[str], hints: list[str] = (), memory: int = 300_000):
        self.trie, self.known, self.memory = Trie(words, stems, hints), {}, memory
        self.fuzzy = {k: Trie([w for w in words if edits_of(w) == k], []) for k in (1, 2)}
        # k edits leave one of k + 1 parts of a term whole, and move it by k places at most
        self.parts: dict[int, set[tuple[int, str]]] = {1: set(), 2: set()}
        self.sizes: dict[int, set[int]] = {1: set(), 2: set()}
        for w in words:
            if k := edits_of(w):
                cuts = [i * len(w) // (k + 1) for i in range(k + 2)]
                for x, y in zip(cuts, cuts[1:], strict=False):
                    self.sizes[k].add(y - x)
                    self.parts[k].update((at, w[x:y]) for at in range(max(0, x - k), x + k + 1))
        self.longest = {k: max((len(w) for w in words if edits_of(w) == k), default=0) + k for k in (1, 2)}

    def _may(self, word: str, k: int) -> bool:
        return 4 <= len(word) <= self.longest[k] and any((at, word[at : at + n]) in self.parts[k] for n in self.sizes[k] for at in range(len(word) - n + 1))

    def __call__(self, word: str) -> int:
        got = self.known.get(word)
        if got is None:
            got = self.trie.exact(word)
            if got != 2 and any(self._may(word, k) and misspelled(self.fuzzy[k], word, k) for k in (1, 2)):
                got = 1
            if len(self.known) < self.memory:
                self.known[word] = got
        return got


N_FEATURES = 9


def features(text: str, match: Matcher) -> list[float]:
    """Direct, misspelled and quoted terms, several different, addressed ones and their density in a text; hints, different ones, their density."""
    low = text.lower()
    words = _WORD.findall(low)
    found = [(i, m) for i, m in enumerate(map(match, words)) if m]
    if not found:
        return [0.0] * N_FEATURES
    hits, hints = [(i, m) for i, m in found if m < 3], [words[i] for i, m in found if m == 3]
    spots = [m.span() for m in _WORD.finditer(low)] if hits else []
    direct = fuzzy = quoted = addressed = 0.0
    for i, kind in hits:
        near = words[max(0, i - WINDOW) : i + WINDOW + 1]
        s, e = spots[i]
        left, right = low[spots[max(0, i - WINDOW)][0] : s], low[e : spots[min(len(spots) - 1, i + WINDOW)][1]]
        inside = any(c in _QUOTES for c in left) and any(c in _QUOTES for c in right)
        if inside or any(w in REPORTING for w in near):
            quoted += 1
        elif kind == 2:
            direct += 1
        else:
            fuzzy += 1
        addressed += any(w in ADDRESS for w in near)
    return [math.log1p(direct), math.log1p(fuzzy), math.log1p(quoted), float(direct + fuzzy >= 2), math.log1p(addressed), math.log1p(100 * (direct + fuzzy) / len(words)), math.log1p(len(hints)), math.log1p(len(set(hints))), math.log1p(100 * len(hints) / len(words))]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, list[float]]:
    """Intercept and weights by Newton steps with a small ridge; the base rate alone without rows or with one class."""
    base = (y.sum() + 1) / (len(y) + 2)
    if not len(y) or y.min() == y.max():
        return math.log(base / (1 - base)), [0.0] * N_FEATURES
    a = np.hstack([np.ones((len(y), 1)), x])
    w = np.zeros(a.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = a.T @ (a * (p * (1 - p) + 1e-9)[:, None]) / len(y) + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, a.T @ (p - y) / len(y) + ridge * w)
    return float(w[0]), [float(v) for v in w[1:]]


def learn_terms(sample: DataFrame) -> tuple[list[str], list[str], list[str]]:
    """Whole words and stems that mark labelled texts, and stems that hint at it.

    Near copies would lend their rare words the weight of many texts, so of texts that share a
    smallest word-triple hash one stays, under two seeds. A term must stand in LEAST_DOCS marked
    texts or more and almost never in others. A hint stands in both, but in marked texts more
    often by a factor of e ** HINT_LIFT, and by HINT_DEVIATIONS standard deviations or more: how
    many of them a text needs is left to the weights. All that pass are taken; the sample bounds them.
    """
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+"), lambda w: F.length(w) >= 4))
    sample = sample.select("doc_id", "_y", words.alias("w")).filter(F.size("w") > 0)
    for seed in (11, 12, 13):
        key = F.array_min(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 3, F.lit(0))), lambda i: F.xxhash64(F.lit(seed), F.slice(F.col("w"), i + 1, 3))))
        sample = sample.withColumn("k", key).groupBy("k").agg(F.min_by(F.struct("doc_id", "_y", "w"), "doc_id").alias("r")).select("r.*")
    sample = written(sample, "terms")
    n, marked = sample.agg(F.count("*"), F.sum("_y")).first()
    if not marked or marked == n:
        return [], [], []
    each = sample.select("_y", F.explode("w").alias("w"))
    count = [F.sum("_y").cast("long").alias("bad"), F.sum(1 - F.col("_y")).cast("long").alias("good")]
    pure = (F.col("bad") >= LEAST_DOCS) & (F.col("bad") >= 20 * F.col("good"))
    whole = {r.w: r.bad for r in each.groupBy("w").agg(*count).filter(pure).select("w", "bad").collect()}
    heads = sample.select("_y", F.explode(F.array_distinct(F.flatten(F.transform("w", lambda w: F.transform(F.sequence(F.lit(4), F.least(F.length(w), F.lit(8))), lambda n: F.substring(w, F.lit(1), n)))))).alias("w"))
    chance = marked / n * (F.col("bad") + F.col("good"))
    lift = F.log((F.col("bad") + 0.5) / (F.col("good") + 0.5)) - math.log((marked + 1) / (n - marked + 1))
    hint = (F.col("bad") >= LEAST_DOCS) & (lift >= HINT_LIFT) & (F.col("bad") - chance >= HINT_DEVIATIONS * F.sqrt(chance))
    found = heads.groupBy("w").agg(*count).filter(pure | hint).select("w", "bad", pure.alias("pure")).collect()
    shortest = lambda stems: sorted(s for s in stems if not any(s[:k] in stems for k in range(4, len(s))))
    hints = shortest({r.w for r in found if not r.pure})
    of = {r.w: r.bad for r in found if r.w in hints}
    # a rare ending makes part of what a hint finds look pure: it stays with the hint unless it is most of it
    own = lambda w, bad: all(bad >= OWN_SHARE * of[w[:k]] for k in range(4, len(w) + 1) if w[:k] in of)
    return sorted(w for w, bad in whole.items() if own(w, bad)), shortest({r.w for r in found if r.pure and own(r.w, r.bad)}), hints


def _measured(terms: tuple[list[str], list[str], list[str]]):
    def run(batches):
        match = Matcher(*terms)
        for batch in pieces_of(batches):
            got = np.array([features(t, match) for t in texts_of(batch)]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_y"), *(pa.array(c) for c in got.T)], ["doc_id", "_y", *(f"f{i}" for i in range(N_FEATURES))])

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[tuple[list[str], list[str], list[str]], float, list[float]]:
    """Terms and weights from a bounded sample of labelled rows whose part (of 3) is not 1; only terms and features reach the driver.

    Of texts that repeat a doc_id one row counts; null and empty texts have no terms; without
    labels, or with one class, there are no terms and the base rate is all.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = written(labelled_sample(docs, labels, "toxic", 3, 1, rows).withColumn("_y", F.col("_y").cast("long")), "sample")
    terms = learn_terms(sample)
    names = [f"f{i}" for i in range(N_FEATURES)]
    got = one_per_id(sample.select("doc_id", "_y", "text").mapInArrow(_measured(terms), "doc_id long, _y long, " + ", ".join(f"{f} double" for f in names))).toArrow()
    x = np.stack([got.column(f).to_numpy() for f in names], axis=1) if got.num_rows else np.zeros((0, N_FEATURES))
    return (terms, *fit_logistic(x, got.column("_y").to_numpy().astype(np.float64)))


def score_toxicity(docs: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; null and empty texts have no terms.

    Whole texts are read, however long. Ids may be null or repeat, each row has a score; further
    columns are ignored; an empty table gives no rows.
    """
    terms, base, weights = model

    def run(batches):
        match = Matcher(*terms)
        for batch in pieces_of(batches):
            z = [base + sum(w * v for w, v in zip(weights, features(t, match), strict=True)) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([1 / (1 + math.exp(-max(-30.0, min(30.0, v)))) for v in z], pa.float64())], ["doc_id", "score"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = docs.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (part_of(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, read_table(spark, sf_dir, "labels")))
