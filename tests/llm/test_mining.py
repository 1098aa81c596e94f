"""Centroid clustering, phrases and word windows against plain versions, on small and awkward tables."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from citegrid.llm import centroids, passages, phrases
from pyspark.sql import functions as F

KINDS = "vec_id long, embedding array<double>"


def plain_clusters(rows, k=centroids.CENTROIDS, rounds=centroids.ROUNDS, dimensions=64, scale=64):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    middle = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min(range(len(middle)), key=lambda c: (far(v, middle[c]), c))
    for _ in range(rounds):
        own = [[] for _ in middle]
        for _, v in kept:
            own[nearest(v)].append(v)
        middle = [[sum(col) // len(vs) for col in zip(*vs, strict=True)] if vs else m for vs, m in zip(own, middle, strict=True)]
    at = [(i, c, far(v, middle[c])) for i, v in kept for c in [nearest(v)]]
    total = [sum(d for _, c, d in at if c == n) for n in range(len(middle))]
    return [(i, c, d, total[c], sum(total), hashlib.sha256(",".join(map(str, middle[c])).encode()).hexdigest()) for i, c, d in at]


def vectors(n, dimensions=64, seed=1):
    r = random.Random(seed)
    spots = [[r.uniform(-1, 1) for _ in range(dimensions)] for _ in range(9)]
    return [(i, [x + r.gauss(0, 0.05 if i % 3 else 0.6) for x in r.choice(spots)]) for i in range(n)]


def awkward_vectors():
    good = vectors(150)
    bad = [(900, None), (901, []), (902, good[0][1][:63]), (903, [*good[0][1], 0.0]), (904, [None, *good[0][1][1:]]), (905, [math.nan, *good[0][1][1:]]), (906, [math.inf, *good[0][1][1:]]), (907, [-math.inf, *good[0][1][1:]])]
    hot = [(i, good[3][1]) for i in range(200, 300)]  # a third of the rows are one vector
    return good + bad + hot + [good[5], good[5], (5, good[6][1]), (None, good[7][1]), (None, good[8][1]), (None, good[7][1]), (950, [-0.0] * 64), (951, [1000.0] * 64), (952, [-1 / 64] * 64)]


@pytest.mark.parametrize("rows", [awkward_vectors(), vectors(10), vectors(1), [(1, None)], [], [(i, [0.5] * 64) for i in range(40)]], ids=["awkward", "ten", "one", "none", "empty", "equal"])
def test_clusters(spark, rows):
    df = spark.createDataFrame(rows, KINDS).repartition(3).withColumns({"cluster": F.lit("x"), "vector": F.lit(1), "ids": F.lit(2), "distance": F.lit(None), "_rank": F.lit(3)})
    got = centroids.clusters(df)
    assert [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "bigint", "bigint", "string"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain_clusters(rows)))


def test_clusters_in_few_dimensions(spark):
    """Pruning is strong where dimensions are few, and coarse numbers give many ties."""
    rows = [(i, [round(x * 3) for x in v]) for i, v in vectors(400, 2, 4)]
    got = centroids.clusters(spark.createDataFrame([(i, list(map(float, v))) for i, v in rows], KINDS), k=7, rounds=4, dimensions=2, scale=1)
    assert sorted(map(tuple, got.collect())) == sorted(plain_clusters(rows, 7, 4, 2, 1))


def test_centroids_are_pruned_only_where_strictly_dominated():
    r = np.random.default_rng(3)
    for _ in range(300):
        points, middle = r.integers(-6, 7, (r.integers(1, 90), 3)), r.integers(-6, 7, (5, 3))
        tree = centroids.Tree(points, leaf=4)
        near = centroids.distances(points[:, None, :], middle[None]).argmin(axis=1)
        got = np.full(len(points), -1)
        whole = 0
        for node, cluster in centroids.assigned(tree, middle):
            got[tree.order[tree.start[node] : tree.end[node]]] = cluster
            whole += isinstance(cluster, int)
            assert (tree.sums[node] == tree.of(node).sum(axis=0)).all() and (tree.low[node] == tree.of(node).min(axis=0)).all() and (tree.high[node] == tree.of(node).max(axis=0)).all()
        assert (got == near).all()
        again = centroids.Tree.of_row(tree.to_row(), 3)
        assert (again.points == tree.points).all() and (again.child == tree.child).all()
    points = r.integers(0, 1000, (2000, 2))
    tree = centroids.Tree(points)
    runs = list(centroids.assigned(tree, np.array([[0, 0], [1000, 1000], [0, 1000], [1000, 0]])))
    assert sum(tree.end[n] - tree.start[n] for n, c in runs if isinstance(c, int)) > 1500  # most points are assigned by whole nodes


def test_components_too_large_are_refused(spark):
    df = spark.createDataFrame([(1, [0.0] * 64), (2, [1e9] * 64)], KINDS)
    with pytest.raises(Exception, match="would not fit"):
        centroids.clusters(df).collect()


def plain_passages(rows, length=35):
    """doc_id, n_words, n_removed, kept text: all windows of all texts counted."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = {i + k for i in range(len(w) - length + 1) if seen[tuple(w[i : i + length])] > 1 for k in range(length)}
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def passage_rows():
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)] + ["é", "\u00a0", "a\0b", "x" * 3000]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    common = text(60)
    slots = text(80)
    rows = [(i, " ".join(text(r.randrange(20)) + common[r.randrange(12) : 60 - r.randrange(12)] + text(r.randrange(30)))) for i in range(60)]
    rows += [(100 + i, " ".join(slots[:20] + text(1) + slots[20:54] + text(1) + slots[54:])) for i in range(8)]  # 34 common words at most
    rows += [(200, " ".join(["same"] * 90)), (201, " ".join(["same"] * 35)), (202, " ".join(["same"] * 34)), (203, " ".join(["x", "y"] * 40)), (204, None), (205, ""), (206, " \t\n\x0b\f\r "), (207, "\t".join(common)), (207, "\n".join(common)), (None, " ".join(common[:40])), (None, " ".join(text(40)))]
    rows += [(208, " ".join(text(50))), (208, " ".join(text(50)))] + 2 * [(209, " ".join(text(50)))] + 40 * [(210, " ".join(common + slots))]
    half = text(40)
    return rows + [(211, " ".join(half + text(5) + half)), (212, " ".join(half[:34])), (213, " ".join(text(400_000 // 40) * 2)), (214, " ".join(half[5:] + ["END"]))]


@pytest.mark.parametrize("group", [passages.GROUP, 2, 1])
def test_passages(spark, monkeypatch, group):
    """Contexts extended in one task, and (groups beyond 2 or 1) windows that meet by hashes."""
    monkeypatch.setattr(passages, "GROUP", group)
    rows = passage_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumns({"data": F.lit("x"), "tid": F.lit(1), "found": F.lit(2), "n_words": F.lit("n"), "copies": F.lit(None)})
    got = passages.remove_passages(df).collect()
    assert sorted(repr((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), r.kept)) for r in got) == sorted(map(repr, plain_passages(rows)))
    assert all(a.end < b.start for r in got for a, b in zip(r.spans, r.spans[1:]))  # maximal


def test_passages_of_few_rows(spark):
    for rows in ([], [(1, None)], [(1, "a b c")], [(7, " ".join(map(str, range(35)))), (8, " ".join(map(str, range(35))))]):
        got = passages.remove_passages(spark.createDataFrame(rows, "doc_id long, text string"))
        assert [(r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), r.kept) for r in got.orderBy("doc_id").collect()] == plain_passages(rows)


def test_contexts_are_extended_in_linear_rows():
    """Windows of two contexts are found whatever the other contexts of the group are; classes, not pairs."""
    r = np.random.default_rng(2)
    words = r.integers(0, 2, (200, 11)).astype(np.uint64)  # length 7, grams of 3: four words before the anchor
    group, low, high = r.integers(0, 3, 200), r.integers(0, 3, 200), r.integers(2, 5, 200)
    got = passages.extended(group, words, low, high, 7)
    window = lambda i, l: (group[i], l, tuple(words[i, 4 - l : 11 - l]))
    n = Counter(window(i, l) for i in range(200) for l in range(low[i], high[i] + 1))
    for i in range(200):
        for l in range(5):
            assert got[i, l] == (low[i] <= l <= high[i] and n[window(i, l)] > 1)


def test_equal_windows_have_equal_anchors():
    r = np.random.default_rng(4)
    h = r.integers(0, 6, 4000).astype(np.uint64)
    anchor, place, start, count = passages.seeds(h, 9, 4)
    assert (start[1:] == start[:-1] + count[:-1]).all() and start[0] == 0 and start[-1] + count[-1] == len(h) - 8
    known = {}
    for a, p, s, c in zip(anchor, place, start, count, strict=True):
        for i in range(s, s + c):
            assert known.setdefault(tuple(h[i : i + 9]), (a, p - i)) == (a, p - i) and 0 <= p - i <= 5


def plain_phrases(rows, least, top, longest=4, subsumed=80):
    f, total = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total["und" if lang is None else lang] += len(w)
            f.update(("und" if lang is None else lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    often = {(g, p): a for (g, p), a in f.items() if len(p) > 1 and a >= least}
    out = []
    for (g, p), a in often.items():
        if any(100 * b >= subsumed * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for (h, q), b in often.items() if g == h):
            continue
        score, _, l, r = min((2000000 * a // (f[g, p[:k]] + f[g, p[k:]]), k, f[g, p[:k]], f[g, p[k:]]) for k in range(1, len(p)))
        out.append((g, -score, -a, " ".join(p).encode(), l, r, total[g]))
    result, rank = [], Counter()
    for g, score, a, p, l, r, n in sorted(out):
        rank[g] += 1
        if rank[g] <= top:
            result.append((g, rank[g], p.decode(), -a, l, r, n, -score))
    return result


def phrase_rows():
    r = random.Random(11)
    words = ["the", "The", "cat", "dog", "é", "\u00e9t\u00c9", "a\0b", "|", "new", "York", "city", "\u00a0", "\U0001f600"]
    rows = [("".join(r.choice(words) + r.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "! ", "\x0b"]) for _ in range(r.randrange(60))), r.choice(["en", "en", "en", "fr", None, "und", "EN"])) for _ in range(200)]
    rows += [(None, "en"), ("", None), (" \t ", "zz"), ("...", "zz"), ("one", "x1")] + [("one of these copies of New York City", "en")] * 100
    return rows + [("again and again " * 3000, "de"), ("same " * 2000, "fr")]


@pytest.mark.parametrize("bits,least,top", [(None, 5, 2000), (None, 5, 7), (3, 5, 2000), (12, 300, 50)])
def test_phrases(spark, monkeypatch, bits, least, top):
    """With 2^3 cells the sketch lets everything through: slower, with the same result."""
    if bits:
        monkeypatch.setattr(phrases, "sketch_bits", lambda n: bits)
    rows = phrase_rows()
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5).withColumns({"doc_id": F.lit(1), "phrase": F.lit("x"), "n": F.lit(2), "size": F.lit(3), "data": F.lit(4), "_salt": F.lit(5)})
    got = phrases.phrases(df, least, top)
    assert [t for _, t in got.dtypes] == ["string", "bigint", "string", "bigint", "bigint", "bigint", "bigint", "bigint"]
    assert sorted(map(tuple, got.collect())) == sorted(plain_phrases(rows, least, top))


def test_phrases_of_no_rows(spark):
    for rows in ([], [(None, None)], [("alone", "en")]):
        assert phrases.phrases(spark.createDataFrame(rows, "text string, lang string")).collect() == []


def test_sketches_never_fall_below_the_counts(spark):
    rows = phrase_rows()
    texts = [((lang or "und"), (text or "").encode().translate(phrases._PLAIN)) for text, lang in rows]
    bits, least = 8, 40
    parts = [list(phrases._sketch(bits, least, 4)(iter([batch]))) for batch in (phrases.pa.table({"lang": [x for x, _ in t], "data": [x for _, x in t]}).combine_chunks().to_batches()[0] for t in (texts[:90], texts[90:]))]
    every = sorted((b for p in parts for b in p), key=lambda b: (b["row"][0].as_py(), b["block"][0].as_py()))
    table = np.zeros((phrases.ROWS, 1 << bits >> 3), np.uint8)
    for b in phrases._merged(bits, least)(iter(every)):
        table[b["row"][0].as_py()] = np.frombuffer(b["cells"][0].as_py(), np.uint8)
    words = phrases.Words(texts)
    h = words.hashes()
    assert 0 < np.unpackbits(table).sum() < table.size * 8
    for k in (1, 2, 3, 4):
        grams = phrases.shingle_hashes(h, k)
        own = np.flatnonzero(words.within(k))
        value, n = np.unique(grams[own], return_counts=True)
        frequent = own[np.isin(grams[own], value[n >= least])]
        assert len(frequent) and len(phrases.passing(table, grams, frequent, bits)) == len(frequent)


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(phrases, "TEXT_BYTES", 10)
    data = b"aa bb\ncc dd ee ff gg hh\nii\n\njj kk ll mm nn"
    assert b"".join(phrases._parts(data)) == data and all(x.endswith(b"\n") for x in list(phrases._parts(data))[:-1])
    assert list(phrases._parts(b"x" * 50)) == [b"x" * 50] and list(phrases._parts(b"")) == [b""]


def test_scores_are_exact_beyond_64_bits(spark):
    big = 4_000_000_000_000_000_003
    rows = [("en", "a", 1, big), ("en", "b", 1, big + 1), ("en", "a b", 2, big - 5), ("en", "c", 1, big), ("en", "b c", 2, 40), ("en", "a b c", 3, 39)]
    got = {r.phrase: (r.score, r.l, r.r) for r in phrases.scored(spark.createDataFrame(rows, "lang string, phrase string, size int, n long")).collect()}
    assert got["a b"] == (2000000 * (big - 5) // (2 * big + 1), big, big + 1) and got["a b c"] == (0, big, 40)
    assert {r.phrase: r.most for r in phrases.subsuming(spark.createDataFrame(rows, "lang string, phrase string, size int, n long")).collect()} == {"a b": 39, "b c": 39}
