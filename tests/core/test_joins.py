"""Joins of spans, suggestions and resolution on tables, each against a plain version."""

import hashlib
import json
import random
import time

import pytest
from citegrid import refdata
from citegrid.engine import Engine
from citegrid.operators import extract, lookup, resolve, rules, spans, suggest
from citegrid.sources import readers
from pyspark.sql import functions as F


def span_rows(seed, n, far=6000):
    r = random.Random(seed)
    rows = [(r.choice([1, 1, 1, 1, 2, 3]), s, s + r.choice([0, 1, 5, 40, 900]), r.randrange(3)) for s in (r.randrange(far) for _ in range(n))]
    return rows + rows[:5] + [(1, 0, 5000, 7), (9, 1, 2, 7), (None, 5, 9, 7), (2, None, 9, 7), (2, 5, None, 7), (2, 9, 3, 7), (1, 1024, 1024, 7), (1, 2048, 2049, 7), (2, 100, 4096, 7)]


def plain_overlap(a, b):
    whole = lambda x: x[0] is not None and x[1] is not None and x[2] is not None and x[1] <= x[2]
    return whole(a) and whole(b) and a[0] == b[0] and a[1] < b[2] and b[1] < a[2]


@pytest.mark.parametrize("width", [1024, 7, 100_000])
def test_spans_join_by_overlap(spark, width):
    left, right = span_rows(1, 120), span_rows(2, 60)[:-8]
    kind = "doc_id int, start int, end int, note int"
    a, b = (spark.createDataFrame(x, kind).repartition(3).withColumns({"bucket": F.lit("b"), "_key": F.lit(1), "reach": F.lit(2), "_row": F.lit(3)}) for x in (left, right))
    short = lambda x: tuple(x)[:4]
    got = sorted((r.doc_id, short(r.left), short(r.right)) for r in spans.overlapping(a, b, width=width).collect())
    assert got == sorted((x[0], x, y) for x in left for y in right if plain_overlap(x, y))
    key = lambda x: repr(x)
    met = [x for x in left if any(plain_overlap(x, y) for y in right)]
    out = spans.overlapped(a, b, width=width)
    assert out.columns == a.columns and sorted(map(short, out.collect())) == sorted(met)
    assert sorted(map(short, spans.clear(a, b, width=width).collect()), key=key) == sorted((x for x in left if not any(plain_overlap(x, y) for y in right)), key=key)
    none = b.limit(0)
    assert spans.overlapped(a, none).count() == 0 and spans.clear(a, none).count() == len(left) and spans.overlapping(none, b).count() == 0


def test_spans_of_one_crowded_text(spark):
    """A hundred thousand spans of one text over one another: the sweep makes no pairs."""
    crowd = spark.range(100_000).select(F.lit(1).alias("doc_id"), (F.col("id") % 500).alias("start"), (F.col("id") % 500 + 300 + F.col("id") % 7).alias("end"))
    probe = spark.createDataFrame([(1, i, i + 1) for i in range(0, 1000, 10)], "doc_id int, start int, end int")
    assert spans.overlapped(probe, crowd).count() == spans.overlapped(probe, crowd.distinct()).count() == 81
    assert spans.clear(crowd, probe).count() == 0


def test_spans_are_merged(spark):
    rows = [(1, 5, 9), (1, 0, 3), (1, 3, 4), (1, 8, 20), (1, 7, 8), (2, 1, 1), (2, 4, 6), (None, 1, 2), (1, 30, 31), (1, 30, 31)]
    got = spans.merged(spark.createDataFrame(rows, "doc_id int, start int, end int"))
    assert sorted(map(tuple, got.collect())) == [(1, 0, 4), (1, 5, 20), (1, 30, 31), (2, 4, 6)]
    rows = [(k, s, e) for k, s, e, _ in span_rows(5, 300, 20_000)]
    places = {(k, p) for k, s, e in rows if None not in (k, s, e) for p in range(s, e)}
    want = sorted((k, p) for k, p in places if (k, p - 1) not in places)
    for width in (64, 1000, 1 << 16):
        got = sorted(map(tuple, spans.merged(spark.createDataFrame(rows, "doc_id int, start int, end int"), width=width).collect()))
        assert [x[:2] for x in got] == want and all((k, e - 1) in places and (k, e) not in places for k, _, e in got)


def torn(words, seed=3):
    r = random.Random(seed)
    for w in words:
        x = list(w)
        for _ in range(r.randrange(4)):
            i = r.randrange(len(x) + 1)
            x[i : i + r.randrange(2)] = r.choice(["", "a", "R", "p", "q"])
        yield "".join(x)


@pytest.mark.parametrize("complete", [True, False])
def test_suggestions_by_join(spark, complete):
    order = spark.createDataFrame([(e[0], i) for i, e in enumerate(refdata.EDITIONS)], "a string, i int").orderBy(F.expr("a collate UNICODE")).collect()
    ref = extract.Reference([(r.a, r.i) for r in order], list(refdata.VARIATIONS.items()), [], complete)
    known = [e[0] for e in refdata.EDITIONS] + list(refdata.VARIATIONS)
    tokens = sorted({t for seed in (3, 4) for t in torn(known, seed)} | set(known) | {"Blatchf.", "Barb.", "A.L.R.", "", "...", "Cal. Rprt. 3d", "Z" * 24})
    got: dict[str, list] = {}
    for r in suggest.suggestions(spark.createDataFrame([(t,) for t in [*tokens, *tokens, None]], "token string"), complete=complete).orderBy("token", "place").collect():
        got.setdefault(r.token, []).append(r.abbrev)
    for t in tokens:
        near = ref.suggest(t) if extract.squash(t) else []
        if not complete:
            near = [a for a in near if any(c == a and extract.mistyped(t, k) for k, c in ref.written)]
        assert got.get(t, [])[: len(near)] == near and (complete is False or len(got.get(t, [])) == len(near)), t


def test_joined_suggestions_give_the_same_findings(spark):
    texts = ["Gamma v. Theta, 12 Cal. Rprt. 3d 45 (2004). A v. B, 1 F. Suop. 2 (1990).", "12 F. Suop. 34; 64 U. Pitt. L. Rev. 639 (2003); 3 Blatchf. 9", None, "", "none", "12 F. Supp. 34"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    both = [sorted(map(repr, Engine(enable=["RP002", "RP001"], join_suggestions=j).check(docs).collect())) for j in (False, True)]
    assert both[0] == both[1] and len(both[0]) == 3
    assert Engine(enable=["RP002"], join_suggestions=True).check(docs.limit(0)).count() == 0


def test_incomplete_tables_accuse_no_other_reporter(spark):
    """Real reporters that the built-in table lacks: distance alone took some for misspellings of others."""
    real = ["A.L.R.", "A.L.R.2d", "Barb.", "Blatchf.", "Blackf.", "Ark. App'x", "Wend.", "Paige Ch.", "Ohio Misc.", "Ohio Misc. 2d", "Cow.", "Denio", "Hill", "Sandf.", "Wheel. Cr. Cas.", "McLean", "Mason", "Sumn.", "Story", "Fed. Cas.", "Bosw.", "Duer", "Hun", "Misc.", "Rob.", "Tenn. Crim. App.", "Va. Dec."]
    docs = spark.createDataFrame([(i, f"Ames v. Bell, 12 {a} 34 (1850).") for i, a in enumerate(real)], "doc_id long, text string")
    assert Engine(enable=["RP002"]).check(docs).count() == 0
    wrong = ["Cal. Rprt. 3d", "F. Suop.", "Cal. Rptrr. 3d", "F. Spup. 2d"]
    docs = spark.createDataFrame([(i, f"Ames v. Bell, 12 {a} 34 (1950).") for i, a in enumerate(wrong)], "doc_id long, text string")
    assert [r.replacement for r in Engine(enable=["RP002"]).check(docs).orderBy("doc_id").collect()] == ["Cal. Rptr. 3d", "F. Supp.", "Cal. Rptr. 3d", "F. Supp. 2d"]


@pytest.mark.parametrize("a,b,slip", [("rprt", "rptr", True), ("abc", "abc", False), ("abc", "abd", True), ("abc", "abcd", True), ("abcd", "abd", True), ("abcd", "badc", False), ("", "a", True), ("ab", "ba", True), ("abc", "cab", False), ("black", "blatchf", False)])
def test_one_slip(a, b, slip):
    assert extract.one_slip(a, b) is slip and extract.one_slip(b, a) is slip


def test_a_list_that_the_session_names(spark, tmp_path):
    """With a published list named in the session every lookup uses it, and a token close to one of its reporters is reported however short."""
    families = {"Zed.": [{"cite_type": "state", "name": "Zed's Reports", "editions": {"Zed.": {"start": "1850-01-01T00:00:00", "end": None}, "Zed. 2d": {"start": "1900-01-01T00:00:00", "end": None}}, "variations": {"Zedd.": "Zed."}}]}
    path = tmp_path / "list.json"
    path.write_text(json.dumps(families))
    docs = spark.createDataFrame([(1, "Ames v. Bell, 12 Zed. 34 (1860)."), (2, "Ames v. Bell, 12 Zedd. 34 (1860)."), (3, "Ames v. Bell, 12 Zod. 34 (1860)."), (4, "Ames v. Bell, 12 U.S. 34 (1990).")], "doc_id long, text string")
    own = lambda: {r.doc_id: r.canonical for r in Engine().citations(docs).collect()}
    assert own() == {4: "U.S."}
    spark.conf.set(refdata.LIST_PATH, str(path))
    try:
        assert own() == {1: "Zed.", 2: "Zed."}
        assert [(r.doc_id, r.replacement) for r in Engine(enable=["RP002"]).check(docs.filter("doc_id < 4")).collect()] == [(3, "Zed.")]
        assert {r.abbrev for r in refdata.reporters(spark).collect()} == {"Zed.", "Zed. 2d"}
        spark.conf.set(refdata.LIST_DIGEST, "0" * 64)
        with pytest.raises(ValueError, match="digest"):
            refdata.reporters(spark)
    finally:
        spark.conf.unset(refdata.LIST_PATH)
        spark.conf.unset(refdata.LIST_DIGEST)
    assert rules.selected(["RP002"]) == ["RP002"]


def briefs(n, seed=8):
    r = random.Random(seed)
    full = lambda: f"{r.choice(['Ames', 'Cole', 'Eads', 'Ames'])} v. {r.choice(['Bell', 'Dunn', 'Foss Corp.'])}, {r.randrange(1, 4)} {r.choice(['U.S.', 'F.3d', 'F. Supp. 2d'])} {r.randrange(1, 5)}00"
    part = {
        "full": lambda: full() + f" ({r.randrange(1990, 2015)})",
        "parallel": lambda: full() + f", {r.randrange(1, 4)} S. Ct. {r.randrange(100, 104)}, 1999 WL {r.randrange(9)} (1999)",
        "bare": lambda: f"{r.randrange(1, 4)} {r.choice(['U.S.', 'F.3d'])} {r.randrange(1, 5)}00",
        "id": lambda: r.choice(["Id.", "Id. at 5", "Id., 2 F.3d 300", "Id. at 7, 3 U.S. 100"]),
        "short": lambda: f"{r.choice(['Ames, ', ''])}{r.randrange(1, 4)} {r.choice(['U.S.', 'F.3d', 'S. Ct.'])} at {r.randrange(100, 300)}" + r.choice(["", ", 1 U.S. 200"]),
        "supra": lambda: r.choice(["Ames, supra", "See Dunn, supra", "Nobody, supra", "supra", "Cole v. Foss, supra", "ames, supra"]),
        "statute": lambda: f"{r.randrange(1, 3)} U.S.C. § {r.randrange(1, 9)}",
        "neutral": lambda: f"2013 IL App (1st) {r.randrange(100000, 100004)}",
    }
    kinds = [*part, "id", "short", "full"]
    return [(i if i else None, ". ".join(part[r.choice(kinds)]() for _ in range(r.randrange(1, 14))) + ".") for i in range(n)]


def test_resolution_on_tables_equals_the_parser(spark):
    rows = briefs(150)
    cites = extract.citations(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("want", F.struct("resource_key", "parallel_of")).drop("resource_key", "parallel_of")
    cites = cites.withColumns({"joined": F.col("want.parallel_of").isNotNull(), "own": resolve.own_key(), "at": F.lit("x"), "to": F.lit(1), "doc": F.lit(2), "key": F.lit(3)})
    got = resolve.resolved(cites).collect()
    assert len(got) > 500 and {"id", "short-form", "supra", "statute", "neutral", "database", "case-reporter"} == {r.kind for r in got}
    for r in got:
        assert (r.resource_key, r.parallel_of) == tuple(r.want), (dict(rows)[r.doc_id], r.start, r.kind)
    assert sum(r.resource_key is None for r in got) > 30 and sum(r.kind == "short-form" and r.resource_key is not None for r in got) > 30


def test_resolution_across_parts_of_a_document(spark):
    """The second part takes its authorities from the first."""
    parts = [(7, 0, "Ames v. Bell, 12 F.3d 34 (1999); Cole v. Dunn, 3 U.S. 100 (1990)."), (7, 1, "Id. at 101. 12 F.3d at 36; Ames, supra."), (8, 1, "Id. at 5.")]
    cut = spark.createDataFrame([(10 * d + p, t) for d, p, t in parts], "doc_id long, text string")
    rows = extract.citations(cut).drop("resource_key").withColumns({"part": F.col("doc_id") % 10, "doc_id": F.floor(F.col("doc_id") / 10), "joined": F.col("parallel_of").isNotNull(), "own": resolve.own_key()})
    got = {(r.doc_id, r.part, r.idx): r.resource_key for r in resolve.resolved(rows, ["part", "start"]).collect()}
    assert got == {(7, 0, 0): "12 F.3d 34", (7, 0, 1): "3 U.S. 100", (7, 1, 0): "3 U.S. 100", (7, 1, 1): "12 F.3d 34", (7, 1, 2): "12 F.3d 34", (8, 1, 0): None}
    assert resolve.resolved(rows.limit(0), ["part", "start"]).count() == 0


def test_long_chains_are_followed_in_few_rounds(spark):
    """A thousand times id. after one citation."""
    rows = [(1, 0, "case-reporter", "1 F.3d 2")] + [(1, i, "id", None) for i in range(1, 1000)]
    df = spark.createDataFrame(rows, "doc_id long, start int, kind string, own string").withColumns({"joined": F.lit(None).cast("boolean"), "volume": F.lit("1"), "canonical": F.lit("F.3d"), "case_name": F.lit(None).cast("string")})
    assert {r.resource_key for r in resolve.resolved(df).collect()} == {"1 F.3d 2"}


def test_resolution_writes_no_tables(spark):
    """Rounds once left a table each; now nothing but the shuffle goes to disk."""
    rows = [(d, i, "case-reporter" if not i else "id", f"{d} F.3d 2") for d in (1, 2, None) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, start int, kind string, own string").withColumns({"joined": F.lit(False), "volume": F.lit(None).cast("string"), "canonical": F.lit("F.3d"), "case_name": F.lit(None).cast("string")})
    out = resolve.resolved(df.repartition(7), partitions=3)
    got = out.collect()
    assert len(got) == 120 and {(r.doc_id, r.resource_key) for r in got} == {(d, f"{d} F.3d 2") for d in (1, 2, None)}
    assert not out.inputFiles()


def double(log):
    """A client that writes down each request; keys of one kind fail, others are absent or known."""

    def ask(key):
        with open(log, "a") as f:
            f.write(f"{time.time()} {key}\n")
        if "down" in key:
            raise OSError("no route")
        if "busy" in key:
            return 429, []
        if "gone" in key:
            return 404, []
        return 200, [{"case_name": f"Ames v. {key}", "year": 1990, "court_id": "scotus", "url": None, "more": 1}]

    return ask


def test_lookups_ask_each_key_once(spark, tmp_path):
    log, store = tmp_path / "log", str(tmp_path / "store")
    asked = lambda: [x.split(" ", 1)[1] for x in log.read_text().splitlines()]
    keys = spark.createDataFrame([(k,) for k in ["a", "b", "a", "gone", "busy", "down", None, "a"]], "key string")
    rate = {"most": 1000, "seconds": 1.0, "lanes": 3}
    got = {r.key: (r.status, [c.case_name for c in r.clusters]) for r in lookup.answers(keys, double(log), store, run="one", **rate).collect()}
    assert got == {"a": (200, ["Ames v. a"]), "b": (200, ["Ames v. b"]), "gone": (404, []), "busy": (429, []), "down": (0, [])}
    assert sorted(asked()) == ["a", "b", "busy", "down", "gone"]
    again = {r.key: r.status for r in lookup.answers(keys, double(log), store, run="two", **rate).collect()}
    assert again == {k: s for k, (s, _) in got.items()} and sorted(asked()[5:]) == ["busy", "down"]  # failures alone were not kept
    more = keys.union(spark.createDataFrame([("c",)], "key string"))
    for _ in range(2):  # a run that is repeated leaves one answer
        lookup.answers(more, double(log), store, run="three", **rate).collect()
    assert sorted(r.key for r in lookup.kept_answers(spark, store).collect()) == ["a", "b", "c", "gone"] and asked().count("c") == 1
    n = len(asked())
    assert lookup.answers(keys.limit(0), double(log), store, **rate).count() == 0 and len(asked()) == n


def test_lookups_keep_their_rate_and_lose_patience(spark, tmp_path):
    log = tmp_path / "log"
    keys = spark.range(24).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    lookup.answers(keys, double(log), str(tmp_path / "store"), most=6, seconds=0.5, lanes=2).collect()
    at = sorted(float(x.split()[0]) for x in log.read_text().splitlines())
    assert len(at) == 24 and max(sum(t <= x < t + 0.5 for x in at) for t in at) <= 6
    log.write_text("")
    busy = keys.select(F.concat(F.lit("busy"), "key").alias("key"))
    got = lookup.answers(busy, double(log), str(tmp_path / "other"), most=1000, seconds=1.0, lanes=1, patience=3).collect()
    assert sorted((r.status is None) for r in got) == [False] * 3 + [True] * 21 and len(log.read_text().splitlines()) == 3


def test_lookups_drive_the_rules(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Ames v. Bell, 1 U.S. 100 (1990). Id. Cole v. Dunn, 2 U.S. 200 (1990)."), (2, "Zeta v. Omega, 1 U.S. 100 (1990). X v. Y, 3 U.S. 300 (1990).")], "doc_id long, text string")
    cites = Engine().citations(docs)
    assert sorted(r.key for r in lookup.wanted_keys(cites, 1).collect()) == ["1 U.S. 100"]
    answer = lambda key: (404, []) if key.startswith("2") else (503, []) if key.startswith("3") else (200, [{"case_name": "Ames v. Bell", "year": 1990}])
    found = lookup.lookups(cites, answer, str(tmp_path / "store"), most=1000, seconds=1.0)
    engine = Engine(enable=["VF001", "VF002", "VF003", "VF004"], lookups=found)
    assert sorted((r.doc_id, r.rule_id, r.start) for r in engine.check(docs).collect()) == [(1, "VF001", 51), (2, "VF003", 15)]


def test_contents_are_read_once(spark, tmp_path):
    log = tmp_path / "log"

    def pages(data):
        with open(log, "a") as f:
            f.write(f"{data!r}\n")
        if b"bad" in data:
            raise ValueError("broken")
        return [f"page of {len(data)}"]

    reads = lambda: len(log.read_text().splitlines()) if log.exists() else 0
    rows = [(f"{i}.pdf", bytearray(b"%PDF-1 " + b"x" * (i % 3))) for i in range(30)] + [("bad.pdf", bytearray(b"%PDF-bad")), ("bad2.pdf", bytearray(b"%PDF-bad")), ("t.txt", bytearray(b"<p>a</p>")), ("t.html", bytearray(b"<p>a</p>")), ("none", None), ("0.pdf", bytearray(b"%PDF-1 "))]
    files = spark.createDataFrame(rows, "path string, content binary").withColumns({"digest": F.lit("d"), "named": F.lit(1)})
    store = str(tmp_path / "store")
    plain = lambda rows: sorted((r.path, r.format, r.text, r.error) for r in rows)
    want = plain(readers.imported(files, pages).collect())
    n = reads()
    got = readers.imported_once(files, store, pages, run="one")
    assert plain(got.collect()) == want and reads() - n == 5  # three contents, one of them in two rows of one path, and a broken one
    assert {r.digest for r in got.collect()} == {hashlib.sha256(bytes(c or b"")).hexdigest() for _, c in rows}
    n = reads()
    more = files.unionByName(spark.createDataFrame([("new.pdf", bytearray(b"%PDF-new"))], "path string, content binary").withColumns({"digest": F.lit("d"), "named": F.lit(1)}))
    assert len(plain(readers.imported_once(more, store, pages, run="two").collect())) == len(want) + 1 and reads() - n == 1
    n = reads()
    assert plain(readers.imported_once(files, store, pages, settings="v2", run="three").collect()) == want and reads() - n == 5  # other settings, other texts
    assert readers.imported_once(files.limit(0), store, pages).count() == 0


def test_a_rule_that_fails_on_one_document(spark):
    docs = spark.range(400, 650).select(F.col("id").alias("doc_id"), F.concat(F.lit("Id. at 5. Ames v. Bell, "), (F.col("id") + 1).cast("string"), F.lit(" F.3d 34 (9th Cir. 1999).")).alias("text"))

    def odd(cites):
        if cites[1]["volume"] == "500":
            raise KeyError("volume 500")
        if cites[1]["volume"] == "600":
            return [{"message": 5, "start": "x"}]
        return [{"message": f"{len(cites)} citations", "start": c["start"], "end": c["end"], "citation_text": c["text"]} for c in cites if c["kind"] == "case-reporter"]

    for isolated in (False, True):
        found = Engine(enable=["ST001"], custom=[rules.DocumentRule("X1", odd)], isolated=isolated).check(docs).collect()
        assert sum(r.rule_id == "ST001" for r in found) == 250
        own = {r.doc_id: r for r in found if r.rule_id == "X1"}
        assert len(own) == 250 and {d for d, r in own.items() if r.severity == "error"} == {499, 599}
        assert "KeyError" in own[499].message and own[403].message == "2 citations" and own[403].citation_text == "404 F.3d 34"


def test_what_fails_as_it_runs_is_left_out(spark):
    docs = spark.createDataFrame([(1, "Id. at 5. Ames v. Bell, 12 U.S. 34 (1999)."), (2, "12 U.S. 35")], "doc_id long, text string")

    def late(cites):
        return cites.select("doc_id", *[F.when(F.col("doc_id") == 2, F.raise_error(F.lit("late"))).otherwise(F.lit(None)).cast(k).alias(n) for n, k in (x.split() for x in rules.FINDING.split(", "))])

    def sound(cites):
        return cites.filter("kind = 'id'").select("doc_id", *[F.lit("X2" if n == "rule_id" else None).cast(k).alias(n) for n, k in (x.split() for x in rules.FINDING.split(", "))])

    broken = spark.createDataFrame([("12 U.S. 34", "Ames v. Bell", 1999)], "key string, case_name string, year int").withColumns({"court_id": F.lit("scotus"), "url": F.raise_error(F.lit("table is gone")).cast("string")})
    engine = Engine(enable=["ST001", "VF001"], authorities=broken, custom=[late, sound], isolated=True)
    assert sorted(r.rule_id for r in engine.check(docs).collect()) == ["ST001", "X2"]
    assert len(engine.notices) == 2 and "authorities were not checked" in engine.notices[0] and "late" in engine.notices[1]
    fine = Engine(enable=["ST001", "VF001"], authorities=broken.withColumn("url", F.lit("u")), isolated=True)
    plain = Engine(enable=["ST001", "VF001"], authorities=broken.withColumn("url", F.lit("u")))
    assert sorted(map(repr, fine.check(docs).collect())) == sorted(map(repr, plain.check(docs).collect())) and not fine.notices
