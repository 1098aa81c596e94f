"""Parser, rules, fixes, readers and writers on small texts."""

import io
import time
import zipfile

import pyarrow as pa
import pytest
from citegrid import refdata
from citegrid.engine import Engine
from citegrid.functions import text as T
from citegrid.operators import annotate, extract, feedback, fix, rich, rules
from citegrid.sources import readers, writers
from citegrid.streaming.watch import check_stream
from pyspark.sql import functions as F

REF = extract.Reference([(e[0], i) for i, e in enumerate(refdata.EDITIONS)], list(refdata.VARIATIONS.items()), [(c[0], [c[2], *c[6]]) for c in refdata.COURTS])

# Sentences of a public court filing and of a graded quiz: fixed test values.
GOLDEN = [
    ("In the case of Ashcroft v. Iqbal, 556 U.S. 662 (2009), the Supreme Court held that when", [dict(kind="case-reporter", text="556 U.S. 662", year=2009, case_name="Ashcroft v. Iqbal", court_id=None)]),
    ("In Doe v. United States, 419 F.3d 1058 (9th Cir. 2005), the Ninth Circuit held", [dict(canonical="F.3d", court_id="ca9", court_text="9th Cir.", case_name="Doe v. United States")]),
    ("In Shaboon v. Egyptair, 2013 IL App (1st) 111279-U (Ill. App. Ct. 2013), the Illinois", [dict(kind="neutral", year=2013, neutral_body="IL App (1st) 111279-U", court_id="illapp")]),
    ("Similarly, in Peterson v. Iran Air, 905 F. Supp. 2d 121 (D.D.C. 2012), the District", [dict(canonical="F. Supp. 2d", court_id="dcd", case_name="Peterson v. Iran Air")]),
    ("In Ehrlich v. American Airlines, Inc., 360 N.J. Super. 360 (App. Div. 2003), the New", [dict(court_text="App. Div.", court_id=None, case_name="Ehrlich v. American Airlines, Inc.")]),
    ("In Martinez v. Delta Airlines, Inc., 2019 WL 4639462 (Tex. App. Sept. 25, 2019), the", [dict(kind="database", court_id="texapp", court_text="Tex. App.", year=2019)]),
    ("Lastly, in Estate of Durden v. KLM Royal Dutch Airlines, 2017 WL 2418825 (Ga. Ct. App. June 5, 2017).", [dict(case_name="Estate of Durden v. KLM Royal Dutch Airlines", court_id="gactapp")]),
    ("the case of Varghese v. China Southern Airlines Co., Ltd., 925 F.3d 1339 (11th Cir. 2019), stating", [dict(case_name="Varghese v. China Southern Airlines Co., Ltd.", court_id="ca11")]),
    ("See El Al Airlines, Ltd. v. Tseng, 525 U.S. 155, 161, 119 S. Ct. 662, 142 L. Ed. 2d 576 (1999). Id. at 166, 119 S. Ct. 662.", [dict(pin="161", parallel_of=None), dict(parallel_of=0, year=1999), dict(parallel_of=0), dict(kind="id", pin="166", resource_key="525 U.S. 155"), dict(parallel_of=3, case_name=None, year=None)]),
    ("In re Smith, 174 F.3d\n366, 371-\n72 (3d Cir. 1999)", [dict(case_name="In re Smith", pin="371-72", court_id="ca3")]),
    ("11 U.S.C. § 362(a). 42 U.S.C. § 1983 (2012). Id. § 1985.", [dict(kind="statute", sections="362(a)"), dict(resource_key="42 U.S.C. § 1983"), dict(kind="id", resource_key="42 U.S.C. § 1983")]),
    ("The Court in Varghese, relied on 123 Main Street 45; Fed. R. Civ. P. 12; § 1332.", []),
    ("12 March 2019 F.3d 4", [dict(text="2019 F.3d 4")]),
    ("as noted above, supra", [dict(kind="supra", case_name=None, resource_key=None)]),
]


@pytest.mark.parametrize("text,want", GOLDEN)
def test_parser(text, want):
    got = extract.parse(text, REF)
    assert [{k: g[k] for k in w} for g, w in zip(got, want, strict=True)] == want
    assert all(text[g["start"] : g["end"]] == g["text"] for g in got)
    assert all(a["end"] <= b["start"] for a, b in zip(got, got[1:], strict=False))


@pytest.mark.parametrize("unit", ["Smith v. ", "1 F. ", "A ", "1 U.S. 1, ", "(", "Id. ", "§ 1, ", "supra ", "Jan  ", "12 F.3d at "])
def test_time_grows_with_the_text(unit):
    took = []
    for n in (2000, 8000):
        t = time.perf_counter()
        extract.parse(unit * n, REF)
        took.append(time.perf_counter() - t)
    assert took[1] < max(took[0], 0.02) * 12 + 0.3


def findings(spark, text, profile=None, **options):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return Engine(profile or rules.Profile(), **options).check(docs).collect()


def test_correct_citations_are_silent(spark):
    for text in ("See Ames v. Bell, 12 F.3d 34, 36-37 (9th Cir. 1999).", "11 U.S.C. § 362(a); 17 C.F.R. § 240.10b-5; 42 U.S.C. §§ 1981-1985.", "Ames v. Bell, 5 U.S. 100 (1990). Id. at 101."):
        assert findings(spark, text) == [], text


def test_selection():
    assert rules.selected(["rp001", "Implausible-Year"]) == ["RP001", "DT002"]
    assert "VF001" not in rules.selected(verification=False) and len(rules.selected()) == 24
    assert rules.selected(disable=["st001"], verification=False)[:2] == ["RP001", "RP002"]


def test_custom_rule(spark):
    def every(cites):
        f = rules._finding("X1", "info", F.lit("seen"))
        return cites.select("doc_id", f.alias("f")).select("doc_id", "f.*")

    assert [r.rule_id for r in findings(spark, "Ames v. Bell, 5 U.S. 100 (1990).", custom=[every])] == ["X1"]


def test_fix_is_idempotent(spark):
    docs = spark.createDataFrame([(1, "Ames v. Bell, 12 F.Supp.2d 34 (D.D.C. 1999), and 5 U.S. 6 (U.S. 1999)."), (2, "nothing"), (3, None), (4, "")], "doc_id long, text string")
    engine = Engine(rules.Profile(edition=20))
    once = engine.fix(docs).select("doc_id", "text")
    assert {r.doc_id: r.text for r in once.collect()} == {1: "Ames v. Bell, 12 F. Supp. 2d 34 (D.D.C. 1999), and 5 U.S. 6 (1999).", 2: "nothing", 3: None, 4: ""}
    assert {r.doc_id: r.changed for r in engine.fix(once).collect()}[1] is False


def test_zero_length_and_touching_fixes(spark):
    fixes = F.array(*[F.struct(F.lit(s).alias("start"), F.lit(e).alias("end"), F.lit(r).alias("replacement")) for s, e, r in ((2, 2, "+"), (0, 2, "AB"), (2, 4, "CD"))])
    assert spark.range(1).select(fix.patch(F.lit("abcdef"), fixes).alias("p")).first().p.text == "AB+CDef"


@pytest.mark.parametrize("raw,items,join", [("362(a)", ["362(a)"], "single"), ("1, 2", ["1", "2"], "list"), ("1981-1985", ["1981", "1985"], "span"), ("240.10b-5", ["240.10b-5"], "single"), ("1981–85", ["1981", "85"], "span"), ("1-2, 5", ["1", "2", "5"], "list"), ("1,", ["1,"], "single")])
def test_sections(spark, raw, items, join):
    s = spark.range(1).select(T.sections(F.lit(raw)).alias("s")).first().s
    assert (s["items"], s["join"]) == (items, join)


def test_scalar_functions(spark):
    row = spark.range(1).select(
        T.expand_to(F.lit(371), F.lit("72")).alias("a"), T.expand_to(F.lit(371), F.lit("300")).alias("b"), T.abbreviate_range(F.lit(371), F.lit(372)).alias("c"), T.abbreviate_range(F.lit(99), F.lit(101)).alias("d"),
        T.spacing_variant(F.lit("F.Supp.2d"), F.lit("F. Supp. 2d")).alias("e"), T.spacing_variant(F.lit("F. 3d"), F.lit("F.3d")).alias("f"), T.looks_like_periodical(F.lit("Harv. L. Rev.")).alias("g"),
        T.count_before(F.lit("ab ab ab"), F.lit("ab"), F.lit(6)).alias("h"), T.base_name(F.lit("a:b.docx")).alias("i"), T.base_name(F.lit("")).alias("j"), T.csv_field(F.lit('x"y')).alias("k"),
        T.repair_section_symbols(F.lit("11 U.S.C. 8§ 362 and 88 keys")).alias("l"), T.name_similarity(F.lit("the of"), F.lit("Ames")).alias("m"),
    ).first()
    assert tuple(row) == (372, 300, "72", "101", "tightened", "loosened", True, 2, "a-b", "document", '"x""y"', "11 U.S.C. § 362 and 88 keys", 1.0)


def test_edition_table(spark):
    rows = [("federal", "Reports", {"F.": ("1880-01-01", "1924-12-31"), "F.2d": ("1924-01-01", None)}, {"Fed.": ["F."], "F2d": ["F.2d", "F."], "F.": ["F.2d"], "Zed": ["Q."]}), ("odd", "Other", {"F.": ("1870-01-01", None), "X.": (None, None)}, None)]
    families = spark.createDataFrame(rows, refdata.FAMILY_SCHEMA)
    ed = refdata.edition_table(families)
    got = {r.abbrev: (r.start, r.end, r.ambiguous, r.jurisdiction) for r in ed.collect()}
    assert got == {"F.": (1870, None, True, "specialty"), "F.2d": (1924, None, False, "federal"), "X.": (1600, None, False, "specialty")}
    assert {(r.written, r.canonical) for r in refdata.variation_table(families, ed).collect()} == {("Fed.", "F.")}
    new = ed.filter("abbrev <> 'X.'").withColumn("start", F.when(F.col("abbrev") == "F.2d", 1925).otherwise(F.col("start")))
    assert {(r.abbrev, r.change) for r in refdata.table_changes(ed, new).collect()} == {("X.", "removed"), ("F.2d", "re-dated")}


def test_readers_and_writers(spark, tmp_path):
    text = "Ames v. Bell, 12 F.3d 34.\n§ “quoted” <tag> & é\n{brace} \\ end"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    for kind in writers.FORMATS:
        (tmp_path / f"f.{kind}").write_bytes(bytes(writers.exported(docs, kind).first().content))
    (tmp_path / "old.doc").write_bytes(b"\xd0\xcf\x11\xe0rest")
    (tmp_path / "p.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "bin.dat").write_bytes(bytes(range(256)) * 20)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("x", "y")
    (tmp_path / "z.zip").write_bytes(data.getvalue())
    got = {r.path.rpartition("/")[2]: r for r in readers.read_documents(spark, str(tmp_path)).collect()}
    for kind in sorted(set(writers.FORMATS) - {"pdf"}):
        assert got[f"f.{kind}"].text == text, kind
    for name in ("old.doc", "p.pdf", "f.pdf", "bin.dat", "z.zip"):
        assert got[name].text is None and got[name].error
    assert readers.import_document("none.txt", b"")[1:3] == (None, "the file is empty")


def test_comments_stand_at_their_spans(spark):
    text = "ab\x01cd\nefgh\n"
    notes = [(3, 7, "over <two> lines"), (6, 8, "second"), (8, 10, "next"), (2, 2, "empty"), (5, 99, "too far")]
    assert writers.paragraphs(text, notes) == [[("text", "ab", ()), ("start", 0), ("text", "cd", ())], [("start", 1), ("text", "e", ()), ("end", 0), ("text", "f", ()), ("end", 1), ("start", 2), ("text", "gh", ()), ("end", 2)], []]
    docs = spark.createDataFrame([(1, text), (2, "none"), (3, None)], "doc_id long, text string")
    table = spark.createDataFrame([(1, *n) for n in notes], "doc_id long, start int, end int, body string")
    for kind, part in (("docx", "word/comments.xml"), ("odt", "content.xml")):
        got = {r.doc_id: r.content for r in writers.exported(docs, kind, table).collect()}
        with zipfile.ZipFile(io.BytesIO(bytes(got[1]))) as z:
            assert "over &lt;two&gt; lines" in z.read(part).decode() and "too far" not in z.read(part).decode()
        assert readers.import_document("x", bytes(got[1]))[1] == "abcd\nefgh"
        assert got[3] is None and ("word/comments.xml" in zipfile.ZipFile(io.BytesIO(bytes(got[2]))).namelist()) is False


def letters(text, marks):
    return [(c, frozenset(m.mark for m in marks if m.start <= i < m.end)) for i, c in enumerate(text)]


def test_formatted_texts(spark):
    text = "plain bold both\nnext line"
    marks = [("bold", 6, 12), ("bold", 12, 15), ("italic", 11, 20), ("italic", 3, 3)]
    fixes = [(6, 10, "B"), (11, 15, "longer"), (15, 15, "!"), (16, 20, ""), (25, 25, "?")]
    docs = spark.createDataFrame([(1, text, marks), (2, text, []), (3, text, None)], "doc_id long, text string, marks " + rich.MARKS)
    found = spark.createDataFrame([(d, s, e, r, "safe") for d in (1, 3) for s, e, r in fixes], "doc_id long, fix_start int, fix_end int, replacement string, safety string")
    got = {r.doc_id: r for r in rich.fixed_rich(docs, found).collect()}
    want = [(c, frozenset(m for m, s, e in marks if s <= i < e)) for i, c in enumerate(text)]
    for s, e, r in reversed(fixes):  # letter by letter
        at = s if text[s : s + 1] not in ("", "\n") else s - 1
        want[s:e] = [(c, want[at][1]) for c in r]
    drop = lambda rows: [(c, m if c != "\n" else None) for c, m in rows]
    assert drop(letters(got[1].text, got[1].marks)) == drop(want)
    assert got[1].text == got[3].text and got[3].marks == [] and got[2].text == text and not got[2].changed
    t, m = F.col("text"), F.col("marks")
    at = lambda a, b: (F.lit(a), F.lit(b))
    row = docs.filter("doc_id = 1").select(rich.merged(m).alias("m"), rich.toggled(t, m, "bold", *at(6, 10)).alias("off"), rich.toggled(t, m, "bold", *at(0, 8)).alias("on"), rich.toggled(t, m, "bold", *at(9, 16)).alias("over"), rich.toggled(t, m, "bold", *at(4, 4)).alias("same"), rich.marked_throughout(t, m, "bold", *at(15, 16)).alias("none"), rich.paragraph_offsets(t).alias("p"), rich.rich_html(t, m).alias("h")).first()
    spans = lambda x: [tuple(v) for v in x]
    assert spans(row.m) == [("bold", 6, 15), ("italic", 11, 20)] == spans(row.same)
    assert spans(row.off)[0] == ("bold", 10, 15) and spans(row.on)[0] == ("bold", 0, 15) and spans(row.over)[0] == ("bold", 6, 9) and row.none is False
    assert spans(row.p) == [(0, 15), (16, 25)]
    assert row.h == "<p>plain <strong>bold </strong><strong><em>both</em></strong></p>\n<p><em>next</em> line</p>"


def test_pdf_objects_and_pages():
    for text, pages in (("", 1), ("line (1) \\ é → ž\n" * 100, 3), ("word " * 5000, None), ("w" * 4000, None)):
        data = writers.pdf_document(text)
        start = int(data.rsplit(b"startxref\n", 1)[1].split()[0])
        rows = data[start:].split(b"\n")
        for i in range(1, int(rows[1].split()[1])):
            at = int(rows[2 + i].split()[0])
            assert data[at:].startswith(b"%d 0 obj" % i)
        assert pages is None or data.count(b"/Type /Page ") == pages
    assert all(sum(writers.HELVETICA[c - 32] for c in line) * writers.SIZE / 1000 <= 468 for line in writers.wrapped(b"some words that go on " * 80 + b"x" * 500, 468))
    assert readers.import_document("x.pdf", b"%PDF-1.4", lambda _: ["a" * 120, "b"], lambda _, i: f"scan {i}")[:2] == ("pdf", "a" * 120 + "\n\nscan 1")


def test_feedback_is_bounded(spark):
    text = "First one ended. Then in Doe v. Roe, 526 U.S. 795 the court spoke. Last."
    at = text.index("526")
    rows = [(1, text, at, at + 12, "526 U.S. 795"), (2, "x" * 500 + " 1 U.S. 2 " + "y" * 500, 501, 509, "1 U.S. 2"), (3, "a" * 90, 0, 90, "a" * 90), (4, "", 0, 0, "")]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    found = spark.createDataFrame([(r[0], "ST001", "m", r[4], r[2], r[3]) for r in rows], "doc_id long, rule_id string, message string, citation_text string, start int, end int")
    got = {r.doc_id: r for r in feedback.feedback(docs, found, base="https://t.example/").collect()}
    assert got[1].context == "Then in Doe v. Roe, 526 U.S. 795 the court spoke."
    assert len(got[2].context) <= feedback.MAX_CONTEXT and "1 U.S. 2" in got[2].context
    assert got[3].title == "False positive ST001: " + "a" * 57 + "…" and got[4].title.endswith("(no citation given)")
    assert got[1].link.startswith("https://t.example/issues/new?title=False%20positive") and "+" not in got[1].link


def test_html_and_rtf():
    assert readers.html_text("<html><head><title>t</title></head><p>a <b>b</b><br>c</p><script>x()</script><ul><li>d &amp; e</li></ul>") == "a b\nc\nd & e"
    assert readers.rtf_text(r"{\rtf1{\fonttbl{\f0 Arial;}}{\*\gen x;}a\par b \u233?\'e9 \{c\}\emdash d}") == "a\nb éé {c}—d"


def test_readers_keep_notes_and_foreign_entities():
    assert readers.rtf_text(r"{\rtf1 a{\footnote see 5 U.S. 6}b{\header top}\sect c\_d\~e}") == "asee 5 U.S. 6btop\n\nc\u2011d\u00a0e"
    assert readers.html_text("<p>a &amp; b &eacute; &#167; &#x110000; &amp;lt; &amp</p>") == "a & b &eacute; § &#x110000; &lt; &amp"
    assert readers.decode_entities("&AMP;&#x41;&#66;&copy;") == "&AB&copy;"
    pages = lambda _: ["a" * 120, " "]
    assert readers.import_document("x.pdf", b"%PDF-1.4", pages, lambda _, i: "42 U.S.C. 8§ 1983", "auto")[1].endswith("42 U.S.C. § 1983")
    assert readers.import_document("x.pdf", b"%PDF-1.4", pages, lambda _, i: "scan", "never") == ("pdf", "a" * 120, None, "no text on page 2")


def test_a_file_that_cannot_be_read_is_told(spark):
    def broken(_):
        raise ValueError("no pages")

    files = spark.createDataFrame([("a.pdf", b"%PDF-1.4"), ("b.txt", b"fine"), ("c.txt", b"fine")], "path string, content binary")
    got = {r.path: r for r in readers.imported(files, broken).collect()}
    assert "no pages" in got["a.pdf"].error and got["b.txt"].text == "fine"
    assert sorted((r.path, r.paths) for r in readers.distinct_contents(files).collect()) == [("a.pdf", ["a.pdf"]), ("b.txt", ["b.txt", "c.txt"])]


def test_files_are_read_in_batches_and_equal_ones_once(monkeypatch):
    calls, read = [], readers.import_document
    monkeypatch.setattr(readers, "import_document", lambda path, data, *how: calls.append(path) or read(path, data, *how))
    files = [(f"{i}.docx", writers.docx_document(f"No. {i % 3}")) for i in range(900)] + [("x.html", b"a < b"), ("y.txt", b"a < b"), ("z", None)]
    out = list(readers._reading(None, None, "auto")(iter([pa.RecordBatch.from_arrays([pa.array([p for p, _ in files]), pa.array([d for _, d in files], pa.binary())], ["path", "content"])])))
    rows = [r for b in out for r in b.to_pylist()]
    assert len(out) == 1 and len(calls) == 6
    assert [(r["path"], r["text"]) for r in rows[:900]] == [(f"{i}.docx", f"No. {i % 3}") for i in range(900)]
    assert [(r["format"], r["error"]) for r in rows[900:]] == [("html", None), ("text", None), ("none", "the file is empty")]


def test_archives_are_as_zipfile_reads_them():
    for text in ("", "a", "Ames & Bell\n" * 2000):
        for made in (writers.docx_document(text, [(0, 1, "n")]), writers.odt_document(text, [], [("bold", 0, 1)])):
            with zipfile.ZipFile(io.BytesIO(made)) as z:
                assert z.testzip() is None and all(x.date_time == (1980, 1, 1, 0, 0, 0) for x in z.infolist())
                if z.namelist()[0] == "mimetype":
                    assert z.infolist()[0].compress_type == zipfile.ZIP_STORED and made[38:].startswith(writers.FORMATS["odt"].encode())


def test_plain_archives_are_read_without_zipfile_and_others_by_it(monkeypatch):
    text = "Ames & Bell <so>\n" * 500
    docx = writers.docx_document(text, [(0, 4, "n")], [("bold", 5, 9)])

    def packed(zipped=None, **how):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", **how) as z:
            z.writestr("word/document.xml", readers._part(docx, "word/document.xml"))
            z.comment = zipped or b""
        return out.getvalue()

    plain = [docx, writers.odt_document(text), packed(), packed(compression=zipfile.ZIP_DEFLATED)]
    broken = docx.replace(b"word/document.xml", b"word/dokument.xml", 1)  # the local name alone
    other = [packed(b"a comment"), packed(compression=zipfile.ZIP_BZIP2), b"PK" + docx]
    for data in (*plain, *other):
        assert readers._read("x", data)[1:] == (text.strip(), None)
    for data in (broken, docx[:-1], docx[:100], b"PK", docx[:-22] + docx[-22:].replace(b"PK", b"PQ")):
        assert readers._read("x", data)[0] == "zip"
    changed = bytearray(packed())
    changed[400] ^= 1  # the sum differs
    assert "CRC" in readers._read("x", bytes(changed))[2]
    monkeypatch.setattr(zipfile, "ZipFile", None)
    for data in plain:
        assert readers._read("x", data)[1] == text.strip()


def test_tags_of_parts():
    part = """<?xml version="1.0"?><a:b x="1>2" y='/'/><c d='"'//><e/f="/"><!-- <g> --><![CDATA[<h>]]>i</j ><k l="m>n"""
    assert [x[1:5] for x in readers._TAG.findall(part) if x[2]] == [("", "a:b", """ x="1>2" y='/'""", "/"), ("", "c", """ d='"'/""", "/"), ("", "e", '/f="/"', ""), ("/", "j", " ", "")]


def test_equal_rows_of_a_batch_are_made_once(spark, monkeypatch):
    calls, make = [], writers.docx_document
    monkeypatch.setitem(writers.MAKERS, "docx", lambda *x: calls.append(x) or make(*x))
    rows = [("a", None, '[{"mark":"bold","start":0,"end":1}]'), ("b", '[{"s":0,"e":1,"b":"\\"n\\"\\n"}]', None), (None, None, None), ("b", None, None)] * 5
    monkeypatch.setattr(writers, "SMALL", -1)
    out = writers._files("docx", *(pa.array(x, pa.string()) for x in zip(*rows, strict=True))).to_pylist()
    assert calls == [("a", (), (("bold", 0, 1),)), ("b", ((0, 1, '"n"\n'),), ()), ("b", (), ())]
    assert out == [make(*calls[0]), make(*calls[1]), None, make(*calls[2])] * 5
    marks = [("bold", 0, 1), (None, 1, 2), None, ("italic", None, 2), ("underline", 1, 3)]
    docs = spark.createDataFrame([(1, "a€😀", marks), (2, "b", None), (3, None, [])], "doc_id long, text string, marks " + rich.MARKS)
    notes = spark.createDataFrame([(1, 0, 1, 'n "é"\n\\ 😀'), (1, 1, 2, None), (2, None, 1, "x")], "doc_id long, start int, end int, body string")
    got = {r.doc_id: r.content for r in writers.exported(docs, "docx", notes).collect()}
    assert bytes(got[1]) == make("a€😀", [(0, 1, 'n "é"\n\\ 😀'), (1, 2, "")], [("bold", 0, 1), (None, 1, 2), ("underline", 1, 3)])
    assert bytes(got[2]) == make("b") and got[3] is None


def test_rich_files_deals_equal_texts_to_one_task(spark):
    from citegrid.plans import queries

    files = queries.rich_files(spark, "/root/testdata/sf0.001").filter("path like '%.rtf'").select("text", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(files) < len({r.text for r in files}) + len({r.task for r in files})


def test_marks_in_files():
    text, marks = "Bold é {x}\nplain it\x01alic end", [("bold", 0, 4), ("italic", 18, 25), ("underline", 2, 8)]
    clean = text.replace("\x01", "")
    for make, read in ((writers.docx_document, readers.docx_text), (writers.odt_document, readers.odt_text), (writers.rtf_document, lambda d: readers.rtf_text(d.decode()))):
        assert read(make(text, [], marks)) == clean == read(make(text, []))
    body = readers._part(writers.docx_document(text, [(5, 9, "note")], marks), "word/document.xml")
    assert '<w:rPr><w:b/><w:u w:val="single"/></w:rPr><w:t xml:space="preserve">ld</w:t>' in body and "commentRangeStart" in body
    assert '<text:span text:style-name="TBU">ld</text:span>' in readers._part(writers.odt_document(text, [], marks), "content.xml")
    assert writers.rtf_document(text, [], marks).startswith(b"{\\rtf1\\ansi\\uc1\n{\\b Bo}{\\b\\ul ld}")


def test_rules_that_fail_and_empty_choices(spark):
    docs = spark.createDataFrame([(1, "Id. at 5."), (2, "x" * 50)], "doc_id long, text string")

    def broken(cites):
        raise RuntimeError("boom")

    def unknown_column(cites):
        return cites.select("nowhere")

    engine = Engine(custom=[broken, unknown_column])
    assert [r.rule_id for r in engine.check(docs).collect()] == ["ST001"]
    assert len(engine.notices) == 2 and "broken" in engine.notices[0]
    assert Engine(enable=["VF001"]).check(docs).count() == 0
    no_key = Engine(authorities=spark.range(1))
    assert [r.rule_id for r in no_key.check(docs).collect()] == ["ST001"] and "authorities" in no_key.notices[0]


def test_refused_texts_do_not_look_clean(spark, monkeypatch):
    monkeypatch.setattr(extract, "MAX_CHARS", 20)
    docs = spark.createDataFrame([(1, "Ames v. Bell, 12 F.3d 34 (1999)."), (2, "5 U.S. 6")], "doc_id long, text string")
    found = [(r.doc_id, r.rule_id, r.severity) for r in Engine().check(docs).collect()]
    assert found == [(1, "INPUT", "error")]
    assert {r.doc_id: r.text for r in Engine().fix(docs).collect()}[1].startswith("Ames")


def test_published_list(spark, tmp_path):
    import hashlib
    import json

    years = lambda a, b: {"start": f"{a}-01-01T00:00:00", "end": b and f"{b}-12-31T00:00:00"}
    families = {"Zed.": [{"cite_type": "state", "name": "Zed Reports", "editions": {"Zed.": years(1900, 1950), "Zed. 2d": years(1950, None)}, "variations": {"Zd.": "Zed.", "Zed. 2d": "Zed.", "Zz.": ["Zed.", "Other"], "Gone": "Nowhere"}}]}
    data = json.dumps(families).encode()
    (tmp_path / "list.json").write_bytes(data)
    editions, spellings = refdata.published_reporters(spark, f"{tmp_path}/list.json", hashlib.sha256(data).hexdigest())
    assert sorted((r.abbrev, r.start, r.end) for r in editions.collect()) == [("Zed.", 1900, 1950), ("Zed. 2d", 1950, None)]
    assert [tuple(r) for r in spellings.select("written", "canonical").collect()] == [("Zd.", "Zed.")]
    engine = Engine(editions=editions, spellings=spellings)
    docs = spark.createDataFrame([(1, "Ames v. Bell, 5 Zd. 7 (1960).")], "doc_id long, text string")
    assert sorted(r.rule_id for r in engine.check(docs).collect()) == ["DT001", "RP001"]
    assert refdata.unmatched_annotations(editions).count() == len({*refdata.SCOTUS_ONLY, *refdata.NON_PRECEDENTIAL})
    assert {r.spelt for r in refdata.spellings_of(editions, spellings).collect()} == {"Zed.", "Zed. 2d", "Zd."}
    with pytest.raises(ValueError, match="digest"):
        refdata.published_reporters(spark, f"{tmp_path}/list.json", "0" * 64)


def test_pins_and_docket_numbers(spark):
    texts = ["Ames v. Bell, 12 F.3d 34, 371 n.5 (9th Cir. 1999).", "Ames v. Bell, 12 F.3d 34, 371 & 375 (9th Cir. 1999).", "Ames Corp., Inc. v. Bell, No. 1:22-cv-01461-PKC, 2019 WL 123, at *6 (S.D.N.Y. Oct. 1, 2019).", "Doe v. Roe, Nos. 12-345, 12-346, 2019 WL 124."]
    got = extract.citations(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.pin for r in got] == ["371 n.5", "371 & 375", "at *6", None]
    assert [r.court_id for r in got[:3]] == ["ca9", "ca9", "nysd"] and [r.case_name for r in got[2:]] == ["Ames Corp., Inc. v. Bell", "Doe v. Roe"]
    assert [r.docket for r in got[2:]] == [True, True] and got[2].full_start == 0
    row = spark.range(1).select(T.pin_first(F.lit("371 & n.5")).alias("a"), T.pin_passim(F.lit("Passim")).alias("b"), T.looks_like_periodical(F.lit("Cardozo Law Review")).alias("c"), T.looks_like_periodical(F.lit("J.Corp.")).alias("d"), T.duration_label(F.lit(4123)).alias("e"), T.phases_label(F.array(F.struct(F.lit("read").alias("name"), F.lit(812).alias("ms")), F.struct(F.lit("x").alias("name"), F.lit(0).alias("ms")))).alias("f"), T.chars_per_second(F.lit(900), F.lit(2000)).alias("g"), annotate.redacted(F.lit("Token abc said " + "a" * 40)).alias("h"), annotate.cluster_year(F.lit("1999-02-03")).alias("i"), annotate.looks_like_token(F.lit("a" * 40)).alias("j"), annotate.annotation_comment(F.lit("Ames v. Bell"), F.lit("5"), F.lit("So."), F.lit(None).cast("string"), F.lit("u"), "Src").alias("k")).first()
    assert tuple(row)[:10] == (371, True, True, True, "4.1s", "read 812ms", 450, "Token … said …", 1999, True) and row.k.startswith("Ames v. Bell, at 5\n“So.”\nSrc: u\n")
    parts = annotate.citation_components(extract.citations(spark.createDataFrame([(1, "5 U.S. 6; 1999 WL 7.")], "doc_id long, text string")))
    assert [tuple(r)[2:] for r in parts.collect()] == [("5", "U.S.", "6")]


def test_pages_of_many_digits_are_taken_whole(spark):
    far = "9" * 25
    row = spark.range(1).select(T.pin_first(F.lit("1000005–1000010, 9")).alias("a"), T.pin_first(F.lit(f"1000005, {far}")).alias("b"), T.pin_ranges(F.lit(f"1000005–10, 2000000-2000001, {far}-{far}")).alias("c")).first()
    assert (row["a"], row["b"]) == (9, 1000005)
    assert [(x["from"], x["to"]) for x in row["c"]] == [(1000005, 1000010), (2000000, 2000001), (None, None)]


def test_lookups_read_texts_once(spark):
    """Four times in the plan before, for the keys and the citations and both again for the second notice; exchanges that were reused left three."""
    docs = spark.createDataFrame([(1, "Ames v. Bell, 1 U.S. 100 (1990). Cole v. Dunn, 2 U.S. 200 (1991). Id. Eads v. Foss, 4 U.S. 300 (1992)."), (2, "Ames v. Bell, 1 U.S. 100 (1990)."), (None, "Ames v. Bell, 1 U.S. 100 (1990).")], "doc_id long, text string")
    answers = spark.createDataFrame([("1 U.S. 100", 200, 1), ("2 U.S. 200", 429, 0), ("4 U.S. 300", 200, 1)], "key string, status int, n_clusters int")
    asked = annotate.looked_up(extract.citations(docs), answers, most=2)
    assert sorted((r.doc_id or 0, r.idx, r.status, r.beyond) for r in asked.collect()) == [(0, 0, "unchecked", False), (1, 0, "found", False), (1, 1, "unchecked", False), (1, 2, "unchecked", False), (1, 3, "unchecked", True), (2, 0, "found", False)]
    told = annotate.notices(asked, lookups=2)
    assert told._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted(r.notice[:9] for r in told.filter("doc_id = 1").collect()) == ["1 citatio", "Looked up"]


def test_suggestions_against_all_distances():
    names = [e[0] for e in refdata.EDITIONS]
    ref = extract.Reference([(a, 0) for a in sorted(names)], [], [])
    for token in ("F. Suop.", "N.E.4d", "Call.", "Ohoi St.", "Xyzzy.", "U.S", "Mas. App. Ct."):
        k = extract.squash(token)
        most = 1 if len(k) <= 3 else 2 if len(k) <= 6 else 3
        near = sorted((extract.edit_distance(k, extract.squash(a)), abs(len(k) - len(extract.squash(a))), a) for a in names if abs(len(k) - len(extract.squash(a))) <= most)
        assert ref.suggest(token) == [a for d, _, a in near if 0 < d <= most][:3], token


def test_quotations(spark):
    row = spark.range(1).select(annotate.quote_at_page(annotate.markup_to_text(F.lit('<p>One. <span class="star-pagination">*12</span> Two &amp; three.</p><script>no</script>')), F.lit(12)).alias("q"), annotate.quote_at_page(F.lit("x *123 y"), F.lit(12)).alias("n")).first()
    assert tuple(row) == ("Two & three.", None)


def test_oversized(spark, monkeypatch):
    monkeypatch.setattr(extract, "MAX_CHARS", 20)
    docs = spark.createDataFrame([(1, "Ames v. Bell, 12 F.3d 34 (1999)."), (2, "5 U.S. 6")], "doc_id long, text string")
    assert [r.doc_id for r in extract.oversized(docs).collect()] == [1]
    assert {r.doc_id for r in extract.citations(docs).collect()} == {2}


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "Id. at 5.")], "doc_id long, text string").write.parquet(f"{tmp_path}/in")
    check_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    assert [r.rule_id for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ["ST001"]


def test_hostile_files(spark, tmp_path, monkeypatch):
    html = "<html><p>a&#xD800;b&#55357;&#xDFFF;c &#xE9; &#x1F600;</p>"
    assert readers.html_text(html) == "a\ufffdb\ufffd\ufffdc é \U0001f600"
    assert readers.html_pages(spark.createDataFrame([(1, html)], "page_id long, html string")).first().text == readers.html_text(html)
    monkeypatch.setattr(readers, "MAX_BYTES", 100_000)
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", "<w:t>" + "x" * 5_000_000)
    assert len(packed.getvalue()) < 100_000
    kind, text, error, _ = readers.import_document("bomb.docx", packed.getvalue())
    assert kind == "zip" and text is None and "word/document.xml has more than" in error
    files = spark.createDataFrame([("a.html", bytearray(html.encode())), ("b.pdf", bytearray(b"%PDF-1"))], "path string, content binary")
    got = {r.path: r for r in readers.imported(files, pdf=lambda data: ["bad \ud800 page"]).collect()}
    assert got["a.html"].text and got["b.pdf"].text is None and "cannot be read" in got["b.pdf"].error


def test_labels_name_the_halves_of_the_book():
    assert rules.Profile(21, "practitioner").label == "Bluebook 21st edition, Bluepages (court documents)"
    assert rules.Profile(20, "academic").label == "Bluebook 20th edition, Whitepages (scholarly writing)"
