"""Files as a data source: ten formats written and read, commits, and what failing tasks leave."""

import json
import os
import tarfile
import zipfile

import pyarrow as pa
import pytest
from citegrid.operators import reports
from citegrid.sources import datasource, readers, writers
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

MARKED = "doc_id long, text string, marks array<struct<mark:string,start:int,end:int>>, comments array<struct<start:int,end:int,body:string>>, path string"
ROWS = [
    (1, "Ames v. Bell, 12 U.S. 34.\nNext <line> & \"more\" §", [("bold", 0, 12), ("italic", 5, 7)], [(14, 24, "a note"), (None, 2, "x")], "clash"),
    (1, "the same id", None, [], None),
    (None, "no id", [None], None, None),
    (4, None, None, None, None),
    (5, "", None, None, None),
]


@pytest.fixture
def source(spark):
    datasource.register(spark)
    return spark


def files_below(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if not f.startswith((".", "_")))


@pytest.mark.parametrize("kind", sorted(writers.FORMATS))
def test_texts_come_back(source, tmp_path, kind):
    path = str(tmp_path / "out")
    docs = source.createDataFrame(ROWS, MARKED).repartition(3)
    docs.write.format("citegrid").option("format", kind).mode("append").save(path)
    files = files_below(path)
    assert len(files) == 4 and all(f.endswith(f".{kind}") for f in files)
    assert json.load(open(next(os.path.join(path, f) for f in os.listdir(path) if f.startswith("_written")))) == {"format": kind, "files": 4}
    same = {bytes(r.content) for r in writers.exported(docs, kind, docs.select("doc_id", F.inline("comments"))).collect() if r.content is not None}
    if kind not in ("docx", "odt"):  # there a comment goes by doc_id, which repeats here
        assert {open(f, "rb").read() for f in files} == same
    if kind == "pdf":
        return
    back = source.read.format("citegrid").load(path)
    assert back.schema == source.createDataFrame([], readers.SCHEMA).schema
    got = {r.path.rsplit("/", 1)[1].split(".")[0] + "|" + (r.text or "") for r in back.collect()}
    assert got == {"1|" + ROWS[0][1], "1|the same id", "None|no id", "5|"}
    if kind == "docx":
        assert sum("word/comments.xml" in zipfile.ZipFile(f).namelist() for f in files) == 1


@pytest.mark.parametrize("size", [1024, datasource.ARCHIVE_BYTES])
def test_archives_hold_the_same_files(source, tmp_path, size):
    """The same documents, alone and in archives: the same names, bytes and texts, in far fewer files."""
    batch = pa.RecordBatch.from_pylist([{"doc_id": i, "text": f"No. {i}" if i != 7 else None} for i in range(300)])
    for archive in ("false", "true"):
        writer = datasource.FileWriter({"path": str(tmp_path / archive), "format": "docx", "archive": archive}, ["doc_id", "text"], False)
        with pytest.MonkeyPatch.context() as m:
            m.setattr(datasource, "ARCHIVE_BYTES", size)
            writer.commit([writer.write(iter([batch]))])
    alone, packed = (files_below(str(tmp_path / x)) for x in ("false", "true"))
    assert len(alone) == 299 and len(packed) == (299 if size == 1024 else 1)
    got = []
    for path in packed:
        with pa.input_stream(path, compression="zstd") as f, tarfile.open(fileobj=f, mode="r|") as t:
            got += [(m.name, t.extractfile(m).read()) for m in t]
    assert sorted(got) == sorted((os.path.basename(f), open(f, "rb").read()) for f in alone)
    rows = [sorted((r.path.rsplit("/", 1)[1], r.format, r.text, r.error) for r in source.read.format("citegrid").load(str(tmp_path / x)).collect()) for x in ("false", "true")]
    assert rows[0] == rows[1] and len(rows[0]) == 299
    assert source.read.format("citegrid").option("glob", "1?.*").load(str(tmp_path / "true")).count() == 10


def test_a_cut_archive_is_no_short_answer(source, tmp_path):
    writer = datasource.FileWriter({"path": str(tmp_path), "format": "txt", "archive": "true"}, ["doc_id", "text"], False)
    writer.commit([writer.write(iter([pa.RecordBatch.from_pylist([{"doc_id": i, "text": os.urandom(900).hex()} for i in range(50)])]))])
    (path,) = files_below(str(tmp_path))
    data = open(path, "rb").read()
    open(path, "wb").write(data[: len(data) // 2])
    with pytest.raises(PySparkException):
        source.read.format("citegrid").load(str(tmp_path)).collect()


def test_reports_are_files_too(source, tmp_path):
    names = source.createDataFrame([(1, "a"), (2, "b")], "doc_id long, name string")
    empty = lambda schema: source.createDataFrame([], schema)
    rows = reports.reported(names, empty("doc_id long, kind string"), empty("doc_id long, start int, end int, rule_id string, severity string, citation_text string, message string, replacement string, safety string"))
    for kind, made in (("json", reports.json_report(rows)), ("csv", reports.csv_report(rows)), ("report-md", reports.markdown_report(rows))):
        path = str(tmp_path / kind)
        made.toDF("doc_id", "content").write.format("citegrid").option("format", kind).mode("append").save(path)
        want = {r[1] for r in made.collect()}
        assert {open(f).read() for f in files_below(path)} == want and len(files_below(path)) == 2
        assert {r.text for r in source.read.format("citegrid").load(path).collect()} <= want


def test_append_overwrite_and_empty(source, tmp_path):
    path = str(tmp_path / "out")
    docs = lambda *xs: source.createDataFrame([(i, x) for i, x in enumerate(xs)], "doc_id long, text string")
    read = lambda: sorted(r.text for r in source.read.format("citegrid").load(path).collect())
    save = lambda df, mode: df.write.format("citegrid").option("format", "txt").mode(mode).save(path)
    save(docs("a", "b"), "append")
    save(docs("c"), "append")
    assert read() == ["a", "b", "c"]
    save(docs("d"), "overwrite")
    assert read() == ["d"]
    save(docs("x").limit(0), "overwrite")
    assert read() == []
    with pytest.raises(PySparkException, match="NotFound|not found|FileNotFound|No such"):
        source.read.format("citegrid").load(str(tmp_path / "absent")).collect()
    for bad in ({"format": "wpd"}, {"format": "json"}, {}):
        with pytest.raises(PySparkException, match="must be one of|operators.reports"):
            docs("a").write.format("citegrid").options(**bad).mode("append").save(path)


def test_a_failed_task_leaves_no_file(source, tmp_path):
    path = str(tmp_path / "out")
    bad = source.range(0, 400, 1, 4).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 399, F.raise_error(F.lit("broken"))).otherwise("text").alias("text"))
    with pytest.raises(Exception, match="broken"):
        bad.write.format("citegrid").option("format", "docx").mode("append").save(path)
    assert files_below(path) == [] and not [x for x in os.listdir(path) if x.startswith("_")]


def test_attempts_that_do_not_count_leave_no_file(source, tmp_path):
    batches = source.createDataFrame([(1, "one"), (2, "two")], "doc_id long, text string").toArrow().to_batches()
    w = datasource.FileWriter({"path": str(tmp_path), "format": "txt"}, ["doc_id", "text"], False)
    first, second = w.write(iter(batches)), w.write(iter(batches))
    torn = w.write(iter(batches[:1]))  # an attempt that was lost: no message of it arrives
    assert len({first.folder, second.folder, torn.folder}) == 3
    datasource_rows = lambda: source.read.format("citegrid").load(str(tmp_path)).count()
    assert datasource_rows() == 0  # nothing is seen before commit
    w.commit([second, None])
    assert datasource_rows() == 2 and len(files_below(tmp_path)) == 2


def test_folders_are_split(source, tmp_path):
    for i in range(60):
        where = tmp_path / ("a" if i % 3 else "b/c")
        where.mkdir(parents=True, exist_ok=True)
        (where / f"{i}.txt").write_text(f"text {i}")
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "_hidden" / "x.txt").write_text("hidden")
    (tmp_path / "a" / "bad.docx").write_bytes(b"PK\x03\x04 no archive")
    (tmp_path / "a" / "page.html").write_text("<html>&#xD800;</html>")
    reader = datasource.FileReader({"path": str(tmp_path), "splitbytes": "20000"})
    parts = reader.partitions()
    assert len(parts) == sum(-(-sum(min(f.stat().st_size, 1 << 20) + 4096 for f in d.iterdir()) // 20000) for d in (tmp_path / "a", tmp_path / "b" / "c"))
    df = source.read.format("citegrid").option("splitBytes", 20000).load(str(tmp_path))
    rows = df.collect()
    assert df.rdd.getNumPartitions() == len(parts) and len(rows) == 62 and len({r.path for r in rows}) == 62
    plain = {r.path.split(":", 1)[-1].lstrip("/"): (r.format, r.text) for r in readers.read_documents(source, f"{tmp_path}/a").collect()}
    got = {r.path.lstrip("/"): (r.format, r.text) for r in rows}
    assert all(got[k] == v for k, v in plain.items() if k in got) and got[f"{tmp_path}/a/page.html".lstrip("/")][1] == "�"
    assert [r.error is None for r in rows if r.path.endswith("bad.docx")] == [False]
    assert source.read.format("citegrid").option("glob", "1?.txt").load(str(tmp_path)).count() == 10


def page_texts(data):
    return ["first page, long enough" * 9, ""]


def test_pdf_by_the_name_of_an_extractor(source, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1.4 stuff")
    one = lambda **o: source.read.format("citegrid").options(**o).load(str(tmp_path)).collect()[0]
    assert one().error.startswith("PDF needs an extractor")
    assert one(pdf="json:dumps").format == "none"  # a function of another kind: told, not raised
    r = datasource.FileReader({"path": str(tmp_path), "pdf": f"{__name__}:page_texts"})
    batch = next(r.read(r.partitions()[0])).to_pylist()[0]
    assert batch["format"] == "pdf" and batch["warning"] == "no text on page 2"
