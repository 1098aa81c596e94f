"""Runs against a plain version, and against the form with spans."""

import random

from citegrid.operators import rich
from citegrid.operators.fix import patch
from pyspark.sql import functions as F

SCHEMA = "id int, text string, marks array<struct<mark:string,start:int,end:int>>, start int, end int, put string"


def plain_runs(text, marks):
    """By letters: each with its set of marks."""
    ink = [tuple(sorted({m for m, s, e in marks if s <= i < e})) for i in range(len(text))]
    out = []
    for c, k in zip(text, ink, strict=True):
        if out and out[-1][1] == k:
            out[-1] = (out[-1][0] + c, k)
        else:
            out.append((c, k))
    return out


def joined(runs):
    out = []
    for t, k in runs:
        if t and out and out[-1][1] == k:
            out[-1] = (out[-1][0] + t, k)
        elif t:
            out.append((t, k))
    return out


def plain_at(text, marks, at):
    ink = lambda i: tuple(sorted({m for m, s, e in marks if s <= i < e}))
    if at < len(text) and text[at] != "\n":
        return ink(at)
    return ink(at - 1) if 0 < at <= len(text) and text[at - 1] != "\n" else ()


def rows(seed, n):
    r = random.Random(seed)
    out = []
    for i in range(n):
        text = "".join(r.choice("ab\n§😀 ") for _ in range(r.randrange(14)))
        marks = [(r.choice(["bold", "italic", "underline"]), s, s + r.randrange(6)) for s in (r.randrange(len(text) + 2) for _ in range(r.randrange(6)))]
        a = r.randrange(len(text) + 1)
        out.append((i, text, marks, a, a + r.randrange(len(text) - a + 1), r.choice(["", "x", "yy\nz"])))
    return out


def shown(runs):
    return [(x["text"], tuple(x["marks"])) for x in runs]


def test_runs_against_letters(spark):
    data = rows(7, 300)
    df = spark.createDataFrame(data, SCHEMA).withColumn("runs", rich.runs_of(F.col("text"), F.col("marks")))
    run, a, b = F.col("runs"), F.col("start"), F.col("end")
    got = df.select("id", "runs", rich.run_text(run).alias("back"), rich.runs_of(rich.run_text(run), rich.run_marks(run)).alias("again"), rich.slice_runs(run, a, b).alias("cut"), rich.marks_at(run, a).alias("at"), rich.replaced_runs(run, a, b, F.col("put")).alias("new"))
    for r, (i, text, marks, s, e, put) in zip(got.orderBy("id").collect(), data, strict=True):
        whole = plain_runs(text, marks)
        assert (r["id"], shown(r["runs"]), r["back"], shown(r["again"])) == (i, whole, text, whole)
        shifted = lambda lo, hi, marks=marks: [(m, x - lo, y - lo) for m, x, y in marks]
        cut = lambda lo, hi, text=text: plain_runs(text[lo:hi], shifted(lo, hi))
        assert shown(r["cut"]) == cut(s, e)
        assert tuple(r["at"]) == plain_at(text, marks, s)
        assert shown(r["new"]) == joined([*cut(0, s), (put, plain_at(text, marks, s)), *cut(e, len(text))])


def test_edits_of_runs_equal_those_of_spans(spark):
    r = random.Random(3)
    # places three apart, so that no two corrections touch
    data = [(i, t, m, [(s, s + r.randrange(3), r.choice(["", "q", "rs"])) for s in range(r.randrange(3), len(t) + 1, 3) if r.random() < 0.7]) for i, t, m, *_ in rows(11, 200)]
    df = spark.createDataFrame(data, "id int, text string, marks array<struct<mark:string,start:int,end:int>>, fixes array<struct<start:int,end:int,replacement:string>>")
    df = df.withColumn("p", patch(F.col("text"), F.col("fixes")))
    by_spans = rich.runs_of(F.col("p.text"), rich.moved(F.col("text"), F.col("marks"), F.col("p.applied")))
    by_runs = rich.patched_runs(rich.runs_of(F.col("text"), F.col("marks")), F.col("p.applied"))
    got = df.select(by_spans.alias("a"), by_runs.alias("b"), F.size("p.applied").alias("n")).collect()
    assert all(shown(x["a"]) == shown(x["b"]) for x in got) and sum(x["n"] for x in got) > 200


def test_corrections_that_touch_go_from_the_back(spark):
    df = spark.createDataFrame([("ab\n", [("bold", 0, 2)], [(1, 1, "x"), (1, 2, "")])], "text string, marks array<struct<mark:string,start:int,end:int>>, fixes array<struct<start:int,end:int,replacement:string>>")
    got = df.select(rich.patched_runs(rich.runs_of(F.col("text"), F.col("marks")), F.col("fixes")).alias("r")).first()["r"]
    assert shown(got) == [("ax", ("bold",)), ("\n", ())]  # what stands before the place is bold once the letter there is gone


def test_runs_that_lack_something(spark):
    data = [(1, [("a", ["bold", "bold", None]), (None, ["bold"]), ("", ["italic"]), ("b", ["bold"]), ("c", None), ("d", [])]), (2, None), (3, []), (4, [None, ("x", ["u", "i"])])]
    got = spark.createDataFrame(data, f"id int, runs {rich.RUNS}").select("id", rich.merge_runs(F.col("runs")).alias("r"), rich.run_marks(F.col("runs")).alias("m"), rich.run_text(F.col("runs")).alias("t"))
    assert [(shown(x["r"]), [tuple(m) for m in x["m"]], x["t"]) for x in got.orderBy("id").collect()] == [
        ([("ab", ("bold",)), ("cd", ())], [("bold", 0, 2)], "abcd"),
        ([], [], ""),
        ([], [], ""),
        ([("x", ("i", "u"))], [("i", 0, 1), ("u", 0, 1)], "x"),
    ]
    assert spark.range(1).select(rich.runs_of(F.lit(None).cast("string"), F.array().cast(rich.MARKS)).alias("r")).first()["r"] is None


def test_runs_are_merged_once_in_a_correction(spark):
    """A fold inside each look at the text made the plan, and the work of a document, many times as large."""
    runs = spark.createDataFrame([(1, [("ab", ["bold"]), ("c", [])])], f"doc_id long, runs {rich.RUNS}")
    found = spark.createDataFrame([(1, 0, 1, "x", "safe")], "doc_id long, fix_start int, fix_end int, replacement string, safety string")
    out = rich.fixed_runs(runs, found)
    assert out._jdf.queryExecution().analyzed().toString().count("aggregate(") <= 10
    assert shown(out.first()["runs"]) == [("xbc"[:2], ("bold",)), ("c", ())]
