"""Formatted texts: a text and marks on its spans, so that offsets are those of the plain text. Column expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_escape, span_text
from .fix import corrections, patch

MARKS = "array<struct<mark:string,start:int,end:int>>"
RUNS = "array<struct<text:string,marks:array<string>>>"
TAGS = {"bold": "strong", "italic": "em", "underline": "u"}  # from the outside to the inside


def _mark(mark: Column, start: Column, end: Column) -> Column:
    return F.struct(mark.cast("string").alias("mark"), start.cast("int").alias("start"), end.cast("int").alias("end"))


def _bound(x: Column, use) -> Column:
    """use(x) with x computed once, however often lambdas refer to it."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def merged(marks: Column) -> Column:
    """Marks in order, those of one kind that touch or overlap as one; empty ones and nulls are left out."""
    some = F.array_sort(F.filter(F.coalesce(marks.cast(MARKS), F.array().cast(MARKS)), lambda m: m.isNotNull() & (m["start"] < m["end"])))

    def step(acc: Column, m: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        joins = (F.size(acc) > 0) & (last["mark"] == m["mark"]) & (m["start"] <= last["end"])
        longer = _mark(m["mark"], last["start"], F.greatest(last["end"], m["end"]))
        return F.when(joins, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(acc, F.array(_mark(m["mark"], m["start"], m["end"]))))

    return F.aggregate(some, F.array().cast(MARKS), step)


def _inherited(text: Column, m: Column, at: Column) -> Column:
    """Whether what is put in at a place takes the mark: that of the letter there, or before it at the end of a paragraph."""
    here, before = F.substring(text, at + 1, F.lit(1)), F.substring(text, at, F.lit(1))
    inside = ~here.isin("", "\n")
    return F.when(inside, (m["start"] <= at) & (at < m["end"])).otherwise((at > 0) & (before != "\n") & (m["start"] < at) & (at <= m["end"]))


def moved(text: Column, marks: Column, applied: Column) -> Column:
    """Marks after the applied corrections (in order, without overlaps) of a text; a replacement takes the marks where it lands."""

    def step(now: Column, x: Column) -> Column:
        a, b, size = x["start"], x["end"], F.length(x["replacement"])
        shift = size - (b - a)
        parts = F.transform(
            now,
            lambda m: F.array(
                _mark(m["mark"], m["start"], F.least(m["end"], a)),
                F.when(_inherited(text, m, a), _mark(m["mark"], a, a + size)),
                _mark(m["mark"], F.greatest(m["start"], b) + shift, m["end"] + shift),
            ),
        )
        return F.filter(F.flatten(parts), lambda m: m.isNotNull() & (m["start"] < m["end"]))

    # from the back, so that places to the left still hold
    return merged(F.aggregate(F.reverse(applied), merged(marks), step))


def marked_throughout(text: Column, marks: Column, mark: str, start: Column, end: Column) -> Column:
    """Whether all letters of a span, line breaks aside, have the mark; false for none."""
    letters = F.filter(F.sequence(start, F.greatest(start, end - 1)), lambda i: (i < end) & ~F.substring(text, i + 1, F.lit(1)).isin("", "\n"))
    has = lambda ms, i: F.exists(ms, lambda m: (m["mark"] == mark) & (m["start"] <= i) & (i < m["end"]))
    return (F.size(letters) > 0) & _bound(merged(marks), lambda ms: F.forall(letters, lambda i: has(ms, i)))


def toggled(text: Column, marks: Column, mark: str, start: Column, end: Column) -> Column:
    """Marks with one kind taken off a span that has it throughout, else put on it."""
    cut = F.flatten(F.transform(merged(marks), lambda m: F.when(m["mark"] != mark, F.array(m)).otherwise(F.array(_mark(m["mark"], m["start"], F.least(m["end"], start)), _mark(m["mark"], F.greatest(m["start"], end), m["end"])))))
    added = F.concat(merged(marks), F.array(_mark(F.lit(mark), start, end)))
    return F.when(end <= start, merged(marks)).when(marked_throughout(text, marks, mark, start, end), merged(cut)).otherwise(merged(added))


def paragraph_offsets(text: Column) -> Column:
    """Array of (start, end) of the lines; a line break counts as one place."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, line: Column) -> Column:
        at = F.coalesce(F.get(acc, F.size(acc) - 1)["end"] + 1, F.lit(0))
        return F.concat(acc, F.array(F.struct(at.cast("int").alias("start"), (at + F.length(line)).cast("int").alias("end"))))

    return F.aggregate(F.split(text, "\n"), none, step)


def rich_html(text: Column, marks: Column) -> Column:
    """Paragraphs with nested tags for the marks."""

    def run(ms: Column, cuts: Column, a: Column, i: Column) -> Column:
        b = F.get(cuts, i + 1)
        out = html_escape(span_text(text, a, b))
        for mark, tag in reversed(TAGS.items()):
            has = F.exists(ms, lambda m: (m["mark"] == mark) & (m["start"] <= a) & (a < m["end"]))  # noqa: B023
            out = F.concat(F.when(has, f"<{tag}>").otherwise(""), out, F.when(has, f"</{tag}>").otherwise(""))
        return F.when(b.isNull(), "").otherwise(out)

    def paragraph(ms: Column, p: Column) -> Column:
        inside = F.filter(F.flatten(F.transform(ms, lambda m: F.array(m["start"], m["end"]))), lambda i: (p["start"] < i) & (i < p["end"]))
        cuts = F.array_sort(F.array_distinct(F.concat(F.array(p["start"], p["end"]), inside)))
        return _bound(cuts, lambda c: F.concat(F.lit("<p>"), F.array_join(F.transform(c, lambda a, i: run(ms, c, a, i)), ""), F.lit("</p>")))

    return _bound(merged(marks), lambda ms: F.array_join(F.transform(paragraph_offsets(text), lambda p: paragraph(ms, p)), "\n"))


def fixed_rich(docs: DataFrame, findings: DataFrame, unsafe: bool = False) -> DataFrame:
    """(doc_id, text, marks) and findings -> doc_id, text, marks, applied, skipped, changed: what a plain text accepts, a formatted one does."""
    per = corrections(findings, unsafe).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "replacement")).alias("fixes"))
    out = docs.select("doc_id", "text", F.col("marks").cast(MARKS).alias("marks")).join(per, "doc_id", "left").withColumn("p", patch(F.col("text"), F.col("fixes")))
    return out.select("doc_id", F.col("p.text").alias("text"), moved(F.col("text"), F.col("marks"), F.col("p.applied")).alias("marks"), "p.applied", "p.skipped", "p.changed")


# The same text as runs: an array of (text, marks), the marks by name in order. Line breaks are characters of runs. Prefixes are
# added up by a fold that copies its array, so runs are for thousands of pieces a document, not millions.
_PLACED = "array<struct<text:string,marks:array<string>,start:int,end:int>>"


def _run(text: Column, marks: Column) -> Column:
    return F.struct(text.cast("string").alias("text"), marks.cast("array<string>").alias("marks"))


def _names(marks: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.coalesce(marks.cast("array<string>"), F.array().cast("array<string>")))))


def merge_runs(runs: Column) -> Column:
    """Runs without empty ones, neighbours of equal marks as one. Null runs and texts are left out, null marks are none."""
    some = F.filter(F.coalesce(runs.cast(RUNS), F.array().cast(RUNS)), lambda r: F.coalesce(r["text"], F.lit("")) != "")

    def step(acc: Column, r: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        joins = (F.size(acc) > 0) & (last["marks"] == r["marks"])
        return F.when(joins, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(_run(F.concat(last["text"], r["text"]), r["marks"])))).otherwise(F.concat(acc, F.array(r))).cast(RUNS)

    return F.aggregate(F.transform(some, lambda r: _run(r["text"], _names(r["marks"]))).cast(RUNS), F.array().cast(RUNS), step)


def _placed(merged_runs: Column) -> Column:

    def step(acc: Column, r: Column) -> Column:
        at = F.coalesce(F.get(acc, F.size(acc) - 1)["end"], F.lit(0))
        return F.concat(acc, F.array(F.struct(r["text"].alias("text"), r["marks"].alias("marks"), at.alias("start"), (at + F.length(r["text"])).alias("end")))).cast(_PLACED)

    return F.aggregate(merged_runs, F.array().cast(_PLACED), step)


def placed_runs(runs: Column) -> Column:
    """Merged runs with start and end, their places in the text."""
    return _placed(merge_runs(runs))


def runs_of(text: Column, marks: Column) -> Column:
    """A text and marks on its spans as merged runs; an empty text has none, a null one gives null. Marks beyond the text end with it."""
    size = F.length(text)

    def cut(ms: Column) -> Column:
        edges = F.filter(F.flatten(F.transform(ms, lambda m: F.array(m["start"], m["end"]))), lambda p: (F.lit(0) < p) & (p < size))
        cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0), size), edges)))
        inked = lambda a: F.transform(F.filter(ms, lambda m: (m["start"] <= a) & (a < m["end"])), lambda m: m["mark"])
        return _bound(cuts, lambda c: F.transform(F.slice(c, 1, F.size(c) - 1), lambda a, i: _run(span_text(text, a, F.get(c, i + 1)), _names(inked(a)))))

    return F.when(text.isNotNull(), merge_runs(_bound(merged(marks), cut)))


def run_text(runs: Column) -> Column:
    return F.array_join(F.transform(F.coalesce(runs.cast(RUNS), F.array().cast(RUNS)), lambda r: r["text"]), "")


def run_marks(runs: Column) -> Column:
    """Marks on spans of run_text(): with it, runs_of() gives the merged runs again, and loses nothing of merged marks."""
    return merged(F.flatten(F.transform(placed_runs(runs), lambda r: F.transform(r["marks"], lambda m: _mark(m, r["start"], r["end"])))))


def _sliced(placed: Column, start: Column, end: Column) -> Column:
    inside = F.filter(placed, lambda r: (r["start"] < end) & (start < r["end"]))
    return F.transform(inside, lambda r: _run(span_text(r["text"], F.greatest(start - r["start"], F.lit(0)), F.least(end, r["end"]) - r["start"]), r["marks"])).cast(RUNS)


def slice_runs(runs: Column, start: Column, end: Column) -> Column:
    """The runs of [start, end) of the text; none where that is empty."""
    return F.when(start < end, _sliced(placed_runs(runs), start, end)).otherwise(F.array().cast(RUNS))


def _marks_at(placed: Column, at: Column) -> Column:
    here = F.get(F.filter(placed, lambda r: (r["start"] <= at) & (at < r["end"])), F.lit(0))
    before = F.get(F.filter(placed, lambda r: (r["start"] < at) & (at <= r["end"])), F.lit(0))
    letter = lambda r, p: F.substring(r["text"], p - r["start"] + 1, F.lit(1))
    ends = here["text"].isNull() | (letter(here, at) == "\n")
    opens = before["text"].isNull() | (letter(before, at - 1) == "\n")
    return F.coalesce(F.when(~ends, here["marks"]).when(~opens, before["marks"]), F.array().cast("array<string>"))


def marks_at(runs: Column, at: Column) -> Column:
    """The marks that a text put in at a place takes: those of the letter there, or, at the end of a paragraph, before it."""
    return _bound(placed_runs(runs), lambda p: _marks_at(p, at))


def _replaced(merged_runs: Column, start: Column, end: Column, replacement: Column) -> Column:
    far = F.lit((1 << 31) - 1)

    def made(p: Column) -> Column:
        return F.concat(_sliced(p, F.lit(0), start), F.array(_run(replacement, _marks_at(p, start))).cast(RUNS), _sliced(p, end, far))

    return merge_runs(_bound(_placed(merged_runs), made))


def replaced_runs(runs: Column, start: Column, end: Column, replacement: Column) -> Column:
    """Merged runs with [start, end) replaced by a text that takes the marks at its start."""
    return _replaced(merge_runs(runs), start, end, replacement)


def _patched(merged_runs: Column, applied: Column) -> Column:
    return F.aggregate(F.reverse(applied), merged_runs, lambda now, x: _replaced(now, x["start"], x["end"], x["replacement"]).cast(RUNS))


def patched_runs(runs: Column, applied: Column) -> Column:
    """Runs after the applied corrections (in order, without overlaps), from the back, so that places to the left still hold."""
    return _patched(merge_runs(runs), applied)


def fixed_runs(docs: DataFrame, findings: DataFrame, unsafe: bool = False) -> DataFrame:
    """(doc_id, runs) and findings on their text -> doc_id, runs, applied, skipped, changed: as fixed_rich() does on spans.

    Corrections that touch go from the back, too: each takes the marks at its start in what the later ones left.
    """
    per = corrections(findings, unsafe).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "replacement")).alias("fixes"))
    out = docs.select("doc_id", merge_runs(F.col("runs")).alias("runs")).join(per, "doc_id", "left")
    # a patch looks at the text many times: it is a column of its own, not an expression inside each look
    out = out.withColumn("_text", run_text(F.col("runs"))).withColumn("p", patch(F.col("_text"), F.col("fixes")))
    return out.select("doc_id", F.when(F.col("p.changed"), _patched(F.col("runs"), F.col("p.applied"))).otherwise(F.col("runs")).alias("runs"), "p.applied", "p.skipped", "p.changed")
