"""Reports on single findings, to be sent to whoever keeps the rules: bounded context, title, text and link."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import span_text

MAX_CONTEXT = 240
MAX_LINK = 6000
TITLE_CHARS = 60
# Titles by the kind of a report.
TITLES = {"false-positive": "False positive", "missed": "Missed citation", "wrong": "Wrong finding", "other": "Report"}
# A stop ends a sentence unless a capital or a letter of its own stands before it, as in U.S. or v.
_STOP = r"(?<![A-Z])(?<!\b[A-Za-z])[.?!][\"”’)]?"


def context_around(text: Column, start: Column, end: Column, most: int = MAX_CONTEXT) -> Column:
    """The sentence around a span, of at most `most` characters, on one line."""
    half = F.floor(F.greatest(F.lit(0), most - (end - start)) / 2).cast("int")
    low, high = F.greatest(F.lit(0), start - half), F.least(F.length(text), end + half)
    before = F.regexp_replace(span_text(text, low, start), rf"(?s)^.*{_STOP}\s+(?=[A-Z“\"(])", "")
    after = span_text(text, end, high)
    sentence = F.regexp_extract(after, rf"(?s)^(.*?{_STOP})(?:\s|\z)", 1)
    whole = F.concat(before, span_text(text, start, end), F.when(sentence != "", sentence).otherwise(after))
    return F.substring(F.trim(F.regexp_replace(whole, r"\s+", " ")), 1, most)


def report_title(kind: Column, rule: Column, citation: Column) -> Column:
    named = F.create_map(*[F.lit(x) for kv in TITLES.items() for x in kv])[kind]
    cite = F.trim(F.regexp_replace(F.coalesce(citation, F.lit("")), r"\s+", " "))
    shown = F.when(cite == "", "(no citation given)").when(F.length(cite) > TITLE_CHARS, F.concat(F.substring(cite, 1, TITLE_CHARS - 3), F.lit("…"))).otherwise(cite)
    return F.concat(F.coalesce(named, F.lit(TITLES["other"])), F.coalesce(F.concat(F.lit(" "), rule), F.lit("")), F.lit(": "), shown)


def issue_link(base: str, title: Column, body: Column, most: int = MAX_LINK) -> Column:
    """A link that opens a new issue with title and body; null where it would be longer than `most`."""
    enc = lambda x: F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))
    link = F.concat(F.lit(base.rstrip("/") + "/issues/new?title="), enc(title), F.lit("&body="), enc(body))
    return F.when(F.length(link) <= most, link)


def feedback(docs: DataFrame, findings: DataFrame, kind: str = "false-positive", base: str | None = None) -> DataFrame:
    """(doc_id, text) and findings -> doc_id, rule_id, start, title, context, body, and link if base names a tracker."""
    rows = findings.select("doc_id", "rule_id", "message", "citation_text", "start", "end").join(docs.select("doc_id", F.col("text").alias("_text")), "doc_id")
    rows = rows.select("doc_id", "rule_id", "start", report_title(F.lit(kind), F.col("rule_id"), F.col("citation_text")).alias("title"), context_around(F.col("_text"), F.col("start"), F.col("end")).alias("context"), "message", "citation_text")
    quote = lambda c: F.concat(F.lit("> "), F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s*\n\s*", " "))
    body = F.concat_ws("\n\n", F.concat(F.lit("### "), "title"), F.concat(F.lit("Rule "), "rule_id", F.lit(":")), quote("message"), F.lit("Citation:"), quote("citation_text"), F.lit("Context:"), quote("context"))
    out = rows.select("doc_id", "rule_id", "start", "title", "context", body.alias("body"))
    return out.withColumn("link", issue_link(base, F.col("title"), F.col("body"))) if base else out
