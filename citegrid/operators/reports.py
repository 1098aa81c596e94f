"""Reports of findings: JSON, CSV and Markdown, one text per document, also for documents without findings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import csv_field, line_col
from .rules import REGISTRY, ordered

CSV_HEADER = "rule,name,severity,citation,start,end,message,suggestion"


@dataclass(frozen=True)
class Provenance:
    """What a report tells about how it was made."""

    tool: str = "citegrid"
    version: str = "0"
    commit: str = "unknown"
    reporter_data: str = "built-in"
    profile: str = "Bluebook 21st edition, Bluepages (court documents)"
    authority: str | None = None


def rule_name(rule: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in REGISTRY for x in pair])
    return F.coalesce(F.try_element_at(names, rule), rule)


def located(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """Ordered findings with line and col."""
    out = ordered(findings).join(docs.select("doc_id", F.col("text").alias("_text")), "doc_id")
    return out.withColumn("_at", line_col(F.col("_text"), F.col("start"))).withColumns({"line": F.col("_at.line"), "col": F.col("_at.col")}).drop("_text", "_at")


_FINDINGS = "array<struct<start:int,rank:int,ruleId:string,ruleName:string,severity:string,citation:string,end:int,message:string,suggestion:string,safety:string>>"
_NOTES = "array<struct<start:int,end:int,citation:string,case_name:string,pin:string,quote:string,note:string,url:string>>"


def reported(names: DataFrame, cites: DataFrame, findings: DataFrame, annotations: DataFrame | None = None) -> DataFrame:
    """(doc_id, name) -> doc_id, name, citations, findings, annotations: all that a report of a document holds.

    findings are ordered by start, severity from high to low, and rule; annotations (doc_id, start,
    end, citation, case_name, pin, quote, note, url) by start. A document without either has empty
    arrays. Names, not texts, are joined: only citations' counts and findings are shuffled.
    """
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    row = F.struct("start", rank.alias("rank"), F.col("rule_id").alias("ruleId"), rule_name(F.col("rule_id")).alias("ruleName"), "severity", F.col("citation_text").alias("citation"), "end", "message", F.col("replacement").alias("suggestion"), "safety")
    found = findings.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).cast(_FINDINGS).alias("findings"))
    counts = cites.filter("kind not in ('unknown', 'refused')").groupBy("doc_id").agg(F.count("*").alias("citations"))
    out = names.join(counts, "doc_id", "left").join(found, "doc_id", "left")
    if annotations is not None:
        notes = annotations.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "citation", "case_name", "pin", "quote", "note", "url"))).cast(_NOTES).alias("annotations"))
        out = out.join(notes, "doc_id", "left")
    else:
        out = out.withColumn("annotations", F.lit(None).cast(_NOTES))
    return out.select("doc_id", "name", F.coalesce("citations", F.lit(0).cast("long")).alias("citations"), F.coalesce("findings", F.array().cast(_FINDINGS)).alias("findings"), F.coalesce("annotations", F.array().cast(_NOTES)).alias("annotations"))


def _line(*fields: Column) -> Column:
    return F.concat_ws(",", *[csv_field(f.cast("string")) for f in fields])


def csv_report(rows: DataFrame) -> DataFrame:
    """doc_id, csv: a line per finding, and one of rule PIN per quotation."""
    finding = lambda x: _line(x["ruleId"], x["ruleName"], x["severity"], x["citation"], x["start"], x["end"], x["message"], x["suggestion"])
    said = lambda x: F.when(x["quote"].isNotNull(), F.concat(x["case_name"], F.lit(", at "), F.coalesce(x["pin"], F.lit("?")), F.lit(": "), x["quote"])).otherwise(F.coalesce(x["note"], F.concat(x["case_name"], F.lit(" — no quotation"))))
    pin = lambda x: _line(F.lit("PIN"), F.lit("pincite-quotation"), F.lit("info"), x["citation"], x["start"], x["end"], said(x), x["url"])
    lines = F.concat(F.array(F.lit(CSV_HEADER)), F.transform("findings", finding), F.transform("annotations", pin))
    return rows.select("doc_id", F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("csv"))


def json_report(rows: DataFrame, about: Provenance = Provenance()) -> DataFrame:
    """doc_id, json: provenance, counts, findings, and annotations where there are any."""
    slim = F.transform("findings", lambda x: F.struct(x["ruleId"].alias("ruleId"), x["ruleName"].alias("ruleName"), x["severity"].alias("severity"), x["citation"].alias("citation"), x["start"].alias("start"), x["end"].alias("end"), x["message"].alias("message"), x["suggestion"].alias("suggestion"), x["safety"].alias("safety")))
    notes = F.when(F.size("annotations") > 0, F.transform("annotations", lambda x: F.struct(x["citation"].alias("citation"), x["case_name"].alias("caseName"), x["pin"].alias("pinCite"), x["start"].alias("start"), x["end"].alias("end"), x["quote"].alias("quotation"), x["note"].alias("note"), x["url"].alias("url"))))
    told = {"tool": about.tool, "version": about.version, "commit": about.commit, "reporterData": about.reporter_data}
    parts = [*[F.lit(v).alias(k) for k, v in told.items()], F.col("name").alias("document"), F.lit(about.profile).alias("bluebook"), F.lit(about.authority).cast("string").alias("authority"), F.col("citations").alias("citations"), slim.alias("findings"), notes.alias("annotations")]
    return rows.select("doc_id", F.concat(F.to_json(F.struct(*parts)), F.lit("\n")).alias("json"))


def markdown_report(rows: DataFrame, about: Provenance = Provenance()) -> DataFrame:
    """doc_id, markdown: what was checked, a table of findings or a word on what their absence means, and quotations."""
    cell = lambda x: F.replace(F.replace(x, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    bullet = lambda label, value: F.concat(F.lit(f"- **{label}:** "), value)
    head = [F.concat(F.lit("# Citation check — "), F.col("name")), F.lit(""), bullet("Checked against", F.lit(about.profile)), bullet("Citations found", F.col("citations").cast("string")), bullet("Findings", F.size("findings").cast("string"))]
    head += [bullet(about.tool, F.lit(f"{about.version} (commit {about.commit})")), bullet("Reporter data", F.lit(about.reporter_data))]
    head += [bullet("Authority check", F.lit(about.authority))] if about.authority else []
    none = F.array(F.lit("No findings. That proves nothing right: only what is"), F.lit("certainly wrong is told, and no citation was verified."), F.lit(""))
    line = lambda x: F.concat(F.lit("| `"), x["ruleId"], F.lit("` | "), x["severity"], F.lit(" | "), cell(x["citation"]), F.lit(" | "), cell(x["message"]), F.lit(" |"))
    table = F.concat(F.array(F.lit("| Rule | Severity | Citation | Problem |"), F.lit("| --- | --- | --- | --- |")), F.transform("findings", line), F.array(F.lit("")))
    part = lambda *xs: F.concat(*[F.coalesce(x, F.lit("")) for x in xs])
    note = lambda x: F.array_compact(
        F.array(
            part(F.lit("### "), x["citation"], F.concat(F.lit(", at "), x["pin"])),
            F.lit(""),
            part(F.lit("*"), x["case_name"], F.lit("*"), F.concat(F.lit(" — <"), x["url"], F.lit(">"))),
            F.lit(""),
            F.concat(F.lit("> "), x["quote"], F.lit("\n")),
            F.concat(x["note"], F.lit("\n")),
        )
    )
    quotes = F.concat(F.array(F.lit("## Pincite quotations"), F.lit("")), F.flatten(F.transform("annotations", note)), F.array(F.lit("A quotation is there to be checked; it does not replace"), F.lit("reading the opinion."), F.lit("")))
    empty = F.array().cast("array<string>")
    lines = F.concat(F.array(*head, F.lit("")), F.when(F.size("findings") == 0, none).otherwise(table), F.when(F.size("annotations") > 0, quotes).otherwise(empty))
    return rows.select("doc_id", F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("markdown"))
