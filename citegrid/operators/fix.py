"""Corrections: which of them hold, and the text they give. One fold per document, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import span_text

_FIX = "array<struct<start:int,end:int,replacement:string>>"
_SKIP = "array<struct<start:int,end:int,replacement:string,reason:string>>"


def corrections(findings: DataFrame, unsafe: bool = False) -> DataFrame:
    """(doc_id, start, end, replacement) of the findings' fixes: the safe ones, or all."""
    out = findings.filter("replacement is not null")
    out = out if unsafe else out.filter("safety = 'safe'")
    return out.select("doc_id", F.col("fix_start").alias("start"), F.col("fix_end").alias("end"), "replacement")


def patch(text: Column, fixes: Column) -> Column:
    """Struct (text, applied, skipped, changed) of a text and an array of (start, end, replacement).

    In order of start and end a correction is skipped if it ends past the text, changes nothing
    or overlaps one accepted before; only the last accepted with any length can overlap.
    """
    typed = F.coalesce(fixes.cast(_FIX), F.array().cast(_FIX))
    none = F.struct(F.array().cast(_FIX).alias("applied"), F.array().cast(_SKIP).alias("skipped"), F.lit(-1).alias("s"), F.lit(-1).alias("e"))

    def step(acc: Column, x: Column) -> Column:
        reason = (
            F.when(x["end"] > F.length(text), "span extends past end of document")
            .when(span_text(text, x["start"], x["end"]) == x["replacement"], "replacement is identical to source")
            .when((acc["s"] < x["end"]) & (x["start"] < acc["e"]) & (x["start"] < x["end"]), F.concat(F.lit("overlaps an earlier fix at ["), acc["s"].cast("string"), F.lit(", "), acc["e"].cast("string"), F.lit(")")))
        )
        ok = reason.isNull()
        long = ok & (x["start"] < x["end"])
        skip = F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"), x["replacement"].alias("replacement"), reason.alias("reason")))
        return F.struct(
            F.when(ok, F.concat(acc["applied"], F.array(x))).otherwise(acc["applied"]).alias("applied"),
            F.when(ok, acc["skipped"]).otherwise(F.concat(acc["skipped"], skip)).alias("skipped"),
            F.when(long, x["start"]).otherwise(acc["s"]).alias("s"),
            F.when(long, x["end"]).otherwise(acc["e"]).alias("e"),
        )

    chosen = F.aggregate(F.array_sort(typed), none, step)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    built = F.aggregate(
        chosen["applied"],
        start,
        lambda acc, x: F.struct(F.concat(acc["out"], span_text(text, acc["at"], x["start"]), x["replacement"]).alias("out"), x["end"].alias("at")),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return F.struct(built.alias("text"), chosen["applied"].alias("applied"), chosen["skipped"].alias("skipped"), (F.size(chosen["applied"]) > 0).alias("changed"))


def fixed(docs: DataFrame, findings: DataFrame, unsafe: bool = False) -> DataFrame:
    """(doc_id, text) and findings -> doc_id, text, applied, skipped, changed; documents without fixes stay as they are."""
    per = corrections(findings, unsafe).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "replacement")).alias("fixes"))
    return docs.join(per, "doc_id", "left").select("doc_id", patch(F.col("text"), F.col("fixes")).alias("p")).select("doc_id", "p.*")
