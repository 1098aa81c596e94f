"""Queries over the driver's tables, each with SQL for the same rows.

The tables hold no citations, so briefs are written from the columns of orders; the SQL takes
the expected rows from the columns alone and shares no pattern with the engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import refdata
from ..engine import Engine
from ..functions import text as T
from ..operators import annotate, extract, feedback, fix, reports, resolve, rich, rules, spans, suggest
from ..sources import datasource, readers, writers
from ..stored import folder, stored
from .graded import GRADED

Y = "year(o_orderdate)"
REPORTERS = ["U.S.", "F.3d", "F. Supp. 2d", "S. Ct."]
_PICK = "CASE o_orderkey % 4 " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(REPORTERS)) + " END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def briefs(spark: SparkSession, sf_dir: str, *parts: str) -> DataFrame:
    """One text per order: SQL expressions over its columns, joined. The small file is dealt out, as parsing is CPU work."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate").repartition(spark.sparkContext.defaultParallelism)
    return orders.select(F.col("o_orderkey").alias("doc_id"), F.expr(f"concat({', '.join(parts)})").alias("text"))


def _s(x: str) -> str:
    return "'" + x.replace("'", "\\'") + "'"


def _cites(parts: list[str], columns: str, keep: str | None = None):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = extract.citations(briefs(spark, sf_dir, *parts))
        return (out.filter(keep) if keep else out).selectExpr(*columns.split("; "))

    return query


EXTRACTION = {
    "extract_case": (_cites([_s("See Ames v. Bell, "), "o_orderkey % 900 + 1", _s(" "), _PICK, _s(" "), "o_custkey % 9000 + 1", _s(" ("), Y, _s(").")], "doc_id; volume; canonical; page; year; case_name"), f"SELECT o_orderkey AS doc_id, CAST(o_orderkey % 900 + 1 AS VARCHAR) AS volume, {_PICK} AS canonical, CAST(o_custkey % 9000 + 1 AS VARCHAR) AS page, CAST({Y} AS INT) AS year, 'Ames v. Bell' AS case_name FROM orders"),
    "extract_statute": (_cites([_s("under "), "o_orderkey % 50 + 1", _s(" U.S.C. §§ "), "o_custkey", _s("(a), "), "o_custkey + 1", _s(".")], "doc_id; volume; symbol; sections"), "SELECT o_orderkey AS doc_id, CAST(o_orderkey % 50 + 1 AS VARCHAR) AS volume, '§§' AS symbol, o_custkey || '(a), ' || (o_custkey + 1) AS sections FROM orders"),
    "extract_database": (_cites([_s("Ames v. Bell, "), Y, _s(" WL "), "o_custkey", _s(" (Tex. App. Sept. 25, "), Y, _s(").")], "doc_id; year; database; court_id; court_text; resource_key"), f"SELECT o_orderkey AS doc_id, CAST({Y} AS INT) AS year, 'WL' AS database, 'texapp' AS court_id, 'Tex. App.' AS court_text, {Y} || ' WL ' || o_custkey AS resource_key FROM orders"),
    "extract_neutral": (_cites([_s("In Ames v. Bell, "), Y, _s(" IL App (1st) "), "o_custkey", _s("-U (Ill. App. Ct. "), Y, _s("), it")], "doc_id; year; neutral_body; court_id"), f"SELECT o_orderkey AS doc_id, CAST({Y} AS INT) AS year, 'IL App (1st) ' || o_custkey || '-U' AS neutral_body, 'illapp' AS court_id FROM orders"),
    "extract_short_form": (_cites([_s("Ames v. Bell, 5 U.S. 100 (1990). Then 5 U.S. at "), "o_custkey % 900 + 100", _s(" says")], "doc_id; idx; pin; resource_key", "kind = 'short-form'"), "SELECT o_orderkey AS doc_id, CAST(1 AS INT) AS idx, CAST(o_custkey % 900 + 100 AS VARCHAR) AS pin, '5 U.S. 100' AS resource_key FROM orders"),
    "short_form_resolution": (_cites([_s("Ames v. Bell, 5 U.S. 100 (1990). "), "if(o_orderkey % 2 = 0, 'Cole v. Dunn, 6 F.3d 200 (9th Cir. 1995). ', '')", _s("Then 6 F.3d at 210.")], "doc_id; coalesce(resource_key, 'none') AS resource_key", "kind = 'short-form'"), "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN '6 F.3d 200' ELSE 'none' END AS resource_key FROM orders"),
    "id_resolution": (_cites(["if(o_orderkey % 3 = 0, 'Id. at 4. ', '')", _s("Ames v. Bell, "), "o_custkey % 900 + 1", _s(" U.S. 100 (1990). Id. at 101.")], "doc_id; idx; coalesce(resource_key, 'none') AS resource_key", "kind = 'id'"), "SELECT o_orderkey AS doc_id, CAST(0 AS INT) AS idx, 'none' AS resource_key FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END, (o_custkey % 900 + 1) || ' U.S. 100' FROM orders"),
    "supra_resolution": (_cites([_s("Ames Corp. v. Bell, 5 U.S. 100 (1990). Cole v. Dunn, 6 F.3d 200 (9th Cir. 1995). As in "), "if(o_orderkey % 2 = 0, 'Ames Corp.', 'Ghost Corp.')", _s(", supra.")], "doc_id; coalesce(resource_key, 'none') AS resource_key", "kind = 'supra'"), "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN '5 U.S. 100' ELSE 'none' END AS resource_key FROM orders"),
    "parallel_groups": (_cites([_s("Ames v. Bell, 525 U.S. 155, "), "if(o_orderkey % 2 = 0, '161, ', '')", _s("119 S. Ct. 662, 142 L. Ed. 2d 576 ("), Y, _s("). Cole v. Dunn, 6 F.3d "), "o_custkey % 900 + 1", _s(" (9th Cir. 1995).")], "doc_id; idx; coalesce(parallel_of, -1) AS parallel_of; resource_key; coalesce(pin, '') AS pin"), "SELECT o_orderkey AS doc_id, CAST(i AS INT) AS idx, CAST(CASE WHEN i IN (1, 2) THEN 0 ELSE -1 END AS INT) AS parallel_of, CASE WHEN i < 3 THEN '525 U.S. 155' ELSE '6 F.3d ' || (o_custkey % 900 + 1) END AS resource_key, CASE WHEN i = 0 AND o_orderkey % 2 = 0 THEN '161' ELSE '' END AS pin FROM orders, (VALUES (0), (1), (2), (3)) v(i)"),
    "canonical_reporter": (_cites([_s("Ames v. Bell, 12 "), "CASE o_orderkey % 3 WHEN 0 THEN 'F.Supp.2d' WHEN 1 THEN 'Fed. Rep.' ELSE 'Sup. Ct.' END", _s(" 34 (1990).")], "doc_id; reporter; canonical"), "SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'F.Supp.2d' WHEN 1 THEN 'Fed. Rep.' ELSE 'Sup. Ct.' END AS reporter, CASE o_orderkey % 3 WHEN 0 THEN 'F. Supp. 2d' WHEN 1 THEN 'F.' ELSE 'S. Ct.' END AS canonical FROM orders"),
    "citation_index": (_cites(["if(o_orderkey % 2 = 0, '42 U.S.C. § 1983. ', '')", _s("Ames v. Bell, 5 U.S. 100 (1990); Cole v. Dunn, 1999 WL 77; 12 Main Street 45; Id.")], "doc_id; idx; kind"), "SELECT o_orderkey AS doc_id, CAST(i + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS INT) AS idx, k AS kind FROM orders, (VALUES (0, 'case-reporter'), (1, 'database'), (2, 'id')) v(i, k) UNION ALL SELECT o_orderkey, 0, 'statute' FROM orders WHERE o_orderkey % 2 = 0"),
}

# rule -> (parts of the brief, severity in SQL, replacement in SQL, condition in SQL)
_EVEN = "o_orderkey % 2 = 0"
_A = "Ames v. Bell, "
_VOLUME, _PAGE = "o_orderkey % 9000 + 1", "o_orderkey div 9000 + 34"  # together they tell orders apart
_KEY = f"concat({_VOLUME}, ' U.S. ', {_PAGE}) AS key"
RULES = {
    "RP001": ([_s(_A + "12 "), f"if({_EVEN}, 'F.Supp.2d', 'F. Supp. 2d')", _s(" 34 (D.D.C. "), Y, _s(").")], "'info'", "'12 F. Supp. 2d 34'", _EVEN),
    "RP002": ([_s(_A + "12 "), "CASE o_orderkey % 4 WHEN 0 THEN 'F. Suop.' WHEN 1 THEN 'F. Supp.' WHEN 2 THEN 'F. Suop.' ELSE 'Cal. 4th' END", _s(" 34 (1995); 7 N.E.3d 300 (2015); 64 U. Pitt. L. Rev. 639 (2003).")], "'error'", "'F. Supp.'", _EVEN),
    "RP003": ([_s(_A + "1 "), f"if({_EVEN}, 'F.Supp.', 'F. Supp.')", _s(" 2 (D.D.C. 1980). Cole v. Dunn, 3 F. Supp. 4 (D.D.C. 1981).")], "'warning'", "''", _EVEN),
    "DT001": ([_s(_A), "o_orderkey % 900 + 1", f"if({_EVEN}, ' F.2d ', ' F.3d ')", "o_custkey % 900 + 1", _s(" (9th Cir. "), Y, _s(").")], "'error'", "(o_orderkey % 900 + 1) || ' F.3d ' || (o_custkey % 900 + 1)", _EVEN),
    "DT002": ([_s(_A + "12 F.3d 34 (9th Cir. "), f"{Y} + 30", _s(").")], "'error'", "''", f"{Y} + 30 > 2026"),
    "CT001": ([_s(_A + "12 F.3d 34 ("), f"if({_EVEN}, 'Ninth Circuit', '9th Cir.')", _s(" 1999).")], "'info'", "'9th Cir.'", _EVEN),
    "CT002": ([_s(_A + "12 U.S. 34 ("), f"if({_EVEN}, '9th Cir. ', '')", _s("1999).")], "'error'", "''", _EVEN),
    "CT003": ([_s(_A + "12 F.2d 34 (11th Cir. "), "1971 + o_orderkey % 20", _s(").")], "'warning'", "''", "1971 + o_orderkey % 20 < 1981"),
    "CT004": ([_s(_A + "12 N.J. Super. 34 ("), f"if({_EVEN}, 'App. Div.', 'N.J. Super. Ct. App. Div.')", _s(" 1999).")], "'info'", "''", _EVEN),
    "CT005": ([_s(_A + "12 U.S. 34 ("), f"if({_EVEN}, 'U.S. ', '')", _s("1999).")], "'info'", "''", _EVEN),
    "CT006": ([_s(_A + "12 N.E.2d 34 ("), f"if({_EVEN}, 'Ill. Appellate Ct.', 'Ill. App. Ct.')", _s(" 1999).")], "'warning'", "'Ill. App. Ct.'", _EVEN),
    "ST001": ([f"if({_EVEN}, 'Id. at 5. ', '')", _s(_A + "12 F.3d 34 (9th Cir. 1999). Id. at 36.")], "'error'", "''", _EVEN),
    "ST002": ([_s(_A + "12 F.3d 100, "), "90 + o_orderkey % 20", _s(" (9th Cir. 1999).")], "'warning'", "''", "90 + o_orderkey % 20 < 100"),
    "ST003": ([_s(_A + "12 F.3d 100, 371-"), f"if({_EVEN}, '372', '72')", _s(" (9th Cir. 1999).")], "'info'", "''", _EVEN),
    "ST004": ([_s(_A + "12 F.3d 100, 371-"), "o_orderkey % 200 + 300", _s(" (9th Cir. 1999).")], "'warning'", "''", "o_orderkey % 200 + 300 < 371"),
    "ST005": ([_s(_A + "5 U.S. 100 (1990). 5 U.S. at 101"), f"if({_EVEN}, ' (1990).', '.')"], "'warning'", "''", _EVEN),
    "ST006": ([_s("11 U.S.C. § "), "o_custkey", f"if({_EVEN}, ', 9999.', '.')"], "'warning'", "'§§'", _EVEN),
    "ST007": ([_s("42 U.S.C. §§ 1981-"), f"if({_EVEN}, '85', '1985')", _s(".")], "'warning'", "''", _EVEN),
    "AU001": (["CASE o_orderkey % 3 WHEN 0 THEN 'Ames v. Bell, 2013 IL App (1st) 111279-U.' WHEN 1 THEN 'Ames v. Bell, 5 F. App\\'x 6 (9th Cir. 2003).' ELSE 'Ames v. Bell, 12 F.3d 34 (9th Cir. 1999).' END"], "CASE o_orderkey % 3 WHEN 0 THEN 'error' ELSE 'warning' END", "''", "o_orderkey % 3 < 2"),
    "AU002": (["CASE o_orderkey % 4 WHEN 1 THEN 'Held so, No. 12-345, 2019 WL 123' WHEN 3 THEN 'Ames v. Bell, Inc., No. 15-2994, 2019 WL 123, at *6 (7th Cir. Oct. 12, 2019)' ELSE 'Held so, 2019 WL 123' END", _s(". Ames v. Bell, 925 F.3d 1339, 2019 WL 4639462 (11th Cir. 2019).")], "'warning'", "''", _EVEN),
    "VF001": ([_s(_A), _VOLUME, _s(" U.S. "), _PAGE, _s(" (1999).")], "'warning'", "''", "o_orderkey % 3 = 0"),
    "VF002": ([_s(_A), _VOLUME, _s(" U.S. "), _PAGE, _s(" (1999).")], "'warning'", "''", "o_orderkey % 3 = 1 AND o_orderkey % 2 = 0"),
    "VF003": ([_s(_A), _VOLUME, _s(" U.S. "), _PAGE, _s(" (1999).")], "'error'", "''", "o_orderkey % 3 = 2 AND o_orderkey % 5 = 0"),
    "VF004": ([_s(_A), _VOLUME, _s(" U.S. "), _PAGE, _s(" (1999).")], "'warning'", "''", "o_orderkey % 3 > 0 AND NOT (o_orderkey % 3 = 1 AND o_orderkey % 2 = 0) AND o_orderkey % 7 = 0"),
}


def authorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An authority for two thirds of the orders, two for some, with other names and years for others."""
    rows = table(spark, sf_dir, "orders").filter("o_orderkey % 3 > 0")
    one = rows.selectExpr(_KEY, "if(o_orderkey % 3 = 2 AND o_orderkey % 5 = 0, 'Zeta v. Omega', 'Ames v. Bell') AS case_name", "if(o_orderkey % 7 = 0, 1987, 1999) AS year", "'scotus' AS court_id", "cast(null AS string) AS url")
    return one.unionByName(one.join(rows.filter("o_orderkey % 3 = 1 AND o_orderkey % 2 = 0").selectExpr(_KEY), "key", "left_semi"))


# rule -> in SQL: what the finding spans, its message, what the correction spans, its safety
_CITE = f"({_VOLUME}) || ' U.S. ' || ({_PAGE.replace(' div ', ' // ')})"
DETAILS = {
    "RP001": ("'12 F.Supp.2d 34'", "'\"F.Supp.2d\" runs together what Bluebook 20th edition, Bluepages (court documents) writes apart: \"F. Supp. 2d\".'", "'12 F.Supp.2d 34'", "safe"),
    "RP002": ("'12 F. Suop. 34'", "'No reporter is called \"F. Suop.\"; the nearest name is \"F. Supp.\".'", "'F. Suop.'", "unsafe"),
    "RP003": ("'1 F.Supp. 2'", "'One document, 2 spellings of \"F. Supp.\": \"F.Supp.\", \"F. Supp.\".'", None, None),
    "DT001": ("(o_orderkey % 900 + 1) || ' F.2d ' || (o_custkey % 900 + 1)", f"'F.2d was published 1924–1993, but this cites ' || {Y} || '. A ' || {Y} || ' case in this series would be in \"F.3d\".'", "(o_orderkey % 900 + 1) || ' F.2d ' || (o_custkey % 900 + 1)", "unsafe"),
    "DT002": ("'12 F.3d 34'", f"'The year ' || ({Y} + 30) || ' is yet to come; the check is made for 2026.'", None, None),
    "CT001": ("'Ninth Circuit'", "'Court is written \"Ninth Circuit\"; the standard abbreviation is \"9th Cir.\".'", "'Ninth Circuit'", "unsafe"),
    "CT002": ("'12 U.S. 34'", "'A volume of \"U.S.\" holds cases of the Supreme Court of the United States only, not of United States Court of Appeals for the Ninth Circuit.'", None, None),
    "CT003": ("'12 F.2d 34'", "'No case of ' || (1971 + o_orderkey % 20) || ' can be by United States Court of Appeals for the Eleventh Circuit, a court of 1981–present.'", None, None),
    "CT004": ("'App. Div.'", "'Several courts go by \"App. Div.\": New York Supreme Court, Appellate Division or New Jersey Superior Court, Appellate Division. Say which.'", None, None),
    "CT005": ("'U.S. 1999'[:4]", "'\"U.S.\" covers one court only, so rule 10.4(a) asks for the year alone.'", "'U.S. 1999'[:5]", "safe"),
    "CT006": ("'Ill. Appellate Ct.'", "'The standard abbreviation for \"Ill. Appellate Ct.\" is \"Ill. App. Ct.\", with fewer words spelt out.'", "'Ill. Appellate Ct.'", "unsafe"),
    "ST001": ("'Id. at 5'", "'An `Id.` citation (\"Id. at 5\") has no full citation before it. The first citation of an authority is a full one.'", None, None),
    "ST002": ("'12 F.3d 100'", "'Pin cite ' || (90 + o_orderkey % 20) || ' is before page 100, where the opinion starts.'", None, None),
    "ST003": ("'12 F.3d 100'", "'Pages 371-372 are 371-72 by rule 3.2(a): two digits, and those that differ.'", None, None),
    "ST004": ("'12 F.3d 100'", "'Pages 371-' || (o_orderkey % 200 + 300) || ' run backwards.'", None, None),
    "ST005": ("'5 U.S. at 101'", "'The date belongs to the full citation (B10.2), but \"5 U.S. at 101\" gives 1990 again.'", None, None),
    "ST006": ("'§'", "'\"11 U.S.C. § ' || o_custkey || ', 9999\": 2 sections ask for \"§§\" (rule 3.3(b)).'", "'§'", "safe"),
    "ST007": ("'42 U.S.C. §§ 1981-85'", "'Sections 1981-85 are 1981-1985 in full: by rule 3.3(b), unlike 3.2(a) for pages, no digit goes.'", None, None),
    "AU001": ("CASE o_orderkey % 3 WHEN 0 THEN '2013 IL App (1st) 111279-U' ELSE '5 F. App''x 6' END", "CASE o_orderkey % 3 WHEN 0 THEN '\"2013 IL App (1st) 111279-U\" carries \"-U\", the mark of an unpublished order without the force of a precedent.' ELSE '\"5 F. App''x 6\" is in Federal Appendix, whose dispositions are unpublished and do not bind.' END", None, None),
    "AU002": ("'2019 WL 123'", "'\"2019 WL 123\" is a WL database number with no reporter citation. Add the reporter cite, or say the case is unreported.'", None, None),
    "VF001": (_CITE, f"'\"' || {_CITE} || '\" does not appear in the caller corpus. Make sure that it exists.'", None, None),
    "VF002": (_CITE, f"'\"' || {_CITE} || '\" fits more than one authority (Ames v. Bell; Ames v. Bell). A court or a year would tell them apart.'", None, None),
    "VF003": (_CITE, f"'\"' || {_CITE} || '\" is \"Zeta v. Omega\", not \"Ames v. Bell\".'", None, None),
    "VF004": (_CITE, "'The corpus gives ' || CASE WHEN o_orderkey % 3 = 2 AND o_orderkey % 5 = 0 THEN 'Zeta v. Omega' ELSE 'Ames v. Bell' END || ' the year 1987, the text 1999.'", None, None),
}


def _rule(rule: str):
    parts = RULES[rule][0]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        profile = rules.Profile(edition=20 if rule in ("RP001", "RP003") else 21)
        engine = Engine(profile, enable=[rule], authorities=authorities(spark, sf_dir) if rule.startswith("VF") else None)
        found = engine.check(briefs(spark, sf_dir, *parts))
        plain = [F.coalesce(c, F.lit("")).alias(c) for c in ("replacement", "safety")] + [F.coalesce(c, F.lit(-1)).alias(c) for c in ("fix_start", "fix_end")]
        return found.select("doc_id", "rule_id", "severity", "message", "start", "end", "citation_text", *plain)

    return query


def _rule_sql(rule: str) -> str:
    """The text as the brief has it, and where in it the finding and its correction lie."""
    parts, severity, replacement, condition = RULES[rule]
    target, message, fix_target, safety = DETAILS[rule]
    text = ", ".join(parts).replace(" div ", " // ").replace("\\'", "''")
    at = lambda x: f"CAST(strpos(text, {x}) - 1 AS INT)"
    if rule == "CT005":  # the same letters stand in the citation itself
        at = lambda x: "CAST(strpos(text, '(U.S. 1999') AS INT)"
    cited = {"CT001": "'12 F.3d 34'", "CT004": "'12 N.J. Super. 34'", "CT005": "'12 U.S. 34'", "CT006": "'12 N.E.2d 34'", "ST006": "'11 U.S.C. § ' || o_custkey || ', 9999'"}.get(rule, target)
    span = f"{at(fix_target)} AS fix_start, CAST({at(fix_target)} + length({fix_target}) AS INT) AS fix_end, '{safety}' AS safety" if fix_target else "CAST(-1 AS INT) AS fix_start, CAST(-1 AS INT) AS fix_end, '' AS safety"
    return f"SELECT o_orderkey AS doc_id, '{rule}' AS rule_id, {severity} AS severity, {message} AS message, {at(target)} AS start, CAST({at(target)} + length({target}) AS INT) AS \"end\", {cited} AS citation_text, {replacement} AS replacement, {span} FROM (SELECT *, concat({text}) AS text FROM orders) WHERE {condition}"


_MIXED = [_s("Id. at 5. " + _A + "12 "), f"if({_EVEN}, 'F.Supp.2d', 'F. Supp. 2d')", _s(" 34 (D.D.C. "), Y, _s("). Cole v. Dunn, 5 U.S. 100, 371-372 (U.S. 1999).")]


def fix_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(rules.Profile(edition=20)).fix(briefs(spark, sf_dir, *_MIXED)).select("doc_id", "text", F.size("applied").alias("n_applied"))


def fix_unsafe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = briefs(spark, sf_dir, _s(_A), _VOLUME, _s(" F.2d 34 (Ninth Circuit "), Y, _s(")."))
    return Engine().fix(docs, unsafe=True).select("doc_id", "text", F.size("applied").alias("n_applied"))


def fix_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two corrections on the same words, one past the end, one that changes nothing."""
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("0123456789"), "p_brand").alias("text"))
    fixes = F.array(*[F.struct(F.lit(s).alias("start"), F.lit(e).alias("end"), F.lit(r).alias("replacement")) for s, e, r in ((6, 8, "xy"), (2, 5, "AB"), (4, 7, "zz"), (0, 1, "0"), (900, 901, "!"))])
    out = docs.select("doc_id", fix.patch(F.col("text"), fixes).alias("p"))
    return out.select("doc_id", "p.text", F.array_join(F.transform("p.skipped", lambda x: x["reason"]), "; ").alias("reasons"))


def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.severity_counts(Engine(rules.Profile(edition=20)).check(briefs(spark, sf_dir, *_MIXED)))


def findings_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.ordered(Engine(rules.Profile(edition=20)).check(briefs(spark, sf_dir, *_MIXED))).select("doc_id", "place", "rule_id")


def _reported(docs: DataFrame, engine: Engine, annotations: DataFrame | None = None) -> DataFrame:
    cites = stored(engine.citations(docs, shapes=True, refused=True))  # counts and findings both read them: texts are parsed once
    return reports.reported(docs.select("doc_id", F.concat(F.lit("brief "), F.col("doc_id").cast("string")).alias("name")), cites, engine.check(docs, cites), annotations)


def _report_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second brief has a court that its reporter does not need; the others have no finding."""
    return briefs(spark, sf_dir, _s(_A + "12 U.S. "), _PAGE, f"if({_EVEN}, ' (U.S. ', ' (')", Y, _s(")."))


def _quotations(docs: DataFrame) -> DataFrame:
    """A quotation for every third brief, and a note for the one after."""
    third = docs.filter("doc_id % 3 < 2").select("doc_id", F.lit(14).alias("start"), F.lit(20).alias("end"), F.lit("12 U.S. 34").alias("citation"), F.lit("Ames v. Bell").alias("case_name"), F.lit("35").alias("pin"))
    return third.withColumns({"quote": F.expr("if(doc_id % 3 = 0, 'It is, \"so\".', null)"), "note": F.expr("if(doc_id % 3 = 0, null, 'page 35 is not marked')"), "url": F.lit("https://x.example/1")})


def report_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _report_briefs(spark, sf_dir)
    return reports.csv_report(_reported(docs, Engine(enable=["CT005"]), _quotations(docs)))


def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.json_report(_reported(_report_briefs(spark, sf_dir), Engine(enable=["CT005"])), reports.Provenance(version="1.2", commit="abc"))


def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _report_briefs(spark, sf_dir)
    return reports.markdown_report(_reported(docs, Engine(enable=["CT005"]), _quotations(docs)), reports.Provenance(version="1.2", commit="abc"))


def graded_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of a graded quiz, one for each order."""
    texts = ", ".join(_s(t) for t, _ in GRADED)
    return Engine().check(briefs(spark, sf_dir, f"element_at(array({texts}), cast(o_orderkey % {len(GRADED)} AS int) + 1)")).select("doc_id", "rule_id")


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = briefs(spark, sf_dir, _s(_A), "o_custkey % 900 + 1", _s(" U.S. 100 (1990). Id. at 101. Cole v. Dunn, 6 F.3d 200 (9th Cir. 1995). Id."))
    return extract.resources(extract.citations(docs)).select("doc_id", "resource_key", F.array_join(F.transform("indexes", lambda i: i.cast("string")), ",").alias("indexes"))


def pin_quotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = briefs(spark, sf_dir, _s(_A), "o_orderkey % 50 + 1", _s(" U.S. 100, 102 (1990)."))
    keys = spark.range(1, 51)
    clusters = keys.selectExpr("concat(id, ' U.S. 100') AS key", "id AS cluster_id", "array(concat('/a/', id), concat('/b/', id)) AS opinion_urls")
    opinions = keys.selectExpr("concat('/b/', id) AS url", "concat('<p>Start <span class=\"star-pagination\">*101</span> no. <span class=\"star-pagination\">*102</span> Ruling ', id, ' stands.</p>') AS html", "'' AS plain_text")
    return annotate.annotations(extract.citations(docs), clusters, opinions).select("doc_id", "page_no", "quote", "url")


def lookup_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = briefs(spark, sf_dir, _s(_A), "o_orderkey % 5 + 1", _s(" U.S. 100 (1990)."))
    lookups = spark.createDataFrame([("1 U.S. 100", 200, 1), ("2 U.S. 100", 200, 2), ("3 U.S. 100", 404, 0), ("4 U.S. 100", 429, 0)], "key string, status int, n_clusters int")
    return annotate.looked_up(extract.citations(docs), lookups).select("doc_id", "status")


def lookup_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three authorities a brief, two of them within the ceiling, one of these without an answer in every second brief."""
    docs = briefs(spark, sf_dir, _s(_A + "1 U.S. 100 (1990). Cole v. Dunn, "), f"if({_EVEN}, '2', '3')", _s(" U.S. 200 (1991). Id. Ames v. Bell, 1 U.S. 100 (1990). Eads v. Foss, 4 U.S. 300 (1992)."))
    lookups = spark.createDataFrame([("1 U.S. 100", 200, 1), ("2 U.S. 200", 429, 0), ("3 U.S. 200", 200, 1), ("4 U.S. 300", 200, 1)], "key string, status int, n_clusters int")
    return annotate.notices(annotate.looked_up(extract.citations(docs), lookups, most=2), lookups=2)


def lookup_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to lookups as authorities: one is another case, one is two cases, one is absent, one did not come."""
    docs = briefs(spark, sf_dir, _s(_A), "o_orderkey % 5 + 1", _s(" U.S. 100 (1990). Id. Ames v. Bell, "), "o_orderkey % 5 + 1", _s(" U.S. 100 (1990)."))
    cluster = "struct<case_name:string,year:int,court_id:string,url:string>"
    rows = [("1 U.S. 100", 200, [("Ames v. Bell", 1990, "scotus", "u")]), ("2 U.S. 100", 200, [("Zeta v. Omega", 1990, "scotus", "u")]), ("3 U.S. 100", 300, [("Ames v. Bell", 1990, "scotus", "u")] * 2), ("4 U.S. 100", 404, []), ("5 U.S. 100", 429, [])]
    lookups = spark.createDataFrame(rows, f"key string, status int, clusters array<{cluster}>")
    return Engine(enable=["VF001", "VF002", "VF003", "VF004"], lookups=lookups).check(docs).select("doc_id", "rule_id", "start")


def decoded_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.lit("&amp;lt; &sect;&#"), (F.col("p_size") + 64).cast("string"), F.lit("; &eacute; &#x110000; &NBSP;&#0;"), "p_brand", F.lit(" & "))
    return table(spark, sf_dir, "part").select("p_partkey", annotate.decode_entities(made).alias("text"), annotate.opinion_path(F.expr("if(p_partkey % 2 = 0, concat('https://x.example/api/rest/v4/opinions/', p_partkey, '/'), 'https://y.example/api/rest/v4/opinions/1/')"), "https://x.example").alias("path"))


def request_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as requests of their customers: how many fall in a window of 30 days."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("client"), "o_orderkey", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("at"))
    return annotate.within_rate(orders, most=2, seconds=30 * 86400).select("o_orderkey", "recent", "allowed")


def table_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    years = F.struct(F.lit("1900-01-01").alias("start"), F.lit(None).cast("string").alias("end"))
    wrong = F.create_map(F.concat(F.lit("w"), (F.col("p_partkey") % 50).cast("string")), F.when(F.col("p_size") < 25, F.array("p_brand")).otherwise(F.array("p_brand", F.lit("other"))))
    families = part.select(F.lit("state").alias("cite_type"), F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("name"), F.create_map(F.col("p_brand"), years).alias("editions"), wrong.alias("variations"))
    return refdata.table_statistics(families)


def rich_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked briefs as RTF, as it is written, and read back from three formats."""
    docs = briefs(spark, sf_dir, _s(_A), "o_custkey", _s(" U.S. 34 (§)."))
    # equal texts side by side, so that a task makes and reads each once; a text of many documents spans several tasks
    docs = docs.repartitionByRange(spark.sparkContext.defaultParallelism, "text", "doc_id").sortWithinPartitions("text").withColumn("marks", F.array(F.struct(F.lit("bold").alias("mark"), F.lit(0).alias("start"), F.lit(12).alias("end")), F.struct(F.lit("italic").alias("mark"), F.lit(5).alias("start"), F.lit(7).alias("end"))))
    files = [writers.exported(docs, kind).select(F.concat_ws(".", F.col("doc_id").cast("string"), F.lit(kind)).alias("path"), "content") for kind in ("rtf", "docx", "odt")]
    back = readers.imported(files[1].unionByName(files[2])).select("path", "text")
    return files[0].select("path", F.decode("content", "UTF-8").alias("text")).unionByName(back)


def extraction_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    got = extract.citations(briefs(spark, sf_dir, _s(_A + "12 F.3d 34 (9th Cir. 1999); "), f"if({_EVEN}, '1999 WL 7', 'nothing')", _s(".")))
    want = orders.select(F.col("o_orderkey").alias("doc_id"), F.explode(F.array(F.lit("12  F.3D 34"), F.lit("5 U.S. 6"))).alias("text"))
    return annotate.accuracy(want, got).withColumn("lost", F.array_join("lost", "|"))


def document_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place in each text, for some past its end."""
    docs = table(spark, sf_dir, "documents")
    at = (F.col("doc_id") * 37 % 3000).cast("int")
    spot = T.line_col(F.col("text"), at)
    return docs.select("doc_id", T.snippet(F.col("text"), at, at + 20, 20).alias("snippet"), spot["line"].cast("int").alias("line"), spot["col"].cast("int").alias("col"))


def document_tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.length(T.squash(F.col("text"))).cast("int").alias("squashed"), T.line_diff(F.col("text"), F.replace(F.col("text"), F.lit("the"), F.lit("THE"))).alias("diff"))


def name_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(T.name_similarity(F.concat(F.lit("Acme Corp v. "), "p_type"), F.concat_ws(" ", F.lit("ACME"), "p_brand", "p_type")), 6).alias("likeness"), F.round(T.edit_similarity(F.col("p_name"), F.col("p_type")), 6).alias("edits"))


def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("a", F.col("p_partkey") + 100).withColumn("b", F.col("p_partkey") + 100 + F.col("p_size"))
    pin = F.concat(F.col("a").cast("string"), F.lit("–"), F.col("b").cast("string"), F.lit(", 9"))
    return part.select("p_partkey", T.abbreviate_range(F.col("a"), F.col("b")).alias("short"), T.pin_first(pin).alias("first"), T.expand_to(F.col("a"), F.substring(F.col("b").cast("string"), -2, 2)).alias("expanded"))


def merge_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_brand", "p_type", "p_size", "p_partkey")
    families = part.select(F.lit("federal").alias("cite_type"), F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("name"), F.create_map(F.col("p_brand"), F.struct(F.concat((1800 + F.col("p_size")).cast("string"), F.lit("-01-01")).alias("start"), F.when(F.col("p_size") < 45, F.concat((1900 + F.col("p_size")).cast("string"), F.lit("-12-31"))).alias("end"))).alias("editions"), F.lit(None).cast("map<string, array<string>>").alias("variations"))
    return refdata.edition_table(families).select("abbrev", "start", F.coalesce("end", F.lit(-1)).alias("end"), "ambiguous")


def section_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("CASE p_partkey % 3 WHEN 0 THEN concat('240.10b-', p_size) WHEN 1 THEN concat(p_partkey, '(a), ', p_size) ELSE concat(p_partkey, '–', p_partkey + p_size) END")
    secs = T.sections(raw)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(secs["items"], "|").alias("items"), secs["join"].alias("kind"))


def spacing_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.expr("CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN replace(p_type, ' ', '') WHEN 2 THEN replace(p_type, ' ', '  ') ELSE concat(p_type, '.') END")
    return table(spark, sf_dir, "part").select("p_partkey", T.spacing_variant(written, F.col("p_type")).alias("variant"), T.count_before(F.col("p_type"), F.lit("E"), F.col("p_size")).alias("before"))


def edition_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a table of editions, before and after: some go, some come, some have other dates."""
    part = table(spark, sf_dir, "part")
    old = part.filter("p_partkey % 5 <> 0").selectExpr("cast(p_partkey AS string) AS abbrev", "1800 + p_size AS start", "cast(null AS int) AS end")
    new = part.filter("p_partkey % 7 <> 0").selectExpr("cast(p_partkey AS string) AS abbrev", "1800 + p_size AS start", "if(p_partkey % 3 = 0, 1990, null) AS end")
    return refdata.table_changes(old, new)


def feedback_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = briefs(spark, sf_dir, _s("It was so. As told in "), *RULES["CT002"][0], _s(" Then it ended."))
    rows = feedback.feedback(docs, Engine(enable=["CT002"]).check(docs), base="https://tracker.example")
    return rows.select("doc_id", "title", "context", F.startswith("link", F.lit("https://tracker.example/issues/new?title=False%20positive%20CT002%3A%2012%20U.S.%2034&body=")).alias("linked"))


def formatted_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bold citations, corrected: what is put in is bold too."""
    docs = briefs(spark, sf_dir, *RULES["RP001"][0])
    end = F.instr("text", " (D.D.C.") - 1
    docs = docs.withColumn("marks", F.array(F.struct(F.lit("bold").alias("mark"), F.lit(len(_A)).alias("start"), end.alias("end"))))
    out = rich.fixed_rich(docs, Engine(rules.Profile(edition=20), enable=["RP001"]).check(docs.select("doc_id", "text")))
    return out.select("doc_id", rich.rich_html(F.col("text"), F.col("marks")).alias("html"), F.size("applied").alias("n_applied"))


def run_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrected runs, with marks that begin and end within the citation and around it: a correction of the whole citation takes the marks at its start."""
    docs = briefs(spark, sf_dir, *RULES["RP001"][0])
    mark = lambda m, a, b: F.struct(F.lit(m).alias("mark"), F.lit(a).alias("start"), b.alias("end"))
    marks = F.array(mark("bold", len(_A), F.instr("text", " (D.D.C.") - 1), mark("italic", 0, F.lit(12)), mark("underline", 5, F.lit(len(_A) + 2)))
    runs = docs.select("doc_id", rich.runs_of(F.col("text"), marks).alias("runs"))
    found = Engine(rules.Profile(edition=20), enable=["RP001"]).check(runs.select("doc_id", rich.run_text(F.col("runs")).alias("text")))
    out = rich.fixed_runs(runs, found)
    shown = F.array_join(F.transform("runs", lambda r: F.concat(F.array_join(r["marks"], "+"), F.lit(":"), r["text"])), "|")
    return out.select("doc_id", shown.alias("runs"), F.size("applied").alias("n_applied"))


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Briefs with comments, written as files of three formats by the data source, in archives, and read back by it."""
    datasource.register(spark)
    docs = briefs(spark, sf_dir, _s("Held, <so> & {thus}:\n"), *RULES["CT002"][0])
    note = F.array(F.struct(F.lit(6).alias("start"), F.lit(10).alias("end"), F.lit("why?").alias("body")))
    path = folder(spark)
    for kind in ("docx", "rtf", "html"):
        docs.withColumn("comments", note).write.format(datasource.NAME).option("format", kind).option("archive", True).mode("append").save(path)
    back = spark.read.format(datasource.NAME).load(path)
    return back.select(F.regexp_extract("path", r"/(\d+)[^/]*$", 1).cast("long").alias("doc_id"), "format", "text", "error")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Briefs written as files of four formats, with comments on findings, and read back."""
    docs = briefs(spark, sf_dir, _s("Held, <so> & {thus}:\n"), *RULES["CT002"][0])
    notes = stored(Engine(enable=["CT002"]).check(docs).select("doc_id", "start", "end", F.col("message").alias("body")))  # two formats have comments
    files = [writers.exported(docs, kind, notes).select(F.concat_ws(".", F.col("doc_id").cast("string"), F.lit(kind)).alias("path"), "content") for kind in ("docx", "odt", "rtf", "html")]
    for more in files[1:]:
        files[0] = files[0].unionByName(more)
    return readers.imported(files[0]).select("path", "format", "text")


_KNOWN = [a for a, *_ in refdata.EDITIONS]
# a spelling of the table for each part, with a letter less, a wrong one, one more, or both of these
_SPELT = f"element_at(array({', '.join(_s(a) for a in _KNOWN)}), cast(p_partkey % {len(_KNOWN)} AS int) + 1)"
_TORN = "CASE p_size % 4 WHEN 0 THEN concat(left(a, m), substring(a, m + 2)) WHEN 1 THEN concat(left(a, m), 'q', substring(a, m + 2)) WHEN 2 THEN concat(left(a, m), 'x', substring(a, m + 1)) ELSE concat('z', left(a, m), substring(a, m + 2), 'y') END"


def reporter_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_size", F.expr(_SPELT).alias("a")).withColumn("m", F.expr("cast(p_size % length(a) AS int)"))
    return suggest.suggestions(part.select(F.expr(_TORN).alias("token")))


# order lines as spans: a third of them in one text, some of them empty; orders as claimed spans, some empty too
_LINES = "CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_orderkey % 1000 END AS doc_id, CAST(l_orderkey * 13 % 900000 + l_linenumber * 7 AS BIGINT) AS start, CAST(l_orderkey * 13 % 900000 + l_linenumber * 7 + l_partkey % 60 AS BIGINT) AS \"end\", l_orderkey, l_linenumber"
_CLAIMS = "CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 1000 END AS doc_id, CAST(o_orderkey * 13 % 900000 AS BIGINT) AS start, CAST(o_orderkey * 13 % 900000 + o_custkey % 20 AS BIGINT) AS \"end\", o_orderkey"
_OVERLAP = "c.doc_id = l.doc_id AND c.start < l.\"end\" AND l.start < c.\"end\""


def _span_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    plain = lambda x: x.replace('"', "`")
    lines, orders = (table(spark, sf_dir, t) for t in ("lineitem", "orders"))
    lines, claims = (df.select(*[F.expr(e) for e in plain(x).split(", ")]) for df, x in ((lines, _LINES), (orders, _CLAIMS)))
    return lines, claims


def spans_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each claimed span with the lines inside or across it: how many, and how many places they share."""
    pairs = spans.overlapping(*_span_tables(spark, sf_dir))
    common = F.least("left.end", "right.end") - F.greatest("left.start", "right.start")
    return pairs.groupBy(F.col("right.o_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.sum(common).alias("places"))


def spans_overlapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.overlapped(*_span_tables(spark, sf_dir)).select("l_orderkey", "l_linenumber", "start", "end")


def spans_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.clear(*_span_tables(spark, sf_dir)).select("l_orderkey", "l_linenumber", "start", "end")


def spans_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.merged(_span_tables(spark, sf_dir)[0])


# order lines as citations of another tool
_CITED_LINES = """l_orderkey AS doc_id, l_linenumber AS start, l_partkey, l_suppkey,
CASE l_partkey % 7 WHEN 2 THEN 'id' WHEN 3 THEN 'short-form' WHEN 4 THEN 'supra' WHEN 6 THEN 'statute' ELSE 'case-reporter' END AS kind, l_partkey % 7 IN (1, 5) AND l_suppkey % 2 = 0 AS joined,
CAST(l_suppkey % 3 AS STRING) AS volume, 'F.3d' AS canonical, CASE WHEN l_partkey % 7 = 4 THEN concat('MARK', l_suppkey % 4) WHEN l_suppkey % 5 > 0 THEN concat('Benchmark', l_suppkey % 3, ' v. Doe') END AS case_name,
CASE WHEN l_partkey % 7 IN (0, 1, 5, 6) THEN concat(l_suppkey % 3, ' F.3d ', l_partkey) END AS own"""


def resolved_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    rows = spark.sql(f"SELECT {_CITED_LINES} FROM {{lines}}", lines=lines)
    dealt = max(int(spark.conf.get("spark.sql.shuffle.partitions")), lines.count() // 500_000)
    return resolve.resolved(rows, ["start", "l_partkey", "l_suppkey"], partitions=dealt).select("doc_id", "start", "l_partkey", "resource_key", "parallel_of")


def imported_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as a file at two paths: read once, the second time from the store."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("content"))
    files = pages.withColumn("path", F.explode(F.array(F.format_string("a/%d.html", "page_id"), F.format_string("b/%d.HTM", "page_id")))).select("path", "content")
    store = folder(spark)
    readers.imported_once(files.filter(F.startswith("path", F.lit("a"))), store, run="first")
    return readers.imported_once(files, store, run="second").select("path", "format", "text")


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.html_pages(table(spark, sf_dir, "pages")).select("page_id", "text")


def _words(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda w: length(w) > 1 AND NOT list_contains({T.NOISE}, w)))"


_MIXED_COUNT = f"CASE WHEN {_EVEN} THEN 1 ELSE 0 END"
_PAGE_TEXTS = r"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<(script|style|head|title|noscript|template)\b[^>]*>.*?</(script|style|head|title|noscript|template)>', '', 'gis') AS x FROM pages),
b AS (SELECT page_id, regexp_replace(x, '\s+', ' ', 'g') AS x FROM a),
c AS (SELECT page_id, regexp_replace(regexp_replace(x, '<br\s*/?>|</(p|div|section|article|header|footer|li|ul|ol|table|tr|blockquote|pre|h1|h2|h3|h4|h5|h6)\s*>', chr(10), 'gi'), '<[^>]*>', '', 'g') AS x FROM b),
d AS (SELECT page_id, replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&quot;', '"'), '&apos;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS x FROM c)
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(x, ' *' || chr(10) || ' *', chr(10), 'g'), chr(10) || '{3,}', chr(10) || chr(10), 'g'), '  +', ' ', 'g'), ' ' || chr(10)) AS text FROM d
"""
# the order of letters in the root collation: signs, digits, then letters in any case
_SIGNS = " _-,;:!?.'’\"()[]{}@*/\\&#%`^+<=>|~$"
_ORDER = {a: i for i, a in enumerate(sorted(_KNOWN, key=lambda a: [("s", _SIGNS.index(c)) if c in _SIGNS else ("t", ord(c.lower())) for c in a]))}
_q = lambda x: "'" + x.replace("'", "''") + "'"
_SUGGESTED = f"""
WITH e AS (SELECT * FROM (VALUES {", ".join(f"({_q(a)}, {i})" for a, i in _ORDER.items())}) v(abbrev, o)),
k AS (SELECT abbrev AS known, abbrev, o FROM e UNION SELECT written, canonical, coalesce(o, 999999) FROM (VALUES {", ".join(f"({_q(w)}, {_q(c)})" for w, c in refdata.VARIATIONS.items())}) v(written, canonical) LEFT JOIN e ON canonical = abbrev),
s AS (SELECT DISTINCT regexp_replace(lower(known), '[^a-z0-9]', '', 'g') AS spelt, abbrev, o FROM k),
p AS (SELECT p_size, a, p_size % length(a) AS m FROM (SELECT p_size, list_extract([{", ".join(map(_q, _KNOWN))}], CAST(p_partkey % {len(_KNOWN)} AS INT) + 1) AS a FROM part)),
t AS (SELECT token, regexp_replace(lower(token), '[^a-z0-9]', '', 'g') AS sq FROM (SELECT DISTINCT {_TORN} AS token FROM p)),
d AS (SELECT token, abbrev, o, levenshtein(sq, spelt) AS distance, abs(length(sq) - length(spelt)) AS apart, CASE WHEN length(sq) <= 3 THEN 1 WHEN length(sq) <= 6 THEN 2 ELSE 3 END AS most FROM t, s WHERE sq <> ''),
b AS (SELECT token, abbrev, o, min((distance, apart)) AS b FROM d WHERE distance BETWEEN 1 AND most GROUP BY ALL),
r AS (SELECT token, abbrev, b[1] AS distance, row_number() OVER (PARTITION BY token ORDER BY b, o) AS place FROM b)
SELECT token, CAST(place AS INT) AS place, abbrev, CAST(distance AS INT) AS distance FROM r WHERE place <= 3
"""
_CITED = "'12 U.S. ' || (o_orderkey // 9000 + 34)"
_COURT_AT = "(24 + length(CAST(o_orderkey // 9000 + 34 AS VARCHAR)))"
_REDUNDANT = " covers one court only, so rule 10.4(a) asks for the year alone."
OTHERS = {
    "fix_safe": (fix_safe, f"SELECT o_orderkey AS doc_id, 'Id. at 5. Ames v. Bell, 12 F. Supp. 2d 34 (D.D.C. ' || {Y} || '). Cole v. Dunn, 5 U.S. 100, 371-372 (1999).' AS text, CAST(1 + {_MIXED_COUNT} AS INT) AS n_applied FROM orders"),
    "fix_unsafe": (fix_unsafe, f"SELECT o_orderkey AS doc_id, 'Ames v. Bell, ' || ({_VOLUME}) || ' F.3d 34 (9th Cir. ' || {Y} || ').' AS text, CAST(2 AS INT) AS n_applied FROM orders"),
    "fix_conflict": (fix_conflict, "SELECT p_partkey AS doc_id, '01AB5xy89' || p_brand AS text, 'replacement is identical to source; overlaps an earlier fix at [2, 5); span extends past end of document' AS reasons FROM part"),
    "severity_counts": (severity_counts, f"SELECT o_orderkey AS doc_id, CAST(1 AS BIGINT) AS error, CAST(0 AS BIGINT) AS warning, CAST(2 + {_MIXED_COUNT} AS BIGINT) AS info FROM orders"),
    "findings_ordered": (findings_ordered, f"SELECT o_orderkey AS doc_id, CAST(CASE WHEN p > 1 AND NOT ({_EVEN}) THEN p - 1 ELSE p END AS INT) AS place, r AS rule_id FROM orders, (VALUES (1, 'ST001'), (2, 'RP001'), (3, 'ST003'), (4, 'CT005')) v(p, r) WHERE {_EVEN} OR p <> 2"),
    "report_csv": (report_csv, f"SELECT o_orderkey AS doc_id, 'rule,name,severity,citation,start,end,message,suggestion' || chr(10) || CASE WHEN {_EVEN} THEN 'CT005,redundant-court,info,' || {_CITED} || ',' || {_COURT_AT} || ',' || ({_COURT_AT} + 4) || ',\"\"\"U.S.\"\"{_REDUNDANT}\",' || chr(10) ELSE '' END || CASE o_orderkey % 3 WHEN 0 THEN 'PIN,pincite-quotation,info,12 U.S. 34,14,20,\"Ames v. Bell, at 35: It is, \"\"so\"\".\",https://x.example/1' || chr(10) WHEN 1 THEN 'PIN,pincite-quotation,info,12 U.S. 34,14,20,page 35 is not marked,https://x.example/1' || chr(10) ELSE '' END AS csv FROM orders"),
    "report_json": (report_json, f"""SELECT o_orderkey AS doc_id, '{{"tool":"citegrid","version":"1.2","commit":"abc","reporterData":"built-in","document":"brief ' || o_orderkey || '","bluebook":"Bluebook 21st edition, Bluepages (court documents)","citations":1,"findings":[' || CASE WHEN {_EVEN} THEN '{{"ruleId":"CT005","ruleName":"redundant-court","severity":"info","citation":"' || {_CITED} || '","start":' || {_COURT_AT} || ',"end":' || ({_COURT_AT} + 4) || ',"message":"\\"U.S.\\"{_REDUNDANT}","suggestion":"","safety":"safe"}}' ELSE '' END || ']}}' || chr(10) AS json FROM orders"""),
    "report_markdown": (
        report_markdown,
        f"""SELECT o_orderkey AS doc_id, '# Citation check — brief ' || o_orderkey || chr(10) || chr(10) || '- **Checked against:** Bluebook 21st edition, Bluepages (court documents)' || chr(10) || '- **Citations found:** 1' || chr(10) || '- **Findings:** ' || {_MIXED_COUNT} || chr(10) || '- **citegrid:** 1.2 (commit abc)' || chr(10) || '- **Reporter data:** built-in' || chr(10) || chr(10)
        || CASE WHEN {_EVEN} THEN '| Rule | Severity | Citation | Problem |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || '| `CT005` | info | ' || {_CITED} || ' | "U.S."{_REDUNDANT} |' || chr(10) ELSE 'No findings. That proves nothing right: only what is' || chr(10) || 'certainly wrong is told, and no citation was verified.' || chr(10) END || chr(10)
        || CASE WHEN o_orderkey % 3 < 2 THEN '## Pincite quotations' || chr(10) || chr(10) || '### 12 U.S. 34, at 35' || chr(10) || chr(10) || '*Ames v. Bell* — <https://x.example/1>' || chr(10) || chr(10) || CASE o_orderkey % 3 WHEN 0 THEN '> It is, "so".' ELSE 'page 35 is not marked' END || chr(10) || chr(10) || 'A quotation is there to be checked; it does not replace' || chr(10) || 'reading the opinion.' || chr(10) || chr(10) ELSE '' END AS markdown FROM orders""",
    ),
    "graded_citations": (graded_citations, f"SELECT o_orderkey AS doc_id, r AS rule_id FROM orders JOIN (VALUES {', '.join(f"({i}, '{r}')" for i, (_, rs) in enumerate(GRADED) for r in rs)}) v(i, r) ON o_orderkey % {len(GRADED)} = i"),
    "resources": (resources, "SELECT o_orderkey AS doc_id, (o_custkey % 900 + 1) || ' U.S. 100' AS resource_key, '0,1' AS indexes FROM orders UNION ALL SELECT o_orderkey, '6 F.3d 200', '2,3' FROM orders"),
    "pin_quotation": (pin_quotation, "SELECT o_orderkey AS doc_id, CAST(102 AS BIGINT) AS page_no, 'Ruling ' || (o_orderkey % 50 + 1) || ' stands.' AS quote, '/b/' || (o_orderkey % 50 + 1) AS url FROM orders"),
    "lookup_statuses": (lookup_statuses, "SELECT o_orderkey AS doc_id, CASE o_orderkey % 5 WHEN 0 THEN 'found' WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'not-found' ELSE 'unchecked' END AS status FROM orders"),
    "extraction_accuracy": (extraction_accuracy, f"SELECT o_orderkey AS doc_id, CAST(2 AS BIGINT) AS expected, CAST(1 AS BIGINT) AS recovered, CAST({_MIXED_COUNT} AS BIGINT) AS spurious, CAST(0.5 AS DOUBLE) AS recall, '5 u.s. 6' AS lost FROM orders"),
    "lookup_notices": (lookup_notices, f"SELECT o_orderkey AS doc_id, 'Looked up the first 2 of 3 distinct citations. The other one was not checked: it is neither verified nor absent.' AS notice FROM orders UNION ALL SELECT o_orderkey, '1 citation could not be checked.' FROM orders WHERE {_EVEN}"),
    "lookup_findings": (lookup_findings, "SELECT o_orderkey AS doc_id, CASE o_orderkey % 5 WHEN 1 THEN 'VF003' WHEN 2 THEN 'VF002' ELSE 'VF001' END AS rule_id, CAST(s AS INT) AS start FROM orders, (VALUES (14), (51)) v(s) WHERE o_orderkey % 5 IN (1, 2, 3)"),
    "decoded_markup": (decoded_markup, "SELECT p_partkey, '&lt; §' || chr(p_size + 64) || ' &eacute; &#x110000;  &#0;' || p_brand || ' & ' AS text, CASE WHEN p_partkey % 2 = 0 THEN '/api/rest/v4/opinions/' || p_partkey || '/' END AS path FROM part"),
    "request_windows": (request_windows, "SELECT o_orderkey, n AS recent, n <= 2 AS allowed FROM (SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY epoch(CAST(o_orderdate AS TIMESTAMP)) RANGE BETWEEN 2592000 PRECEDING AND CURRENT ROW) AS n FROM orders)"),
    "table_statistics": (table_statistics, "SELECT count(*) AS families, CAST(count(*) AS BIGINT) AS listed, count(DISTINCT p_brand) AS editions, (SELECT count(*) FROM (SELECT p_brand FROM part GROUP BY p_brand HAVING count(*) > 1)) AS ambiguous, count(DISTINCT CASE WHEN p_size < 25 THEN p_partkey % 50 END) AS spellings, count(DISTINCT p_partkey % 50) - count(DISTINCT CASE WHEN p_size < 25 THEN p_partkey % 50 END) AS dropped FROM part"),
    "rich_files": (rich_files, r"SELECT o_orderkey || '.rtf' AS path, '{\rtf1\ansi\uc1' || chr(10) || '{\b Ames }{\b\i v.}{\b  Bell}, ' || o_custkey || ' U.S. 34 (\u167?).}' AS text FROM orders UNION ALL SELECT o_orderkey || '.' || k, 'Ames v. Bell, ' || o_custkey || ' U.S. 34 (§).' FROM orders, (VALUES ('docx'), ('odt')) v(k)"),
    "document_snippets": (document_snippets, "SELECT doc_id, CASE WHEN spot > 10 THEN '…' ELSE '' END || trim(regexp_replace(CASE WHEN least(length(text), spot + 30) > greatest(spot - 10, 0) THEN substr(text, greatest(spot - 10, 0) + 1, least(length(text), spot + 30) - greatest(spot - 10, 0)) ELSE '' END, '\\s+', ' ', 'g')) || CASE WHEN length(text) > spot + 30 THEN '…' ELSE '' END AS snippet, CAST(len(string_split(substr(text, 1, spot), chr(10))) AS INT) AS line, CAST(length(string_split(substr(text, 1, spot), chr(10))[-1]) + 1 AS INT) AS col FROM (SELECT *, CAST(doc_id * 37 % 3000 AS INT) AS spot FROM documents)"),
    "document_tidy": (document_tidy, "SELECT doc_id, CAST(length(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS INT) AS squashed, array_to_string([CASE WHEN replace(x, 'the', 'THE') <> x THEN '- ' || x || chr(10) || '+ ' || replace(x, 'the', 'THE') END FOR x IN string_split(text, chr(10)) IF replace(x, 'the', 'THE') <> x], chr(10)) AS diff FROM documents"),
    "name_likeness": (name_likeness, f"SELECT p_partkey, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 1.0 ELSE CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))) END, 6) AS likeness, round(CASE WHEN greatest(length(p_name), length(p_type)) = 0 THEN 1.0 ELSE 1 - CAST(levenshtein(p_name, p_type) AS DOUBLE) / greatest(length(p_name), length(p_type)) END, 6) AS edits FROM (SELECT *, {_words("'Acme Corp v. ' || p_type")} AS a, {_words("'ACME ' || p_brand || ' ' || p_type")} AS b FROM part)"),
    "page_ranges": (page_ranges, "SELECT p_partkey, CASE WHEN length(a) <> length(b) THEN b ELSE right(b, greatest(2, length(b) - len(list_filter(range(1, length(b) + 1), lambda i: left(a, i) = left(b, i))))) END AS short, least(a::BIGINT, 9) AS first, CASE WHEN (left(a, length(a) - 2) || right(b, 2))::BIGINT >= a::BIGINT THEN (left(a, length(a) - 2) || right(b, 2))::BIGINT ELSE right(b, 2)::BIGINT END AS expanded FROM (SELECT p_partkey, CAST(p_partkey + 100 AS VARCHAR) AS a, CAST(p_partkey + 100 + p_size AS VARCHAR) AS b FROM part)"),
    "section_lists": (section_lists, "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '240.10b-' || p_size WHEN 1 THEN p_partkey || '(a)|' || p_size ELSE p_partkey || '|' || (p_partkey + p_size) END AS items, CASE p_partkey % 3 WHEN 0 THEN 'single' WHEN 1 THEN 'list' ELSE 'span' END AS kind FROM part"),
    "spacing_variants": (spacing_variants, "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'same' WHEN 1 THEN CASE WHEN contains(p_type, ' ') THEN 'tightened' ELSE 'same' END WHEN 2 THEN CASE WHEN contains(p_type, ' ') THEN 'loosened' ELSE 'same' END ELSE 'different' END AS variant, CAST(len(list_filter(range(1, least(p_size, length(p_type)) + 1), lambda i: substr(p_type, i, 1) = 'E')) AS INT) AS before FROM part"),
    "edition_changes": (edition_changes, "SELECT CAST(p_partkey AS VARCHAR) AS abbrev, CASE WHEN p_partkey % 5 = 0 THEN 'added' WHEN p_partkey % 7 = 0 THEN 'removed' ELSE 're-dated' END AS change FROM part WHERE (p_partkey % 5 = 0) <> (p_partkey % 7 = 0) OR (p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 3 = 0)"),
    "feedback_reports": (feedback_reports, f"SELECT o_orderkey AS doc_id, 'False positive CT002: 12 U.S. 34' AS title, 'As told in Ames v. Bell, 12 U.S. 34 (9th Cir.' AS context, true AS linked FROM orders WHERE {_EVEN}"),
    "formatted_fixes": (formatted_fixes, f"SELECT o_orderkey AS doc_id, '<p>Ames v. Bell, <strong>12 F. Supp. 2d 34</strong> (D.D.C. ' || {Y} || ').</p>' AS html, CAST(CASE WHEN {_EVEN} THEN 1 ELSE 0 END AS INT) AS n_applied FROM orders"),
    "run_edits": (run_edits, f"SELECT o_orderkey AS doc_id, 'italic:Ames |italic+underline:v. Bell|underline:, |' || CASE WHEN {_EVEN} THEN 'bold+underline:12 F. Supp. 2d 34' ELSE 'bold+underline:12|bold: F. Supp. 2d 34' END || '|: (D.D.C. ' || {Y} || ').' AS runs, CAST(CASE WHEN {_EVEN} THEN 1 ELSE 0 END AS INT) AS n_applied FROM orders"),
    "source_files": (source_files, f"SELECT o_orderkey AS doc_id, k AS format, 'Held, <so> & {{thus}}:' || chr(10) || 'Ames v. Bell, 12 U.S. 34 (' || CASE WHEN {_EVEN} THEN '9th Cir. ' ELSE '' END || '1999).' AS text, CAST(NULL AS VARCHAR) AS error FROM orders, (VALUES ('docx'), ('rtf'), ('html')) v(k)"),
    "document_files": (document_files, f"SELECT o_orderkey || '.' || k AS path, k AS format, 'Held, <so> & {{thus}}:' || chr(10) || 'Ames v. Bell, 12 U.S. 34 (' || CASE WHEN {_EVEN} THEN '9th Cir. ' ELSE '' END || '1999).' AS text FROM orders, (VALUES ('docx'), ('odt'), ('rtf'), ('html')) v(k)"),
    "merge_editions": (merge_editions, "SELECT p_brand AS abbrev, CAST(1800 + min(p_size) AS INT) AS start, CAST(CASE WHEN max(p_size) >= 45 THEN -1 ELSE 1900 + max(p_size) END AS INT) AS \"end\", count(*) > 1 AS ambiguous FROM part GROUP BY p_brand"),
    "page_texts": (page_texts, _PAGE_TEXTS),
    "imported_pages": (imported_pages, f"SELECT replace(k, '%', CAST(page_id AS VARCHAR)) AS path, 'html' AS format, text FROM ({_PAGE_TEXTS}), (VALUES ('a/%.html'), ('b/%.HTM')) v(k)"),
    # one citation after the other, with the keys so far in a list
    "resolved_rows": (resolved_rows, f"""
WITH RECURSIVE c AS (SELECT {_CITED_LINES.replace("STRING", "VARCHAR")} FROM lineitem),
d AS (SELECT doc_id, list({{'start': start, 'part': l_partkey, 'kind': kind, 'joined': joined, 'volume': volume, 'name': lower(case_name), 'own': own}} ORDER BY start, l_partkey, l_suppkey) AS r FROM c GROUP BY doc_id),
s AS (SELECT doc_id, r, 0 AS i, CAST([] AS VARCHAR[]) AS keys, CAST([] AS INT[]) AS heads FROM d
UNION ALL SELECT doc_id, r, i + 1, list_append(keys, CASE
  WHEN i > 0 AND r[i + 1].joined THEN keys[list_last(list_filter(range(1, i + 1), lambda j: j = 1 OR NOT r[j].joined))]
  WHEN r[i + 1].kind = 'id' THEN CASE WHEN i > 0 THEN keys[i] END
  WHEN r[i + 1].kind = 'short-form' THEN keys[list_last(list_filter(range(1, i + 1), lambda j: r[j].kind = 'case-reporter' AND r[j].volume = r[i + 1].volume AND keys[j] IS NOT NULL))]
  WHEN r[i + 1].kind = 'supra' THEN keys[list_last(list_filter(range(1, i + 1), lambda j: r[j].kind IN ('case-reporter', 'statute') AND contains(r[j].name, r[i + 1].name)))]
  ELSE r[i + 1].own END),
  list_append(heads, CASE WHEN i > 0 AND r[i + 1].joined THEN CAST(list_last(list_filter(range(1, i + 1), lambda j: j = 1 OR NOT r[j].joined)) - 1 AS INT) END)
  FROM s WHERE i < len(r))
SELECT doc_id, u.start AS start, u.part AS l_partkey, u.key AS resource_key, u.head AS parallel_of FROM (SELECT doc_id, unnest([{{'start': r[j].start, 'part': r[j].part, 'key': keys[j], 'head': heads[j]}} FOR j IN range(1, len(r) + 1)]) AS u FROM s WHERE i = len(r))"""),
    "spans_overlapping": (spans_overlapping, f"""SELECT o_orderkey, count(*) AS n, CAST(sum(least(c."end", l."end") - greatest(c.start, l.start)) AS BIGINT) AS places FROM (SELECT {_CLAIMS} FROM orders) c JOIN (SELECT {_LINES} FROM lineitem) l ON {_OVERLAP} GROUP BY o_orderkey"""),
    "spans_overlapped": (spans_overlapped, f"""SELECT l_orderkey, l_linenumber, start, "end" FROM (SELECT {_LINES} FROM lineitem) l WHERE EXISTS (SELECT 1 FROM (SELECT {_CLAIMS} FROM orders) c WHERE {_OVERLAP})"""),
    "spans_clear": (spans_clear, f"""SELECT l_orderkey, l_linenumber, start, "end" FROM (SELECT {_LINES} FROM lineitem) l WHERE NOT EXISTS (SELECT 1 FROM (SELECT {_CLAIMS} FROM orders) c WHERE {_OVERLAP})"""),
    "spans_merged": (spans_merged, f"""
WITH l AS (SELECT {_LINES} FROM lineitem), s AS (SELECT doc_id, start, "end" FROM l WHERE start < "end"),
m AS (SELECT *, coalesce(start > max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS new FROM s),
r AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT doc_id, min(start) AS start, max("end") AS "end" FROM r GROUP BY doc_id, run"""),
    "reporter_suggestions": (reporter_suggestions, _SUGGESTED),
}

QUERIES = {k: q for k, (q, _) in EXTRACTION.items()} | {f"rule_{r.lower()}": _rule(r) for r in RULES} | {k: q for k, (q, _) in OTHERS.items()}
ORACLES = {k: sql for k, (_, sql) in EXTRACTION.items()} | {f"rule_{r.lower()}": _rule_sql(r) for r in RULES} | {k: sql for k, (_, sql) in OTHERS.items() if sql}
