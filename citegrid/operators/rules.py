"""The 24 rules: one projection over what the parser found; the verification ones join a table of authorities first."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import refdata
from ..functions import text as T
from ..stored import stored
from .annotate import MAX_LOOKUPS, looked_up
from .extract import MAX_CHARS

FINDING = "rule_id string, severity string, message string, start int, end int, citation_text string, fix_start int, fix_end int, replacement string, safety string"
REGISTRY = [
    ("RP001", "reporter-format"), ("RP002", "unknown-reporter"), ("RP003", "inconsistent-reporter-style"), ("DT001", "year-outside-reporter-range"), ("DT002", "implausible-year"),
    ("CT001", "court-abbreviation"), ("CT002", "reporter-court-mismatch"), ("CT003", "court-did-not-exist"), ("CT004", "ambiguous-court"), ("CT005", "redundant-court"), ("CT006", "non-standard-court"),
    ("ST001", "unresolved-short-form"), ("ST002", "pin-cite-out-of-range"), ("ST003", "page-range-format"), ("ST004", "reversed-page-range"), ("ST005", "short-form-parenthetical"), ("ST006", "section-symbol-count"), ("ST007", "section-range-digits"),
    ("AU001", "non-precedential-disposition"), ("AU002", "database-only-citation"), ("VF001", "unverified-authority"), ("VF002", "ambiguous-authority"), ("VF003", "case-name-mismatch"), ("VF004", "year-mismatch"),
]


@dataclass(frozen=True)
class Profile:
    edition: int = 21
    style: str = "practitioner"
    current_year: int = 2026

    @property
    def tightens(self) -> bool:
        return self.edition >= 21 and self.style == "practitioner"

    @property
    def label(self) -> str:
        ordinal = {20: "20th", 21: "21st", 22: "22nd"}.get(self.edition, f"{self.edition}th")
        # fixed values: the names of the two halves of the book
        return f"Bluebook {ordinal} edition, {'Bluepages (court documents)' if self.style == 'practitioner' else 'Whitepages (scholarly writing)'}"


def _finding(rule: str, severity, message: Column, start="start", end="end", fix=None, safety: str | None = None, fix_start=None, fix_end=None) -> Column:
    """A finding as a struct; a null fix means none."""
    col = lambda x: F.col(x) if isinstance(x, str) else x
    has = fix.isNotNull() if fix is not None else F.lit(False)
    none = F.lit(None)
    return F.struct(
        F.lit(rule).alias("rule_id"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        message.alias("message"),
        col(start).alias("start"),
        col(end).alias("end"),
        F.col("text").alias("citation_text"),
        F.when(has, col(start if fix_start is None else fix_start)).otherwise(none.cast("int")).alias("fix_start"),
        F.when(has, col(end if fix_end is None else fix_end)).otherwise(none.cast("int")).alias("fix_end"),
        (fix if fix is not None else none.cast("string")).alias("replacement"),
        F.when(has, F.lit(safety)).otherwise(none.cast("string")).alias("safety"),
    )


def _js(c) -> Column:
    return T.quoted(F.col(c) if isinstance(c, str) else c)


def _say(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# rules that ask for the edition, for its series, for the courts a text may name, for the court it does name, for near courts
_NEEDS = {"edition": {"DT001", "CT002", "CT005", "AU001"}, "series": {"DT001"}, "courts": {"CT001", "CT004", "CT006"}, "court": {"CT002", "CT003"}}
MAX_COURTS = 10_000


def enriched(cites: DataFrame, editions: DataFrame, court_table: DataFrame, on: set[str] | None = None) -> DataFrame:
    """cites with the facts of reporter and court that the rules in `on` ask for: broadcast joins of dimensions alone, no shuffle.

    Editions go to every task in any case (extract.reference checks their number), courts after a check against MAX_COURTS.
    """
    needs = {k for k, rules in _NEEDS.items() if on is None or rules & on}
    if needs & {"edition", "series"}:
        ed = editions.groupBy("abbrev").agg(F.max_by(F.struct("name", "series", "start", "end", "scotus_only", "non_precedential"), "position").alias("ed"))
        if "series" in needs:
            series = editions.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("start", "abbrev", "end"))).alias("siblings")).withColumnRenamed("series", "_series")
            ed = ed.join(F.broadcast(series), F.col("ed.series") == F.col("_series"), "left").drop("_series")
        cites = cites.join(F.broadcast(ed), cites.canonical == ed.abbrev, "left").drop("abbrev")
    if not needs & {"courts", "court"}:
        return cites
    listed = court_table.orderBy("position").select("id", "abbrev").limit(MAX_COURTS + 1).collect()
    if len(listed) > MAX_COURTS:
        raise ValueError(f"more than {MAX_COURTS} courts cannot be sent to every task")
    if "court" in needs:
        ct = court_table.select(F.col("id").alias("_id"), F.struct("name", "abbrev", "start", "end").alias("court"))
        cites = cites.join(F.broadcast(ct), F.col("court_id") == F.col("_id"), "left").drop("_id")
    if "courts" not in needs:
        return cites
    keys = court_table.select("id", "name", "abbrev", "position", F.explode(F.array_union(F.array("abbrev"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("key"))
    each = F.array_sort(F.collect_set(F.struct("position", "id", "name", "abbrev")))
    exact = keys.groupBy(T.normalized(F.col("key")).alias("_k")).agg(each.alias("_exact"))
    bare = lambda c: F.regexp_replace(F.regexp_replace(T.normalized(c), r"\s+", ""), r"\.+$", "")
    loose = keys.groupBy(bare(F.col("key")).alias("_b")).agg(each.alias("_loose"))
    real = F.when(~T.normalized(F.col("court_text")).isin(refdata.NON_COURT), F.col("court_text"))
    cites = cites.withColumn("_named", real)
    cites = cites.join(F.broadcast(exact), T.normalized(F.col("_named")) == F.col("_k"), "left").join(F.broadcast(loose), bare(F.col("_named")) == F.col("_b"), "left")
    cites = cites.withColumn("courts", F.coalesce("_exact", "_loose")).drop("_k", "_b", "_exact", "_loose")
    if on is not None and "CT006" not in on:
        return cites.drop("_named")
    # only a text that names no court meets the table: as many words as a court, each the beginning of the other
    words = F.filter(F.split(F.lower("_named"), "[^a-z0-9]+"), lambda w: w != "")
    cites = cites.withColumn("_words", F.when(F.col("court_id").isNull() & F.col("courts").isNull(), words)).drop("_named")
    tokens = [[w for w in re.split("[^a-z0-9]+", r["abbrev"].lower()) if w] for r in listed]
    at = lambda n: [i for i, t in enumerate(tokens) if len(t) == n]
    found = F.lit(None).cast("array<string>")
    for n in sorted({len(t) for t in tokens}):
        table = F.split(F.lit("\n".join("\t".join([listed[i]["abbrev"], *tokens[i]]) for i in at(n))), "\n")
        fits = lambda row, n=n: F.forall(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: _begins(F.get(F.split(row, "\t"), i + 1), F.get(F.col("_words"), i)))
        other = lambda row, n=n: F.slice(F.split(row, "\t"), 2, n) != F.col("_words")
        near = F.transform(F.slice(F.filter(table, lambda row: fits(row) & other(row)), 1, 2), lambda row: F.split(row, "\t")[0])  # noqa: B023
        found = F.when(F.size("_words") == n, near).otherwise(found)
    return cites.withColumn("suggested", F.when(F.col("_words").isNotNull(), found)).drop("_words")


def _begins(a: Column, b: Column) -> Column:
    return F.startswith(a, b) | F.startswith(b, a)


# what several rules ask for, and which: bound once, and only where a citation has what it is made of
_BOUND = {"_variant": {"RP001"}, "_fixed": {"RP001"}, "_ranges": {"ST003", "ST004"}, "_pin": {"ST002"}, "_secs": {"ST006", "ST007"}}


def bound(cites: DataFrame, on: set[str]) -> DataFrame:
    other = F.col("reporter") != F.col("canonical")
    made = {
        "_variant": F.when(other, T.spacing_variant(F.col("reporter"), F.col("canonical"))),
        "_fixed": F.when(other, T.replace_first(F.col("text"), F.col("reporter"), F.col("canonical"))),
        "_ranges": F.when(F.col("pin").rlike(r"\d\s*[^\d\s,&]"), T.pin_ranges(F.col("pin"))),
        "_pin": F.when(F.col("first_page").isNotNull() & F.col("pin").isNotNull(), T.pin_first(F.col("pin"))),
        "_secs": F.when(F.col("kind") == "statute", T.sections(F.col("sections"))),
    }
    return cites.withColumns({k: x for k, x in made.items() if _BOUND[k] & on})


def row_rules(profile: Profile) -> dict[str, Column]:
    """Rule -> array of findings (or null), from one enriched citation."""
    c = F.col
    kind, year = c("kind"), c("year")
    one = lambda test, finding: F.when(test, F.array(finding))
    variant, fixed = c("_variant"), c("_fixed")
    rp001 = F.when(variant == "different", _say("The standard form of ", _js("reporter"), " is ", _js("canonical"), ".")).when(variant == "tightened", _say(_js("reporter"), f" runs together what {profile.label} writes apart: ", _js("canonical"), ".")).otherwise(_say("Spacing: ", _js("text"), f" is ", _js(fixed), f" by {profile.label}."))
    covering = F.filter("siblings", lambda e: (e["start"] <= year) & (e["end"].isNull() | (year <= e["end"])))
    only = F.when(F.size(covering) == 1, F.get(covering, F.lit(0))["abbrev"])
    outside = (year < c("ed.start")) | (year > c("ed.end"))
    dt001 = _say(c("canonical"), " was published ", T.coverage_label(c("ed.start"), c("ed.end")), ", but this cites ", year, ".")
    resolved = F.when(F.size("courts") == 1, F.get("courts", F.lit(0)))
    ranges, pin, secs = c("_ranges"), c("_pin"), c("_secs")
    wanted = F.when(secs["join"] == "single", "§").otherwise("§§")
    at = F.locate("§", "text") - 1
    symbol_start, symbol_end = c("start") + at, c("start") + at + F.length(F.regexp_extract(F.substring(c("text"), at + 1, F.length("text")), "^§+", 0))
    a, b = F.get(secs["items"], F.lit(0)), F.get(secs["items"], F.lit(1))
    drops = (secs["join"] == "span") & (F.size(secs["items"]) == 2) & a.rlike(r"^\d+$") & b.rlike(r"^\d+$") & (F.length(b) < F.length(a))
    expanded = F.concat(F.substring(a, F.lit(1), F.length(a) - F.length(b)), b)
    label = F.when(kind == "id", "An `Id.` citation").when(kind == "supra", "A `supra` citation").otherwise("A short-form citation")
    hint = F.when(c("case_name").isNotNull(), _say(" No earlier citation names ", _js("case_name"), ".")).otherwise(" The first citation of an authority is a full one.")
    joined = F.array_join(F.transform("courts", lambda x: x["name"]), " or ")
    unpublished = (kind == "neutral") & c("neutral_body").rlike(r"-U\b")
    written = F.array_join(F.transform("ways", T.quoted), ", ")
    token_start = c("start") + F.instr(c("text"), c("reporter")) - 1
    others = F.when(F.size("near") > 1, _say(" (or ", F.array_join(F.transform(F.slice("near", 2, 2), T.quoted), ", "), ")")).otherwise("")
    rules = {
        "RP002": one((kind == "unknown") & (F.size("near") > 0), _finding("RP002", "error", _say("No reporter is called ", _js("reporter"), "; the nearest name is ", _js(F.get("near", F.lit(0))), others, "."), fix=F.get("near", F.lit(0)), safety="unsafe", fix_start=token_start, fix_end=token_start + F.length("reporter"))),
        "RP003": one(F.size("ways") > 1, _finding("RP003", "warning", _say("One document, ", F.size("ways"), " spellings of ", _js("canonical"), ": ", written, "."))),
        "AU002": one((kind == "database") & ~c("has_parallel") & ~c("docket"), _finding("AU002", "warning", _say(_js("text"), " is a ", c("database"), " database number with no reporter citation. Add the reporter cite, or say the case is unreported."))),
        "RP001": one(c("canonical").isNotNull() & (c("reporter") != c("canonical")) & ~((variant == "tightened") & F.lit(profile.tightens)), _finding("RP001", F.when(T.squash(c("reporter")) == T.squash(c("canonical")), "info").otherwise("warning"), rp001, fix=fixed, safety="safe")),
        "DT001": one(c("ed").isNotNull() & outside, _finding("DT001", "error", F.when(only.isNotNull(), _say(dt001, " A ", year, " case in this series would be in ", _js(only), ".")).otherwise(_say(dt001, " Check the volume, the reporter and the year.")), fix=T.replace_first(c("text"), c("reporter"), only), safety="unsafe")),
        "DT002": F.when(year > profile.current_year, F.array(_finding("DT002", "error", _say("The year ", year, f" is yet to come; the check is made for {profile.current_year}.")))).when(year < 1600, F.array(_finding("DT002", "warning", _say("No reporter goes back to ", year, "; the year looks mistyped.")))),
        "CT001": one(resolved.isNotNull() & (resolved["id"] != "scotus") & (resolved["abbrev"] != c("court_text")), _finding("CT001", "info", _say("Court is written ", _js("court_text"), "; the standard abbreviation is ", _js(resolved["abbrev"]), "."), "court_start", "court_end", resolved["abbrev"], "unsafe")),
        "CT002": one(c("ed.scotus_only") & c("court_id").isNotNull() & (c("court_id") != "scotus"), _finding("CT002", "error", _say("A volume of ", _js("canonical"), " holds cases of the Supreme Court of the United States only, not of ", c("court.name"), "."))),
        "CT003": one(c("court").isNotNull() & ((year < c("court.start")) | (year > c("court.end"))), _finding("CT003", "warning", _say("No case of ", year, " can be by ", c("court.name"), ", a court of ", T.coverage_label(c("court.start"), c("court.end")), "."))),
        "CT004": one(c("court_id").isNull() & (F.size("courts") >= 2), _finding("CT004", "info", _say("Several courts go by ", _js("court_text"), ": ", joined, ". Say which."), "court_start", "court_end")),
        "CT005": one(c("ed.scotus_only") & (c("court_id") == "scotus"), _finding("CT005", "info", _say(_js("canonical"), " covers one court only, so rule 10.4(a) asks for the year alone."), "court_start", "court_end", F.lit(""), "safe", "court_start", "court_stop")),
        "CT006": one(F.size("suggested") == 1, _finding("CT006", "warning", _say("The standard abbreviation for ", _js("court_text"), " is ", _js(F.get("suggested", F.lit(0))), ", with fewer words spelt out."), "court_start", "court_end", F.get("suggested", F.lit(0)), "unsafe")),
        "ST001": one(kind.isin("id", "supra", "short-form") & c("resource_key").isNull(), _finding("ST001", "error", _say(label, " (", _js("text"), ") has no full citation before it.", hint))),
        "ST002": one(pin < c("first_page"), _finding("ST002", "warning", _say("Pin cite ", pin, " is before page ", c("first_page"), ", where the opinion starts."))),
        "ST003": F.transform(F.filter(ranges, lambda r: T.abbreviate_range(r["from"], r["to"]) != r["written"]), lambda r: _finding("ST003", "info", _say("Pages ", r["from"], "-", r["written"], " are ", r["from"], "-", T.abbreviate_range(r["from"], r["to"]), " by rule 3.2(a): two digits, and those that differ."))),
        "ST004": F.transform(F.filter(ranges, lambda r: r["to"] < r["from"]), lambda r: _finding("ST004", "warning", _say("Pages ", r["from"], "-", r["to"], " run backwards."))),
        "ST005": one((kind == "short-form") & year.isNotNull(), _finding("ST005", "warning", _say("The date belongs to the full citation (B10.2), but ", _js("text"), " gives ", year, " again."))),
        "ST006": one(c("symbol").isNotNull() & (c("symbol") != wanted), _finding("ST006", "warning", F.when(wanted == "§§", _say(_js("text"), ": ", F.size(secs["items"]), ' sections ask for "§§" (rule 3.3(b)).')).otherwise(_say(_js("text"), ': one section asks for a single "§" (rule 3.3(b)).')), symbol_start, symbol_end, wanted, "safe")),
        "ST007": one(drops, _finding("ST007", "warning", _say("Sections ", a, "-", b, " are ", a, "-", expanded, " in full: by rule 3.3(b), unlike 3.2(a) for pages, no digit goes."))),
        "AU001": F.when(unpublished, F.array(_finding("AU001", "error", _say(_js("text"), ' carries "-U", the mark of an unpublished order without the force of a precedent.')))).when(c("ed.non_precedential"), F.array(_finding("AU001", "warning", _say(_js("text"), " is in ", c("ed.name"), ", whose dispositions are unpublished and do not bind.")))),
    }
    return rules


def verified(cites: DataFrame, authorities: DataFrame) -> DataFrame:
    """Citations with status, records (array of case_name, year, court_id, url), from a table of authorities (key, case_name, year, court_id, url)."""
    records = authorities.groupBy(T.normalized(F.col("key")).alias("_key")).agg(F.collect_list(F.struct("case_name", "year", "court_id", "url")).alias("records"))
    own = F.when(F.col("kind").isin("id", "supra", "short-form"), None).otherwise(T.normalized(F.when(F.col("kind") == "case-reporter", F.concat_ws(" ", "volume", "canonical", "page")).otherwise(F.col("resource_key"))))
    out = cites.withColumn("_own", own).join(records, F.col("_own") == F.col("_key"), "left")
    status = F.when(F.col("_own").isNull(), "unchecked").when(F.col("records").isNull(), "not-found").when(F.size("records") > 1, "ambiguous").otherwise("found")
    return out.withColumn("status", status).drop("_own", "_key")


def verified_by_lookups(cites: DataFrame, lookups: DataFrame, most: int = MAX_LOOKUPS) -> DataFrame:
    """Citations with status, records and beyond, from answers to lookups: (key, status, clusters: array of case_name, year, court_id, url).

    One answer serves all uses of a key; each document asks for its first `most` keys. What was not
    asked, or not answered, is unchecked, never absent.
    """
    out = looked_up(cites, lookups.select("key", "status", F.size("clusters").alias("n_clusters")), most)
    answers = lookups.groupBy(F.col("key").alias("_key")).agg(F.first("clusters").alias("records"))
    return out.join(answers, out.resource_key == answers._key, "left").drop("_key").withColumn("records", F.when(F.col("status").isin("found", "ambiguous"), F.col("records")))


def verification_rules(source: str = "caller") -> dict[str, Column]:
    rec = F.get("records", 0)
    one = lambda test, finding: F.when(test, F.array(finding))
    status = F.col("status")
    return {
        "VF001": one(status == "not-found", _finding("VF001", "warning", _say(_js("text"), f" does not appear in the {source} corpus. Make sure that it exists."))),
        "VF002": one(status == "ambiguous", _finding("VF002", "warning", _say(_js("text"), " fits more than one authority (", F.array_join(F.transform(F.slice("records", 1, 3), lambda r: r["case_name"]), "; "), "). A court or a year would tell them apart."))),
        "VF003": one((status == "found") & F.col("case_name").isNotNull() & (T.name_similarity(F.col("case_name"), rec["case_name"]) < 0.34), _finding("VF003", "error", _say(_js("text"), " is ", _js(rec["case_name"]), ", not ", _js("case_name"), "."))),
        "VF004": one((status == "found") & (F.coalesce(rec["year"], F.lit(0)) != 0) & (F.col("year") != rec["year"]), _finding("VF004", "warning", _say("The corpus gives ", rec["case_name"], " the year ", rec["year"], ", the text ", F.col("year"), "."))),
    }


def selected(enable: list[str] | None = None, disable: list[str] | None = None, verification: bool = True) -> list[str]:
    """Rule ids by id or name, in any case, in registry order."""
    names = {x.lower(): rule for rule, name in REGISTRY for x in (rule, name)}
    pick = lambda xs: {names[x.lower()] for x in xs if x.lower() in names}
    on = pick(enable) if enable else {r for r, _ in REGISTRY}
    on -= pick(disable or [])
    return [r for r, _ in REGISTRY if r in on and (verification or not r.startswith("VF"))]


@dataclass(frozen=True)
class DocumentRule:
    """A rule of the caller's in Python: the citations of a document in order (dicts by their columns) -> findings (dicts by those of FINDING; what is left out is null).

    If it raises on a document, that document gets a finding of the rule that says so, at 0 to 0; all others keep theirs.
    """

    rule_id: str
    check: Callable[[list[dict]], Iterable[dict]]

    def findings(self, cites: list[dict]) -> list[dict]:
        try:
            found = [{"rule_id": self.rule_id, "severity": "warning"} | f for f in self.check(cites)]
            pa.array(found, _PLAIN)  # a finding of wrong types is a failure of this document, not of the job
            return found
        except Exception as e:  # noqa: BLE001 - a rule of the caller's may raise anything
            return [{"rule_id": self.rule_id, "severity": "error", "message": f"The rule failed on this document: {type(e).__name__}: {ascii(str(e))[:200]}", "start": 0, "end": 0}]


_FIELDS = [x.split() for x in FINDING.split(", ")]
_PLAIN = pa.struct([(n, pa.int32() if k == "int" else pa.string()) for n, k in _FIELDS])


def by_document(cites: DataFrame, rules: list[DocumentRule]) -> DataFrame:
    """Findings (doc_id and FINDING) of rules that see a document at a time: its citations, not its text, are brought together, once for all rules."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("idx").to_pylist()
        found = [f for rule in rules for f in rule.findings(rows)]
        doc = pa.array([rows[0]["doc_id"]] * len(found), pa.int64())
        return pa.table([doc, *(pa.array([f.get(n) for f in found], _PLAIN.field(n).type) for n, _ in _FIELDS)], names=["doc_id", *(n for n, _ in _FIELDS)])

    return cites.groupBy("doc_id").applyInArrow(run, f"doc_id long, {FINDING}")


Custom = Callable[[DataFrame], DataFrame] | DocumentRule
_NONE = f"array<struct<{FINDING.replace(' ', ':').replace(',:', ',')}>>"


def refusals() -> Column:
    """A finding for a text that was not read: it must not look like one without errors."""
    say = F.concat(F.lit("The text has "), F.col("page"), F.lit(f" characters, above the limit of {MAX_CHARS}. It was not checked."))
    return F.when(F.col("kind") == "refused", F.array(_finding("INPUT", "error", say)))


def run_rules(cites: DataFrame, profile: Profile | None = None, authorities: DataFrame | None = None, enable=None, disable=None, editions: DataFrame | None = None, spellings: DataFrame | None = None, custom: list[Custom] = (), notices: list[str] | None = None, lookups: DataFrame | None = None, isolated: bool = False) -> DataFrame:
    """Findings (doc_id and FINDING) of all chosen rules, in one projection over the parsed rows. Order them with ordered().

    A custom rule that cannot be planned, or a table of authorities that cannot be joined, is left
    out and told in notices; the other rules run. Texts that were refused give a finding INPUT.
    No rule chosen gives no findings but those. A DocumentRule that raises tells so for the document
    alone. With isolated the citations are written first, then the findings of each part (the rules
    here, verification, each rule of the caller's), so that what fails only as it runs is left out
    and told as well, and texts are parsed once.
    """
    if isolated:
        cites = stored(cites)
    spark, profile, notices = cites.sparkSession, profile or Profile(), notices if notices is not None else []
    on = selected(enable, disable, authorities is not None or lookups is not None)
    own = plain = bound(enriched(cites, refdata.reporters(spark, editions), refdata.courts(spark), set(on)), set(on))
    columns = row_rules(profile)
    if any(r.startswith("VF") for r in on):
        try:
            own, columns = (verified(own, authorities), columns | verification_rules()) if lookups is None else (verified_by_lookups(own, lookups), columns | verification_rules("lookup"))
        except AnalysisException as e:
            notices.append(f"authorities were not checked: {e.getCondition()}")
    arrays = [F.coalesce(x, F.array().cast(_NONE)).cast(_NONE) for x in [refusals(), *(columns[r] for r in on if r in columns)]]
    # a projection of its own is compiled; inside the generator the same expression would be interpreted
    one = lambda df, arrays: df.select("doc_id", F.concat(*arrays).alias("_all")).select("doc_id", F.explode("_all").alias("f")).select("doc_id", "f.*")
    if isolated and own is not plain:
        out = stored(one(plain, [a for a, r in zip(arrays, ["", *(r for r in on if r in columns)], strict=True) if not r.startswith("VF")]))
        try:
            out = out.unionByName(stored(one(own, [a for a, r in zip(arrays[1:], (r for r in on if r in columns), strict=True) if r.startswith("VF")])))
        except Exception as e:  # noqa: BLE001 - whatever stops the table of authorities must not stop the rules
            notices.append(f"authorities were not checked: {type(e).__name__}: {str(e)[:200]}")
    else:
        out = stored(one(own, arrays)) if isolated else one(own, arrays)
    seen = plain.filter("kind not in ('unknown', 'refused')")
    if by_doc := [r for r in custom if isinstance(r, DocumentRule)]:
        out = out.unionByName(by_document(cites.filter("kind not in ('unknown', 'refused')"), by_doc))
    for i, rule in enumerate(r for r in custom if not isinstance(r, DocumentRule)):
        try:
            found = rule(seen).select("doc_id", *[x.split()[0] for x in FINDING.split(", ")])
            out = out.unionByName(stored(found) if isolated else found)
        except Exception as e:  # noqa: BLE001 - a rule of the caller's may raise anything
            notices.append(f"rule {getattr(rule, '__name__', i)} was skipped: {type(e).__name__}: {str(e)[:200]}")
    return out


def severity_rank(c: str = "severity") -> Column:
    return F.when(F.col(c) == "error", 2).when(F.col(c) == "warning", 1).otherwise(0)


def ordered(findings: DataFrame) -> DataFrame:
    """Findings with place, counted from 1 in each document: by start, severity from high to low, rule."""
    by = Window.partitionBy("doc_id").orderBy("start", severity_rank().desc(), "rule_id", "end", "message")
    return findings.withColumn("place", F.row_number().over(by))


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("doc_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("error", "warning", "info")])
