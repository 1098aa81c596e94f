"""Quotations at pin cites from opinions, and comparison of extractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

BODIES = ["html_with_citations", "html_columbia", "html_lawbox", "xml_harvard", "html", "plain_text"]
MAX_QUOTE = 420
MAX_QUOTED = 60
MAX_LOOKUPS = 120
# Entities of opinions; the shape of an opinion's address.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "mdash": "—", "ndash": "–", "ldquo": "“", "rdquo": "”", "lsquo": "‘", "rsquo": "’", "sect": "§", "para": "¶"}
OPINION_PATH = r"^/api/rest/v\d+/opinions/\d+/$"


def decode_entities(x: Column) -> Column:
    """The entities above and numbers from 1 to 10FFFF; any other stays as it is written. A text is split at its entities, so none is decoded twice."""
    pattern = r"&(?:#[xX][0-9a-fA-F]+|#[0-9]+|[a-zA-Z]+);"
    table = F.create_map(*[F.lit(v) for kv in ENTITIES.items() for v in kv])

    def decoded(e: Column) -> Column:
        body = F.substring(e, F.lit(2), F.length(e) - 2)
        hexadecimal = F.lower(F.substring(body, 1, 2)) == "#x"
        digits = F.when(hexadecimal, F.substring(body, F.lit(3), F.length(body))).otherwise(F.substring(body, F.lit(2), F.length(body)))
        code = F.when(F.length(digits) <= 8, F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10))).cast("long")
        # four bytes of UTF-32 name the character
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        number = F.when(code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF), char)
        return F.coalesce(F.when(F.startswith(body, F.lit("#")), number).otherwise(F.try_element_at(table, F.lower(body))), e)

    between = F.split(x, pattern)
    found = F.regexp_extract_all(x, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(between.alias("t"), found.alias("e"))
    return F.when(F.contains(x, F.lit("&")), F.array_join(F.transform(pairs, lambda p: F.concat(p["t"], F.coalesce(decoded(p["e"]), F.lit("")))), "")).otherwise(x)


def opinion_path(url: Column, origin: str) -> Column:
    """The path of an opinion's address on one origin; null for any other address, which is then not asked."""
    path = F.substring(url, F.lit(len(origin) + 1), F.length(url))
    return F.when(F.startswith(url, F.lit(f"{origin}/")) & path.rlike(OPINION_PATH), path)


def citation_components(cites: DataFrame) -> DataFrame:
    """(doc_id, idx, volume, reporter, page): all that a lookup is told, of complete case citations alone."""
    reporter = F.coalesce("canonical", "reporter")
    return cites.filter(F.col("kind") == "case-reporter").select("doc_id", "idx", "volume", reporter.alias("reporter"), "page").filter("volume <> '' AND reporter <> '' AND page <> ''")


def cluster_year(date: Column) -> Column:
    """The year of a date as text; null where it does not begin with one."""
    return F.when(date.rlike(r"^\d{4}"), F.substring(date, 1, 4)).cast("int")


def redacted(message: Column) -> Column:
    """A message without tokens: after the word Token, or 40 hexadecimal digits."""
    return F.regexp_replace(F.regexp_replace(message, r"(?i)\bToken\s+\S+", "Token …"), r"(?i)\b[0-9a-f]{40}\b", "…")


def looks_like_token(x: Column) -> Column:
    return F.trim(x).rlike(r"^[0-9a-zA-Z]{20,64}$")


def annotation_comment(case_name: Column, pin: Column, quote: Column, note: Column, url: Column, source: str) -> Column:
    """Lines of a comment: the case and page, the words, a note, where they are from, and a caution."""
    return F.concat_ws(
        "\n",
        F.concat(case_name, F.coalesce(F.concat(F.lit(", at "), pin), F.lit(""))),
        F.concat(F.lit("“"), quote, F.lit("”")),
        note,
        F.coalesce(F.concat(F.lit(f"{source}: "), url), F.lit(f"Source: {source}")),
        F.lit("A quotation is there to be checked; it does not replace reading the opinion."),
    )


def within_rate(requests: DataFrame, most: int = 60, seconds: int = 60) -> DataFrame:
    """(client, at in seconds) of started requests -> client, at, recent, allowed: how many began in the window that ends there, and whether that keeps the limit."""
    window = Window.partitionBy("client").orderBy(F.col("at").cast("long")).rangeBetween(-seconds, 0)
    out = requests.withColumn("recent", F.count("*").over(window))
    return out.withColumn("allowed", F.col("recent") <= most)


def notices(asked: DataFrame, quoted: DataFrame | None = None, lookups: int = MAX_LOOKUPS, quotes: int = MAX_QUOTED) -> DataFrame:
    """(doc_id, notice): what the ceilings and failures left unchecked or unquoted in a document.

    asked: what looked_up() gives; quoted: what annotations() gives. Documents with nothing to tell have no row.
    """
    keys = asked.filter("kind = 'case-reporter'").groupBy("doc_id", "resource_key").agg(F.max("beyond").alias("beyond"), F.max(F.col("status") == "unchecked").alias("open"))
    per = keys.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("beyond").alias("over"), F.count_if(F.col("open") & ~F.col("beyond")).alias("failed"))
    text = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    first = F.when(F.col("over") > 0, text("Looked up the first ", F.col("n") - F.col("over"), " of ", F.col("n"), " distinct citations. The other ", F.when(F.col("over") == 1, "one was not checked: it is").otherwise(F.concat(F.col("over").cast("string"), F.lit(" were not checked: they are"))), " neither verified nor absent."))
    failed = F.when(F.col("failed") > 0, text(F.col("failed"), F.when(F.col("failed") == 1, " citation").otherwise(" citations"), " could not be checked."))
    told = lambda df, *xs: df.select("doc_id", F.explode(F.array_compact(F.array(*xs))).alias("notice"))  # noqa: E731 - one pass over what is counted
    out = told(per, first, failed)
    if quoted is not None:
        counts = quoted.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("candidates").alias("all"), F.count_if(F.col("quote").isNull()).alias("none"))
        some = F.when(F.col("n") < F.col("all"), text("Quoted the first ", F.col("n"), " of ", F.col("all"), " pin cites; the others were left alone."))
        none = F.when(F.col("none") > 0, text(F.col("none"), F.when(F.col("none") == 1, " pin cite").otherwise(" pin cites"), " could not be quoted; the note on each says why."))
        out = out.unionByName(told(counts, some, none))
    return out


def best_body(columns: list[str]) -> Column:
    """The first opinion body that is not blank."""
    return F.coalesce(*[F.when(F.trim(F.col(c)) != "", F.col(c)) for c in BODIES if c in columns])


def markup_to_text(x: Column) -> Column:
    """Markup to text; star pages become *N, breaks and blocks become lines."""
    for pattern, new in (
        (r"(?is)<(script|style)\b.*?</\1>", ""),
        (r'(?i)<span[^>]*class="[^"]*star-pagination[^"]*"[^>]*>\s*\*?(\d+)\s*</span>', " *$1 "),
        (r'(?i)<page-number[^>]*>\s*\*?(\d+)\s*</page-number>', " *$1 "),
        (r"(?i)<br\s*/?>|</(p|div|blockquote|h[1-6]|li|section)>", "\n"),
        (r"<[^>]*>", ""),
    ):
        x = F.regexp_replace(x, pattern, new)
    return T.tidy(F.regexp_replace(decode_entities(x), r"[ \t]+", " "))


def tidy_quotation(x: Column, most: int = MAX_QUOTE) -> Column:
    """x on one line, cut to a sentence end if that keeps 40 % of the length, else to a word and dots."""
    x = F.trim(F.regexp_replace(F.regexp_replace(x, r"\*\d+", " "), r"\s+", " "))
    head = F.substring(x, 1, most)
    sentence = F.regexp_extract(head, r"(?s)^(.*[.!?][\"”’)]?)(?=\s|$)", 1)
    return F.when(F.length(x) <= most, x).when(F.length(sentence) >= 0.4 * most, sentence).otherwise(F.concat(F.regexp_replace(head, r"\s+\S*$", ""), F.lit("…")))


def quote_at_page(x: Column, page: Column, most: int = MAX_QUOTE) -> Column:
    """What follows the mark *page; null if the mark is not there."""
    mark = F.regexp_instr(x, F.concat(F.lit(r"\*"), page.cast("string"), F.lit(r"(?!\d)")))
    rest = F.substring(x, mark + 1 + F.length(page.cast("string")), F.lit(4 * most))
    return F.when(mark > 0, tidy_quotation(rest, most))


def annotations(cites: DataFrame, clusters: DataFrame, opinions: DataFrame, limit: int = MAX_QUOTED) -> DataFrame:
    """Quotations for citations with a pin page and exactly one cluster.

    clusters: (key, cluster_id, opinion_urls); opinions: (url, bodies). One lookup per cluster and
    page; opinions are tried in order until one has the page. Per document the first `limit`
    citations are quoted.
    """
    by = Window.partitionBy("doc_id", "resource_key").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one = clusters.groupBy(T.normalized(F.col("key")).alias("_k")).agg(F.count("*").alias("n"), F.first("cluster_id").alias("cluster_id"), F.first("opinion_urls").alias("urls")).filter("n = 1").drop("n")
    asked = cites.withColumn("page_no", T.pin_first(F.col("pin"))).withColumn("first_page", F.first(F.when(F.col("kind") == "case-reporter", F.col("page").cast("long")), ignorenulls=True).over(by))
    asked = asked.filter("page_no is not null").join(one, T.normalized(F.col("resource_key")) == F.col("_k"))
    asked = asked.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("idx"))).withColumn("candidates", F.count("*").over(Window.partitionBy("doc_id"))).filter(F.col("nth") <= limit)
    wanted = asked.select("cluster_id", "page_no", "first_page", "urls").distinct().select("*", F.posexplode("urls").alias("at", "url"))
    bodies = opinions.select("url", markup_to_text(best_body(opinions.columns)).alias("body"))
    quoted = wanted.join(bodies, "url").withColumn("quote", F.coalesce(quote_at_page(F.col("body"), F.col("page_no")), F.when((F.col("page_no") == F.col("first_page")) & (F.col("at") == 0), tidy_quotation(F.col("body")))))
    best = quoted.filter("quote is not null").groupBy("cluster_id", "page_no").agg(F.min_by("quote", "at").alias("quote"), F.min_by("url", "at").alias("url"))
    out = asked.join(best, ["cluster_id", "page_no"], "left")
    return out.select("doc_id", "idx", "page_no", "quote", "url", "candidates", F.when(F.col("quote").isNull(), F.concat(F.lit("page "), F.col("page_no").cast("string"), F.lit(" is not marked in the opinion"))).alias("note"))


def lookup_status(status: Column, n_clusters: Column) -> Column:
    """Status of a remote answer; failures and invalid requests are unchecked, never absent."""
    return F.when((status == 200) & (n_clusters == 1), "found").when((status == 300) | ((status == 200) & (n_clusters > 1)), "ambiguous").when(status == 404, "not-found").otherwise("unchecked")


def looked_up(cites: DataFrame, lookups: DataFrame, most: int = MAX_LOOKUPS) -> DataFrame:
    """Status per citation from a lookup table (key, status, n_clusters): each document's distinct keys, the first `most` in order of use; beyond tells of keys past them (see notices)."""
    case = F.col("kind") == "case-reporter"
    others = [F.col(f"`{c}`") for c in cites.columns if c not in ("doc_id", "resource_key")]
    # citations are made once and dealt out once: both windows, and the counts of notices(), keep to documents
    rows = cites.select("doc_id", "resource_key", *others).repartition("doc_id")
    rows = rows.withColumn("_first", F.min(F.when(case, F.col("idx"))).over(Window.partitionBy("doc_id", "resource_key")))
    rows = rows.withColumn("_nth", F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.col("_first").asc_nulls_last(), "resource_key")))
    asked = F.col("_first").isNotNull() & F.col("doc_id").isNotNull() & F.col("resource_key").isNotNull()
    rows = rows.withColumn("_key", F.when(asked, F.col("resource_key")))
    told = lookups.select(F.col("key").alias("_told"), lookup_status(F.col("status"), F.col("n_clusters")).alias("_status"))
    rows = rows.join(told, F.col("_key") == F.col("_told"), "left")
    beyond = F.coalesce(F.col("_key").isNotNull() & (F.col("_nth") > most), F.lit(False))
    status = F.when(case & ~beyond, F.coalesce("_status", F.lit("unchecked"))).otherwise("unchecked")
    return rows.select("doc_id", "resource_key", *others, status.alias("status"), beyond.alias("beyond"))


def accuracy(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(doc_id, text) twice -> expected, recovered, spurious, lost (texts), recall per document, by text in lower case with blanks collapsed."""
    flat = lambda df, name: df.select("doc_id", T.normalized(F.col("text")).alias("t")).distinct().withColumn(name, F.lit(True))
    j = flat(expected, "e").join(flat(actual, "a"), ["doc_id", "t"], "full")
    out = j.groupBy("doc_id").agg(F.count_if("e").alias("expected"), F.count_if(F.col("e") & F.col("a")).alias("recovered"), F.count_if(F.col("e").isNull()).alias("spurious"), F.array_sort(F.collect_list(F.when(F.col("a").isNull(), F.col("t")))).alias("lost"))
    return out.withColumn("recall", F.coalesce(F.try_divide("recovered", "expected"), F.lit(1.0)))
