"""Column functions over texts, spans, page and section references. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASHES = "-‐‑‒–—―−"  # fixed values: the dashes that part a range
_D = DASHES.replace("-", r"\-")  # inside a class of a pattern


# Endings of periodicals: reviews and journals of law. Stops and blanks in them may be left out.
REVIEWS = ["L. Rev.", "L. Review", "Law Rev.", "Law Review", "L. J."]


def _loosely(ending: str) -> str:
    return ending.replace(".", r"\.?").replace(" ", r"\s?")


# What tells an abbreviation of a periodical: such an ending; "J." before the matter of a journal; "J. L." anywhere.
PERIODICALS = [rf"\b({'|'.join(map(_loosely, REVIEWS))})$", r"^J\. ?[A-Z]", r"\bJ\. ?L\."]


def squash(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def normalized(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))


def quoted(x: Column) -> Column:
    """x as a JSON string."""
    return F.concat(F.lit('"'), F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))


def span_text(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end) & (a_start < a_end) & (b_start < b_end)


def line_col(text: Column, offset: Column) -> Column:
    """1-based struct (line, col); offsets past the end count as the end, negative ones raise."""
    head = F.substring(text, F.lit(1), F.least(offset, F.length(text)).cast("int"))
    line = F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1
    col = F.length(F.substring_index(head, "\n", -1)) + 1
    return F.when(offset < 0, F.raise_error(F.lit("offset must not be negative"))).otherwise(F.struct(line.alias("line"), col.alias("col")))


def snippet(text: Column, start: Column, end: Column, width: int = 80) -> Column:
    """The span with half the width on either side, white space collapsed, dots where cut."""
    half = width // 2
    a, b = F.greatest(F.lit(0), start - half), F.least(F.length(text), end + half)
    body = F.trim(F.regexp_replace(span_text(text, a, b), r"\s+", " "))
    return F.concat(F.when(a > 0, "…").otherwise(""), body, F.when(b < F.length(text), "…").otherwise(""))


def line_diff(old: Column, new: Column) -> Column:
    """Lines that differ at the same place, the old one after '- ' and the new one after '+ '."""
    rows = F.zip_with(F.split(old, "\n"), F.split(new, "\n"), lambda a, b: F.when(a.eqNullSafe(b), F.lit(None)).otherwise(F.concat_ws("\n", F.concat(F.lit("- "), a), F.concat(F.lit("+ "), b))))
    return F.array_join(F.filter(rows, lambda x: x.isNotNull()), "\n")


def replace_first(text: Column, old: Column, new: Column) -> Column:
    at = F.instr(text, old)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(old), F.length(text)))).otherwise(text)


def spacing_variant(written: Column, canonical: Column) -> Column:
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    gaps = lambda c: F.length(c) - F.length(bare(c))
    return F.when(written == canonical, "same").when(bare(written) != bare(canonical), "different").when(gaps(written) < gaps(canonical), "tightened").when(gaps(written) > gaps(canonical), "loosened").otherwise("different")


def expand_to(start: Column, written: Column) -> Column:
    """End of a page range written short: 371-72 ends at 372; never turned backwards by expanding."""
    s = start.cast("string")
    full = F.concat(F.substring(s, F.lit(1), F.length(s) - F.length(written)), written).try_cast("long")
    return F.when((F.length(written) < F.length(s)) & (full >= start), full).otherwise(written.try_cast("long"))


def abbreviate_range(start: Column, end: Column) -> Column:
    """End of a page range with repeated digits dropped, two kept."""
    a, b = start.cast("string"), end.cast("string")
    same = F.size(F.filter(F.sequence(F.lit(1), F.length(b)), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))
    keep = F.greatest(F.lit(2), F.length(b) - same)
    return F.when((F.length(a) != F.length(b)) | (end < start), b).otherwise(F.substring(b, F.length(b) - F.least(keep, F.length(b)) + 1, F.length(b)))


_RANGE = rf"(\d+)(?:\s*[{_D}]\s*(\d+))?"  # numbers are taken whole; one that is no long is no page


def pages_only(pin: Column) -> Column:
    """A pin cite without its footnotes: 371 & n.5 is page 371."""
    return F.regexp_replace(pin, rf"\s*&?\s*\bnn?\.\s*\d+(?:\s*[{_D}]\s*\d+)?", "")


def pin_passim(pin: Column) -> Column:
    return F.coalesce(F.lower(F.trim(pin)) == "passim", F.lit(False))


def pin_ranges(pin: Column) -> Column:
    """Ranges of a pin cite: array of (from, to, written)."""
    pin = pages_only(pin)
    pairs = F.arrays_zip(F.regexp_extract_all(pin, F.lit(_RANGE), F.lit(1)).alias("a"), F.regexp_extract_all(pin, F.lit(_RANGE), F.lit(2)).alias("b"))
    found = F.filter(pairs, lambda x: x["b"] != "")
    return F.transform(found, lambda x: F.struct(x["a"].try_cast("long").alias("from"), expand_to(x["a"].try_cast("long"), x["b"]).alias("to"), x["b"].alias("written")))


def pin_first(pin: Column) -> Column:
    """The smallest page of a pin cite."""
    return F.array_min(F.transform(F.regexp_extract_all(pages_only(pin), F.lit(_RANGE), F.lit(1)), lambda x: x.try_cast("long")))


def sections(raw: Column) -> Column:
    """Struct (items, join) of a reference to sections: join is single, list or span.

    A dash parts two sections only where bare numbers stand on both sides; elsewhere, as in
    240.10b-5, it belongs to the name.
    """
    text = F.trim(raw)
    # a dash that only joins a name is put aside while the parts are split
    mark = F.regexp_replace(text, rf"(?<![\d])\s*[{_D}]\s*|\s*[{_D}]\s*(?!\d+\s*(?:[,{_D}]|$))", "\u0001")
    mark = F.regexp_replace(mark, rf"((?:^|[,{_D}\u0001])\s*[^,{_D}\u0001]*[^\d\s,{_D}\u0001][^,{_D}\u0001]*)[{_D}]", "$1\u0001")
    items = F.transform(F.split(mark, rf"[,{_D}]"), lambda x: F.replace(F.trim(x), F.lit("\u0001"), F.lit("-")))
    n = F.size(items)
    whole = F.struct(F.array(text).alias("items"), F.lit("single").alias("join"))
    kind = F.when(n == 1, "single").when(F.contains(mark, F.lit(",")), "list").otherwise("span")
    return F.when(F.exists(items, lambda x: x == ""), whole).otherwise(F.struct(F.when(n == 1, F.array(text)).otherwise(items).alias("items"), kind.alias("join")))


def looks_like_periodical(x: Column) -> Column:
    """Whether an abbreviation names a law review or journal; asked only of what no reporter table has."""
    return F.coalesce(F.trim(x).rlike("|".join(f"(?:{p})" for p in PERIODICALS)), F.lit(False))


# Words that tell nothing about which case is named.
NOISE = ["and", "co", "coop", "corp", "inc", "llc", "llp", "ltd", "of", "the", "v", "airlines", "airways", "air", "company", "incorporated", "limited"]


def name_words(x: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda w: (F.length(w) > 1) & ~w.isin(NOISE)))


def name_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the telling words; 1 if either name has none."""
    x, y = name_words(a), name_words(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 1.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def edit_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def count_before(text: Column, needle: Column, offset: Column) -> Column:
    head = F.substring(text, F.lit(1), offset)
    return F.when(F.length(needle) > 0, ((F.length(head) - F.length(F.replace(head, needle, F.lit("")))) / F.length(needle)).cast("int")).otherwise(0)


def tidy(text: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "[ \t]+\n", "\n")
    return F.regexp_replace(F.regexp_replace(x, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def base_name(name: Column) -> Column:
    x = F.trim(F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), r'[\\/:*?"<>|]+', "-"))
    return F.when((x == "") | x.isNull(), "document").otherwise(x)


def csv_field(x: Column) -> Column:
    x = F.coalesce(x, F.lit(""))
    return F.when(x.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def html_escape(x: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def strip_xml_invalid(x: Column) -> Column:
    return F.regexp_replace(x, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def repair_section_symbols(x: Column) -> Column:
    """Between a code's abbreviation and a digit a short run of section signs, eights and blanks with a true sign keeps its signs alone."""
    run = r"((?:U\.\s*S\.\s*C\.|C\.F\.R\.)\s*)(?=[§8 ]{1,8}\d)(?=[8 ]*§)[8 ]*(§)[8 ]*(§?)[8 ]*(?=\d)"
    return F.regexp_replace(x, run, "$1$2$3 ")


def coverage_label(start: Column, end: Column) -> Column:
    return F.concat(start.cast("string"), F.lit("–"), F.coalesce(end.cast("string"), F.lit("present")))


def duration_label(ms: Column) -> Column:
    """812ms, or 4.1s from a second on."""
    return F.when(ms < 1000, F.concat(F.round(ms, 0).cast("long").cast("string"), F.lit("ms"))).otherwise(F.concat(F.format_string("%.1f", (ms / 1000).cast("double")), F.lit("s")))


def phases_label(phases: Column) -> Column:
    """Phases (name, ms) of a millisecond or more, in one line."""
    return F.array_join(F.transform(F.filter(phases, lambda p: p["ms"] >= 1), lambda p: F.concat(p["name"], F.lit(" "), duration_label(p["ms"]))), " · ")


def chars_per_second(chars: Column, ms: Column) -> Column:
    return F.when((ms > 0) & (chars > 0), F.round(chars / (ms / 1000), 0).cast("long"))
