"""Secret scans: patterns over whole texts, and weak parts that count once complementary parts lie near."""

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, pieces_of, read_table, texts_of

KINDS = ("assign", "access", "hex", "identifier", "weak", "endpoint")
SCOPE = 240
# A-Z are lowered before this one runs, so that letters match in either case and offsets stay.
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_IDENTIFIER = re.compile(r"(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9@._-]{3,})")
_ENDPOINT = re.compile(r"(?:https?|ftp|jdbc:\w+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]{4,}")
_USERINFO = re.compile(r"://([^\s/:@\"'<>]*):([^\s/@\"'<>]+)@")
_WEAK = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def _weak(s: str) -> bool:
    return any(c.isdigit() for c in s) and any("A" <= c <= "Z" for c in s) and any("a" <= c <= "z" for c in s) and _entropy(s) >= 3.5


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the three strong kinds, each leftmost and without overlap within its kind."""
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(low) if m.end() - m.start(1) >= 8] if ":" in low or "=" in low else []
    out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    return out + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


def in_addresses(text: str) -> list[tuple[int, int, str]]:
    """Users, passwords and addresses of addresses that hold a password."""
    if "://" not in text or "@" not in text:
        return []
    low, out = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"), []
    for m in _ENDPOINT.finditer(low):
        if u := _USERINFO.search(low, m.start(), m.end()):
            out += [(*m.span(), "endpoint"), (*u.span(2), "weak")] + ([(*u.span(1), "identifier")] if u[1] else [])
    return out


def linked_spans(text: str, base: list[tuple[int, int, str]], scope: int = SCOPE) -> list[tuple[int, int, str]]:
    """Parts that only together give a credential: an interval join over scopes of a text.

    Secrets are weak tokens (mixed letters and digits, high entropy) outside base spans; they
    count where an access identifier or an endpoint lies within scope characters in the same
    paragraph. The identifiers and endpoints that complete one are reported with it. An address
    with a user and a password in it (scheme://user:password@host) has its parts by itself.
    """
    out = set(in_addresses(text))
    weak = [(m.start(), m.end(), "weak") for m in _WEAK.finditer(text) if _weak(m.group())]
    strong = [s for s in base if s[2] != "access"]
    if not weak and not strong:
        return list(out)
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    partners = [(m.start(), m.end(), "identifier") for m in _IDENTIFIER.finditer(low)] + [(m.start(), m.end(), "endpoint") for m in _ENDPOINT.finditer(low)]
    partners = sorted(partners + [s for s in base if s[2] == "access"])
    if not partners:
        return list(out)
    starts = [p[0] for p in partners]
    reach = scope + max(e - s for s, e, _ in partners)
    taken = sorted((s, e) for s, e, _ in base + [p for p in partners if p[2] != "access"])
    ends, most = [], 0
    for _, e in taken:
        most = max(most, e)
        ends.append(most)
    breaks = [m.start() for m in re.finditer(r"\n\s*\n", text)]
    for s, e, kind in weak + strong:
        if kind == "weak" and (i := bisect_left(taken, (e, 0))) and ends[i - 1] > s:
            continue
        near = [p for p in partners[bisect_left(starts, s - reach) : bisect_right(starts, e + scope)] if p[1] >= s - scope and (p[1] <= s or p[0] >= e) and bisect_left(breaks, min(e, p[1])) == bisect_left(breaks, max(s, p[0]))]
        if near:
            out.update(p for p in near if p[2] != "access")
            if kind == "weak":
                out.add((s, e, kind))
    return list(out)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


_OUT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scan(batches):
    for batch in pieces_of(batches):
        found = []
        for text in texts_of(batch):
            base = base_spans(text)
            n = [sum(k == kind for _, _, k in base) for kind in KINDS[:3]]
            found.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + linked_spans(text, base))))
        cols = list(zip(*found, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], [x.split()[0] for x in _OUT.split(", ")])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> counts and spans of secrets in each whole text, one row per row.

    Spans are kind:start:end in code points, by start and then kind. Null and empty texts have
    none (base_sha256 is that of the empty string). Repeated rows and null ids give a row each;
    further columns are ignored; an empty table gives an empty result.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scan, _OUT)


def _redacted(text: str, mask: str) -> str:
    base = base_spans(text)
    out, at = [], 0
    for s, e, k in sorted(base + linked_spans(text, base)):
        if k in ("identifier", "endpoint") or e <= at:
            continue
        out += [text[at : max(s, at)], mask if s >= at else ""]
        at = e
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """Every row with its secrets masked and n_chars, where there is such a column, counted anew; null texts stay null.

    Rows that repeat or have no id are masked like any other; whole texts are read, however long;
    an empty table stays empty.
    """

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else _redacted(t, mask))
        give_back()

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read_table(spark, sf_dir, "documents"))


def _found(kind: str, source: str, pattern: str, test: str = "true") -> str:
    """SQL for matches of a pattern with their places: the pieces between them tell where each begins."""
    return f"""SELECT doc_id, '{kind}' AS kind, s, s + length(m) AS e FROM (
  SELECT doc_id, m, CAST(sum(length(before) + coalesce(length(last), 0)) OVER w AS BIGINT) AS s, g FROM (
    SELECT doc_id, k, m, g, before, lag(m) OVER (PARTITION BY doc_id ORDER BY k) AS last FROM (
      SELECT doc_id, unnest(range(1, len(ms) + 1)) AS k, unnest(ms) AS m, unnest(gs) AS g, unnest(parts[:len(ms)]) AS before FROM (
        SELECT doc_id, regexp_extract_all({source}, '{pattern}', 0) AS ms, regexp_extract_all({source}, '{pattern}', 1) AS gs, regexp_split_to_array({source}, '{pattern}') AS parts FROM d)))
  WINDOW w AS (PARTITION BY doc_id ORDER BY k)) WHERE {test}"""


_Q = "[\"'']?"
_SQL_ASSIGN = f"(?:password|passwd|secret|token|api_?key){_Q}\\x20*[:=]\\x20*{_Q}([a-z0-9+/_.=-]+)"
_SQL_IDENTIFIER = f"(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?){_Q}\\x20*[:=]\\x20*{_Q}([a-z0-9@._-]{{3,}})"
_SQL_ENDPOINT = "((?:https?|ftp|jdbc:\\w+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\\s\"''<>]{4,})"
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
base AS ({_found('assign', 'low', _SQL_ASSIGN, 'length(g) >= 8')} UNION ALL {_found('access', 'text', '(AKIA[A-Z0-9]{12,})')} UNION ALL {_found('hex', 'text', '([0-9a-f]{32,})')}),
ident AS ({_found('identifier', 'low', _SQL_IDENTIFIER)}),
ends AS ({_found('endpoint', 'low', _SQL_ENDPOINT)}),
runs AS ({_found('run', 'text', '([A-Za-z0-9+/_=-]{20,})')}),
tokens AS (SELECT doc_id, e - length(t) AS s, e, t FROM (SELECT doc_id, e, regexp_extract(substr(text, CAST(s + 1 AS BIGINT), CAST(e - s AS BIGINT)), '(?:^|=)([A-Za-z0-9+/_-]{{20,}}={{0,2}})$', 1) AS t FROM runs JOIN d USING (doc_id)) WHERE t <> ''),
mixed AS (SELECT doc_id, s, e, t FROM tokens WHERE regexp_matches(t, '[0-9]') AND regexp_matches(t, '[A-Z]') AND regexp_matches(t, '[a-z]')),
bits AS (SELECT doc_id, s, -sum(c / n * log2(c / n)) AS h FROM (SELECT doc_id, s, x, CAST(count(*) AS DOUBLE) AS c, CAST(any_value(length(t)) AS DOUBLE) AS n FROM (SELECT doc_id, s, t, unnest(string_split(t, '')) AS x FROM mixed) GROUP BY doc_id, s, x) GROUP BY doc_id, s),
weak AS (SELECT m.doc_id, 'weak' AS kind, m.s, m.e FROM mixed m JOIN bits USING (doc_id, s) WHERE h >= 3.5 AND NOT EXISTS (SELECT 1 FROM (FROM base UNION ALL FROM ident UNION ALL FROM ends) x WHERE x.doc_id = m.doc_id AND x.s < m.e AND m.s < x.e)),
secrets AS (FROM weak UNION ALL SELECT * FROM base WHERE kind <> 'access'),
partners AS (FROM ident UNION ALL FROM ends UNION ALL SELECT * FROM base WHERE kind = 'access'),
pairs AS (SELECT a.doc_id, a.kind AS ak, a.s AS as_, a.e AS ae, b.kind AS bk, b.s AS bs, b.e AS be FROM secrets a JOIN partners b ON a.doc_id = b.doc_id JOIN d ON d.doc_id = a.doc_id
  WHERE (b.e <= a.s OR b.s >= a.e) AND b.e >= a.s - 240 AND b.s <= a.e + 240
  AND NOT regexp_matches(substr(d.text, CAST(least(a.e, b.e) + 1 AS BIGINT), CAST(greatest(a.s, b.s) - least(a.e, b.e) AS BIGINT)), '\\n\\s*\\n')),
inside AS (SELECT doc_id, s, e, regexp_extract(u, '://([^\\s/:@"''<>]*):([^\\s/@"''<>]+)@', 1) AS name, regexp_extract(u, '://([^\\s/:@"''<>]*):([^\\s/@"''<>]+)@', 2) AS word, strpos(u, '://') AS spot FROM (SELECT doc_id, s, e, substr(low, CAST(s + 1 AS BIGINT), CAST(e - s AS BIGINT)) AS u FROM ends JOIN d USING (doc_id)) WHERE regexp_matches(u, '://([^\\s/:@"''<>]*):([^\\s/@"''<>]+)@')),
linked AS (SELECT doc_id, ak AS kind, as_ AS s, ae AS e FROM pairs WHERE ak = 'weak' UNION SELECT doc_id, bk, bs, be FROM pairs WHERE bk <> 'access'
  UNION SELECT doc_id, 'endpoint', s, e FROM inside UNION SELECT doc_id, 'identifier', s + spot + 2, s + spot + 2 + length(name) FROM inside WHERE name <> '' UNION SELECT doc_id, 'weak', s + spot + 3 + length(name), s + spot + 3 + length(name) + length(word) FROM inside),
spans AS (SELECT *, list_position(['assign', 'access', 'hex', 'identifier', 'weak', 'endpoint'], kind) AS k, kind || ':' || s || ':' || e AS x FROM (FROM base UNION ALL FROM linked)),
joined AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, string_agg(x, ',' ORDER BY s, k, e) FILTER (k <= 3) AS base, string_agg(x, ',' ORDER BY s, k, e) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN joined USING (doc_id)
"""
