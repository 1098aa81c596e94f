"""Authorities of citation rows that are already there: those of another tool, or of a document cut in parts.

The parser resolves its own citations as it reads a text. Here the same is done on tables: rows are
dealt out by document and sorted, and one pass goes over them with what a document has shown so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

FULL = ["case-reporter", "statute", "database", "neutral"]


def own_key() -> Column:
    """The key of a full citation by its columns; null for others."""
    kind, col = F.col("kind"), F.col
    statute = F.concat(col("volume"), F.lit(" "), F.replace(col("reporter"), F.lit(" "), F.lit("")), F.lit(" § "), col("page"))
    plain = lambda *cs: F.concat(*[x for c in cs for x in (F.lit(" "), F.col(c).cast("string"))][1:])
    return F.when(kind == "case-reporter", plain("volume", "canonical", "page")).when(kind == "statute", statute).when(kind == "database", plain("year", "database", "page")).when(kind == "neutral", plain("year", "neutral_body"))


class _Document:
    """What the citations of a document have shown so far. It holds a row for each case and each name, not for each citation."""

    def __init__(self):
        self.at, self.last, self.head, self.head_key = -1, None, None, None
        self.cases: dict[tuple, str] = {}
        self.names: dict[str, tuple[int, str | None]] = {}  # name -> the place and key of the last full citation that has it
        self.known: list[str] = []  # the same names as they came
        self.fits: dict[str, tuple[int, list[str]]] = {}  # name asked for -> how many of these were looked at, and which of them hold it

    def _named(self, asked: str) -> str | None:
        seen, fits = self.fits.get(asked, (0, []))
        fits += [n for n in self.known[seen:] if asked in n]
        self.fits[asked] = len(self.known), fits
        return max((self.names[n] for n in fits), key=lambda x: x[0], default=(0, None))[1]

    def take(self, kind: str | None, joined: bool, volume: str | None, canonical: str | None, name: str | None, own: str | None) -> tuple[str | None, int | None]:
        """(key, place of the head of its group) of the next citation."""
        self.at += 1
        joined, full = bool(joined) and self.at > 0, kind in FULL
        if joined:
            key = self.head_key
        elif full:
            key = own
        elif kind == "id":
            key = self.last
        elif kind == "short-form":
            key = self.cases.get((volume, canonical))
        else:
            key = self._named(name) if kind == "supra" and name else None
        if not joined:
            self.head, self.head_key = self.at, key
        if kind == "case-reporter" and key is not None:  # a case that took no authority cannot lend one
            self.cases[volume, canonical] = key
        if full and name is not None:
            if name not in self.names:
                self.known.append(name)
            self.names[name] = self.at, key
        self.last = key
        return key, self.head if joined else None


_ASKED = ["_doc", "kind", "joined", "_volume", "_canonical", "_name", "own"]
_MADE = [c for c in _ASKED if c.startswith("_")]


def _passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with what they resolve to; a document may go on in the next batch. Other columns pass as they are."""
    doc, now = None, None
    for batch in batches:
        keys, heads = [], []
        for at, *row in zip(*(batch.column(c).to_pylist() for c in _ASKED), strict=True):
            if now is None or at != doc:
                doc, now = at, _Document()
            key, head = now.take(*row)
            keys.append(key)
            heads.append(head)
        kept = [i for i, c in enumerate(batch.schema.names) if c not in _MADE]
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], pa.array(keys, pa.string()), pa.array(heads, pa.int32())], [*[batch.schema.names[i] for i in kept], "resource_key", "parallel_of"])


def resolved(cites: DataFrame, order: list[str] | None = None, key: str = "doc_id", partitions: int | None = None) -> DataFrame:
    """Citation rows with resource_key and parallel_of (the place, from 0, of the head of its group), found anew.

    Asked for are: key, the columns of order (start by default; for a document in parts part and
    start), kind, joined (whether nothing but a comma or a pin cite parts it from the row before),
    volume, canonical, case_name and own, the key of a full citation (see own_key()). A joined
    citation has the authority of the head of its group; `id` that of the citation before it;
    a short form that of the last case with its volume and reporter that has one; `supra` that of
    the last full citation whose name holds its own. Rows of other kinds have none. A first row
    cannot be joined. Ties in order are broken by kind, own and name; null keys are one document; further columns stay.
    An empty table gives no rows. A document is read in one task, as its order asks, and its rows are sorted on
    disk where they are many; what is held of it is a key for each case, and a place for each different name.
    partitions: into how many the documents are dealt (spark.sql.shuffle.partitions by default); where a
    partition fits the memory of its task, the sort writes nothing, and the one shuffle is all that goes to disk.
    """
    order = order or ["start"]
    packed = cites.drop("resource_key", "parallel_of")
    doc = F.when(F.col(key).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(key).cast("string")))  # null keys meet, too
    dealt = packed.repartition(partitions, doc) if partitions else packed.repartition(doc)
    # made after the shuffle, so that it moves the given columns alone
    made = zip(_MADE, [doc, F.col("volume").cast("string"), F.col("canonical").cast("string"), F.lower("case_name")], strict=True)
    rows = dealt.sortWithinPartitions(doc, *order, "kind", "own", "case_name").select("*", *[c.alias(n) for n, c in made])
    schema = StructType([*packed.schema.fields, StructField("resource_key", StringType()), StructField("parallel_of", IntegerType())])
    return rows.mapInArrow(_passed, schema)
