"""What unknown reporters may stand for, as a join: tokens meet the tables by what is left when letters are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import refdata
from ..functions.text import squash
from .extract import mistyped

MOST = 3  # edits that any tolerance allows


def tolerance(letters: Column) -> Column:
    """Edits that a token of so many letters may be away: 1 up to three, 2 up to six, else 3."""
    return F.when(letters <= 3, 1).when(letters <= 6, 2).otherwise(MOST)


def deletions(word: Column, most: int = MOST) -> Column:
    """All that is left of a word when up to `most` letters are left out, the word itself included.

    Two words within d edits have such a rest in common, of at most d letters left out of each.
    """
    without = lambda w: F.when(
        F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    ).otherwise(F.array().cast("array<string>"))
    rest = found = F.array(word)
    for _ in range(most):
        rest = F.array_distinct(F.flatten(F.transform(rest, without)))
        found = F.array_union(found, rest)
    return found


def suggestions(tokens: DataFrame, editions: DataFrame | None = None, spellings: DataFrame | None = None, top: int = 3, complete: bool = True) -> DataFrame:
    """(token) -> token, place, abbrev, distance: up to `top` reporters that each distinct token may be a misspelling of.

    Ranked by edits between squashed forms, then by difference in length, then by alphabet; a form
    that is spelt like a reporter (distance 0) suggests nothing by it. Each distinct token meets the
    tables once, by an equi-join on deletions(); true distances are computed for pairs that meet
    alone, at most one for each row of the tables. With incomplete tables only mistyped() ones stay.
    Tokens without letters, and nulls, have no rows.
    """
    spark = tokens.sparkSession
    known = refdata.reporters(spark, editions).select(F.col("abbrev").alias("known"), "abbrev", F.lit(False).alias("_late"))
    other = refdata.variations(spark, spellings).select(F.col("written").alias("known"), F.col("canonical").alias("abbrev"))
    other = other.join(known.select("abbrev").distinct().withColumn("_real", F.lit(True)), "abbrev", "left").select("known", "abbrev", F.col("_real").isNull().alias("_late"))
    table = known.unionByName(other).distinct().withColumn("_spelt", squash(F.col("known"))).filter("_spelt <> ''")
    wanted = tokens.select(F.col("token").cast("string").alias("token")).filter("token is not null").distinct().withColumn("_squash", squash(F.col("token"))).filter("_squash <> ''")
    left = wanted.withColumn("_most", tolerance(F.length("_squash")))
    rests = F.when(F.col("_most") == 1, deletions(F.col("_squash"), 1)).when(F.col("_most") == 2, deletions(F.col("_squash"), 2)).otherwise(deletions(F.col("_squash")))
    pairs = left.withColumn("_rest", F.explode(rests)).join(table.withColumn("_rest", F.explode(deletions(F.col("_spelt")))), "_rest").drop("_rest").distinct()
    edits = F.levenshtein("_squash", "_spelt")
    near = pairs.withColumn("distance", edits).filter((F.col("distance") > 0) & (F.col("distance") <= F.col("_most")))
    if not complete:
        slip = F.udf(mistyped, "boolean", useArrow=True)
        near = near.join(near.filter(slip("token", "known")).select("token", "abbrev").distinct(), ["token", "abbrev"], "left_semi")
    best = near.groupBy("token", "abbrev", "_late").agg(F.min(F.struct("distance", F.abs(F.length("_squash") - F.length("_spelt")).alias("apart"))).alias("_best"))
    order = Window.partitionBy("token").orderBy("_best.distance", "_best.apart", "_late", F.expr("abbrev collate UNICODE"))
    return best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top).select("token", "place", "abbrev", F.col("_best.distance").alias("distance"))


def with_suggestions(cites: DataFrame, editions: DataFrame | None = None, spellings: DataFrame | None = None, complete: bool = True) -> DataFrame:
    """Citations whose unknown rows carry tokens alone (extract.citations with shapes="tokens") with `near` from suggestions(); those without any go.

    Only distinct tokens meet the tables; their answers come back by a join on the token, which a common misspelling may skew and Spark splits.
    """
    unknown = cites.filter("kind = 'unknown'")
    found = suggestions(unknown.select(F.col("reporter").alias("token")), editions, spellings, complete=complete)
    near = found.groupBy("token").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "abbrev"))), lambda x: x["abbrev"]).alias("_near"))
    told = unknown.join(near, unknown.reporter == near.token).withColumn("near", F.col("_near")).select(*cites.columns)
    return cites.filter("kind <> 'unknown'").unionByName(told)
