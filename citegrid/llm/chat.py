"""Chat formatting: collapse of cumulative snapshots of a conversation, then rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table

def escaped(c: Column) -> Column:
    """A text in which no mark can stand: one backslash more between "<" and "|", also where backslashes stand there already."""
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescaped(c: Column) -> Column:
    """The text that escaped() was given."""
    return F.regexp_replace(c, r"<\\(\\*)\|", "<$1|")


def collapse_snapshots(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> the turns of maximal conversations, with idx counted from 1.

    A conversation that is a proper prefix of another goes; of equal ones the smallest conv_id
    stays. Turns are compared by role and text (null and empty are equal) in order of turn, then
    role, then text; a row repeated whole counts once. Prefixes are told by rolling hashes: the
    exclusive-or of position-dependent hashes of all turns so far, under two seeds. A row with a
    null conv_id belongs to no other row: it is a conversation of one turn (idx 1), so that such
    rows are no hot key. Empty tables give no rows; a very long conversation is one group, as its
    order asks. Further columns are ignored.
    """
    turns = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own, lone = turns.filter("conv_id is not null"), turns.filter("conv_id is null")
    by = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    same = F.struct("turn", "role", "text")
    own = own.withColumn("again", F.coalesce(same.eqNullSafe(F.lag(same).over(by)), F.lit(False))).filter(~F.col("again")).drop("again")
    own = own.withColumn("idx", F.row_number().over(by))
    far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolling = {name: F.xxhash64(F.lit(seed), "idx", "role", F.length("role"), "text", F.lit(seed * 7)) for name, seed in (("h1", 1), ("h2", 2))}
    for name, h in rolling.items():
        own = own.withColumn(name, F.bit_xor(h).over(far))
    own = own.withColumn("n", F.count("*").over(Window.partitionBy("conv_id")))
    lone = lone.groupBy("conv_id", "role", "text").agg(F.min("turn").alias("turn")).withColumn("idx", F.lit(1)).withColumns(rolling).withColumn("n", F.lit(1).cast("long"))
    key = ["idx", "h1", "h2"]
    ends = own.filter("idx = n").select(*key, "conv_id").unionByName(lone.select(*key, "conv_id")).groupBy(*key).agg(F.min("conv_id").alias("conv_id"))
    shorter = own.filter("idx < n").select(*key).distinct()
    kept = ends.join(shorter, key, "left_anti")
    out = ["conv_id", "idx", "turn", "role", "text"]
    whole = own.join(kept.select(F.col("conv_id").alias("_kept")), F.col("conv_id") == F.col("_kept"), "left_semi").select(*out)
    return whole.unionByName(lone.join(kept.filter("conv_id is null").select(*key), key, "left_semi").select(*out))


def rendered(turns: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """One row per conversation: conv_id, n_turns, text in turn markup.

    Marks that stand in a role or text are escaped (see escaped(), which unescaped() undoes), so that no
    turn can feign another; this holds for all marks that begin with "<|". Null roles and texts are empty.
    Turns without a conv_id are conversations of their own; further columns are ignored; an empty table gives no rows.
    """
    if not (start.startswith("<|") and end.startswith("<|")):
        raise ValueError('marks must begin with "<|"')
    turns = turns.select("conv_id", "idx", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")])
    line = F.concat(F.lit(start), escaped(F.col("role")), F.lit("\n"), escaped(F.col("text")), F.lit(end + "\n"))
    alone = F.when(F.col("conv_id").isNull(), F.xxhash64("role", F.length("role"), "text"))
    turns = turns.groupBy("conv_id", alone.alias("_alone")).agg(F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct("idx", line.alias("line")))).alias("lines"))
    return turns.select("conv_id", "n_turns", F.array_join(F.transform("lines", lambda x: x.line), "").alias("text"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(collapse_snapshots(read_table(spark, sf_dir, "conversations")))


ORACLE = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT *, row_number() OVER w AS idx, count(*) OVER (PARTITION BY conv_id) AS n,
             string_agg(role || chr(1) || text || chr(2), '') OVER (w ROWS UNBOUNDED PRECEDING) AS prefix
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
e AS (SELECT prefix, min(conv_id) AS conv_id FROM p WHERE idx = n GROUP BY prefix),
k AS (SELECT conv_id FROM e WHERE prefix NOT IN (SELECT prefix FROM p WHERE idx < n))
SELECT conv_id, count(*) AS n_turns,
       string_agg('<|im_start|>' || regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g') || chr(10) || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|im_end|>' || chr(10), '' ORDER BY idx) AS text
FROM p JOIN k USING (conv_id) GROUP BY conv_id
"""
