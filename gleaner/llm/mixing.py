"""Mixing sources to target weights.

Tokens are summed per source, targets are shares of a total by weight with a ceiling of
``max_rate`` times the source, and each document is emitted floor(rate) times plus one
hash-seeded Bernoulli copy whose probability is the rate's fraction.

Defined cases: a null text has size 0; a null source is a source of its own, ordered last; a null
id draws as the id ''; repeated rows draw alike (the draw depends on id and seed alone); an empty
table gives an empty result; a table of size 0 has targets and rates of 0.  Columns of ours (size,
source_size, target, copies) replace columns of the same name; all others are kept, whatever their names.

The table of sources (a row each) is put in order in one task: sources are a short list of names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import Scratch, text_of

WORD = r"[^\x20\x09-\x0D]+"
#: Up to this many sources, the table of targets (one short row a source) is broadcast.
BROADCAST_SOURCES = 10_000


def word_count(column):
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def source_targets(totals: DataFrame, weights=(3, 1, 2), share: float = 1.5, max_rate: float = 2.0) -> DataFrame:
    """(source, source_size) -> also target and rate.

    Ceilings make the targets a water level: target = min(max_rate * size, level * weight).  The
    sources that hit their ceiling are those with the lowest size / weight, so one ordered pass
    over the sources finds the level; that pass holds one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = totals.withColumn("weight", weight)
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    past, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    t = t.withColumn("level", (F.lit(share) * F.sum("source_size").over(everything) - F.lit(max_rate) * F.coalesce(F.sum("source_size").over(past), F.lit(0))) / F.sum("weight").over(rest))
    # The first source in this order whose ceiling is above its share sets the level for the rest.
    fits = F.col("level") * F.col("weight") <= F.lit(max_rate) * F.col("source_size")
    t = t.withColumn("water", F.min(F.when(fits, F.struct(F.col("source_size") / F.col("weight"), F.col("level")))).over(everything))
    t = t.withColumn("target", F.least(F.lit(max_rate) * F.col("source_size"), F.coalesce(F.col("water.level"), F.lit(float("inf"))) * F.col("weight")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return t.select("source", "source_size", F.col("target").cast("double").alias("target"), rate.alias("rate"))


def draw(id_column, seed: str):
    """A number in [0, 1) from the id and the seed."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_column.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix_sources(docs: DataFrame, scratch: Scratch, weights=(3, 1, 2), share: float = 1.5, max_rate: float = 2.0, seed: str = "mix", keep: bool = True) -> DataFrame:
    """Each row of ``docs`` (doc_id, text, source, ...) with size, source_size, target and copies.

    ``keep`` False leaves out all but doc_id, which spares reading the texts twice.
    """
    sized = docs.withColumn("size", word_count(F.col("text")))
    if not keep:
        sized = scratch.keep(sized.select("doc_id", "source", "size"))
    totals = scratch.keep(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_rate))
    if totals.count() <= BROADCAST_SOURCES:
        totals = F.broadcast(totals)
    ours = ("source_size", "target", "copies")
    rest = [c for c in sized.columns if c not in ours]
    joined = sized.join(totals, sized["source"].eqNullSafe(totals["source"]), "left")
    rate = totals["rate"]
    extra = (draw(sized["doc_id"], seed) < rate - F.floor(rate)).cast("long")
    return joined.select(*[sized[c] for c in rest], totals["source_size"], totals["target"], (F.floor(rate).cast("long") + extra).alias("copies"))


def emit_mix(mixed: DataFrame) -> DataFrame:
    """One row for each copy that ``mix_sources`` grants."""
    rest = [c for c in mixed.columns if c not in ("size", "source_size", "target", "copies")]
    many = mixed.where("copies > 0").select(*rest, F.explode(F.array_repeat(F.lit(True), F.col("copies").cast("int"))).alias("size"))
    return many.drop("size")
