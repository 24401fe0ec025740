"""Image audits over a stream: facts of new files, and groups against those already stored.

New files arrive as a streaming table (path, content), such as Spark's ``binaryFile`` source.  The facts are
stateless; each micro-batch is appended to a facts table, and its hashes are joined by band to the stored
ones, so a batch costs in proportion to itself and its matches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner.functions.columns import hamming
from gleaner.operators.similarity import BANDED_MOST, bands
from gleaner.sources.image_folder import facts_of


def matches(new: DataFrame, stored: DataFrame, threshold: int = 5) -> DataFrame:
    """(rel, other, distance): each row of ``new`` against rows of ``stored`` within ``threshold`` (at most 7)."""
    if not 0 <= threshold <= BANDED_MOST:
        raise ValueError(f"a threshold of 0 to {BANDED_MOST} bits can be joined by bands")

    def banded(rows: DataFrame, name: str, value: str) -> DataFrame:
        side = rows.where(F.col("dhash").isNotNull()).select(F.col("rel").alias(name), F.col("dhash").alias(value), F.explode(bands(F.col("dhash"), threshold)).alias("at"))
        return side.select(name, value, "at.band", "at.bits")

    pairs = banded(new, "rel", "a").join(banded(stored, "other", "b"), ["band", "bits"]).where("rel <> other")
    near = pairs.withColumn("distance", hamming(F.col("a"), F.col("b")).cast("int")).where(F.col("distance") <= threshold)
    return near.select("rel", "other", "distance").distinct()


def watch(spark: SparkSession, contents: DataFrame, root: str, facts_path: str, matches_path: str, checkpoint: str, threshold: int = 5, **trigger) -> StreamingQuery:
    """Start appending facts and matches (Parquet) for each batch of ``contents`` (path, content).

    Files are written under the batch's number, so a batch that is run again after a failure
    replaces its own output.
    """

    def step(batch: DataFrame, number: int) -> None:
        facts_of(batch, root).write.mode("overwrite").parquet(f"{facts_path}/batch={number}")
        stored = spark.read.option("basePath", facts_path).parquet(facts_path).where(F.col("batch") <= number)
        found = matches(spark.read.parquet(f"{facts_path}/batch={number}"), stored, threshold)
        found.write.mode("overwrite").parquet(f"{matches_path}/batch={number}")

    return contents.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
