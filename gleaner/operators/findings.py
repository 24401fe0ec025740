"""Findings: rows (severity, check, message, files, details) that checks produce and reports rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.columns import severity_rank, severity_weight

SCHEMA = "severity string, check string, message string, files array<string>, details string"


def told(severity: str, check: str, message: Column, files: Column | None = None, details: Column | None = None) -> Column:
    """A finding as one column; files are sorted, details are JSON."""
    none = F.array().cast("array<string>")
    return F.struct(
        F.lit(severity).alias("severity"), F.lit(check).alias("check"), message.cast("string").alias("message"),
        F.array_sort(files if files is not None else none).alias("files"), F.coalesce(F.to_json(details) if details is not None else F.lit("{}"), F.lit("{}")).alias("details"),
    )


def finding(rows: DataFrame, severity: str, check: str, message: Column, files: Column | None = None, details: Column | None = None) -> DataFrame:
    """One finding for each row of ``rows``."""
    return rows.select(told(severity, check, message, files, details).alias("f")).select("f.*")


def findings_of(row: DataFrame, parts: list[tuple[Column, Column]]) -> DataFrame:
    """The findings (whether there is one, the finding) that are made of one row of aggregates."""
    return row.select(F.explode(F.array(*[F.when(there, f) for there, f in parts])).alias("f")).where("f is not null").select("f.*")


def no_findings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ranked(findings: DataFrame) -> DataFrame:
    """Errors first, then warnings, then the rest; by check, then by first file."""
    return findings.orderBy(severity_rank(F.col("severity")), "check", F.get("files", F.lit(0)), "message")


def flattened(findings: DataFrame) -> DataFrame:
    """(check, file): each file once that a check names."""
    return findings.select("check", F.explode("files").alias("file")).distinct()


def score(findings: DataFrame) -> DataFrame:
    """(health_score, n_errors, n_warnings, n_info): one row."""
    severity = F.col("severity")
    return findings.agg(
        F.greatest(F.lit(0), F.lit(100) - F.coalesce(F.sum(severity_weight(severity)), F.lit(0))).cast("int").alias("health_score"),
        F.count_if(severity == "error").alias("n_errors"), F.count_if(severity == "warning").alias("n_warnings"), F.count_if(severity == "info").alias("n_info"),
    )
