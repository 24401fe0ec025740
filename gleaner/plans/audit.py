"""The audit: scan, check, rank and score an image folder and its labels."""

from __future__ import annotations

import datetime
import json
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.columns import SEVERITY_WEIGHT
from gleaner.operators import image_checks, label_checks, noise
from gleaner.operators.findings import finding, ranked, union_all
from gleaner.sources.image_folder import read_images
from gleaner.sources.labels_csv import base_of, check_encoding, read_labels
from gleaner.sources.scratch import Scratch
from gleaner.sources.workers import see_package


def session(cores: str = "*") -> SparkSession:
    """A local session for the command line, unless one is active."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        spark = SparkSession.builder.master(f"local[{cores}]").appName("gleaner").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    see_package(spark)
    return spark


def _rows(findings: DataFrame) -> list[dict]:
    return [r.asDict() | {"details": json.loads(r["details"])} for r in ranked(findings).collect()]


def audit_images(root: str, hash_threshold: int = 5, spark: SparkSession | None = None, images: DataFrame | None = None, hash_size: int = 8, thumb_size: int = 16) -> dict:
    """{'records': DataFrame, 'findings': DataFrame, 'stats': dict} of the files below ``root`` (a folder or a store, or ``images`` as read before)."""
    spark = spark or session()
    scratch = Scratch(spark)
    images = scratch.keep(read_images(spark, root, thumb_size, hash_size)) if images is None else images
    row = image_checks.summary(images).collect()[0]
    summed = spark.createDataFrame([row], image_checks.summary(images).schema)
    return {"records": images, "findings": image_checks.image_findings(images, scratch, hash_threshold, summed), "stats": {k: row[k] for k in image_checks.STATS}}


def analyze_labels(
    dataset_root: str,
    csv_path: str,
    minority_warn_ratio: float = label_checks.MINORITY_RATIO,
    noise_confidence: float = 0.80,
    run_noise_check: bool = True,
    spark: SparkSession | None = None,
    images: DataFrame | None = None,
    cv_folds: int = 3,
    seed: int = 7,
    thumb_size: int = 16,
) -> dict:
    """{'rows', 'findings': DataFrames, 'counts', 'total', 'noise': {'flags', 'info'}} of a label file."""
    spark = spark or session()
    scratch = Scratch(spark)
    labels = scratch.keep(read_labels(spark, csv_path))
    check_encoding(labels)
    images = scratch.keep(read_images(spark, dataset_root, thumb_size)) if images is None else images
    stated = scratch.keep(label_checks.with_state(labels, images, dataset_root))
    spread = label_checks.class_distribution(labels)
    shares, root = spread.collect(), base_of(dataset_root) + "/"
    findings = [label_checks.entry_checks(stated), label_checks.share_checks(spark.createDataFrame(shares, spread.schema), minority_warn_ratio)]
    flags, info = [], {"skipped": "disabled"}
    if run_noise_check:
        first = noise.first_labels(stated).withColumnRenamed("thumb16", "features")
        rel = F.when(F.col("abs").startswith(root), F.substring(F.col("abs"), len(root) + 1, 1 << 30)).otherwise(F.col("abs"))
        found, info = noise.noise_flags(first.withColumn("filepath", rel), noise_confidence, cv_folds, seed)
        if found is not None:
            rows = sorted(found.collect())
            flags = [r.asDict() for r in rows]
            info["n_flags"] = len(flags)
            if flags:
                all_ = spark.createDataFrame([(len(flags), rows)], T.StructType([T.StructField("n", T.LongType()), T.StructField("flags", T.ArrayType(found.schema))]))
                note = F.lit("a hint for review; a flag does not prove a wrong label")
                message = F.format_string("%d label(s) that a cross-validated model contradicts with confidence; review them by hand.", "n")
                findings.append(finding(all_, "warning", "label_noise_suspects", message, F.col("flags.filepath"), F.struct("flags", note.alias("note"))))
    return {"rows": labels, "findings": union_all(findings), "counts": {r["label"]: r["count"] for r in shares}, "total": sum(r["count"] for r in shares), "noise": {"flags": flags, "info": info}}


def run_audit(
    dataset_root: str, labels_csv: str | None = None, hash_threshold: int = 5, noise_confidence: float = 0.80, run_noise_check: bool = True, spark: SparkSession | None = None, images: DataFrame | None = None
) -> dict:
    """The whole audit as one document, of a folder, a store (``scheme://``), or of ``images`` as read before."""
    spark = spark or session()
    image = audit_images(dataset_root, hash_threshold, spark, images)
    findings, label = image["findings"], None
    if labels_csv:
        label = analyze_labels(dataset_root, labels_csv, noise_confidence=noise_confidence, run_noise_check=run_noise_check, spark=spark, images=image["records"])
        findings = findings.unionByName(label["findings"])
    rows = _rows(findings)
    severities = Counter(f["severity"] for f in rows)
    return {
        "dataset": base_of(dataset_root),
        "generated_utc": datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds"),
        "image_stats": image["stats"],
        "label_stats": {k: label[k] for k in ("counts", "total", "noise")} if label else None,
        "findings": rows,
        "health_score": health_score(rows),
        **{f"n_{plural}": severities[severity] for severity, plural in (("error", "errors"), ("warning", "warnings"), ("info", "info"))},
    }


def health_score(findings: list[dict]) -> int:
    """The score of findings that have been collected: what each severity costs, times how often it occurs."""
    cost = sum(n * SEVERITY_WEIGHT.get(severity, 1) for severity, n in Counter(f.get("severity") for f in findings).items())
    return 100 - min(cost, 100)
