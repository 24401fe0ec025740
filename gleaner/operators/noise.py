"""Label-noise triage: out-of-fold class probabilities of a small linear model over feature arrays.

Rows are dealt to stratified folds; for each fold a class-balanced, L2-regularised logistic regression is fitted
to the other folds and applied to it.  A row is flagged when the predicted class differs from its label
with at least the given confidence.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.linear import fit_logistic, probabilities
from gleaner.sources.scratch import Scratch

MINIMUM = 6
#: Numbers (rows times features) up to which a fold's model is fitted by one task.
LOCAL_NUMBERS = 8_000_000


def first_labels(labels: DataFrame, key: str = "abs") -> DataFrame:
    """One row a key: the label that comes first in the file."""
    return labels.groupBy(key).agg(F.min_by(F.struct("*"), "lineno").alias("r")).select("r.*")


def stratified_folds(rows: DataFrame, label: str, key: str, folds: int, seed: int) -> DataFrame:
    """``fold``: each class is shuffled by a hash of its keys and dealt in turn."""
    order = Window.partitionBy(label).orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")), key)
    return rows.withColumn("fold", ((F.row_number().over(order) - 1) % folds).cast("int"))


def _balanced(y: np.ndarray, k: int) -> np.ndarray:
    n = np.bincount(y, minlength=k)
    return (len(y) / (np.count_nonzero(n) * np.maximum(n, 1)))[y]


def out_of_fold_local(rows: DataFrame, classes: list[str], folds: int, c: float = 0.1, max_iter: int = 1000) -> DataFrame:
    """As ``out_of_fold``, each fold's model fitted to the same objective by one task."""

    def judge(table: pd.DataFrame) -> pd.DataFrame:
        x, y = np.stack(table["features"]).astype(float), table["label"].map({n: i for i, n in enumerate(classes)}).to_numpy()
        held = (table["fold"] == table["held"]).to_numpy()
        p = probabilities(fit_logistic(x[~held], y[~held], _balanced(y[~held], len(classes)), len(classes), c, max_iter), x[held])
        out = table[held].drop(columns=["held"])
        out["predicted"], out["confidence"] = [classes[i] for i in p.argmax(1)], p.max(1)
        return out

    order = F.xxhash64(*[c for c in rows.columns if c != "features"])
    every = rows.withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumn("_order", order)
    schema = rows.schema.add("_order", "long").add("predicted", "string").add("confidence", "double")
    return every.groupBy("held").applyInPandas(lambda t: judge(t.sort_values("_order")), schema).drop("_order")


def out_of_fold(rows: DataFrame, classes: list[str], folds: int, c: float = 0.1, max_iter: int = 1000) -> DataFrame:
    """``rows`` (key columns, label, features array, fold) with predicted and confidence, each from the model that did not see it.

    The objective is sum of weighted losses times C plus half the squared norm, which here is
    regParam = 1 / (C * sum of weights) without standardisation; the weights balance the classes.
    """
    index = F.lit(-1)
    for i, name in enumerate(classes):
        index = F.when(F.col("label") == name, F.lit(i)).otherwise(index)
    rows = Scratch(rows.sparkSession).keep(rows)  # read again for each fold
    data = rows.withColumn("_y", index.cast("double")).withColumn("_x", array_to_vector(F.col("features")))
    counts = {(r["fold"], int(r["_y"])): r["n"] for r in data.groupBy("fold", "_y").agg(F.count("*").alias("n")).collect()}
    names, out = F.array(*[F.lit(x) for x in classes]), None
    for fold in range(folds):
        per = [sum(n for (f, y), n in counts.items() if f != fold and y == i) for i in range(len(classes))]
        total, present = sum(per), sum(n > 0 for n in per)
        weight = F.lit(0.0)
        for i, n in enumerate(per):
            weight = F.when(F.col("_y") == i, F.lit(total / (present * n) if n else 0.0)).otherwise(weight)
        model = LogisticRegression(
            featuresCol="_x", labelCol="_y", weightCol="_w", probabilityCol="_p", predictionCol="_c", rawPredictionCol="_r", regParam=1 / (c * total), elasticNetParam=0.0,
            standardization=False, maxIter=max_iter, tol=1e-6, family="binomial" if len(classes) == 2 else "multinomial",
        ).fit(data.where(F.col("fold") != fold).withColumn("_w", weight))
        p = model.transform(data.where(F.col("fold") == fold)).withColumn("_p", vector_to_array("_p"))
        best = F.array_max("_p")
        p = p.withColumn("predicted", F.element_at(names, F.array_position("_p", best).cast("int"))).withColumn("confidence", best).drop("_x", "_y", "_p", "_c", "_r")
        out = p if out is None else out.unionByName(p)
    return out


def noise_flags(rows: DataFrame, confidence: float = 0.80, cv_folds: int = 3, seed: int = 7, key: str = "filepath") -> tuple[DataFrame | None, dict]:
    """(flags, info) for rows (key, filepath, label, features); features may be null.

    flags: filepath, label, predicted_label, confidence.  None, with a reason in info, where there are too few
    rows, a class with one row, or one class only.
    """
    usable = rows.where(F.col("features").isNotNull())
    seen = rows.groupBy("label").agg(F.count("*").alias("rows"), F.count("features").alias("usable"), F.max(F.size("features")).alias("width")).collect()
    info: dict = {"n_labeled_files": sum(r["rows"] for r in seen)}
    counts = {r["label"]: r["usable"] for r in seen if r["usable"]}
    info["n_usable"] = sum(counts.values())
    if info["n_usable"] < MINIMUM:
        return None, info | {"skipped": "too few usable labelled images for cross-validation"}
    classes = sorted(counts)
    info["class_counts"] = {c: counts[c] for c in classes}
    folds = min(cv_folds, *counts.values())
    if folds < 2:
        return None, info | {"skipped": "a class has fewer than 2 samples"}
    if len(classes) < 2:
        return None, info | {"skipped": "there is only one class"}
    info["cv_folds"] = folds
    width = max(r["width"] for r in seen if r["usable"])
    solve = out_of_fold_local if info["n_usable"] * width <= LOCAL_NUMBERS else out_of_fold
    judged = solve(stratified_folds(usable.select(*dict.fromkeys([key, "filepath", "label", "features"])), "label", key, folds, seed), classes, folds)
    flags = judged.where((F.col("predicted") != F.col("label")) & (F.col("confidence") >= confidence))
    return flags.select("filepath", "label", F.col("predicted").alias("predicted_label"), F.bround("confidence", 3).alias("confidence")), info
