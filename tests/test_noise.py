import numpy as np
import pytest

from gleaner.operators.noise import noise_flags, out_of_fold, out_of_fold_local, stratified_folds


def rows(spark, classes, n=45, width=6, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(classes, width)) * 0.7
    data = [(f"f{i:03d}", f"c{i % classes}", (centers[i % classes] + rng.normal(size=width)).tolist()) for i in range(n)]
    return spark.createDataFrame(data, "filepath string, label string, features array<double>")


@pytest.mark.parametrize("classes", [2, 3])
def test_both_solvers_agree(spark, classes):
    dealt = stratified_folds(rows(spark, classes), "label", "filepath", 3, 7).persist()
    names = [f"c{i}" for i in range(classes)]
    a, b = ({r["filepath"]: r for r in f(dealt, names, 3).collect()} for f in (out_of_fold, out_of_fold_local))
    assert set(a) == set(b) and len(a) == 45
    assert max(abs(a[k]["confidence"] - b[k]["confidence"]) for k in a) < 1e-4
    assert all(a[k]["predicted"] == b[k]["predicted"] for k in a if a[k]["confidence"] > 1 / classes + 1e-3)


def test_folds_are_stratified_and_stable(spark):
    dealt = stratified_folds(rows(spark, 3), "label", "filepath", 3, 7)
    counts = {(r["label"], r["fold"]): r["count"] for r in dealt.groupBy("label", "fold").count().collect()}
    assert set(counts.values()) == {5}
    again = stratified_folds(rows(spark, 3).repartition(3), "label", "filepath", 3, 7)
    assert {tuple(r) for r in dealt.select("filepath", "fold").collect()} == {tuple(r) for r in again.select("filepath", "fold").collect()}


def test_reasons_to_skip(spark):
    few, single, one = rows(spark, 2, 5), rows(spark, 2, 9).where("label = 'c0' or filepath = 'f001'"), rows(spark, 1, 9)
    for df, why in ((few, "too few"), (single.union(rows(spark, 1, 5)), "fewer than 2"), (one, "only one class")):
        flags, info = noise_flags(df)
        assert flags is None and why in info["skipped"]
    bad = rows(spark, 2).selectExpr("filepath", "label", "IF(filepath < 'f010', NULL, features) AS features")
    flags, info = noise_flags(bad, 0.5)
    assert info["n_labeled_files"] == 45 and info["n_usable"] == 35 and flags.columns == ["filepath", "label", "predicted_label", "confidence"]
