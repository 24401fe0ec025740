import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.cli import compared, main
from gleaner.functions.columns import listed, shortened, split_of, stripped
from gleaner.operators.tables import file_findings
from gleaner.plans.audit import analyze_labels, audit_images, health_score, run_audit
from gleaner.plans.report import file_list, markdown, render_json, score_bar, table, terminal
from gleaner.sources import image_folder
from gleaner.sources.image_folder import facts_of, read_images
from gleaner.sources.labels_csv import check_encoding, find_labels, read_labels
from gleaner.sources.scratch import Scratch
from gleaner.sources.synthetic import synth_dataset
from tests.conftest import by_check, near, put, textured


def found(spark, root, **how):
    x = audit_images(str(root), spark=spark, **how)
    return by_check([r.asDict() | {"details": json.loads(r["details"])} for r in x["findings"].collect()]), x


def test_scan_sees_what_spark_hides(spark, tmp_path):
    px = textured(1)
    for rel in ("_u.png", ".dot.png", "_hid/x.png", "Train/b.PNG", "with space/c d.png", "val/v.png"):
        put(tmp_path, rel, px)
    put(tmp_path, "empty.png", b"")
    put(tmp_path, "notes.txt", b"text")
    rows = {r["rel"]: r for r in read_images(spark, str(tmp_path)).collect()}
    assert set(rows) == {"_u.png", ".dot.png", "_hid/x.png", "Train/b.PNG", "with space/c d.png", "val/v.png", "empty.png"}
    assert not rows["empty.png"]["ok"] and rows["empty.png"]["size_bytes"] == 0
    assert rows["Train/b.PNG"]["split"] == "train" and rows["val/v.png"]["split"] == "val" and rows["_u.png"]["split"] == "all"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path)).select(F.regexp_replace("path", "^file:", "").alias("path"), "content")
    twin = {r["rel"]: r for r in facts_of(files, str(tmp_path)).collect()}
    assert twin["Train/b.PNG"]["dhash"] == rows["Train/b.PNG"]["dhash"]
    with pytest.raises(Exception, match="no such folder"):
        read_images(spark, str(tmp_path / "nowhere")).count()


def test_broken_and_blank(spark, tmp_path):
    good = tmp_path / "train/good.png"
    put(tmp_path, "train/good.png", textured(2))
    put(tmp_path, "train/cut.png", good.read_bytes()[: good.stat().st_size // 3])
    put(tmp_path, "train/text.jpg", b"not an image")
    for name, value in (("black", 0), ("white", 255), ("grey", 128)):
        put(tmp_path, f"train/{name}.png", np.full((8, 8), value, np.uint8))
    f, x = found(spark, tmp_path)
    (bad,), (blank,) = f["corrupt_files"], f["degenerate_images"]
    assert bad["severity"] == "error" and bad["files"] == ["train/cut.png", "train/text.jpg"] and set(bad["details"]["errors"]) == set(bad["files"])
    assert blank["severity"] == "warning" and blank["details"]["by_type"] == {"all_black": ["train/black.png"], "all_white": ["train/white.png"], "constant": ["train/grey.png"]}
    assert x["stats"] == {"n_files": 6, "n_ok": 4, "n_corrupt": 2, "n_degenerate": 3, "splits": ["train"]}


def test_formats_without_a_decoder_are_not_broken(spark, tmp_path):
    """Nothing is known to be wrong with them: a note, no error, no broken label."""
    put(tmp_path, "train/a.png", textured(3))
    put(tmp_path, "train/b.webp", b"RIFF\x10\0\0\0WEBPVP8 " + bytes(8))
    (tmp_path / "l.csv").write_text("filepath,label\ntrain/a.png,x\ntrain/b.webp,x\n")
    f, x = found(spark, tmp_path)
    assert "corrupt_files" not in f and f["undecoded_images"][0]["severity"] == "info" and f["undecoded_images"][0]["files"] == ["train/b.webp"]
    assert x["stats"]["n_corrupt"] == 0
    labels = analyze_labels(str(tmp_path), str(tmp_path / "l.csv"), spark=spark)
    assert "unreadable_labeled_files" not in by_check([r.asDict() for r in labels["findings"].collect()])
    rows = {r["check"]: r["file"] for r in file_findings(read_images(spark, str(tmp_path)), Scratch(spark)).collect()}
    assert rows == {"undecoded_images": "train/b.webp"}


def test_deep_folders_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    for i in range(30):
        put(tmp_path, f"train/{i % 3}/deep{i}/more/{i}.png", textured(60 + i, 12))
    os.symlink(tmp_path / "train/0", tmp_path / "train/link.png")
    spark.dataSource.register(image_folder.ImageFolder)
    rows = {r["rel"]: r["dhash"] for r in read_images(spark, str(tmp_path)).collect()}
    every = set(rows)
    assert len(every) == 30 and read_images(spark, str(tmp_path / "train/0/deep0")).count() == 1
    assert rows == {r["rel"]: r["dhash"] for r in spark.read.format("gleaner_images").load(str(tmp_path)).collect()}
    monkeypatch.setattr(image_folder, "LISTED", 5)
    assert {r["rel"]: r["dhash"] for r in read_images(spark, str(tmp_path)).collect()} == rows
    for listed in (1, 5, 20):
        some = spark.read.format("gleaner_images").option("listed", listed).load(str(tmp_path))
        assert {r["rel"] for r in some.collect()} == every and (listed == 1 or some.rdd.getNumPartitions() > 1)


def test_an_audit_of_a_store(spark, tmp_path):
    """The same findings through Spark's readers alone."""
    base = textured(50)
    for rel, px in (("train/a.png", base), ("test/b.png", near(base, 2)), ("train/c.png", textured(51)), ("train/bad.png", b"junk" * 9)):
        put(tmp_path, rel, px)
    (tmp_path / "labels.csv").write_text("filepath,label\ntrain/a.png,x\n./train/../test/b.png,x\ntrain/ghost.png,y\ntrain/bad.png,y\nlabels.csv,y\n")
    here, there = (run_audit(root, str(tmp_path / "labels.csv"), spark=spark) for root in (str(tmp_path), f"file://{tmp_path}"))
    told = [[(f["check"], f["files"]) for f in r["findings"]] for r in (here, there)]
    assert told[0] == told[1] and ("missing_labeled_files", ["train/ghost.png"]) in told[0] and ("unreadable_labeled_files", ["labels.csv", "train/bad.png"]) in told[0]
    assert there["dataset"] == f"file://{tmp_path}" and here["health_score"] == there["health_score"]
    again = run_audit(str(tmp_path), str(tmp_path / "labels.csv"), spark=spark, images=read_images(spark, str(tmp_path)))
    assert again["findings"] == here["findings"]


def test_sizes_are_parameters(spark, tmp_path):
    put(tmp_path, "a.png", textured(52))
    r = read_images(spark, str(tmp_path), thumb=4, hash_size=4).first()
    assert len(r["thumb16"]) == 16 and 0 <= r["dhash"] < 1 << 16


def test_odd_geometry(spark, tmp_path):
    for i in range(3):
        put(tmp_path, f"train/{i}.png", textured(10 + i))
    put(tmp_path, "train/odd.png", textured(20, 24))
    (g,) = found(spark, tmp_path)[0]["geometry_mode_inconsistency"]
    assert g["files"] == ["train/odd.png"] and g["details"]["majority"] == {"width": 48, "height": 48, "mode": "RGB"}
    assert g["details"]["offenders"]["train/odd.png"]["width"] == 24


def test_leaks_and_copies(spark, tmp_path):
    base, other = textured(30), textured(31)
    put(tmp_path, "train/base.png", base)
    put(tmp_path, "test/copy.png", base)
    put(tmp_path, "train/other.png", other)
    put(tmp_path, "train/other_near.png", near(other, 1))
    put(tmp_path, "train/alone.png", textured(32))
    f, _ = found(spark, tmp_path)
    (leak,), (inside,) = f["cross_split_leakage"], f["near_duplicates_within_split"]
    assert leak["severity"] == "error" and leak["files"] == ["test/copy.png", "train/base.png"] and leak["details"] == {"splits": ["test", "train"], "group_size": 2}
    assert inside["severity"] == "warning" and inside["files"] == ["train/other.png", "train/other_near.png"]
    assert set(found(spark, tmp_path, hash_threshold=-1)[0]) == set()


def test_label_hygiene(spark, tmp_path):
    p = tmp_path / "l.csv"
    p.write_bytes("﻿ FilePath ,note,LABEL\r\n a.png ,x, cat \r\n\r\nb.png,\"q\"\"u,\n ote\",dog\r\n,y,none\r\nc.png\r\nd.png,z,,extra\r\n".encode())
    rows = [tuple(r) for r in read_labels(spark, str(p)).orderBy("lineno").select("filepath", "label").collect()]
    assert rows == [("a.png", "cat"), ("b.png", "dog"), ("c.png", ""), ("d.png", "")]
    p.write_text("path,category\nx,y\n")
    with pytest.raises(ValueError, match="filepath.*label"):
        read_labels(spark, str(p))
    p.write_text("")
    with pytest.raises(ValueError, match="empty"):
        read_labels(spark, str(p))
    p.write_bytes(b"filepath,label\na\xff.png,x\n")
    with pytest.raises(ValueError, match="UTF-8"):
        check_encoding(read_labels(spark, str(p)))


def test_label_entries(spark, tmp_path):
    outside = tmp_path / "elsewhere.dat"
    root = tmp_path / "set"
    put(root, "train/a.png", textured(40))
    put(root, "train/bad.png", b"junk" * 8)
    outside.write_bytes((root / "train/a.png").read_bytes())
    rows = ["train/a.png,x", "train/a.png,x", "./train//../train/a.png,y", "train/ghost.png,x", "train/ghost.png,x", "train/bad.png,x", f"{outside},y"]
    (root / "labels.csv").write_text("filepath,label\n" + "\n".join(rows) + "\n")
    x = analyze_labels(str(root), str(root / "labels.csv"), spark=spark)
    f = by_check([r.asDict() for r in x["findings"].collect()])
    assert f["duplicate_label_entries"][0]["files"] == ["train/a.png", "train/ghost.png"]
    assert f["missing_labeled_files"][0]["files"] == ["train/ghost.png"] and f["missing_labeled_files"][0]["severity"] == "error"
    assert f["unreadable_labeled_files"][0]["files"] == ["train/bad.png"] and f["unreadable_labeled_files"][0]["severity"] == "warning"
    assert x["noise"]["info"]["n_labeled_files"] == 4 and x["noise"]["info"]["n_usable"] == 2 and "too few" in x["noise"]["info"]["skipped"]


@pytest.mark.parametrize(("a", "b", "flagged"), [(20, 1, True), (19, 1, False), (10, 10, False)])
def test_imbalance(spark, tmp_path, a, b, flagged):
    (tmp_path / "labels.csv").write_text("filepath,label\n" + "".join(f"a{i}.png,A\n" for i in range(a)) + "".join(f"b{i}.png,B\n" for i in range(b)))
    put(tmp_path, "x.png", textured(41))
    x = analyze_labels(str(tmp_path), str(tmp_path / "labels.csv"), run_noise_check=False, spark=spark)
    f = by_check([r.asDict() | {"details": json.loads(r["details"])} for r in x["findings"].collect()])
    assert ("class_imbalance" in f) == flagged and len(f["class_distribution"]) == 1
    assert f["class_distribution"][0]["details"]["distribution"]["B"] == {"count": b, "ratio": round(b / (a + b), 4)}
    if flagged:
        assert f["class_imbalance"][0]["details"] == {"class": "B", "count": 1, "ratio": 0.0476, "threshold": 0.05}


def test_find_labels(tmp_path, monkeypatch):
    assert find_labels(str(tmp_path), None) is None
    (tmp_path / "labels.csv").write_text("x")
    assert find_labels(str(tmp_path), None) == str(tmp_path / "labels.csv") == find_labels(str(tmp_path), "labels.csv")
    assert find_labels("s3a://bucket/set", "s3a://bucket/set/l.csv") == "s3a://bucket/set/l.csv"
    with pytest.raises(SystemExit, match="not found"):
        find_labels(str(tmp_path), "other.csv")


@pytest.mark.parametrize(("severities", "score"), [("", 100), ("error", 85), ("warning", 95), ("error warning info", 79), ("error " * 10, 0)])
def test_health_score(severities, score):
    assert health_score([{"severity": s} for s in severities.split()]) == score


def test_exports():
    import gleaner

    assert gleaner.run_audit is run_audit and all(hasattr(gleaner, n) for n in gleaner.__all__)
    with pytest.raises(AttributeError):
        gleaner.nothing  # noqa: B018


def test_columns(spark):
    df = spark.createDataFrame([("\t\n x  ", "Valid/a", "m" * 95, list("abcdef"))], "t string, rel string, message string, files array<string>")
    r = df.select(stripped(df["t"]), split_of(df["rel"]), shortened(df["message"]), listed(df["files"], 4, " (+%d more)")).first()
    assert tuple(r) == ("x", "valid", "m" * 87 + "...", "a, b, c, d (+2 more)")


@pytest.fixture(scope="module")
def demo(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("demo")
    made = synth_dataset(str(out))
    return out, made, run_audit(str(out), made["labels_csv"], spark=spark)


def test_planted_defects_are_found(spark, demo):
    _, made, report = demo
    p, f = made["planted"], by_check(report["findings"])
    assert (p["class_a"], p["class_b"], p["minority_ratio"]) == (106, 5, 0.045)
    rows = compared(spark, report["findings"], p)
    assert len(rows) == 7 and all(right for *_, right in rows)
    assert not any(right for *_, right in compared(spark, [], p))
    assert sorted(x["details"]["group_size"] for x in f["cross_split_leakage"]) == [2, 5]
    assert f["label_noise_suspects"][0]["files"] == sorted(p["mislabeled_files"])
    assert f["geometry_mode_inconsistency"][0]["files"] == ["train/odd_size.png"]
    assert (report["health_score"], report["n_errors"], report["n_warnings"], report["n_info"]) == (34, 3, 4, 1)
    assert [x["severity"] for x in report["findings"]] == ["error"] * 3 + ["warning"] * 4 + ["info"]
    assert report["image_stats"]["n_files"] == 116 and report["label_stats"]["total"] == 111


def test_long_tables_say_the_same(spark, demo):
    out, _, report = demo
    rows = file_findings(read_images(spark, str(out)), Scratch(spark)).collect()
    got, want = {}, {}
    for r in rows:
        got.setdefault(r["check"], set()).add(r["file"])
    for f in report["findings"]:
        want.setdefault(f["check"], set()).update(f["files"])
    assert got == {k: v for k, v in want.items() if k in got} and set(got) == {"corrupt_files", "degenerate_images", "geometry_mode_inconsistency", "cross_split_leakage"}


def test_reports(spark, demo, tmp_path):
    _, _, report = demo
    text = markdown(report)
    assert "**34 of 100**" in text and "### `cross_split_leakage`" in text and "| train/a_mis_0.png | class_b | class_a |" in text
    assert [text.index(t) for t in ("Errors (3)", "Warnings (4)", "Notes (1)", "Suspect labels")] == sorted(text.index(t) for t in ("Errors (3)", "Warnings (4)", "Notes (1)", "Suspect labels"))
    render_json(report, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text())["health_score"] == 34
    lines = terminal(spark, report["findings"]).split("\n")
    assert " and 1 more" in "".join(lines) and lines[0].startswith("error   corrupt_files: ") and max(map(len, lines)) < 140
    assert score_bar(34) == "#" * 6 + "." * 14 and file_list([]) == "" and file_list([f"f{i}" for i in range(15)]).endswith("- and 3 more")
    assert table(("a",), [("x|y",)]).endswith("| x\\|y |")
    clean = report | {"findings": [], "label_stats": None}
    assert "Nothing was found" in markdown(clean) and "label" not in markdown(clean)


def test_command_line(spark, demo, tmp_path, capsys):
    out, _, _ = demo
    assert main(["audit", str(out), "--out", str(tmp_path / "r.md"), "--json", str(tmp_path / "r.json"), "--no-noise-check", "--quiet"]) == 0
    assert "Health 39 of 100" in capsys.readouterr().out and (tmp_path / "r.md").exists()
    assert main(["synth", "--out", str(tmp_path / "s")]) == 0 and os.path.isfile(tmp_path / "s/labels.csv")
    with pytest.raises(FileExistsError):
        synth_dataset(str(tmp_path / "s"))


def test_demo_command(spark, tmp_path, capsys):
    assert main(["demo", "--out", str(tmp_path / "d")]) == 0
    out = capsys.readouterr().out
    assert "All planted defects were found" in out and "NOT AS PLANTED" not in out and (tmp_path / "d/audit_report.md").exists()
