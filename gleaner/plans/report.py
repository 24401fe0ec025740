"""Reports of an audit: Markdown by severity, JSON, and lines for a terminal."""

from __future__ import annotations

import json
import os
from itertools import groupby

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gleaner.functions.columns import SEVERITY_RANK, listed, shortened
from gleaner.operators.findings import SCHEMA, ranked

#: A report's headings, in order of rank.
TITLES = {"error": "🔴 Errors", "warning": "🟡 Warnings", "info": "🔵 Notes"}
#: Files that a heading of the Markdown report names, and a line in a terminal.
FILES_SHOWN, FILES_IN_LINE = 12, 4


def _cell(value: object) -> str:
    return str(value).replace("|", "\\|").replace("\n", " ")


def table(columns: tuple[str, ...], rows: list[tuple]) -> str:
    """A Markdown table; a bar in a cell is escaped."""
    lines = [columns, ["---"] * len(columns), *rows]
    return "\n".join("| " + " | ".join(map(_cell, line)) + " |" for line in lines)


def file_list(files: list[str], limit: int = FILES_SHOWN) -> str:
    """A bullet for each of the first ``limit`` files, and one that counts the others."""
    rest = len(files) - limit
    return "\n".join([*(f"- `{f}`" for f in files[:limit]), *([f"- and {rest} more"] if rest > 0 else [])])


def score_bar(score: int, width: int = 20) -> str:
    full = score * width // 100
    return "#" * full + "." * (width - full)


def _facts(report: dict) -> list[tuple]:
    images, labels = report["image_stats"], report["label_stats"]
    out = [(what, images[key]) for what, key in (("image files", "n_files"), ("readable", "n_ok"), ("broken", "n_corrupt"), ("without contrast", "n_degenerate"))]
    out.append(("splits", " ".join(images["splits"])))
    if labels is not None:
        out.append(("labels", labels["total"]))
        out += [(f"labels of class {name}", n) for name, n in sorted(labels["counts"].items())]
        out += [(f"label check: {key}", value) for key, value in sorted(labels["noise"]["info"].items())]
    return out


def markdown(report: dict) -> str:
    """The whole report as one text."""
    score, name = report["health_score"], os.path.basename(os.path.normpath(report["dataset"]))
    parts = [f"# Image audit of `{name}`", f"Health **{score} of 100** `[{score_bar(score)}]`, {report['generated_utc']}", table(("Fact", "Value"), _facts(report))]
    for severity, found in groupby(report["findings"], key=lambda f: f["severity"]):
        found = list(found)
        parts.append(f"## {TITLES.get(severity, severity)} ({len(found)})")
        for f in found:
            parts += [f"### `{f['check']}`", f["message"], file_list(f["files"])]
    if not report["findings"]:
        parts.append("Nothing was found.")
    suspects = report["label_stats"]["noise"]["flags"] if report["label_stats"] else []
    if suspects:
        keys = ("filepath", "label", "predicted_label", "confidence")
        parts += ["## Suspect labels", "A suspect is a hint: look at the sample before its label is changed.", table(("File", "Label", "Model says", "Confidence"), [tuple(s[k] for k in keys) for s in suspects])]
    return "\n\n".join(filter(None, parts)) + "\n"


def _save(path: str, text: str) -> str:
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return text


def render_markdown(report: dict, out_path: str) -> str:
    return _save(out_path, markdown(report))


def render_json(report: dict, out_path: str) -> None:
    _save(out_path, json.dumps(report, indent=2))


def terminal(spark: SparkSession, findings: list[dict]) -> str:
    """One line for each finding and one for its files, both cut to what a terminal shows."""
    rows = spark.createDataFrame([(f["severity"], f["check"], f["message"], f["files"], "") for f in findings], SCHEMA)
    mark = F.rpad(F.col("severity"), max(map(len, SEVERITY_RANK)) + 1, " ")
    told = F.concat(mark, "check", F.lit(": "), shortened(F.col("message")))
    named = F.when(F.size("files") > 0, F.concat(F.lit("    "), listed(F.col("files"), FILES_IN_LINE, " and %d more")))
    return "\n".join(r[0] for r in ranked(rows).select(F.concat_ws("\n", told, named)).collect())
