"""One local session for all tests, and small image folders."""

import os
import sys

import numpy as np
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gleaner.functions.imaging import encode_png  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
    }
    s = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def textured(seed: int, side: int = 48) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 256, (side, side, 3), dtype=np.uint8)


def near(px: np.ndarray, seed: int, amount: int = 3) -> np.ndarray:
    return np.clip(px.astype(int) + np.random.default_rng(seed).integers(-amount, amount + 1, px.shape), 0, 255).astype(np.uint8)


def put(root, rel: str, px) -> str:
    """Write pixels (as PNG) or bytes below root."""
    path = root / rel
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(px if isinstance(px, bytes) else encode_png(px, "L" if px.ndim == 2 else "RGB"))
    return rel


def by_check(findings) -> dict:
    out: dict = {}
    for f in findings:
        out.setdefault(f["check"], []).append(f)
    return out
