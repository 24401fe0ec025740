"""Python workers must import this package: where it is not installed, they are told its folder."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def see_package(spark: SparkSession) -> None:
    """Put the folder of this checkout on the workers' path (code that is shipped or installed is found as ever)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))
