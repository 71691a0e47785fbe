"""The package, sent to executors that don't have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let the executors import this whole package, wherever the driver has it from; once an application.

    Functions that run Python in tasks call it themselves."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    name = os.path.join(tempfile.mkdtemp(prefix="spark-"), "framelode.zip")
    with zipfile.ZipFile(name, "w") as z:
        for folder, _, files in sorted(os.walk(here)):
            for f in sorted(files):
                if f.endswith(".py"):
                    z.write(f"{folder}/{f}", os.path.relpath(f"{folder}/{f}", os.path.dirname(here)))
    sc.addPyFile(name)
    _shipped.add(sc.applicationId)
