"""Makes the package importable in the Python workers of a session's executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's sources to the executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        here = os.path.dirname(os.path.abspath(__file__))
        name = os.path.join(tempfile.mkdtemp(prefix="spark-grouploom-"), "grouploom.zip")
        with zipfile.ZipFile(name, "w") as out:
            for folder, _, files in os.walk(here):
                for file in sorted(files):
                    if file.endswith(".py"):
                        path = os.path.join(folder, file)
                        out.write(path, os.path.join("grouploom", os.path.relpath(path, here)))
        context.addPyFile(name)
        _shipped.add(context.applicationId)
    return spark
