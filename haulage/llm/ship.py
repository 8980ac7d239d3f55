"""The package on the executors' path, where it was not submitted with --py-files."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's modules to the session's Python files, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        for folder, _, names in os.walk(PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    whole = os.path.join(folder, name)
                    archive.write(whole, os.path.relpath(whole, os.path.dirname(PACKAGE)))
    path = os.path.join(tempfile.mkdtemp(prefix="haulage-"), "haulage_modules.zip")
    with open(path, "wb") as file:
        file.write(held.getvalue())
    context.addPyFile(path)
    _shipped.add(context.applicationId)
