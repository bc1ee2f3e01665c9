"""Send the package to the executors of a session, once, where it isn't installed there."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

import terralign

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """A zip of this package by way of addPyFile, so that tasks can import it wherever the driver was started."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    root = Path(terralign.__file__).resolve().parent
    if root.is_dir():
        name = shutil.make_archive(f"{tempfile.mkdtemp(prefix='terralign-')}/terralign-package", "zip", root.parent, root.name)
        context.addPyFile(name)
    _sent.add(context.applicationId)
