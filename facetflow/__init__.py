"""Planar-graph validation and training-data operators on PySpark."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile


def ship(spark) -> None:
    """Send this package to the workers, once a session: they need not find it where the driver does."""
    context = spark.sparkContext
    if getattr(context, "_facetflow_shipped", False):
        return
    here, folder = os.path.dirname(os.path.abspath(__file__)), tempfile.mkdtemp(prefix="facetflow-")
    copy = shutil.copytree(here, os.path.join(folder, "files", "facetflow"), ignore=shutil.ignore_patterns("__pycache__"))
    archive = shutil.make_archive(os.path.join(folder, "facetflow"), "zip", os.path.dirname(copy))
    context.addPyFile(archive)  # the driver serves it to every executor
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # executors fetch it when they need it
    context._facetflow_shipped = True
