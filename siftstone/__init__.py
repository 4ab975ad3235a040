"""siftstone: a PySpark library for curating and de-duplicating collections."""

from __future__ import annotations

import os
from pathlib import Path


def make_importable(spark) -> None:
    """Let Python workers on this machine import the library from where the driver has it.

    In local mode workers do not take over the driver's sys.path. On a cluster the library is
    shipped with --py-files, and this adds a path that changes nothing.
    """
    root = str(Path(__file__).resolve().parent.parent)
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
