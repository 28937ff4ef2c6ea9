"""Fresh paths for files that a query writes and reads again."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to Python workers that can't import it by PYTHONPATH."""
    root, sc = Path(__file__).resolve().parents[2], spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or any("decisium-" in f for f in sc._python_includes):
        return
    path = Path(tempfile.mkdtemp()) / f"decisium-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((root / "decisium").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(path))


def scratch(spark: SparkSession, name: str) -> str:
    """Under spark.checkpoint.dir; where unset (one machine), a folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="decisium-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
