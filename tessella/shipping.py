"""Sending this package to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the session runs: its source goes to
    them once a session, as ``--py-files`` would send it."""
    app, root = spark.sparkContext.applicationId, Path(__file__).resolve().parent
    if app in _sent or not root.is_dir():  # from an archive: it has been sent already
        return
    archive = Path(tempfile.mkdtemp(prefix="tessella-")) / "tessella.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted([*root.rglob("*.py"), *root.rglob("*.toml")]):
            out.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _sent.add(app)
