"""Make this package importable in Python workers that do not have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame

_done: set[str] = set()

#: Rows and bytes of the batches that go to Python workers, where the session has Spark's own defaults: texts are long.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


def shipped(df: DataFrame) -> DataFrame:
    """``df``, after handing the package to Spark's own file server, once per application."""
    for key, (usual, own) in BATCHES.items():
        if df.sparkSession.conf.get(key, usual) == usual:
            df.sparkSession.conf.set(key, own)
    context = df.sparkSession.sparkContext
    if context.applicationId not in _done:
        here = Path(__file__).resolve().parent
        archive = os.path.join(tempfile.mkdtemp(prefix="ledgerline-"), "ledgerline_package.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for path in sorted(here.rglob("*.py")):
                z.write(path, path.relative_to(here.parent))
        context.addPyFile(archive)
        _done.add(context.applicationId)
    return df
