"""Makes this package importable on the executors, whatever folder the session was started from."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors once a session, unless their import path holds it already."""
    app = spark.sparkContext.applicationId
    paths = {os.path.realpath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p}
    # the workers of a local session see the driver's folders; those of a cluster have none of them
    if app in _shipped or (str(ROOT) in paths and spark.sparkContext.master.startswith("local[")):
        return
    where = Path(tempfile.mkdtemp(prefix="tidemark-code-")) / "tidemark.zip"
    with zipfile.ZipFile(where, "w") as out:
        for f in sorted([*(ROOT / "tidemark").rglob("*.py"), *ROOT.glob("corpus_pipeline.py")]):
            out.write(f, f.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(where))
    _shipped.add(app)
