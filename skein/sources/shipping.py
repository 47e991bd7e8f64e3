"""Gets this package to Python workers that don't find it themselves."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once an application; nothing to do where PYTHONPATH names the repository."""
    context = spark.sparkContext
    if context.applicationId in _shipped or str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    path = Path(tempfile.mkdtemp(prefix="skein-")) / "skein-package.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in [*ROOT.glob("skein/**/*.py"), *ROOT.glob("corpus_pipeline.py")]:
            out.write(file, file.relative_to(ROOT))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)
