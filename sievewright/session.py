"""Makes this package importable in Spark's Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Send the package's source to the workers, unless they find it by ``PYTHONPATH``."""
    context = spark.sparkContext
    on_path = str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if on_path or any(str(x).endswith("sievewright.zip") for x in context._python_includes):
        return
    target = Path(tempfile.mkdtemp(prefix="sievewright-")) / "sievewright.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in [*ROOT.glob("sievewright/**/*.py"), *ROOT.glob("corpus_pipeline.py")]:
            z.write(f, f.relative_to(ROOT))
    context.addPyFile(str(target))
