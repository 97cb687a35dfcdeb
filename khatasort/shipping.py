"""The package for executors: a zip of its modules, added to the session once, so workers import it wherever they run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        top = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="khatasort-")) / "khatasort.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
            for path in sorted(top.rglob("*.py")):
                archive.write(path, str(path.relative_to(top.parent)))
        sc.addPyFile(str(target))
    return spark
