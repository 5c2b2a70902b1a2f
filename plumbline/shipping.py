"""Makes this package importable in Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Spark's bound of an Arrow batch, and the one that is set in its place.
ARROW_DEFAULT, ARROW_BATCH = "67108864b", "4m"


def ship(spark: SparkSession) -> None:
    """Adds the package to the application's Python files, once per application.

    Needed where executors have no installation of it; where they have one,
    the files are the same. Where the session keeps Spark's default, batches of
    rows on their way to Python are held to a few MB, since several of them are
    in memory at once on both sides.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == ARROW_DEFAULT:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH)
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="plumbline-")) / "plumbline.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)
