"""The package's code on the executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


#: Rows of a batch between Spark and Python.  Texts are long: ten thousand, the default, are tens of MB on either side.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each Spark context.

    Operators in Python are pickled by reference, so workers import the package.  The driver serves a
    small archive of it; nothing is needed where the package itself came as one (``--py-files``).
    Batches are made smaller where the session has the default size.
    """
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    context = spark.sparkContext
    package = Path(__file__).resolve().parent.parent
    if getattr(context, "_sabaki_shipped", False) or not package.is_dir():
        return
    folder = Path(tempfile.mkdtemp(prefix="sabaki-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(folder / "sabaki-package.zip", "w") as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    context.addPyFile(str(folder / "sabaki-package.zip"))
    context._sabaki_shipped = True
