"""Make the package importable in the executors' Python workers."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent
_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once per application, as ``--py-files`` would."""
    context = spark.sparkContext
    if context.applicationId in _done:
        return
    target = Path(tempfile.mkdtemp(prefix="opfold-ship-")) / "opfold_package.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(ROOT.rglob("*.py")):
            archive.write(path, path.relative_to(ROOT.parent))
    context.addPyFile(str(target))
    _done.add(context.applicationId)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, after the package is shipped."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
