"""Session helpers: shipping the package to the executors and shared scratch tables."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from holdfast.session import remove_folder, scratch_dir

_SHIPPED: dict[str, tempfile.TemporaryDirectory] = {}


def ship_package(spark: SparkSession) -> None:
    """Gives the executors this package, as ``--py-files`` would; once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    folder = tempfile.TemporaryDirectory(prefix="holdfast-package-")
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(folder.name, "holdfast.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for base, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(target)
    _SHIPPED[context.applicationId] = folder


_WRITTEN: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared checkpoint folder and read back: cuts lineage,
    survives lost executors, and gives later stages real sizes."""
    path = scratch_dir(df.sparkSession, name)
    _WRITTEN.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession, keep: int = 1) -> Iterator[None]:
    """Removes what ``written`` wrote inside, but for the last ``keep`` tables: for
    steps that end with a written result that needs none of the others."""
    before = len(_WRITTEN)
    yield
    gone = _WRITTEN[before:len(_WRITTEN) - keep]
    del _WRITTEN[before:len(_WRITTEN) - keep]
    for path in gone:
        remove_folder(spark, path)


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Removes the tables of ``written`` that ``df`` reads; it cannot be read afterwards."""
    for path in [p for p in _WRITTEN if any(os.path.dirname(f).endswith(p.split(":", 1)[-1]) for f in df.inputFiles())]:
        _WRITTEN.remove(path)
        remove_folder(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
