"""Session helpers: shared scratch tables that cut lineage, and shipping the package to executors."""

from __future__ import annotations

import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}
_shipped: set[str] = set()
_scopes: list[list[str]] = []
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """Folder for this application's intermediate tables.

    It lies in the shared folder the cluster names in ``spark.checkpoint.dir``. Only a local master
    may go without that setting, because a machine-local folder is lost with its executor.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            base = tempfile.mkdtemp(prefix="run-")
        _roots[app] = f"{base.rstrip('/')}/phenospark-{app}-{uuid.uuid4().hex[:8]}"
    return _roots[app]


def materialize(df: DataFrame, name: str, slot: str | None = None) -> DataFrame:
    """Write ``df`` once as parquet in the scratch folder and return the written table.

    Lineage ends here, a lost executor costs only a re-read, and later readers prune columns and
    see the true size. Loops pass a ``slot`` to reuse a folder instead of piling up one per step.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{slot or uuid.uuid4().hex[:12]}/{name}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Remove, at the end of the block, the tables that :func:`materialize` wrote in it.

    Gives a function that writes a table which stays. Whatever is needed after the block must be
    written with it, as nothing may read the removed tables then. Inside the block Spark also
    gives up each query's shuffle files at its end.
    """
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    made: list[str] = []
    _scopes.append(made)

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = materialize(df, name)
        kept = made.pop()
        if len(_scopes) > 1:
            _scopes[-2].append(kept)
        return out

    try:
        yield keep
    finally:
        _scopes.remove(made)
        spark.conf.set(CLEANUP, before)
        for path in made:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in executor Python workers (needed by the Arrow functions)."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="run-"), "phenospark_pkg")
    archive = shutil.make_archive(out, "zip", os.path.dirname(here), os.path.basename(here))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
