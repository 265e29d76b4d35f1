"""Session helpers: building a session, and cutting lineage in the shared folder of the cluster."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}


def session(name: str = "strata", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the operators are tested with."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir, or where that is unset (tests, on a local master only) an own one."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own:
        return own.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"spark.checkpoint.dir is not set: on {master} it has to name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        path = tempfile.mkdtemp(prefix="strata-")
        atexit.register(shutil.rmtree, path, True)
        _own_dirs[app] = path
    return _own_dirs[app]


class Stage:
    """Tables an operator writes to the shared folder to cut lineage.

    ``keep`` writes a DataFrame as parquet and reads it back, so later stages neither
    recompute it nor depend on the shuffle files of an executor that may be lost.
    ``drop`` removes a table that no later stage reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/strata/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        path, fs = self._at(self.root)
        fs.deleteOnExit(path)  # by whatever file system holds it, when the driver's JVM ends

    def keep(self, df: DataFrame, tag: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{tag}"
        with _free_shuffles(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._strata_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            if at := getattr(df, "_strata_path", None):
                path, fs = self._at(at)
                fs.delete(path, True)

    def _at(self, at: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())


FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _free_shuffles(spark: SparkSession) -> Iterator[None]:
    """Lets the shuffle files of what runs inside be removed as soon as it ends: a kept table is read, never the shuffles it came from."""
    was = spark.conf.get(FREE, None)
    spark.conf.set(FREE, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(FREE)
        else:
            spark.conf.set(FREE, was)


def empty(df: DataFrame) -> bool:
    """Whether a (materialised) DataFrame has no row."""
    return not df.take(1)


def finite(c) -> F.Column:
    """True where a double is neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once per application, so that their Python workers find it wherever they start."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="strata-zip-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "strata.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(at, f)
                    z.write(full, os.path.join("strata", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
