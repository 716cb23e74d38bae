"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_own_dirs: dict[str, str] = {}
LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
#: The JVM interprets methods of more bytes and never compiles them; projections of many columns exceed that as one stage's code.
METHOD_LIMIT, METHOD_BYTES = "spark.sql.codegen.hugeMethodLimit", "8000"


def package_archive() -> str:
    """The package as a zip for the executors' Python path."""
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="windowlab-package-"), "windowlab.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.join("windowlab", os.path.relpath(path, root)))
    return target


def build_session(app: str = "windowlab", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution on; cluster settings win where already given."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config(METHOD_LIMIT, METHOD_BYTES)
    )
    if master:
        b = b.master(master).config("spark.driver.memory", "12g")
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    spark = b.getOrCreate()
    if not getattr(spark.sparkContext, "_windowlab_shipped", False):
        spark.sparkContext.addPyFile(package_archive())
        spark.sparkContext._windowlab_shipped = True
    return spark


def compiled_code(spark: SparkSession) -> None:
    """Lets stages whose code is too long to be compiled run operator by operator, in short methods; a limit that the session names stays."""
    if spark.conf.get(METHOD_LIMIT, None) in (None, "65535"):
        spark.conf.set(METHOD_LIMIT, METHOD_BYTES)


@contextmanager
def packed_listing(spark: SparkSession) -> Iterator[None]:
    """Lists trees of many small folders in a few tasks per level; by default every folder is a task of its own."""
    old = spark.conf.get(LISTING_TASKS, None)
    spark.conf.set(LISTING_TASKS, str(min(int(old or 10_000), 4 * core_count(spark))))
    try:
        yield
    finally:
        spark.conf.unset(LISTING_TASKS) if old is None else spark.conf.set(LISTING_TASKS, old)


@contextmanager
def plain_stages(spark: SparkSession) -> Iterator[None]:
    """Runs short jobs over a fixed number of tasks as planned, without a job of its own for every shuffle."""
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


def mounted(spark: SparkSession, path: str) -> str | None:
    """The path as the executors' Python sees it, if it lies in a mounted folder and not in an object store."""
    if "://" not in path and not path.startswith("file:"):
        path = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").rstrip("/") + os.path.abspath(path)
    return "/" + path[len("file:"):].lstrip("/") if path.startswith("file:") else None


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by the cluster in ``spark.checkpoint.dir``.

    Only a local session that names none (tests, one machine) gets an own folder; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        named = _own_dirs.get(app) or _own_dirs.setdefault(app, tempfile.mkdtemp(prefix="windowlab-"))
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage of iterative work and lets several readers share one
    computation; it survives the loss of executors.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def core_count(spark: SparkSession) -> int:
    """Partitions for work that is heavy per row while the rows are few bytes.

    Adaptive coalescing and file packing size partitions by bytes and would leave most cores idle.
    """
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
