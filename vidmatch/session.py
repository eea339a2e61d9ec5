"""Session settings and the one place that cuts lineage."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(
    app: str = "vidmatch",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    settings: dict[str, str] | None = None,
) -> SparkSession:
    """A session with UTC times and adaptive skew handling.

    ``shuffle_partitions`` is for local runs; on a cluster leave it unset, start
    high (``spark.sql.adaptive.coalescePartitions.initialPartitionNum``) and let
    adaptive execution merge small partitions.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for name, value in (settings or {}).items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of a session, once.

    For sessions that were started elsewhere; ``--py-files`` does the same.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="vidmatch-package-")) / package.name
        archive = shutil.make_archive(str(target), "zip", package.parent, package.name)
        context.addPyFile(archive)
        _shipped.add(context.applicationId)


#: One folder for each local session that names none.
_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Only a local session without that setting gets a folder of its own; a cluster
    must name a shared one, so that a lost executor cannot take the data along.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    if context.applicationId not in _own_folders:
        _own_folders[context.applicationId] = tempfile.mkdtemp(prefix="vidmatch-checkpoint-")
    return _own_folders[context.applicationId]


def new_folder(spark: SparkSession) -> str:
    """A name for a new table in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/vidmatch-{uuid.uuid4()}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to a table of their own in the shared folder and read them back.

    For frames that are used several times or grow step by step. They are computed
    once, where ``checkpoint()`` computes them a second time to store them. The
    folder is kept, as checkpoint files are; let it expire with them.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
