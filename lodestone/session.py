"""Session set-up and the one way this package cuts lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession

_PATH_CONF = "spark.checkpoint.dir"
_ADAPTIVE_CONF = "spark.sql.adaptive.enabled"
# Joins on block and term go without an exchange where both sides are laid out by block.
_CO_PARTITION_CONF = "spark.sql.requireAllClusterKeysForCoPartition"
# Shuffle files of a step go when it ends, not when the driver happens to collect its garbage.
_CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(name: str = "lodestone", cpus: int | str = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus) if str(cpus).isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config(_CO_PARTITION_CONF, "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, taken from the session where it names one."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = spark.conf.get(_PATH_CONF, None) or sc.getConf().get(_PATH_CONF)
    if not path:
        if not re.match(r"local(\[|$)", sc.master):  # a local cluster has to name one
            raise RuntimeError(f"set {_PATH_CONF} to a folder that every executor can reach")
        path = tempfile.mkdtemp(prefix="lodestone-ckpt-")
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame, keep_layout: bool = False, by_block: bool = False) -> DataFrame:
    """Write ``df`` to the checkpoint folder once and go on from the files.

    Later steps neither recompute it nor depend on executors that may be lost. With
    ``keep_layout`` the write is planned without adaptive execution, so that Spark goes on
    knowing by which columns the rows are partitioned and spares later shuffles on them. With ``by_block`` it is
    planned so that tables laid out by a part of their join keys meet as they are, whatever the session says.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    wanted = {_CLEANUP_CONF: "true"}
    if keep_layout:
        wanted[_ADAPTIVE_CONF] = "false"
    if by_block:
        wanted[_CO_PARTITION_CONF] = "false"
    with setting(spark, wanted):
        return df.checkpoint(eager=True)


@contextmanager
def setting(spark: SparkSession, wanted: Mapping[str, str]) -> Iterator[None]:
    """Settings of the session for a while."""
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def tidied(df: DataFrame) -> AbstractContextManager[None]:
    """While it lasts, what the session of ``df`` runs leaves no shuffle files: for steps that are written and read again from their files."""
    return setting(df.sparkSession, {_CLEANUP_CONF: "true"})


def co_partitioned(spark: SparkSession) -> SparkSession:
    """Another session of the same application, in which tables laid out by a part of their join keys meet as they are.

    It shares tables and files with the caller's, whose own settings are left alone. What it runs leaves no shuffle files.
    """
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", _ADAPTIVE_CONF):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set(_CO_PARTITION_CONF, "false")
    own.conf.set(_CLEANUP_CONF, "true")
    return own


def written(df: DataFrame, options: Mapping[str, str] = {}) -> tuple[DataFrame, str]:  # noqa: B006, never changed
    """Write ``df`` to a new folder beside the checkpoints and go on from its files; the table and its folder."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    with tidied(df):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this package wrote."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
