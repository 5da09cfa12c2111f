"""Stages stored as Parquet under the shared folder, partitioned by key dimensions."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fringeflow.session import shared_dir


def new_stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/fringeflow/{uuid.uuid4().hex}/{name}"


def write_stage(
    stage: DataFrame, path: str, dims: Sequence[str] = (), compact: bool = False, replace: bool = False
) -> str:
    """Write a whole stage in place of what was there.

    With ``replace`` only the dimension values that ``stage`` contains are
    replaced and the others stay. ``compact`` gathers each dimension value
    into few files first. It is a rebalance, not a repartition: a value that
    holds a large share of the rows is split over many tasks by size.
    """
    if compact and dims:
        stage = stage.hint("rebalance", *dims)
    mode = "dynamic" if replace else "static"
    writer = stage.write.mode("overwrite").option("partitionOverwriteMode", mode)
    if dims:
        writer = writer.partitionBy(*dims)
    writer.parquet(path)
    return path


def write_measured(stage: DataFrame, path: str, **aggregates: str) -> dict[str, int]:
    """Write a whole stage and return aggregates of its rows, taken on their way: no second scan.

    They are taken in the tasks that write, each of which counts once,
    however often it is tried.
    """
    observation = Observation()
    measures = [F.expr(a).alias(name) for name, a in aggregates.items()]
    write_stage(stage.observe(observation, *measures), path)
    return observation.get


def read_stage(spark: SparkSession, path: str, schema: StructType, **key: int) -> DataFrame:
    """Read a stored stage; ``key`` dimensions prune whole directories.

    With the schema given, no file is opened before the query runs.
    """
    stage = spark.read.schema(schema).parquet(path)
    for dim, value in key.items():
        stage = stage.where(f"{dim} = {value}")
    return stage


def write_bucketed(stage: DataFrame, name: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """Store a stage's rows with a key in ``buckets`` files by hash of the key, sorted by it, and go on from there.

    Stages stored alike join on the key where they lie: the planner knows
    from the catalogue that equal keys are in buckets of equal number. The
    table is external, in the shared folder; ``drop_bucketed`` removes both.
    """
    spark = stage.sparkSession
    path = new_stage_path(spark, name)
    table = f"{name}_{uuid.uuid4().hex}"
    keyed = stage.where(" and ".join(f"{k} is not null" for k in keys)).repartition(buckets, *keys)
    keyed.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).format("parquet").saveAsTable(table)
    BUCKETED[table] = path
    return spark.table(table)


# Tables that ``write_bucketed`` has made in this process, and their folders.
BUCKETED: dict[str, str] = {}


def drop_bucketed(spark: SparkSession) -> None:
    """Forget all bucketed tables and remove their folders."""
    while BUCKETED:
        table, path = BUCKETED.popitem()
        spark.sql(f"drop table if exists {table}")
        remove_stage(spark, path)


def remove_stage(spark: SparkSession, path: str) -> None:
    """Delete a stored stage; frames that read it can no longer run."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


# Paths that ``settle`` has written in this process and nothing has removed yet.
SETTLED: list[str] = []


def remove_settled(spark: SparkSession, since: int = 0) -> None:
    """Delete all that was settled after the first ``since`` paths of ``SETTLED``."""
    while len(SETTLED) > since:
        remove_stage(spark, SETTLED.pop())


def keep_settled(spark: SparkSession, since: int, kept: Sequence[str]) -> None:
    """Delete all that was settled after the first ``since`` paths of ``SETTLED`` but ``kept``; nothing may read it any more."""
    for path in SETTLED[since:]:
        if path not in kept:
            SETTLED.remove(path)
            remove_stage(spark, path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries begun inside remove their shuffle files when they end.

    Otherwise these stay until the driver happens to collect its garbage,
    which large stages do not hasten.
    """
    before = spark.conf.get(REMOVE_SHUFFLES, "false")
    spark.conf.set(REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(REMOVE_SHUFFLES, before)


REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(stage: DataFrame, name: str) -> DataFrame:
    """Run a stage once, at once, and go on from its stored result.

    Building a query that settles stages therefore runs jobs. It cuts the
    lineage in storage that outlives executors, and gives the planner the
    stored size: a later join broadcasts the table only if that size is below
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise.
    """
    spark = stage.sparkSession
    with shuffles_removed(spark):
        path = write_stage(stage, new_stage_path(spark, name))
    SETTLED.append(path)
    return read_stage(spark, path, stage.schema)
