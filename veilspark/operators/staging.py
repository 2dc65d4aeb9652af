"""Written intermediate tables, for results that several later steps read.

A staged table cuts the plan: regexes are not run again for a second consumer, and a lost executor
costs a re-read instead of a recomputation. Tables go to the shared folder named by
``spark.checkpoint.dir``. Only a local session may fall back to a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_local: dict[str, str] = {}


def staging_dir(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = tempfile.mkdtemp(prefix="veilspark-")
        shared = _local[app]
    return shared.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{staging_dir(spark)}/veilspark/{spark.sparkContext.applicationId}"


def staging_path(spark: SparkSession, name: str) -> str:
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_staged(spark: SparkSession) -> None:
    """Delete all tables that this application staged. They hold raw values: call it when the results
    are written. Frames read from staged tables can not be used afterwards."""
    delete_folder(spark, _own_dir(spark))


def numbered_folders(spark: SparkSession, path: str, prefix: str) -> list[tuple[int, bool]]:
    """(number, complete) of the folders ``prefix<number>`` under a path, in order. Spark marks a folder as
    complete when the job that wrote it has committed."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = make(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    names = [s.getPath().getName() for s in files.listStatus(root)]
    numbers = sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))
    return [(n, files.exists(make(f"{path}/{prefix}{n}/_SUCCESS"))) for n in numbers]


def delete_folder(spark: SparkSession, path: str) -> None:
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)


def stage(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as parquet and read it back. Columns and types are kept."""
    spark = df.sparkSession
    path = staging_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a task after dealing, so that tasks stay short however large the input is, and many more than
#: the cores, so that these end together.
TASK_ROWS = 10_000
#: Rows of a split that is left as it is. Row groups may hold a million rows at any size of the table.
SPLIT_ROWS = 100_000


def spread(df: DataFrame, *keys: str, counted: bool = True) -> DataFrame:
    """Deal an input whose rows sit in few splits over all cores before heavy per-row work.

    A file is read by row groups, and a group goes to one split however the file is cut: a table of a
    million narrow rows may be one task among empty ones. So the rows of the splits are counted, which
    reads no column, and an input is dealt by all its columns when one split holds more than twice its
    share or more than ``SPLIT_ROWS``; a small input of one split is dealt by ``keys``. Dealt rows come in
    tasks of at most about ``TASK_ROWS``; other inputs are left alone at any size. Without ``counted``, for inputs that
    are not in row groups, only a single split is dealt.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    single = df.rdd.getNumPartitions() <= 1
    if not counted:
        return df.repartition(cores, *keys) if single else df
    sizes = [n for _, n in df.groupBy(F.spark_partition_id().alias("split")).count().collect()]
    if not single and (not sizes or max(sizes) <= min(SPLIT_ROWS, 2 * sum(sizes) / cores)):
        return df
    tasks = max(cores, -(-sum(sizes) // TASK_ROWS))
    return df.repartition(tasks, *(keys if single and tasks == cores else df.columns))
