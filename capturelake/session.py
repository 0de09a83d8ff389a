"""Session helpers: the shared folder, materialised tables, task counts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share.

    It is what the session names in ``spark.checkpoint.dir``; a temporary folder of this
    machine is set only where that is unset, as in tests on a local master.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder which all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="capturelake-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def materialise(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs no more than a re-read of the table. The table is removed
    when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    remove_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and authority of its file system, as processes outside Spark need it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Have a folder removed when the driver's JVM ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)


def task_count(spark: SparkSession) -> int:
    """Number of balanced tasks to plan for: the session's shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


#: Setting that puts an exchange behind each scan whose rows are costly to parse; for files of one row group each.
SPREAD = "spark.capturelake.spreadScans"


def spread(df: DataFrame) -> DataFrame:
    """``df`` as it is; over all cores by an exchange, if the session asks for it (``spark.capturelake.spreadScans``).

    A file of one row group is one task, however costly its rows are. The plan follows the setting alone, not
    the size of the data; by default scans are read without an exchange.
    """
    spark = df.sparkSession
    return df.repartition(spark.sparkContext.defaultParallelism) if spark.conf.get(SPREAD, "false").lower() == "true" else df


def require_skew_splitting(spark: SparkSession) -> None:
    """Raise an error if the runtime does not split skewed join partitions, on which a join with hot rows relies."""
    for name in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled"):
        if spark.conf.get(name, "true").lower() != "true":
            raise ValueError(f"set {name}; without it a hot group's rows would be joined in one task")


def once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``df`` with ``value`` as ``name``, without the rows where it is NULL; a costly value is evaluated once.

    A projection with a filter on it would compute the value for both, and again for each use further up;
    as a generated row it is neither copied nor pushed down.
    """
    return df.withColumn(name, F.explode(F.filter(F.array(value), lambda x: x.isNotNull())))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)
