"""Tables that cut lineage between the passes of an iterative plan."""

from __future__ import annotations

import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; only local sessions may leave it unset."""
    try:
        at = spark.conf.get("spark.checkpoint.dir", None)
    except PySparkException:
        at = None
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not at:
        at = f"{spark.conf.get('spark.sql.warehouse.dir', 'spark-warehouse')}/checkpoints"
    return at.rstrip("/")


def written(df: DataFrame, stem: str) -> DataFrame:
    """df as a parquet table in the shared checkpoint folder."""
    path = f"{shared_dir(df.sparkSession)}/{stem}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes a table of `written` that nothing reads any more."""
    spark = df.sparkSession
    at = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in at:
        if f"{shared_dir(spark).split('://')[-1].rstrip('/')}/" in f"{folder}/":
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of which nulls are equal; the columns are left's, then right's others."""
    names = {k: f"__right_{k}" for k in keys}
    other = right.withColumnsRenamed(names)
    same = [left[k].eqNullSafe(other[n]) for k, n in names.items()]
    met = left.join(other, same or None, how if same else "cross")
    return met if how in ("left_semi", "left_anti") else met.drop(*names.values())


def with_mean(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """df with the column's mean by keys: an aggregate that is joined, so no task holds a whole key."""
    return joined(df, df.groupBy(*keys).agg(F.avg(column).alias(name)), keys)


#: Rows of a system up to which an iterative search runs whole in one task (some 30 MB).
LONG = 200_000


def by_length(rows: DataFrame, keys: list[str], long: int = LONG) -> tuple[DataFrame, DataFrame | None]:
    """Rows of systems of at most `long` rows, and of the others (None if there are none).

    The first are searched whole in one task a system; the others are read by passes.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    if not counts.where(F.col("__n") > long).head(1):
        return rows, None
    marked = joined(rows, counts, keys)
    return marked.where(F.col("__n") <= long).drop("__n"), marked.where(F.col("__n") > long).drop("__n")
