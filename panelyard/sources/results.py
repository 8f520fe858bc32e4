"""Result files and tables: tolerant reading, choice of a run, resumption, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def parse_results(lines: DataFrame, fields: int, line: str = "value", order: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """(keys, j, x array) from lines of a key and `fields` numbers.

    Lines with another number of fields or a part that is no number are skipped; of lines
    with one key the last (by `order`) counts. NaN becomes null.
    """
    keys = keys or []
    cells = F.split(F.trim(F.col(line)), r"\s+")
    base = lines.select(*keys, cells.alias("c"), (F.col(order) if order else F.lit(0)).alias("__o")).where(F.size("c") == fields + 1)
    nums = F.transform(F.slice("c", 2, fields), lambda v: v.try_cast("double"))
    out = base.select(*keys, F.expr("try_cast(c[0] AS int)").alias("j"), nums.alias("x"), "__o")
    out = out.where(F.col("j").isNotNull() & ~F.exists("x", lambda v: v.isNull()))
    last = out.groupBy(*keys, "j").agg(F.max_by("x", "__o").alias("x"))
    return last.withColumn("x", F.transform("x", lambda v: F.when(~F.isnan(v), v)))


def read_results(spark: SparkSession, path: str, fields: int) -> DataFrame:
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    return parse_results(text, fields, order="line", keys=["file"])


def pick_run(runs: DataFrame, spec: str, tag_rank: str, size: str) -> DataFrame:
    """One run of each spec: the preferred tag, then the most replications."""
    w = Window.partitionBy(spec).orderBy(F.desc(tag_rank), F.desc(size))
    return runs.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def named_runs(files: DataFrame, path: str = "file") -> DataFrame:
    """spec, M and tag from names like kind_spec_M400_tag.txt."""
    return files.withColumns(
        {
            "spec": F.regexp_extract(path, r"[^/_]+_([^/_]+)_M\d+[^/]*$", 1),
            "M": F.expr(f"try_cast(regexp_extract({path}, '_M([0-9]+)', 1) AS int)"),
            "tag": F.regexp_extract(path, r"_M\d+_([A-Za-z]+)\.[^/]*$", 1),
        }
    )


def todo(plan: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Planned keys without a result."""
    return plan.join(done.select(*keys).distinct(), keys, "left_anti")


def requested(plan: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    return plan.join(wanted.select(*keys).distinct(), keys, "left_semi")


def resume_append(plan: DataFrame, path: str, keys: list[str], job: Callable[[DataFrame], DataFrame], partition: list[str]) -> DataFrame:
    """Runs the job on missing keys only and appends its rows; running again adds nothing."""
    spark = plan.sparkSession
    try:
        done = spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        job(plan).write.partitionBy(*partition).parquet(path)
    else:
        job(todo(plan, done, keys)).write.mode("append").partitionBy(*partition).parquet(path)
    return spark.read.parquet(path)


def namespaced(df: DataFrame, numeraire: str) -> DataFrame:
    """Results with their numeraire, a partition column, so that runs never mix."""
    return df.withColumn("numeraire", F.lit(numeraire))


def write_namespaced(df: DataFrame, path: str, numeraire: str, mode: str = "append") -> None:
    """Adds results under their numeraire's folder."""
    namespaced(df, numeraire).write.mode(mode).partitionBy("numeraire").parquet(path)


def read_namespaced(spark: SparkSession, path: str, numeraire: str) -> DataFrame:
    """One numeraire's results; the others' folders aren't read."""
    return spark.read.parquet(path).where(F.col("numeraire") == numeraire)


def report(detail: DataFrame, summary: DataFrame) -> DataFrame:
    """Detail rows and a summary row in one table for display."""
    return detail.withColumn("kind", F.lit("detail")).unionByName(summary.withColumn("kind", F.lit("summary")), allowMissingColumns=True)
