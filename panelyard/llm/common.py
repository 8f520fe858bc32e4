"""Column helpers that several operators share; all of them are plain Spark SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have yet (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    name, n = f"__{stem}", 0
    while name.lower() in taken:
        name, n = f"__{stem}{n}", n + 1
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def renamed(df: DataFrame, apart: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns named k0, k1, ..., but for those of `apart`, and the names' own ones.

    For operators whose columns may have the names of the user's.
    """
    names = {c if c in apart else f"k{n}": c for n, c in enumerate(df.columns)}
    return df.select(*(F.col(quoted(c)).alias(n) for n, c in names.items())), names


def restored(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*(F.col(quoted(n)).alias(c) for n, c in names.items()))


def blank_words(text: Column) -> Column:
    """Maximal runs without ASCII white space, as an array; null text has none."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\x09-\\x0D]+"))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone; text that is all ASCII takes the faster function."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def folded_words(text: Column) -> Column:
    """Runs of ASCII letters, digits and non-ASCII characters, with A-Z lower-cased."""
    parts = F.split(F.coalesce(text, F.lit("")), "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
    return F.transform(F.array_remove(parts, ""), ascii_lower)


def windows(words: Column, size: int) -> Column:
    """Hashes of every run of `size` words, in order; none if there are fewer."""
    n = F.size(words)
    hashed = F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.xxhash64(F.slice(words, i, size)))
    return F.when(n >= size, hashed).otherwise(F.array().cast("array<bigint>"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; only local sessions may leave it unset."""
    from pyspark.errors import PySparkException

    try:
        at = spark.conf.get("spark.checkpoint.dir", None)
    except PySparkException:
        at = None
    if not at:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = current.get() if current.isDefined() else None
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not at:
        at = f"{spark.conf.get('spark.sql.warehouse.dir', 'spark-warehouse')}/checkpoints"
    return at.rstrip("/")


def written(df: DataFrame, stem: str) -> DataFrame:
    """Cuts lineage: df as a parquet table in the shared checkpoint folder."""
    path = f"{shared_dir(df.sparkSession)}/{stem}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes a table of `written` that nothing reads any more."""
    spark = df.sparkSession
    files = df.inputFiles()
    at = files[0].rsplit("/", 1)[0] if files else ""
    if f"{shared_dir(spark).split('://')[-1].rstrip('/')}/" not in f"{at}/":
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
