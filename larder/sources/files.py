"""Reading retail files and writing tables."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def require_files(spark: SparkSession, folder: str, names: Sequence[str]) -> None:
    """An error that names every file that is missing."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    missing = []
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if not path.getFileSystem(conf).exists(path):
            missing.append(name)
    if missing:
        raise FileNotFoundError(f"{folder} lacks {', '.join(missing)}")


def read_text_columns(spark: SparkSession, path: str, types: dict[str, str]) -> DataFrame:
    """A CSV file read as text, each column then cast; empty and unreadable values are null."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    return raw.select(*(F.expr(f"try_cast(nullif(trim(`{c}`), '') as {t})").alias(c) for c, t in types.items()))


def read_sales_wide(spark: SparkSession, path: str, **equal: str | Sequence[str]) -> DataFrame:
    """A wide sales file, with equality or membership filters on its keys; an empty selection is an error."""
    rows = spark.read.csv(path, header=True, inferSchema=True)
    for column, value in equal.items():
        rows = rows.where(F.col(column).isin([value] if isinstance(value, str) else list(value)))
    if rows.isEmpty():
        raise ValueError(f"no series matches {equal}")
    return rows


def read_prices(spark: SparkSession, path: str, sales: DataFrame) -> DataFrame:
    """Prices of the items and stores that are sold."""
    prices = spark.read.csv(path, header=True, schema="store_id string, item_id string, wm_yr_wk int, sell_price double")
    return prices.join(sales.select("item_id").distinct(), "item_id", "left_semi").join(sales.select("store_id").distinct(), "store_id", "left_semi")


def read_upload(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """An uploaded CSV file, or a folder of parts that each begin with the header, as text columns, and the lines that could not be split
    into them; a file without a header is an error.

    Bytes that are no UTF-8 become replacement characters, and a line with one counts as unreadable.
    """
    lines = spark.read.text(path)
    head = lines.first()
    if head is None or not head[0].strip():
        raise ValueError("the file has no header")
    names = spark.read.csv(path, header=True, inferSchema=False).columns
    ddl = ", ".join(f"`{n.replace('`', '``')}` string" for n in (*names, "_corrupt_record"))
    rows = lines.where((F.col("value") != head[0]) & (F.trim("value") != "")).select("value", F.from_csv("value", ddl, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("x"))
    bad = F.col("x._corrupt_record").isNotNull() | F.contains("value", F.lit("\ufffd"))
    return rows.where(~bad).select(*(F.col(f"x.`{n}`") for n in names)), rows.where(bad).select(F.col("value").alias("_corrupt_record"))


def content_id(content: Column) -> Column:
    """A digest of a row's content, in hexadecimal digits."""
    return F.sha2(content.cast("binary"), 256)


def replace_scope(df: DataFrame, path: str, scope: Sequence[str]) -> None:
    """Writes a table by partitions of ``scope`` and replaces only those that ``df`` has: running it again changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*scope).parquet(path)


def append(df: DataFrame, path: str) -> None:
    """Appends; NaN becomes null, as readers take null for none."""
    clean = [F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*clean).write.mode("append").parquet(path)


def publish(df: DataFrame, root: str) -> str:
    """Writes a new version beside the old ones. It counts from when its ``_SUCCESS`` file stands, the last thing written, and nothing
    that readers look at is ever taken away: the version with the greatest name that is complete is the current one."""
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(f"{root}/versions/{version}")
    return version


def current_version(spark: SparkSession, root: str) -> str:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/versions/*/_SUCCESS")
    found = path.getFileSystem(conf).globStatus(path)
    if not found:
        raise FileNotFoundError(f"nothing is published below {root}")
    return max(f.getPath().getParent().getName() for f in found)


def read_current(spark: SparkSession, root: str) -> DataFrame:
    """The published version; a reader keeps it while a newer one is written."""
    return spark.read.parquet(f"{root}/versions/{current_version(spark, root)}")


def newest(df: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """The n newest rows of each key."""
    from pyspark.sql.window import Window

    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where(F.col("_n") <= n).drop("_n")
