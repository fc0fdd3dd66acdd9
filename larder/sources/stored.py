"""Tables that are made once from their inputs and then read, bucketed and sorted, by all that needs them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from larder.sources.shared import fresh

_made: dict[tuple[str, str], str] = {}


def fingerprint(spark: SparkSession, paths: Sequence[str]) -> str:
    """Names, sizes and times of the files at these paths: another input has another one."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    seen = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        for f in fs.listStatus(path):
            seen.append((str(f.getPath()), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(repr(sorted(seen)).encode()).hexdigest()[:16]


def buckets(spark: SparkSession) -> int:
    """Buckets of stored tables: ``larder.buckets`` of the session, else as many as tasks run at a time."""
    return int(spark.conf.get("larder.buckets", None) or max(2, spark.sparkContext.defaultParallelism))


def stored(spark: SparkSession, name: str, inputs: Sequence[str], build: Callable[[], DataFrame], by: Sequence[str] = (), sort: Sequence[str] = ()) -> DataFrame:
    """What ``build`` gives, written to the shared folder when it is first asked for in an application; later calls read it.

    With ``by`` the table has one sorted file for each bucket of these columns, so joins, groups and windows on them need no exchange. A
    changed input is made anew. A write that fails leaves nothing behind that is read, as a table counts once it is complete.
    """
    key = (spark.sparkContext.applicationId, f"{name}_{fingerprint(spark, inputs)}_{buckets(spark)}")
    if key not in _made:
        table, rows, path = f"larder_{key[1]}", build(), fresh(spark, name)
        if by:
            n = buckets(spark)
            spark.sql(f"DROP TABLE IF EXISTS {table}")
            rows.repartition(n, *by).write.option("path", path).format("parquet").bucketBy(n, *by).sortBy(*(sort or by)).saveAsTable(table)
        else:
            rows.write.parquet(path)
        _made[key] = table if by else path
    return spark.table(_made[key]) if by else spark.read.parquet(_made[key])
