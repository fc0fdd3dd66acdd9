"""Work on many products as an append-only log of transitions, which any number of workers may write.

A product's state is its entry with the greatest version. A transition is written as a part of the log that counts once a file of the
next number names it. That file can be created by one writer only, who had read all numbers before it: a writer that comes second reads
again and moves only what still may be moved. Nothing is ever changed or taken away, and a job that was cut off is taken up again: what was
running is queued anew, and results count only if their attempt's entry says that it is done.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators.models import isolated
from larder.sources.manifest import Conflict, create

LOG = "job string, sku string, version int, status string, note string, attempt string"
#: From which states each may be reached.
ALLOWED = {"running": ("queued",), "done": ("running",), "failed": ("running",), "queued": ("running", "failed")}


class Jobs:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self) -> tuple[int, DataFrame]:
        """The greatest number of the log, and its entries up to it."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/log")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path) or not fs.listStatus(path):
            return 0, self.spark.createDataFrame([], LOG)
        rows = self.spark.read.text(f"{self.root}/log").collect()  # a name for each step of a job
        return len(rows), self.spark.read.schema(LOG).parquet(*(f"{self.root}/parts/{r.value}" for r in rows))

    def _append(self, change: Callable[[DataFrame], DataFrame]) -> None:
        """Appends what ``change`` makes of the entries so far; if another writer was first, of the entries with its own."""
        while True:
            number, entries = self._read()
            part = uuid.uuid4().hex[:12]
            rows = change(entries).select("job", "sku", F.col("version").cast("int").alias("version"), "status", F.col("note").cast("string").alias("note"), "attempt")
            rows.write.parquet(f"{self.root}/parts/{part}")
            try:
                return self._commit(number, part)
            except Conflict:
                continue

    def _commit(self, number: int, part: str) -> None:
        create(self.spark, f"{self.root}/log/{number + 1:012d}", f"{part}\n")

    def entries(self) -> DataFrame:
        return self._read()[1]

    def latest(self, entries: DataFrame | None = None) -> DataFrame:
        """The state of each product of each job: job, sku, version, status, note, attempt."""
        entries = self.entries() if entries is None else entries
        last = entries.groupBy("job", "sku").agg(F.max(F.struct("version", "status", "note", "attempt")).alias("x"))
        return last.select("job", "sku", "x.*")

    def submit(self, job: str, skus: DataFrame) -> None:
        """Queues products; those that the job has already stay as they are."""
        new = skus.select("sku").distinct()

        def queued(entries: DataFrame) -> DataFrame:
            fresh = new.join(entries.where(F.col("job") == job).select("sku"), "sku", "left_anti")
            return fresh.select(F.lit(job).alias("job"), "sku", F.lit(0).alias("version"), F.lit("queued").alias("status"), F.lit(None).alias("note"), F.lit("").alias("attempt"))

        self._append(queued)

    def advance(self, job: str, to: str, attempt: str, rows: DataFrame | None = None) -> DataFrame:
        """Moves products (``rows``: sku and maybe note; all that may, if none are given) to a state: those that this attempt has moved."""

        def moved(entries: DataFrame) -> DataFrame:
            now = self.latest(entries).where((F.col("job") == job) & F.col("status").isin(*ALLOWED[to])).drop("note")
            if to in ("done", "failed"):
                now = now.where(F.col("attempt") == attempt)  # only who runs a product may end it
            note = F.col("note") if rows is not None and "note" in rows.columns else F.lit(None)
            now = now if rows is None else now.join(rows.select("sku", note.alias("note")), "sku")
            return now.select("job", "sku", (F.col("version") + 1).alias("version"), F.lit(to).alias("status"), (note if rows is None else F.col("note")).alias("note"), F.lit(attempt).alias("attempt"))

        self._append(moved)
        return self.latest().where((F.col("job") == job) & (F.col("status") == to) & (F.col("attempt") == attempt))

    def run(self, job: str, rows: DataFrame, fit: Callable, columns: Sequence[str], ddl: str, attempt: str | None = None) -> str:
        """Fits every queued product on its rows and ends it as done or failed, with the error as its note; returns the attempt's name.

        ``ddl``: sku, status, error and ``columns``. Products fail one by one; what ends the whole run leaves the rest to ``resume``.
        """
        attempt = attempt or uuid.uuid4().hex[:12]
        mine = self.advance(job, "running", attempt).select("sku")
        own = rows.join(mine, "sku", "left_semi")
        own.groupBy("sku").applyInPandas(isolated(fit, columns), ddl).write.parquet(f"{self.root}/results/attempt={attempt}")
        found = self.spark.read.schema(ddl).parquet(f"{self.root}/results/attempt={attempt}")
        self.advance(job, "done", attempt, found.where("status = 'done'"))
        lost = mine.join(found.select("sku"), "sku", "left_anti").select("sku", F.lit("no rows").alias("note"))  # products without a row to fit on
        self.advance(job, "failed", attempt, found.where("status = 'failed'").select("sku", F.col("error").alias("note")).unionByName(lost))
        return attempt

    def resume(self, job: str, stale: Sequence[str]) -> None:
        """Queues again what attempts that are known to have ended had left running."""
        left = self.latest().where((F.col("job") == job) & (F.col("status") == "running") & F.col("attempt").isin(*stale)).select("sku", F.concat(F.lit("left by "), "attempt").alias("note"))
        self.advance(job, "queued", uuid.uuid4().hex[:12], left)

    def results(self, job: str, ddl: str) -> DataFrame:
        """The results of products that are done, once each, whatever attempts there were."""
        every = self.spark.read.schema(f"{ddl}, attempt string").parquet(f"{self.root}/results")
        done = self.latest().where((F.col("job") == job) & (F.col("status") == "done")).select("sku", "attempt")
        return every.drop("status", "error").join(done, ["sku", "attempt"])

    def summary(self) -> DataFrame:
        """Each job: number of products by state, and its own state: running while any is, queued while any waits, failed if all failed."""
        n = lambda s: F.count_if(F.col("status") == s)
        one = self.latest().groupBy("job").agg(*(n(s).alias(s) for s in ("queued", "running", "done", "failed")))
        state = F.when(F.col("running") > 0, "running").when(F.col("queued") > 0, F.when(F.col("done") + F.col("failed") > 0, "running").otherwise("queued")).when(F.col("done") == 0, "failed").otherwise("done")
        return one.withColumn("state", state)
