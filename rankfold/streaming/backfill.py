"""Backfill: what has no current vector or rating waits in a queue and is worked off in capped ticks.

Arrivals are put in order once, greatest priority first, and written in chunks of at most `cap` rows. A tick takes the chunk
whose head has the greatest priority, works on it and writes the result; it reads nothing else, so the rows read grow as the
rows that arrive, not with the ticks before. Rows that fail (say, a zero vector) come again in chunks of their own, behind
what waits, `tries` times at most; after that the failed result stands. Between ticks the queue rests for `cool_down` seconds.

The queue lives in a shared folder: chunks, results, and a note of each batch that was taken in. A chunk is done when its
result is committed. A restarted queue of the same folder lists them and goes on; a batch or tick that is repeated after a
failure replaces its own files.

Edge cases: a key that arrives again is taken once (the stream drops repeats by state); null keys are left out; null
priorities come last, equal ones go by key; an empty source gives an empty result.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from ..operators.ranking import Down, global_rank
from ..sources.shared import shared_path

LOWEST = float("-inf")


class Queue:
    """process: rows of a chunk (all columns of the arrivals) -> rows of `schema`; failed: a condition on them that asks for another try."""

    def __init__(self, spark: SparkSession, arrivals_schema, process: Callable[[DataFrame], DataFrame], schema: str, key: str = "key", priority: str = "priority", cap: int = 1000, failed: Column | None = None, tries: int = 3, cool_down: float = 0.0, path: str | None = None):
        self.spark, self.process, self.key, self.priority, self.cap, self.failed, self.tries, self.cool_down = spark, process, key, priority, cap, failed, tries, cool_down
        self.columns = [f.name for f in arrivals_schema.fields]
        self.row = StructType([*arrivals_schema.fields, StructField("tries", IntegerType()), StructField("__weight", DoubleType())])
        self.schema = spark.createDataFrame([], schema).schema
        self.path = path or shared_path(spark, "backfill")
        self.waiting: dict[str, tuple[int, float]] = {}  # by chunk: round of tries, priority of its head
        self.done: list[str] = []
        self.rested = 0.0
        self.rows_read = 0
        self._resume()

    def _fs(self, path: str):
        to = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return to.getFileSystem(self.spark._jsc.hadoopConfiguration()), to

    def _list(self, kind: str) -> list[str]:
        """Folders of a kind whose writing was committed."""
        fs, to = self._fs(f"{self.path}/{kind}")
        names = [s.getPath().getName() for s in fs.listStatus(to)] if fs.exists(to) else []
        return sorted(n for n in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/{n}/_SUCCESS")))

    def _resume(self) -> None:
        self.done = self._list("done")
        for batch in self._list("notes"):
            for r in self.spark.read.parquet(f"{self.path}/notes/{batch}").collect():  # a row for each chunk
                if r.chunk not in self.done:
                    self.waiting[r.chunk] = (r.round, r.head)

    def put(self, rows: DataFrame, batch: str, round_: int = 0) -> None:
        """Orders a batch once and writes it in chunks, with a note of their heads."""
        own = rows if "tries" in rows.columns else rows.withColumn("tries", F.lit(0))
        own = own.filter(F.col(self.key).isNotNull()).withColumn("__weight", F.coalesce(F.col(self.priority).cast("double"), F.lit(LOWEST)))
        placed = global_rank(own, [Down("__weight"), self.key], "__at").withColumn("chunk", F.floor(F.col("__at") / self.cap))
        placed.select(*self.columns, "tries", "__weight", "chunk").repartition("chunk").write.mode("overwrite").partitionBy("chunk").parquet(f"{self.path}/chunks/{batch}")
        there = self.spark.read.schema(StructType([*self.row.fields, StructField("chunk", LongType())])).parquet(f"{self.path}/chunks/{batch}")
        heads = there.groupBy("chunk").agg(F.max("__weight").alias("head"), F.count("*").alias("n"))
        notes = heads.select(F.concat(F.lit(f"{batch}."), F.col("chunk").cast("string")).alias("chunk"), F.lit(round_).alias("round"), "head")
        notes.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/notes/{batch}")
        for r in self.spark.read.parquet(f"{self.path}/notes/{batch}").collect():  # a row for each chunk
            if r.chunk not in self.done:
                self.waiting[r.chunk] = (r.round, r.head)

    def _chunk(self, name: str) -> DataFrame:
        batch, _, number = name.rpartition(".")
        return self.spark.read.schema(self.row).parquet(f"{self.path}/chunks/{batch}/chunk={number}")

    def tick(self) -> bool:
        """Works on one chunk, if any waits."""
        if not self.waiting:
            return False
        time.sleep(max(0.0, self.rested + self.cool_down - time.time()))
        # First tries before second ones, then the greatest head; the name decides between equals.
        name = min(self.waiting, key=lambda n: (self.waiting[n][0], -self.waiting[n][1], n))
        round_, chunk = self.waiting[name][0], self._chunk(name)
        result = self.process(chunk.select(*self.columns))
        result.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/work/{name}")
        found = self.spark.read.schema(self.schema).parquet(f"{self.path}/work/{name}")
        if self.failed is not None and round_ + 1 < self.tries:
            bad = found.filter(self.failed).select(self.key)
            again = chunk.join(bad, self.key, "left_semi").withColumn("tries", F.col("tries") + 1).select(*self.columns, "tries")
            if not bad.isEmpty():
                self.put(again, f"again-{name.replace('.', '-')}", round_ + 1)
            found = found.filter(~F.coalesce(self.failed, F.lit(False)))
        found.write.mode("overwrite").parquet(f"{self.path}/done/{name}")
        self.rows_read += chunk.count()
        fs, to = self._fs(f"{self.path}/work/{name}")
        fs.delete(to, True)
        del self.waiting[name]
        self.done.append(name)
        self.rested = time.time()
        return True

    def results(self) -> DataFrame:
        paths = [f"{self.path}/done/{n}" for n in sorted(self.done)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def run(self, arrivals: DataFrame) -> DataFrame:
        """Takes in all that the source of a stream has, a tick after each batch, then ticks until nothing waits."""

        def step(batch: DataFrame, number: int) -> None:
            self.put(batch.select(*self.columns), f"arrived-{number}")
            self.tick()

        once = arrivals.filter(F.col(self.key).isNotNull()).dropDuplicates([self.key])
        once.writeStream.option("checkpointLocation", f"{self.path}/log").trigger(availableNow=True).foreachBatch(step).start().awaitTermination()
        while self.tick():
            pass
        return self.results()
