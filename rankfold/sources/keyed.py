"""A table of files that upserts touch in part: rows lie in buckets by a hash of their key.

An upsert reads only the buckets that its rows fall into, merges, and replaces just these by a dynamic partition overwrite,
which Spark's commit protocol makes visible when the job has succeeded: a failing task leaves the table as it was. A ledger
notes the batches that were applied, so a batch that is delivered again changes nothing; one whose note was lost is applied
again, which is the same for merges that set values (those that add up need their totals in the rows).

Edge cases: of several rows of a key in one batch the greatest by `order` counts; null keys are keys; an empty batch is noted
and changes nothing; a table that isn't there yet reads as empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, keys: list[str], partitions: tuple[str, ...] = (), buckets: int = 64, form: str = "parquet"):
        """partitions: columns that are folders above the buckets; they belong to the key."""
        self.spark, self.path, self.keys, self.partitions, self.buckets, self.form = spark, path, keys, partitions, buckets, form
        self.schema = spark.createDataFrame([], schema).schema
        self.columns = self.schema.names

    def _there(self, path: str) -> bool:
        to = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return to.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(to)

    def _stored(self) -> DataFrame:
        fields = [f for f in self.schema.fields if f.name not in self.partitions]
        schema = StructType([*fields, *(self.schema[p] for p in self.partitions), StructField("bucket", IntegerType())])
        if not self._there(self.path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).format(self.form).load(self.path)

    def read(self) -> DataFrame:
        return self._stored().select(*self.columns)

    def applied(self, batch: str) -> bool:
        return self._there(f"{self.path}/_ledger/{batch}/_SUCCESS")

    def upsert(self, rows: DataFrame, batch: str, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None, order: list[str] | None = None) -> bool:
        """Applies a batch; False if the ledger has it already. merge(rows there, new rows) -> rows of the touched buckets; without it new rows replace those of their key."""
        if self.applied(batch):
            return False
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        key = [*self.partitions, *(k for k in self.keys if k not in self.partitions)]
        rest = [c for c in rows.columns if c not in key]
        last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*(order or rest))).alias("__row")).select(*key, "__row.*") if rest else rows.distinct()
        new = last.withColumn("bucket", bucket)
        at = [*self.partitions, "bucket"]
        touched = new.select(*[F.col(c).alias(f"__{c}") for c in at]).distinct()
        same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in at]
        there = self._stored().join(touched, same, "left_semi")
        if merge is None:
            held = new.select(*[F.col(k).alias(f"__{k}") for k in key])
            kept = there.join(held, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key], "left_anti").select(*self.columns)
            merged = kept.unionByName(last.select(*self.columns))
        else:
            merged = merge(there.select(*self.columns), last).select(*self.columns)
        out = merged.withColumn("bucket", bucket).repartition(*at)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*at).format(self.form).save(self.path)
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_ledger/{batch}")
        return True
