"""Tables stored in buckets of their key, which join and group by it without an exchange."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

BUCKETS = 16


class BucketedTables:
    """Spark tables in the session's catalogue and warehouse, all in the same buckets of one key.

    Written once, they are exchanged once: a join of two of them on the key, and what is grouped by
    the key after it, reads bucket beside bucket. Rows lie sorted, so that a merge join does not
    sort either. Names get a suffix of their own; `drop` removes the tables and their files.
    Choose as many buckets as the cluster has cores, or more: a bucket is read by one task.
    """

    def __init__(self, spark: SparkSession, key: str, buckets: int = BUCKETS):
        self.spark, self.key, self.buckets = spark, key, buckets
        self.names: dict[str, str] = {}

    def save(self, name: str, df: DataFrame) -> DataFrame:
        """Store a table that has the key column; gives it back as it is stored."""
        if name in self.names:
            raise ValueError(f"table {name} is there already")
        stored = f"{name}_{uuid.uuid4().hex}"
        # Dealt by the hash that buckets are made of: one file per bucket, not one per task and bucket.
        dealt = df.repartition(self.buckets, self.key)
        dealt.write.bucketBy(self.buckets, self.key).sortBy(self.key).format("parquet").saveAsTable(stored)
        self.names[name] = stored
        return self.table(name)

    def table(self, name: str) -> DataFrame:
        return self.spark.table(self.names[name])

    def drop(self) -> None:
        for stored in self.names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS `{stored}`")
        self.names.clear()
