"""A table of computed features that is appended to batch by batch: a batch is there as a whole or not at all.

Each batch is a folder of Parquet files, parted by a hash of the key. Only folders that the manifest names are
read, and a manifest row is written last; so a write that was killed leaves nothing that anyone reads, and one that is
repeated takes the place of its first try.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.stored import stored

#: Parts that keys are dealt to. A look-up reads the parts of the wanted keys only.
BUCKETS = 64


class FeatureCache:
    """The cache at ``path``, of rows with the column ``key``."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(BUCKETS)).cast("int")

    def batches(self) -> list[str]:
        """Names of the batches that are there, one a call of ``append``."""
        try:
            rows = self.spark.read.schema("batch string").json(f"{self.path}/manifest").distinct().collect()
        except AnalysisException as gone:
            if gone.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return []
        return sorted(r.batch for r in rows)

    def table(self) -> DataFrame | None:
        """All rows of all batches with their ``_bucket``; None if there is no batch."""
        names = self.batches()
        if not names:
            return None
        found = None
        for n in names:
            one = self.spark.read.parquet(f"{self.path}/data/{n}")
            found = one if found is None else found.unionByName(one, allowMissingColumns=True)
        return found

    def append(self, batch: str, rows: DataFrame) -> None:
        """Writes the rows (one for each key) as ``batch``, then names it. The same batch again takes its place."""
        one = rows.dropDuplicates([self.key]).withColumn("_bucket", self._bucket())
        one.write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/data/{batch}")
        if batch not in self.batches():
            self.spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("append").json(f"{self.path}/manifest")

    def missing(self, wanted: DataFrame) -> DataFrame:
        """The distinct keys of ``wanted`` that no batch has.

        Parts without a wanted key are not read, and the cache's own keys are filtered by those wanted before
        they meet (the join's side of wanted keys is what Spark makes its run-time filters from).
        """
        keys = wanted.select(self.key).distinct().withColumn("_bucket", self._bucket())
        there = self.table()
        return keys.drop("_bucket") if there is None else keys.join(there.select(self.key, "_bucket"), [self.key, "_bucket"], "left_anti").drop("_bucket")

    def read_through(self, batch: str, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame], whole: bool = True) -> DataFrame:
        """Features of the wanted keys, one row a key. If any key is missing, the batch's features are computed (of all its keys
        if ``whole``, as a batch is a hit only as a whole; else of the missing ones), appended, and read back."""
        keys = stored(wanted.select(self.key).distinct())
        gone = stored(self.missing(keys))
        if not gone.isEmpty():
            self.append(batch, compute(keys if whole else gone))
        there = self.table()
        own = keys.withColumn("_bucket", self._bucket())
        return there.join(own, [self.key, "_bucket"], "left_semi").dropDuplicates([self.key]).drop("_bucket")
