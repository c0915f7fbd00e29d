"""Reviewer decisions as an append-only log: revisions, optimistic writes, latest state, merge of two histories."""

from __future__ import annotations

import hashlib
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.relational import best_by

SCHEMA = "scope string, revision bigint, collection string, key string, payload string, deleted boolean, saved_at timestamp"


class StaleRevision(Exception):
    """The log has moved on since the caller read it."""


class DecisionLog:
    """Decisions of many scopes (company and deal) in one folder of files; every save adds one file set.

    A writer claims its revision by creating a file that must not exist, which the file system does for one writer only: of
    two that save at the same moment, the other finds the log stale. A claim whose writer died is void after ``CLAIM_SECONDS``.
    """

    CLAIM_SECONDS = 3600

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def events(self) -> DataFrame:
        """All saved decisions; empty if none was saved yet."""
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], SCHEMA)

    def revision(self, scope: str) -> int:
        """The scope's last revision, 0 before the first save."""
        return self.events().filter(F.col("scope") == scope).agg(F.max("revision")).first()[0] or 0

    def state(self) -> DataFrame:
        """The latest decision of every key that is not deleted."""
        return best_by(self.events(), ["scope", "collection", "key"], [F.col("revision")]).filter("not deleted")

    def save(self, scope: str, changes: DataFrame, expected_revision: int) -> int:
        """Adds ``collection, key, payload, deleted`` as the next revision; the same state again is no revision.

        Raises StaleRevision if the scope is not at ``expected_revision``.
        """
        now = self.revision(scope)
        if now != expected_revision:
            raise StaleRevision(f"{scope} is at revision {now}, not {expected_revision}")
        current = self.state().filter(F.col("scope") == scope).select("collection", "key", F.col("payload").alias("old"))
        new = changes.join(current, ["collection", "key"], "left")
        new = new.filter(F.when(F.col("deleted"), F.col("old").isNotNull()).otherwise(~F.col("old").eqNullSafe(F.col("payload"))))
        if new.isEmpty():
            return now
        claim = self._claim(scope, now + 1)
        out = new.select(F.lit(scope).alias("scope"), F.lit(now + 1).cast("bigint").alias("revision"), "collection", "key", "payload", "deleted", F.current_timestamp().alias("saved_at"))
        try:
            out.write.mode("append").parquet(self.path)
        except Exception:
            claim[0].delete(claim[1], False)
            raise
        return now + 1

    def _claim(self, scope: str, revision: int) -> tuple:
        """Creates the claim of a revision; returns its file system and path."""
        sc = self.spark.sparkContext
        name = hashlib.sha256(scope.encode()).hexdigest()[:24]
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_claims/{name}-{revision}")
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        if fs.exists(path) and time.time() - fs.getFileStatus(path).getModificationTime() / 1000 > self.CLAIM_SECONDS:
            fs.delete(path, False)
        if not fs.createNewFile(path):
            raise StaleRevision(f"{scope} is being saved as revision {revision} by another writer")
        return fs, path

    def history(self, limit: int = 40) -> DataFrame:
        """``scope, revision, saved, removed``: what each of the last revisions changed."""
        h = self.events().groupBy("scope", "revision").agg(F.count_if(~F.col("deleted")).alias("saved"), F.count_if("deleted").alias("removed"))
        last = h.groupBy("scope").agg(F.max("revision").alias("last"))
        return h.join(last, "scope").filter(F.col("revision") > F.col("last") - limit).drop("last")
