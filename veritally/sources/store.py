"""Stored scores: computed once, then an ordinary column every query can read."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.operators.scoring import Scorer, get_scorer, score
from veritally.session import checkpointed, remove_folder
from veritally.sources.generations import BUCKETS, BucketTable

_HASH = "payload_hash"


def _folder(text: str) -> str:
    """A folder name for any text: readable, and different for different texts."""
    return f"{re.sub(r'[^A-Za-z0-9_.-]', '_', text)[:60]}-{hashlib.sha256(text.encode()).hexdigest()[:12]}"


class ScoreStore:
    """Parquet below `root`, one folder per scorer name and version.

    One row per payload row: the key, score, pred, score_error and a 64-bit hash of the payload,
    by which a changed payload is noticed. The payload is not stored. `root` must be a folder
    every executor can reach. Rows lie in hash buckets of the key (see `BucketTable`): new keys are
    added to their buckets, a changed key rewrites its bucket only, and a write that fails at any
    point leaves the table as it was. One writer at a time per scorer version.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark = spark
        self.root = root.rstrip("/")
        self.buckets = buckets

    def path(self, scorer: str | Scorer) -> str:
        scorer = get_scorer(scorer)
        return f"{self.root}/{_folder(scorer.name)}/{_folder(scorer.version)}"

    def read(self, scorer: str | Scorer = "lines") -> DataFrame:
        """All that is stored for a scorer version."""
        return self._rows(scorer).drop(_HASH)

    def exists(self, scorer: str | Scorer = "lines") -> bool:
        return self.table(scorer).exists()

    def table(self, scorer: str | Scorer = "lines") -> BucketTable:
        """The files of a scorer version."""
        return BucketTable(self.spark, self.path(scorer), self.buckets)

    def write(self, df: DataFrame, key: str, payload: str, scorer: str | Scorer = "lines", **options) -> DataFrame:
        """Score every row of `df`, replacing what this scorer version had stored."""
        if options.get("only_keys") is not None:
            raise ValueError("write() stores every row; restrict the table instead")
        self.table(scorer).replace(self._scored(df, key, payload, scorer, options), key)
        return self.read(scorer)

    def append_new(self, df: DataFrame, key: str, payload: str, scorer: str | Scorer = "lines", **options) -> DataFrame:
        """The scores of the rows of `df`. Keys that are not stored yet are scored and added; keys
        whose rows or payloads differ from what was scored are scored again. Stored rows of other
        tables stay stored and are not returned.
        """
        if not self.exists(scorer):
            return self.write(df, key, payload, scorer, **options)
        rows = df.select(F.col(key).alias("_key"), F.xxhash64(F.col(payload)).alias(_HASH))
        present = rows.groupBy("_key").agg(*_contents())
        stored = self._rows(scorer).select(F.col(key).alias("_stored_key"), _HASH).groupBy("_stored_key").agg(*_contents("_stored"))
        # A NULL key is stored like any other, so here it matches itself.
        status = present.join(stored, F.col("_key").eqNullSafe(F.col("_stored_key")), "left")
        same = F.lit(True)
        for name in ("n", "xor", "sum"):
            same = same & F.col(f"_{name}").eqNullSafe(F.col(f"_stored_{name}"))
        stale = checkpointed(status.where(~same).select("_key", F.col("_stored_n").isNotNull().alias("_changed")))
        counts = stale.agg(F.count(F.lit(1)), F.count_if("_changed")).first()
        if counts[0]:
            todo = df.join(stale.select("_key"), F.col(key).eqNullSafe(F.col("_key")), "left_semi")
            scored = self._scored(todo, key, payload, scorer, options)
            self.table(scorer).change(scored, key, stale.where("_changed").select("_key") if counts[1] else None)
        mine = df.select(F.col(key).alias("_key"))
        return self.read(scorer).join(mine, F.col(key).eqNullSafe(F.col("_key")), "left_semi")

    def drop(self) -> None:
        """Remove the whole store."""
        remove_folder(self.spark, self.root)

    def _rows(self, scorer: str | Scorer) -> DataFrame:
        return self.table(scorer).read()

    def _scored(self, df: DataFrame, key: str, payload: str, scorer: str | Scorer, options: dict) -> DataFrame:
        named = df.withColumn(_HASH, F.xxhash64(F.col(payload)))
        return score(named, payload, scorer, keep=[key, _HASH], **options)


def _contents(prefix: str = "") -> list[Column]:
    """The payloads of a key's rows as a multiset, in three numbers that add up map-side."""
    return [
        F.count(F.lit(1)).alias(f"{prefix}_n"),
        F.bit_xor(_HASH).alias(f"{prefix}_xor"),
        F.sum(F.col(_HASH).cast("decimal(20,0)")).alias(f"{prefix}_sum"),
    ]
