"""A Parquet table of hash buckets that is changed bucket by bucket.

`place/g-<id>/bucket=<b>/` holds what one write put into a bucket. `place/_manifests/<number>.json`
lists the parts that make up the table; the highest number is the table. A write adds its parts
under a new name and then renames a manifest into place: until then, and after a crash at any
point, readers see the table as it was. Two writers cannot both take the next number, where the
file system refuses to rename onto a file that exists. What neither the new manifest nor the one
before it lists is removed after a write, so a reader that opened the table keeps its files for
one more write.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 16
MOST_PARTS = 8  # of one bucket; more are put together by the next write
_BUCKET = "bucket"


@dataclass(frozen=True)
class Manifest:
    """What makes up a table: its number of buckets and the generations of each."""

    number: int
    buckets: int
    schema: dict
    parts: dict[int, list[str]] = field(default_factory=dict)

    def text(self) -> str:
        parts = {str(b): names for b, names in sorted(self.parts.items())}
        return json.dumps({"buckets": self.buckets, "schema": self.schema, "parts": parts})


class BucketTable:
    """The table at `place`, a folder that every executor can reach. `key` is hashed to buckets."""

    def __init__(self, spark: SparkSession, place: str, buckets: int = BUCKETS):
        self.spark, self.place, self.buckets = spark, place.rstrip("/"), buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.place).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- reading ---

    def manifest(self, back: int = 0) -> Manifest | None:
        """The table as it is, or as it was some writes back."""
        numbers = self._numbers()
        if len(numbers) <= back:
            return None
        number = numbers[-1 - back]
        stream = self._files.open(self._path(self._manifest(number)))
        try:
            found = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Manifest(number, found["buckets"], found["schema"], {int(b): names for b, names in found["parts"].items()})

    def exists(self) -> bool:
        return bool(self._numbers())

    def read(self, only: Iterable[int] | None = None) -> DataFrame:
        """The rows, of some buckets on request."""
        now = self.manifest()
        if now is None:
            raise FileNotFoundError(f"no table at {self.place}")
        chosen = now.parts if only is None else {b: now.parts[b] for b in only if b in now.parts}
        schema = StructType.fromJson(now.schema)
        paths = self._paths(chosen)
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def files(self) -> set[str]:
        """The data files that make up the table now."""
        found = set()
        for path in self._paths(self.manifest().parts):
            found |= {str(x.getPath()) for x in self._files.listStatus(self._path(path)) if x.getPath().getName().startswith("part-")}
        return found

    def bucket_of(self, key: str) -> Column:
        now = self.manifest()
        return F.pmod(F.xxhash64(F.col(key)), F.lit(now.buckets if now else self.buckets)).cast("int")

    # --- writing ---

    def replace(self, rows: DataFrame, key: str) -> None:
        """These rows instead of all that there are."""
        name, filled = self._written(rows, key)
        before = self.manifest()
        self._commit(before, rows.schema, {b: [name] for b in filled})

    def change(self, rows: DataFrame, key: str, drop: DataFrame | None = None) -> None:
        """Add rows. Keys of `drop` (one column) lose the rows they had; only their buckets, and
        those of too many parts, are written anew. A NULL key is a key like any other."""
        before = self.manifest()
        crowded = {b for b, names in before.parts.items() if len(names) >= MOST_PARTS}
        touched = set(crowded)
        if drop is not None:
            gone = drop.select(F.col(drop.columns[0]).alias("_gone")).distinct()
            touched |= {r[0] for r in gone.select(F.pmod(F.xxhash64("_gone"), F.lit(before.buckets)).cast("int")).distinct().collect()}
        everything = rows
        if touched:
            kept = self.read(sorted(touched))
            if drop is not None:
                kept = kept.join(gone, F.col(key).eqNullSafe(F.col("_gone")), "left_anti")
            everything = kept.unionByName(rows)
        name, filled = self._written(everything, key)
        parts = {b: names for b, names in before.parts.items() if b not in touched}
        for b in filled:
            parts[b] = [*parts.get(b, []), name]
        self._commit(before, StructType.fromJson(before.schema), parts)

    def _written(self, rows: DataFrame, key: str) -> tuple[str, list[int]]:
        name = f"g-{uuid.uuid4().hex}"
        # A bucket's rows come together; Spark cuts large buckets and merges small ones into tasks.
        dealt = rows.withColumn(_BUCKET, self.bucket_of(key)).hint("rebalance", _BUCKET)
        dealt.write.partitionBy(_BUCKET).parquet(f"{self.place}/{name}")
        listed = [x.getPath().getName() for x in self._files.listStatus(self._path(f"{self.place}/{name}"))]
        return name, sorted(int(x.split("=")[1]) for x in listed if x.startswith(f"{_BUCKET}="))

    def _commit(self, before: Manifest | None, schema: StructType, parts: dict[int, list[str]]) -> None:
        number = before.number + 1 if before else 1
        after = Manifest(number, before.buckets if before else self.buckets, json.loads(schema.json()), parts)
        draft = f"{self.place}/_manifests/.draft-{uuid.uuid4().hex}"
        stream = self._files.create(self._path(draft))
        stream.write(bytearray(after.text().encode()))
        stream.close()
        if self._files.exists(self._path(self._manifest(number))) or not self._files.rename(self._path(draft), self._path(self._manifest(number))):
            self._files.delete(self._path(draft), False)
            raise OSError(f"another writer changed {self.place}")
        self._clean()

    def _clean(self) -> None:
        """Remove what the last two manifests do not list, older manifests too."""
        listed = [m for m in (self.manifest(0), self.manifest(1)) if m]
        used = {(name, b) for m in listed for b, names in m.parts.items() for name in names}
        for folder in self._files.listStatus(self._path(self.place)):
            name = folder.getPath().getName()
            if not name.startswith("g-"):
                continue
            if not any(name == n for n, _ in used):
                self._files.delete(folder.getPath(), True)
                continue
            for part in self._files.listStatus(folder.getPath()):
                kind, _, b = part.getPath().getName().partition("=")
                if kind == _BUCKET and (name, int(b)) not in used:
                    self._files.delete(part.getPath(), True)
        for number in self._numbers()[:-2]:
            self._files.delete(self._path(self._manifest(number)), False)

    # --- places ---

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.place}/_manifests")
        if not self._files.exists(folder):
            return []
        names = [x.getPath().getName() for x in self._files.listStatus(folder)]
        return sorted(int(x.removesuffix(".json")) for x in names if x.endswith(".json"))

    def _manifest(self, number: int) -> str:
        return f"{self.place}/_manifests/{number:08d}.json"

    def _paths(self, parts: dict[int, list[str]]) -> list[str]:
        return [f"{self.place}/{name}/{_BUCKET}={b}" for b, names in sorted(parts.items()) for name in names]
