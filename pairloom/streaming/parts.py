"""Tables kept as parts of mergeable rows: batches append parts, readers merge them, compaction bounds how many there are.

A part holds at most one row per key, made by the same ``merge`` that readers and compaction apply, so parts can be merged in any order and grouping.
A manifest (one small table per version, the highest finished one counts) lists the parts that make up the table and the numbers of the batches
in each. A batch that is listed already is not appended again; a part that no manifest lists (its writer was lost) is not read. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "part string, level int, batches array<struct<low: bigint, high: bigint>>"


def spans(numbers: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of numbers joined where they touch."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(numbers):
        if out and low <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(high, out[-1][1])
        else:
            out.append((low, high))
    return out


class Parts:
    """``keys`` and ``merge`` (aliased aggregates, over the columns of a part, that give these columns again) make up a row."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], merge: list[Column], fan: int = 8):
        self.spark, self.path, self.keys, self.merge, self.fan = spark, path.rstrip("/"), keys, merge, fan
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.place = lambda name: hadoop(f"{self.path}/{name}")
        self.files = self.place("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The highest finished manifest, -1 if there is none."""
        if not self.files.exists(self.place("manifest")):
            return -1
        names = [f.getPath().getName() for f in self.files.listStatus(self.place("manifest"))]
        return max((int(n[2:]) for n in names if n.startswith("v=") and self.files.exists(self.place(f"manifest/{n}/_SUCCESS"))), default=-1)

    def listed(self) -> list[tuple[str, int, list[tuple[int, int]]]]:
        """Name, level and batch numbers of the table's parts: few rows, bounded by compaction."""
        at = self.version()
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/v={at}").collect() if at >= 0 else []
        return [(r["part"], r["level"], [(b["low"], b["high"]) for b in r["batches"]]) for r in rows]

    def commit(self, parts: list[tuple[str, int, list[tuple[int, int]]]]) -> None:
        self.spark.createDataFrame(parts, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={self.version() + 1}")

    def written(self, rows: DataFrame) -> str:
        name = f"part-{uuid.uuid4().hex}"
        rows.groupBy(*self.keys).agg(*self.merge).write.parquet(f"{self.path}/{name}")
        return name

    def append(self, rows: DataFrame, number: int) -> bool:
        """Rows in the columns of a part, as batch ``number``; false, and nothing is done, if the table has that batch. Compacts where ``fan`` parts of a level have come together."""
        parts = self.listed()
        if any(low <= number <= high for *_, batches in parts for low, high in batches):
            return False
        self.commit([*parts, (self.written(rows), 0, [(number, number)])])
        while self.compact():
            pass
        return True

    def compact(self, least: int | None = None) -> bool:
        """Merge the parts of the lowest level that has ``least`` (``fan``) of them into one of the next level: a row is rewritten once per level."""
        parts = self.listed()
        for level in sorted({lv for _, lv, _ in parts}):
            these = [p for p in parts if p[1] == level]
            if len(these) >= (least or self.fan):
                merged = self.written(self.spark.read.parquet(*[f"{self.path}/{p}" for p, *_ in these]))
                rest = [p for p in parts if p[1] != level]
                self.commit([*rest, (merged, level + 1, spans([b for *_, bs in these for b in bs]))])
                return True
        return False

    def vacuum(self) -> None:
        """Delete parts and manifests that the table no longer lists; no reader of an older version may be left."""
        keep, at = {p for p, *_ in self.listed()}, self.version()
        for f in self.files.listStatus(self.place("")):
            if (name := f.getPath().getName()).startswith("part-") and name not in keep:
                self.files.delete(f.getPath(), True)
        for v in range(at):
            self.files.delete(self.place(f"manifest/v={v}"), True)

    def read(self) -> DataFrame | None:
        """The table's rows, merged over its parts; None before the first batch."""
        parts = self.listed()
        return self.spark.read.parquet(*[f"{self.path}/{p}" for p, *_ in parts]).groupBy(*self.keys).agg(*self.merge) if parts else None


def first_and_last(rows: DataFrame, number: int, order: str, keys: list[str], first: list[str]) -> DataFrame:
    """Rows in the columns of a part whose columns ``first`` keep the value they began with, while the others take the last one, by batch, then ``order``."""
    last = [c for c in rows.columns if c not in keys and c not in first]
    at = [F.lit(number).cast("long").alias("batch"), F.col(order).alias("at")]
    return rows.select(*keys, F.struct(*at).alias("since"), F.struct(*first).alias("first"), F.struct(*at).alias("until"), F.struct(*last).alias("last"))


def merge_first_and_last() -> list[Column]:
    """Merges rows of ``first_and_last``."""
    return [F.min_by("first", "since").alias("first"), F.min("since").alias("since"), F.max_by("last", "until").alias("last"), F.max("until").alias("until")]
