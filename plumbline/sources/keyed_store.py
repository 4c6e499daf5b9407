"""Keyed stores over an append-only log of deltas, and an asset vault over two of them.

A save or a removal is one published folder of rows, a removal being a row without values (a tombstone). Reading merges the newest
base with the deltas after it: the last version of every key, without removed ones. Compaction writes the merged rows as
the base of the last version it has seen; the rename that publishes it is the only switch, so a compaction that dies half-way leaves
nothing that a reader looks at. Old versions go by :meth:`KeyedStore.vacuum`, one base later than they were replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.places import Versions

#: Deltas after the base from which a save compacts.
COMPACT_AFTER = 20


def listed(df: DataFrame, tags: list[str] | None = None, **wanted: object) -> DataFrame:
    """Rows whose columns equal the values that are given; a value of None matches all. ``tags``: all of them must be in the row's ``tags``."""
    parts: list[Column] = [F.col(name) == F.lit(value) for name, value in wanted.items() if value is not None]
    if tags:
        parts.append(F.size(F.array_except(F.lit(tags), F.coalesce("tags", F.array().cast("array<string>")))) == 0)
    return df.filter(reduce(lambda a, b: a & b, parts)) if parts else df


class KeyedStore:
    def __init__(self, spark: SparkSession, path: str, key: str = "key") -> None:
        self.spark, self.key, self.versions = spark, key, Versions(spark, path)

    def _live(self) -> tuple[int, list[int]]:
        """The newest base (0: none) and the deltas after it."""
        base = (self.versions.all("base") or [0])[-1]
        return base, [n for n in self.versions.all("deltas") if n > base]

    def _rows(self) -> DataFrame | None:
        base, deltas = self._live()
        parts = ([self.versions.read("base", [base])] if base else []) + ([self.versions.read("deltas", deltas)] if deltas else [])
        return reduce(DataFrame.unionByName, parts) if parts else None

    def save(self, df: DataFrame, order: str | None = None) -> int:
        """Adds or replaces rows. Of rows that share a key the one with the largest ``order`` counts, or the largest of all if there is none."""
        rows = df.withColumns({"_order": (F.col(order) if order else F.lit(0)).cast("bigint"), "_removed": F.lit(False)})
        return self._append(rows)

    def remove(self, keys: DataFrame) -> int:
        """Removes keys; unknown ones do no harm."""
        known = self._rows()
        if known is None:
            return 0
        nothing = {f.name: F.lit(None).cast(f.dataType) for f in known.schema if f.name not in (self.key, "v", "_order", "_removed")}
        return self._append(keys.select(self.key).distinct().withColumns(nothing | {"_order": F.lit(0).cast("bigint"), "_removed": F.lit(True)}))

    def _append(self, rows: DataFrame) -> int:
        number = self.versions.append(rows, "deltas", "base")
        if len(self._live()[1]) >= COMPACT_AFTER:
            self.compact()
        return number

    def list(self, tags: list[str] | None = None, **wanted: object) -> DataFrame:
        """The rows as they are now, all or those that match."""
        rows = self._rows()
        if rows is None:
            raise LookupError("nothing has been saved")
        values = [c for c in rows.columns if c not in (self.key, "v", "_order", "_removed")]
        last = rows.groupBy(self.key).agg(F.max_by(F.struct("_removed", *values), F.struct("v", "_order", F.struct(*values))).alias("last"))
        return listed(last.filter(~F.col("last._removed")).select(self.key, *[F.col(f"last.{c}") for c in values]), tags, **wanted)

    def load(self, keys: DataFrame) -> DataFrame:
        """The rows of these keys; unknown and removed ones are absent."""
        return self.list().join(keys.select(self.key).distinct(), self.key, "left_semi")

    def staged_base(self) -> tuple[str, int]:
        """The merged rows, written but not published, and the version that they stand for."""
        base, deltas = self._live()
        rows = self.list().withColumns({"_order": F.lit(0).cast("bigint"), "_removed": F.lit(False)})
        return self.versions.stage(rows), (deltas or [base])[-1]

    def compact(self) -> bool:
        """Makes the rows as they are now the base; false if there was nothing to do or another compaction was faster."""
        if not self._live()[1]:
            return False
        staged, upto = self.staged_base()
        return self.versions.publish(staged, "base", upto)

    def vacuum(self) -> None:
        """Deletes all but the last two bases, the deltas that the older of these holds, and what was never published. No writer may run beside it."""
        bases = self.versions.all("base")
        for n in bases[:-2]:
            self.versions.delete(f"base/v={n}")
        for n in self.versions.all("deltas"):
            if len(bases) > 1 and n <= bases[-2]:
                self.versions.delete(f"deltas/v={n}")
        self.versions.delete("staging")


class AssetVault:
    """Contents by their SHA-256, stored once; names point to them. A content goes when no name is left."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.names, self.contents = KeyedStore(spark, f"{path}/names", "name"), Versions(spark, f"{path}/contents")

    def _contents(self) -> DataFrame | None:
        numbers = self.contents.all("kept")
        first = (self.contents.all("collected") or [0])[-1]
        parts = ([self.contents.read("collected", [first])] if first else []) + ([self.contents.read("kept", live)] if (live := [n for n in numbers if n > first]) else [])
        return reduce(DataFrame.unionByName, parts).select("digest", "content") if parts else None

    def put(self, df: DataFrame) -> None:
        """Stores ``(name, content)``; a name that is there is pointed to its new content."""
        rows = df.select("name", "content", F.sha2("content", 256).alias("digest"), F.length("content").cast("bigint").alias("bytes"))
        fresh, known = rows.select("digest", "content").dropDuplicates(["digest"]), self._contents()
        self.contents.append(fresh if known is None else fresh.join(known.select("digest"), "digest", "left_anti"), "kept", "collected")
        self.names.save(rows.select("name", "digest", "bytes"))

    def remove(self, names: DataFrame) -> None:
        self.names.remove(names)

    def resolve(self, names: DataFrame) -> DataFrame:
        """``(name, digest, bytes, content)`` of the names that are there."""
        return self.names.load(names).join(self._contents().dropDuplicates(["digest"]), "digest").select("name", "digest", "bytes", "content")

    def stats(self) -> DataFrame:
        """One row: names and their bytes, distinct contents that names point to, and contents that are stored."""
        held = self.names.list()
        used = held.groupBy("digest").agg(F.count("*").alias("names"), F.max("bytes").alias("bytes"))
        totals = used.agg(F.coalesce(F.sum("names"), F.lit(0)).alias("assets"), F.coalesce(F.sum(F.col("names") * F.col("bytes")), F.lit(0)).alias("bytes"), F.count("*").alias("contents"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("content_bytes"))
        return totals.crossJoin(self._contents().agg(F.count_distinct("digest").alias("stored")))

    def collect_garbage(self) -> None:
        """Keeps the contents that a name points to. No writer may run beside it."""
        numbers = [*self.contents.all("kept"), *self.contents.all("collected")]
        live = self._contents().dropDuplicates(["digest"]).join(self.names.list().select("digest").distinct(), "digest", "left_semi")
        if numbers and self.contents.publish(self.contents.stage(live), "collected", max(numbers) + 1):
            for kind in ("kept", "collected"):
                for n in self.contents.all(kind):
                    if n <= max(numbers):
                        self.contents.delete(f"{kind}/v={n}")
