"""Tables that change together: versioned folders, and one manifest that names those in force.

A change writes new folders beside the old ones and, at its end, one small manifest under a name with the next number; its
rename into place is the only step that readers see.  Whatever is lost before that leaves the former state whole, for all
tables at once, and of two changes begun from one state only the first can commit.  A table is cut into parts by a column
(a day, or a bucket of a key's hash); an upsert or a merge reads and writes the parts that its rows touch, no others.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WHOLE = "whole"


def bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets))


def _name(part: Column) -> Column:
    """A part's name: its value in hexadecimal, so that any value is a folder."""
    return F.coalesce(F.concat(F.lit("x"), F.hex(part.cast("string"))), F.lit("null"))


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = self._path("")
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def versions(self) -> list[int]:
        if not self.fs.exists(self._path("")):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(""))]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        found = self.versions()
        if not found:
            return {"version": 0, "tables": {}}
        n = found[-1] if version is None else version
        stream = self.fs.open(self._path(f"manifest-{n:08d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
        finally:
            stream.close()

    def read(self, table: str, manifest: dict | None = None, parts: list[str] | None = None) -> DataFrame | None:
        """A table as the manifest has it, or some of its parts; None where there is no such table."""
        told = (manifest or self.manifest())["tables"].get(table)
        if told is None:
            return None
        schema = T.StructType.fromJson(told["schema"])
        folders = [f"{self.root}/{f}" for p, f in sorted(told["parts"].items()) if parts is None or p in parts]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def begin(self) -> Change:
        return Change(self)

    def clean(self, kept: int = 2) -> int:
        """Delete manifests but the newest, and folders that none of those name; returns how many folders went."""
        found = self.versions()
        used = {f.split("/")[1] for n in found[-kept:] for t in self.manifest(n)["tables"].values() for f in t["parts"].values()}
        for n in found[:-kept]:
            self.fs.delete(self._path(f"manifest-{n:08d}.json"), False)
        gone = [s.getPath() for s in (self.fs.listStatus(self._path("data")) if self.fs.exists(self._path("data")) else []) if s.getPath().getName() not in used]
        for p in gone:
            self.fs.delete(p, True)
        return len(gone)


class Change:
    """Changes of several tables that take effect together by ``commit``, or not at all."""

    def __init__(self, store: Store):
        self.store, self.base = store, store.manifest()
        self.tables = json.loads(json.dumps(self.base["tables"]))

    def read(self, table: str, parts: list[str] | None = None) -> DataFrame | None:
        """The table with this change's own writes."""
        return self.store.read(table, {"tables": self.tables}, parts)

    def _write(self, df: DataFrame, part: Column | None) -> dict[str, str]:
        folder = f"data/{uuid.uuid4().hex}"
        if part is None:
            df.write.parquet(f"{self.store.root}/{folder}")
            return {_WHOLE: folder}
        named = df.withColumn("part_", _name(part))
        named.repartition("part_").write.partitionBy("part_").parquet(f"{self.store.root}/{folder}")
        found = [s.getPath().getName() for s in self.store.fs.listStatus(self.store._path(folder))]
        return {n[6:]: f"{folder}/{n}" for n in found if n.startswith("part_=")}

    def replace(self, table: str, df: DataFrame, part: str | Column | None = None) -> None:
        """The whole table."""
        part = F.col(part) if isinstance(part, str) else part
        self.tables[table] = {"schema": df.schema.jsonValue(), "parts": self._write(df, part)}

    def merge(self, table: str, new: DataFrame, part: str | Column, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """``combine(old, new)`` for the parts that ``new`` touches; other parts stay as they are."""
        part = F.col(part) if isinstance(part, str) else part
        if table not in self.tables:
            self.tables[table] = {"schema": new.schema.jsonValue(), "parts": {}}
        touched = [r[0] for r in new.select(_name(part)).distinct().collect()]
        rows = combine(self.read(table, touched), new)
        written = self._write(rows, part)
        if set(written) - set(touched):
            raise ValueError("a merge made rows of parts that it had not read")
        parts = {p: f for p, f in self.tables[table]["parts"].items() if p not in touched}
        self.tables[table] = {"schema": rows.schema.jsonValue(), "parts": parts | written}

    def upsert(self, table: str, new: DataFrame, keys: list[str], part: str | Column) -> None:
        """Rows of ``new``, and those of the table with other keys; keys hold the part."""
        self.merge(table, new, part, lambda old, rows: old.join(rows, keys, "left_anti").unionByName(rows, allowMissingColumns=True))

    def commit(self) -> int:
        """Put the change in force; returns the version."""
        store, n = self.store, self.base["version"] + 1
        staged, target = store._path(f"staged-{uuid.uuid4().hex}"), store._path(f"manifest-{n:08d}.json")
        out = store.fs.create(staged, False)
        try:
            out.write(bytearray(json.dumps({"version": n, "tables": self.tables}).encode("utf-8")))
        finally:
            out.close()
        if store.versions()[-1:] != ([self.base["version"]] if self.base["version"] else []) or not self._put(staged, target):
            store.fs.delete(staged, False)
            raise RuntimeError(f"another change was put in force since version {self.base['version']}")
        return n

    def _put(self, staged, target) -> bool:
        """Rename, unless the target is there."""
        return not self.store.fs.exists(target) and self.store.fs.rename(staged, target)
