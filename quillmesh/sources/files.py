"""Small files through Spark's own file systems: text, JSON and single CSV files, replaced whole, with backups."""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.text import hyperlink
from quillmesh.sources.tables import exists

KEPT = 10


def _place(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def read_text(spark: SparkSession, path: str) -> str | None:
    """A whole small file, or None where there is none."""
    if not exists(spark, path):
        return None
    rows = spark.read.text(path, wholetext=True).head(1)
    return rows[0]["value"] if rows else ""


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a file: it is written beside its place and then renamed."""
    fs, target = _place(spark, path)
    _, staged = _place(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(staged, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    _swap(spark, staged, target)


def _swap(spark: SparkSession, staged, target) -> None:
    """Rename over the target in one step; at no time is there neither the old file nor the new one."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    kind = getattr(hadoop, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(kind, 1)
    over[0] = kind.OVERWRITE
    conf = spark._jsc.hadoopConfiguration()
    whole = target.getFileSystem(conf).makeQualified(target)
    hadoop.FileContext.getFileContext(whole.toUri(), conf).rename(staged.getFileSystem(conf).makeQualified(staged), whole, over)


def write_csv(spark: SparkSession, df: DataFrame, path: str, columns: list[str] | None = None, backups: str | None = None) -> None:
    """Replace a single CSV file with columns in a fixed order; the old one may be kept in a folder of backups."""
    shown = df if columns is None else df.select(*((F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")).alias(c) for c in columns))
    fs, target = _place(spark, path)
    folder = f"{path}.{uuid.uuid4().hex}"
    shown.coalesce(1).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(folder)
    _, made = _place(spark, folder)
    part = next(s.getPath() for s in fs.listStatus(made) if s.getPath().getName().startswith("part-"))
    if backups and fs.exists(target):
        stamp = dt.datetime.now(dt.UTC).strftime("%Y%m%dT%H%M%S%f")
        _, keep = _place(spark, f"{backups}/{target.getName()}.{stamp}")
        fs.mkdirs(keep.getParent())
        fs.rename(target, keep)
        prune(spark, backups, target.getName())
    _swap(spark, part, target)
    fs.delete(made, True)


def prune(spark: SparkSession, folder: str, name: str, kept: int = KEPT) -> int:
    """Delete all but the newest backups of a file; returns how many went."""
    fs, place = _place(spark, folder)
    found = sorted((s.getPath() for s in fs.listStatus(place) if s.getPath().getName().startswith(f"{name}.")), key=lambda p: p.getName())
    for p in found[: max(0, len(found) - kept)]:
        fs.delete(p, False)
    return max(0, len(found) - kept)


def with_links(df: DataFrame, column: str = "url") -> DataFrame:
    """A table as it is offered for download: web addresses become links of a spreadsheet."""
    return df.withColumn(column, hyperlink(F.col(column)))


def read_json(spark: SparkSession, path: str):
    text = read_text(spark, path)
    return None if text is None else json.loads(text)


def write_json(spark: SparkSession, path: str, value) -> None:
    write_text(spark, path, json.dumps(value, ensure_ascii=False, sort_keys=True, indent=1))


def front_matter(text: str) -> tuple[dict[str, str], str]:
    """Head of ``name: value`` lines between two lines of dashes, and the body."""
    if not text.startswith("---\n") or "\n---\n" not in text[4:]:
        return {}, text
    head, body = text[4:].split("\n---\n", 1)
    pairs = (line.split(":", 1) for line in head.split("\n") if ":" in line)
    return {k.strip(): v.strip().strip('"') for k, v in pairs}, body.lstrip("\n")


def write_brief(spark: SparkSession, folder: str, head: dict[str, str], body: str, day: str) -> None:
    """The latest brief and a copy under its day."""
    text = "---\n" + "".join(f"{k}: {v}\n" for k, v in head.items()) + "---\n\n" + body
    for name in ("latest.md", f"{day}.md"):
        write_text(spark, f"{folder}/{name}", text)


def read_brief(spark: SparkSession, folder: str) -> tuple[dict[str, str], str] | None:
    text = read_text(spark, f"{folder}/latest.md")
    return None if text is None else front_matter(text)


# What the metadata of an annotation batch holds.
METADATA = ("batch_id", "fingerprint", "size", "seed")


def write_metadata(spark: SparkSession, path: str, batch_id: str, fingerprint: str, size: int, seed: int) -> None:
    write_json(spark, path, {"batch_id": batch_id, "fingerprint": fingerprint, "size": size, "seed": seed})


def read_metadata(spark: SparkSession, path: str) -> dict:
    told = read_json(spark, path)
    missing = [k for k in METADATA if not isinstance(told, dict) or k not in told]
    if missing:
        raise ValueError(f"{path}: missing {', '.join(missing)}")
    return told


def matches(told: dict, batch_id: str, fingerprint: str) -> bool:
    return told["batch_id"] == batch_id and told["fingerprint"] == fingerprint
