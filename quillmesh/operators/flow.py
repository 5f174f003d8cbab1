"""Whole runs over a store: the full batch and the increment, from raw records to clusters, snapshots and one commit."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh import config
from quillmesh.functions import times as D
from quillmesh.operators import clustering as C
from quillmesh.operators import enrichment as N
from quillmesh.sources import snapshots
from quillmesh.sources.scratch import Scratch
from quillmesh.sources.store import Store


def full(spark: SparkSession, folder: str, raw: DataFrame, d: N.Dictionaries, now: dt.datetime, stop: list[str], source: str = "real", weights: dict = config.ENHANCED) -> int:
    """Score and cluster all raw records and put articles, errors and snapshots in force; returns the version."""
    scratch = Scratch(spark, "flow")
    scored = scratch.save(N.batch(raw, d, _at(now), weights), "scored")
    version = snapshots.write_outputs(spark, folder, C.cluster_articles(scored, stop), source, now)
    scratch.drop()
    return version


def increment(spark: SparkSession, folder: str, raw: DataFrame, d: N.Dictionaries, now: dt.datetime, stop: list[str], source: str = "real", weights: dict = config.ENHANCED) -> int:
    """Score the raw records whose ids are new, cluster them into the stored events, and put the outcome in force."""
    held = Store(spark, folder).read("articles")
    if held is None:
        return full(spark, folder, raw, d, now, stop, source, weights)
    scratch = Scratch(spark, "flow")
    fresh = scratch.save(N.scored_new(held, raw, d, _at(now), weights), "scored")
    known = N.sync_sources(held, raw)
    version = snapshots.write_outputs(spark, folder, C.cluster_incremental(known, fresh, stop), source, now)
    scratch.drop()
    return version


def _at(now: dt.datetime) -> Column:
    return D.parsed(F.lit(now.isoformat()))
