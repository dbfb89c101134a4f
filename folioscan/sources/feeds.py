"""Landed feed pages, the union of feeds, and the policy of the candidate cache."""

from __future__ import annotations

import logging
from collections.abc import Callable
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.values import iso_utc, parse_date
from . import mappers

log = logging.getLogger(__name__)

#: Age up to which cached candidates are used.
CACHE_HOURS = 12
TOP_VENUES = 20


class SourceFailed(Exception):
    """A feed couldn't be read; the others go on."""


def _pages(spark: SparkSession, path: str, schema, rows: str) -> DataFrame:
    """Rows of landed pages (one JSON object a file), with their place as ``_at``."""
    pages = spark.read.schema(schema).option("multiLine", True).json(path)
    placed = pages.select(F.input_file_name().alias("_file"), F.posexplode(rows).alias("_row", "x"))
    return placed.select(F.struct("_file", "_row").alias("_at"), "x.*")


def landed_public(spark: SparkSession, path: str) -> DataFrame:
    return mappers.public_api(_pages(spark, path, schemas.PUBLIC_PAGE, "data"), "_at")


def landed_openalex(spark: SparkSession, path: str) -> DataFrame:
    return mappers.openalex(_pages(spark, path, schemas.OPENALEX_PAGE, "results"), "_at")


def landed_crossref(spark: SparkSession, path: str, venue: Column | None = None) -> DataFrame:
    return mappers.crossref(_pages(spark, path, schemas.CROSSREF_PAGE, "message.items"), "_at", venue=venue)


def landed_biorxiv(spark: SparkSession, path: str, base: str = "biorxiv") -> DataFrame:
    return mappers.biorxiv(_pages(spark, path, schemas.BIORXIV_PAGE, "collection"), "_at", base=base)


def landed_arxiv(spark: SparkSession, path: str) -> DataFrame:
    entries = spark.read.schema(schemas.ARXIV_ENTRY).option("rowTag", "entry").format("xml").load(path)
    return mappers.arxiv(entries.withColumn("_at", F.struct(F.input_file_name().alias("_file"), F.monotonically_increasing_id().alias("_row"))), "_at")


def landed_library(spark: SparkSession, path: str) -> DataFrame:
    """Library pages are arrays of items."""
    rows = spark.read.schema(schemas.LIBRARY_PAGE).option("multiLine", True).json(path)
    return mappers.library_item(rows)


def tombstones(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TOMBSTONES).option("multiLine", True).json(path).select(F.explode("items").alias("key"))


def journals_csv(spark: SparkSession, path: str) -> DataFrame:
    """Title and SJR by row; ``ord`` keeps their order. No file: no rows."""
    try:
        rows = spark.read.schema(schemas.JOURNALS).option("header", True).csv(path)
        return rows.withColumn("ord", F.monotonically_increasing_id())
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "title string, sjr string, ord long")


def profile_json(spark: SparkSession, path: str) -> DataFrame:
    """The profile; raises where there is none."""
    return spark.read.schema(schemas.PROFILE).option("multiLine", True).json(path)


def top_venue_names(profile: DataFrame, n: int = TOP_VENUES) -> DataFrame:
    """Non-empty venue names of a profile, distinct in order, the first ``n``."""
    names = profile.select(F.posexplode("top_venues").alias("p", "v")).select("p", F.col("v.venue").alias("venue")).filter("venue <> ''")
    return names.groupBy("venue").agg(F.min("p").alias("p")).orderBy("p").limit(n).select("venue")


def union(parts: list[DataFrame], order: str = "_at") -> DataFrame:
    """All rows of the parts with ``ord``: a struct that sorts by part, then by place within it."""
    out = None
    for i, part in enumerate(parts):
        rest = [c for c in part.columns if c != order]
        told = part.select(F.struct(F.lit(i).alias("part"), F.col(order).alias("at")).alias("ord"), *rest)
        out = told if out is None else out.unionByName(told)
    return out


def run_source(fetch: Callable[[], DataFrame]) -> tuple[DataFrame | None, bool]:
    """(rows, failed). Only a failed request is caught; the fetch must run its action itself."""
    try:
        return fetch(), False
    except SourceFailed:
        return None, True


def fetch_all(fetchers: list[Callable[[], DataFrame]], extra: Callable[[], DataFrame] | None, cached: tuple[datetime, DataFrame] | None, now: datetime) -> tuple[DataFrame | None, bool]:
    """(candidates, whether to save them).

    A cache of up to 12 hours is used, even an empty one. Else the fetchers run in order,
    each failing for itself, and ``extra`` after them. If all failed, a stale cache
    that is not empty is used instead of everything; a total failure is never saved.
    """
    if cached and now - cached[0] <= timedelta(hours=CACHE_HOURS):
        return cached[1], False
    results = [run_source(f) for f in fetchers]
    more = run_source(extra)[0] if extra else None
    failed = bool(results) and all(bad for _, bad in results)
    if failed and cached and cached[1].limit(1).count():
        return cached[1], False
    parts = [df for df, _ in results if df is not None] + ([more] if more is not None else [])
    return (union(parts) if parts else None), bool(parts) and not failed


def write_cache(works: DataFrame, path: str, fetched_at: datetime) -> bool:
    """Candidates as JSON lines with ISO dates, and when they were fetched; False, with a warning, if they can't be written."""
    try:
        works.withColumn("published", iso_utc("published")).write.mode("overwrite").json(f"{path}/candidates")
        works.sparkSession.createDataFrame([(fetched_at.astimezone(UTC).isoformat(),)], "fetched_at string").write.mode("overwrite").json(f"{path}/fetched")
    except Exception as e:  # a cache that can't be written costs the next run its requests, not this one its result
        log.warning("the candidates couldn't be kept in %s: %s", path, e)
        return False
    return True


def read_cache(spark: SparkSession, path: str) -> tuple[datetime, DataFrame] | None:
    """(when they were fetched, cached candidates); None where there are none to read, or it isn't known from when they are."""
    text = [(f.name, "string" if f.name == "published" else f.dataType.simpleString()) for f in schemas.CANDIDATE if f.name != "ord"]
    try:
        when = spark.read.schema("fetched_at string").json(f"{path}/fetched").first()
        rows = spark.read.schema(", ".join(f"{n} {t}" for n, t in text)).json(f"{path}/candidates")
        fetched = datetime.fromisoformat(when[0])
    except Exception as e:
        log.warning("no candidates could be read from %s: %s", path, str(e).split("\n")[0])
        return None
    return fetched if fetched.tzinfo else fetched.replace(tzinfo=UTC), rows.withColumn("published", parse_date("published"))
