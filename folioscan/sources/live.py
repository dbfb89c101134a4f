"""Feeds as they answer now: requests through the ``feed_pages`` data source, mapped onto the candidate schema."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..lineage import cut
from ..settings import Settings
from . import mappers
from .connectors import ATOM_DELAY, PagesSource, queries_of
from .feeds import SourceFailed, union


def pages(spark: SparkSession, url: str, **options: object) -> DataFrame:
    """(page, body) of a feed, each request made once; a request that fails raises :class:`SourceFailed`."""
    spark.dataSource.register(PagesSource)
    reader = spark.read.format("feed_pages").option("url", url)
    for name, value in options.items():
        reader = reader.option(name, json.dumps(value) if isinstance(value, dict) else str(value))
    try:
        return cut(reader.load(), "pages")
    except PySparkException as e:
        raise SourceFailed(f"{url}: {str(e).splitlines()[0]}") from e
    except Exception as e:  # a task's error comes as the gateway's
        if "ConnectionError" in str(e) or "URLError" in str(e) or "TimeoutError" in str(e) or "JSONDecodeError" in str(e):
            raise SourceFailed(url) from e
        raise


def _rows(found: DataFrame, schema, rows: str) -> DataFrame:
    """Records of JSON pages with their place as ``_at``."""
    told = found.select("page", F.from_json("body", schema).alias("b")).select("page", F.posexplode(f"b.{rows}").alias("_row", "x"))
    return told.select(F.struct(F.col("page").cast("string").alias("_file"), "_row").alias("_at"), "x.*")


def mapped(source: str, found: DataFrame, venue: Column | None = None) -> DataFrame:
    """Candidates of the pages of a feed."""
    if source == "openalex":
        return mappers.openalex(_rows(found, schemas.OPENALEX_PAGE, "results"), "_at")
    if source == "crossref":
        return mappers.crossref(_rows(found, schemas.CROSSREF_PAGE, "message.items"), "_at", venue=venue)
    if source in ("biorxiv", "medrxiv"):
        return mappers.biorxiv(_rows(found, schemas.BIORXIV_PAGE, "collection"), "_at", base=source)
    if source == "public":
        return mappers.public_api(_rows(found, schemas.PUBLIC_PAGE, "data"), "_at")
    if source == "arxiv":
        entries = found.select("page", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?s)(<entry\b.*?</entry>)"), 1)).alias("_row", "e"))
        read = entries.select(F.struct(F.col("page").cast("string").alias("_file"), "_row").alias("_at"), F.from_xml("e", schemas.ARXIV_ENTRY).alias("x"))
        return mappers.arxiv(read.select("_at", "x.*"), "_at")
    raise ValueError(f"no feed {source!r}")


def fetchers(spark: SparkSession, settings: Settings, now: datetime, address: Callable[..., str] = queries_of) -> list[Callable[[], DataFrame]]:
    """One fetch for the public API, if it has an address, and each enabled feed, in order."""
    until, found = now.date().isoformat(), []
    public = settings.sources.public_api
    since = (now - timedelta(days=settings.sources.window_days)).date().isoformat()
    if public.enabled and public.base_url:
        def ask() -> DataFrame:
            headers = {"apikey": public.api_key(), "Authorization": f"Bearer {public.api_key()}"}
            query = {"published_from": since, "published_to": until, "include_preprints": "true"}
            return mapped("public", pages(spark, f"{public.base_url}/candidates", kind="offsets", page_size=public.page_size, headers=headers, query=query))

        found.append(ask)
    for name in settings.sources.enabled():
        feed = settings.sources.feeds[name]
        start = (now - timedelta(days=feed.from_days_ago)).date().isoformat()
        url = address(name, start, until, feed.mailto, feed.categories)
        found.append(lambda name=name, url=url: mapped(name, pages(spark, url, delay=ATOM_DELAY if name == "arxiv" and address is queries_of else 0)))
    return found


def top_venue_works(spark: SparkSession, venues: list[str], since: str, until: str, mailto: str, address: Callable[..., str] = queries_of) -> DataFrame | None:
    """Crossref's works of each venue, one request each (at most the profile's 20); a venue that fails is left out."""
    parts = []
    for venue in venues:
        try:
            parts.append(mapped("crossref", pages(spark, address("crossref", since, until, mailto, None, venue)), F.lit(venue)))
        except SourceFailed:
            continue
    if not parts:
        return None
    both = union(parts)
    place = F.struct(F.format_string("%06d %s", "ord.part", "ord.at._file").alias("_file"), F.col("ord.at._row").alias("_row"))
    return both.withColumn("_at", place).drop("ord")
