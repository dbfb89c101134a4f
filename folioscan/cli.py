"""``python -m folioscan profile|watch``: the two pipelines from tables to files.

``profile`` reads the library (Parquet, as :mod:`folioscan.operators.library` keeps it), encodes what changed
and writes its vectors and ``profile.json``. ``watch`` takes candidates from a Parquet table or
from the feeds (cached for twelve hours), ranks the new ones, and writes RSS and HTML.
"""

from __future__ import annotations

import argparse
import logging
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import settings as conf
from . import sinks
from .operators.vectors import HASHED_SIZE, load_index, save_index
from .plans.pipeline import build_profile, similarity_of, watch
from .sources import feeds, live

log = logging.getLogger("folioscan")


def run_profile(spark: SparkSession, base: str, library: str, now: datetime) -> Path:
    """Vectors below ``base``/index and the profile as ``base``/profile.json."""
    items = spark.read.parquet(library)
    vectors, told = build_profile(items, "ord", F.get_json_object("raw", "$.data.publicationTitle"), F.lit(now))
    save_index(vectors, f"{base}/index", "key")
    return sinks.write_profile(told, Path(base) / "profile.json")


def candidates_of(spark: SparkSession, base: str, settings: conf.Settings, now: datetime, address=live.queries_of) -> DataFrame | None:
    """Candidates of all feeds, or the cached ones; kept for the next run if any feed answered."""
    cache = f"{base}/candidates"
    names = [r.venue for r in feeds.top_venue_names(feeds.profile_json(spark, f"{base}/profile.json")).collect()] if (Path(base) / "profile.json").exists() else []
    since, until = (now.date().replace(day=1)).isoformat(), now.date().isoformat()
    more = (lambda: live.top_venue_works(spark, names, since, until, settings.sources.feeds["crossref"].mailto, address)) if names and settings.sources.feeds["crossref"].enabled else None
    works, keep = feeds.fetch_all(live.fetchers(spark, settings, now, address), more, feeds.read_cache(spark, cache), now)
    if works is not None and keep:
        feeds.write_cache(works.drop("ord"), cache, now)
    return works


def run_watch(spark: SparkSession, base: str, library: str, settings: conf.Settings, now: datetime, works: DataFrame | None = None, n: int = 50, address=live.queries_of) -> tuple[Path, Path] | None:
    """(RSS, HTML) of the best new works; None if no feed answered and nothing was cached."""
    works = candidates_of(spark, base, settings, now, address) if works is None else works
    if works is None:
        log.warning("no candidates")
        return None
    works = works.drop("ord").withColumn("work_no", F.monotonically_increasing_id())
    items = spark.read.parquet(library)
    similarity = similarity_of(works, load_index(spark, f"{base}/index"), "work_no", HASHED_SIZE)
    journals = feeds.journals_csv(spark, f"{base}/journals.csv")
    ranked = watch(works, items, similarity, "work_no", journals, "ord", settings.scoring, F.lit(now), n=n)
    for line in sinks.log_lines(ranked):
        log.info(line)
    out = Path(base) / "reports"
    return sinks.write_rss(ranked, out / "feed.xml", now), sinks.write_html(ranked, out / sinks.report_name(ranked), now)


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="folioscan", description=__doc__)
    parser.add_argument("command", choices=("profile", "watch"))
    parser.add_argument("--base", default=".", help="folder with config, profile.json, index and reports")
    parser.add_argument("--library", required=True, help="the library's items as Parquet")
    parser.add_argument("--candidates", help="candidates as Parquet, instead of the feeds")
    parser.add_argument("--top", type=int, default=50)
    given = parser.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("folioscan").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    now = datetime.now(UTC)
    if given.command == "profile":
        log.info("profile written to %s", run_profile(spark, given.base, given.library, now))
        return 0
    works = spark.read.parquet(given.candidates) if given.candidates else None
    return 0 if run_watch(spark, given.base, given.library, conf.load(given.base), now, works, given.top) else 1
