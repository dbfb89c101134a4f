"""The registered queries of the core and the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas, sinks
from ..functions import text, values
from ..operators import dedupe as dd
from ..operators import library as lib
from ..operators import policy, profile, rank, vectors
from ..settings import FEEDS, Feed, Scoring, Sources
from ..sources import feeds, mappers
from ..tables import table
from . import pipeline
from .oracle import ORACLE

#: The moment that ages are told from; no query reads a clock.
AS_OF = "2024-03-01 00:00:00"
DIM = 64
SCORING = Scoring(decay_days={"fast": 30, "medium": 180, "slow": 720}, whitelist_authors=["Gaël Jestubashak", "PRIYA R. NASHUSHOFI"], whitelist_venues=["advances in industrial agronomy"])

SOURCES = Sources(feeds={n: Feed(enabled=n in ("crossref", "arxiv", "biorxiv")) for n in FEEDS})

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    _queries[f.__name__] = f
    return f


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def candidates(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(s, d, "candidates", *columns)


def library(s: SparkSession, d: str) -> DataFrame:
    """Items as a library: one row per key, the last delivery."""
    return lib.latest(table(s, d, "items"), "item_key", "item_id")


def stamped(df: DataFrame, *columns: str) -> DataFrame:
    """Timestamps without zone are UTC."""
    return df.withColumns({c: F.col(c).cast("timestamp") for c in columns})


# ---- scalar functions ----


@query
def clean_title(s, d):
    return candidates(s, d, "cand_id", "title").select("cand_id", text.clean_title("title").alias("title")).filter("title <> ''")


@query
def normalize_title(s, d):
    return table(s, d, "items", "item_id", "title").select("item_id", text.normalize_title("title").alias("title"))


@query
def normalize_identifier(s, d):
    return candidates(s, d, "cand_id", "identifier", "doi").select("cand_id", text.normalize_identifier("identifier").alias("identifier"), text.normalize_identifier("doi").alias("doi"))


@query
def year_of(s, d):
    return table(s, d, "items", "item_id", "date_text").select("item_id", text.year_of("date_text").cast("long").alias("pub_year"))


@query
def clean_abstract(s, d):
    return candidates(s, d, "cand_id", "abstract").select("cand_id", text.clean_abstract("abstract").alias("abstract"))


@query
def inverted_abstract(s, d):
    """Titles as an index of words and their places, and back."""
    words = candidates(s, d, "cand_id", "title").select("cand_id", F.filter(F.split(F.coalesce("title", F.lit("")), " "), lambda w: w != "").alias("ws"))
    places = lambda w: F.filter(F.sequence(F.lit(0), F.size("ws")), lambda i: F.get("ws", i) == w)
    index = F.map_from_entries(F.transform(F.array_distinct("ws"), lambda w: F.struct(w, places(w))))
    return words.select("cand_id", text.inverted_abstract(index).alias("abstract"))


@query
def numeric_metrics(s, d):
    told = table(s, d, "events", "event_id", "props").select("event_id", values.numeric_only(F.from_json("props", "map<string,string>")).alias("m"))
    return told.select("event_id", F.explode("m").alias("name", "value"))


@query
def content_hash(s, d):
    return table(s, d, "items", "item_id", "title", "abstract", "creators", "tags").select("item_id", text.item_hash().alias("content_hash"))


@query
def embedding_text_library(s, d):
    return table(s, d, "items", "item_id", "title", "abstract", "creators", "tags").select("item_id", text.library_text().alias("content"))


@query
def embedding_text_candidate(s, d):
    return candidates(s, d, "cand_id", "title", "abstract", "authors").select("cand_id", text.candidate_text().alias("content"))


@query
def parse_dates(s, d):
    return table(s, d, "items", "item_id", "date_text").select("item_id", F.unix_seconds(values.parse_date("date_text")).alias("epoch"))


@query
def iso_dates(s, d):
    return candidates(s, d, "cand_id", "published").select("cand_id", values.iso_utc("published").alias("iso"))


@query
def shortened_extra(s, d):
    told = candidates(s, d, "cand_id", "abstract", "title").select("cand_id", text.shorten_values(F.create_map(F.lit("abstract"), "abstract", F.lit("title"), "title")).alias("m"))
    return told.select("cand_id", F.col("m")["abstract"].alias("abstract"), F.col("m")["title"].alias("title"))


@query
def sorted_json(s, d):
    return candidates(s, d, "cand_id", "batch_no").select("cand_id", text.sorted_json("cand_id", "batch_no").alias("json"))


# ---- mappers: what a payload of these rows would map to ----


@query
def map_public_api(s, d):
    rows = stamped(candidates(s, d), "published")
    payload = rows.select("cand_id", F.struct(
        F.lit(None).cast("string").alias("id"), "source", F.col("identifier").alias("source_identifier"), "title", "abstract", "authors", "doi", "url",
        values.iso_utc("published").alias("published_at"), "venue", F.transform_values("metrics", lambda k, v: v.cast("string")).alias("metrics"), F.lit(None).cast("string").alias("candidate_type"),
    ).alias("x"))
    read = payload.select("cand_id", F.from_json(F.to_json("x"), schemas.PUBLIC_PAGE["data"].dataType.elementType).alias("x")).select("cand_id", "x.*")
    mapped = mappers.public_api(read, "cand_id")
    return mapped.select("cand_id", "source", "identifier", "title", F.size("authors").cast("long").alias("n_authors"), F.unix_micros("published").alias("published"), F.size("metrics").cast("long").alias("n_metrics"))


@query
def map_openalex(s, d):
    rows = candidates(s, d)
    payload = rows.select("cand_id", F.struct(
        F.col("identifier").alias("id"), F.col("title").alias("display_name"), "doi", "abstract",
        F.transform(F.coalesce("authors", F.array().cast("array<string>")), lambda a: F.struct(F.struct(a.alias("display_name")).alias("author"))).alias("authorships"),
        F.struct(F.col("url").alias("landing_page_url"), F.struct(F.col("venue").alias("display_name")).alias("source")).alias("primary_location"),
        F.date_format(F.col("published").cast("timestamp"), "yyyy-MM-dd").alias("publication_date"), F.col("batch_no").cast("double").alias("cited_by_count"),
    ).alias("x"))
    read = payload.select("cand_id", F.from_json(F.to_json("x"), schemas.OPENALEX_PAGE["results"].dataType.elementType).alias("x")).select("cand_id", "x.*")
    return mappers.openalex(read, "cand_id").select("cand_id", "identifier", "title", "venue", "url", F.col("metrics")["cited_by"].alias("cited_by"), F.unix_seconds("published").alias("published"))


@query
def map_crossref(s, d):
    rows = candidates(s, d)
    payload = rows.select("cand_id", F.struct(
        F.array("title").alias("title"), F.col("doi").alias("DOI"), F.col("url").alias("URL"),
        F.transform(F.coalesce("authors", F.array().cast("array<string>")), lambda a: F.struct(F.substring_index(a, " ", 1).alias("given"), F.substring_index(a, " ", -1).alias("family"))).alias("author"),
        F.struct(values.iso_utc("fetched_at").alias("date-time")).alias("created"), F.array("venue").alias("container-title"), F.lit("article").alias("type"),
    ).alias("x"))
    read = payload.select("cand_id", F.from_json(F.to_json("x"), schemas.CROSSREF_PAGE["message"].dataType["items"].dataType.elementType).alias("x")).select("cand_id", "x.*")
    return mappers.crossref(read, "cand_id").select("cand_id", "identifier", "title", "venue", F.unix_micros("published").alias("published"), F.col("metrics")["is-referenced-by"].alias("cited"))


@query
def map_biorxiv(s, d):
    rows = candidates(s, d)
    payload = rows.select("cand_id", F.struct("title", "doi", "abstract", F.array_join("authors", "; ").alias("authors"), F.date_format(F.col("published").cast("timestamp"), "yyyy-MM-dd").alias("date"), F.lit("biology").alias("category")).alias("x"))
    read = payload.select("cand_id", F.from_json(F.to_json("x"), schemas.BIORXIV_PAGE["collection"].dataType.elementType).alias("x")).select("cand_id", "x.*")
    return mappers.biorxiv(read, "cand_id").select("cand_id", "identifier", "title", "url", "venue", F.unix_seconds("published").alias("published"))


@query
def map_library_item(s, d):
    rows = table(s, d, "items")
    payload = rows.select("item_id", F.struct(
        F.col("item_key").alias("key"), F.col("item_version").alias("version"),
        F.struct(F.col("title"), F.col("abstract").alias("abstractNote"), F.transform("tags", lambda t: F.struct(t.alias("tag"))).alias("tags"), "collections", F.col("date_text").alias("date"), F.col("doi").alias("DOI"), "url").alias("data"),
    ).alias("x"))
    read = payload.select("item_id", F.from_json(F.to_json("x"), schemas.LIBRARY_PAGE).alias("x")).select("item_id", "x.*")
    return mappers.library_item(read, "item_id").select("item_id", "key", "version", "title", F.size("tags").cast("long").alias("n_tags"), F.col("year").cast("long").alias("year"), "doi", "url")


# ---- sources and sets ----


@query
def source_union(s, d):
    a = candidates(s, d, "cand_id", "source", "identifier", "title").withColumnRenamed("cand_id", "_at")
    b = table(s, d, "feed_works", "feed_id", "source", "identifier", "title").withColumnRenamed("feed_id", "_at")
    return feeds.union([a, b]).select(F.col("ord.part").cast("long").alias("part"), F.col("ord.at").alias("at"), "source", "identifier", "title")


@query
def enabled_source_rows(s, d):
    wanted = SOURCES.enabled()
    return candidates(s, d, "source").withColumn("source", F.lower("source")).filter(F.col("source").isin(wanted)).groupBy("source").agg(F.count("*").alias("n"))


@query
def distinct_venues_in_order(s, d):
    return profile.distinct_in_order(candidates(s, d, "cand_id", "venue"), "venue", "cand_id")


@query
def journal_last_wins(s, d):
    return rank.journal_metrics(table(s, d, "venues"), "venue_id")


# ---- joins ----


@query
def anti_library_doi(s, d):
    return dd.not_in_library_by_doi(candidates(s, d, "cand_id", "doi"), table(s, d, "items", "doi")).select("cand_id")


@query
def anti_library_url(s, d):
    return dd.not_in_library_by_url(candidates(s, d, "cand_id", "identifier"), table(s, d, "items", "url")).select("cand_id")


@query
def anti_library_title(s, d):
    return dd.not_in_library_by_title(candidates(s, d, "cand_id", "title"), table(s, d, "items", "title")).select("cand_id")


@query
def batch_first_wins_key(s, d):
    told = candidates(s, d, "cand_id", "identifier").withColumn("key", text.normalize_identifier("identifier"))
    return dd.first_of_key(told, "key", "cand_id").select("cand_id", "key")


@query
def greedy_dedupe(s, d):
    return dd.dedupe(candidates(s, d, "cand_id", "identifier", "doi", "title"), library(s, d), "cand_id").select("cand_id")


@query
def top1_similarity(s, d):
    items = table(s, d, "items", "embedding").filter(F.size("embedding") == DIM)
    items = items.filter(F.exists("embedding", lambda x: x != 0)).select(vectors.unit("embedding").alias("v"))
    return vectors.nearest_similarity(table(s, d, "embeddings", "vec_id", "embedding"), items, "vec_id", "embedding", "v", DIM).select("vec_id", F.round("similarity", 5).alias("similarity"))


@query
def journal_quality(s, d):
    told = rank.with_journal_quality(candidates(s, d, "cand_id", "venue"), rank.journal_metrics(table(s, d, "venues"), "venue_id"))
    return told.select("cand_id", F.round("journal_quality", 9).alias("journal_quality"), "journal_sjr")


@query
def whitelist_bonus(s, d):
    return candidates(s, d, "cand_id", "authors", "venue").select("cand_id", rank.listed(F.col("authors"), SCORING.whitelist_authors).alias("author_bonus"), rank.listed(F.array("venue"), SCORING.whitelist_venues).alias("venue_bonus"))


@query
def delete_tombstones(s, d):
    return lib.remove(table(s, d, "items", "item_id", "item_key"), table(s, d, "tombstones", "item_key"), "item_key")


# ---- aggregates ----


@query
def top_authors(s, d):
    return profile.top_authors(table(s, d, "items", "item_id", "creators"), "item_id")


@query
def top_venues(s, d):
    return profile.top_venues(table(s, d, "items", "item_id", "publication_title"), "item_id", "publication_title")


@query
def centroid(s, d):
    one = profile.centroid(table(s, d, "items", "embedding"), dim=DIM)
    return one.select(F.posexplode("centroid").alias("place", "value")).select(F.col("place").cast("long").alias("place"), F.round("value", 6).alias("value"))


@query
def profile_summary(s, d):
    one = profile.profile(table(s, d, "items"), "item_id", "publication_title", "given", as_of(), dim=DIM)
    return one.select("generated_at", "item_count", "model", F.size("centroid").cast("long").alias("dim"), F.get("top_authors", F.lit(0))["author"].alias("author"), F.get("top_venues", F.lit(0))["venue"].alias("venue"))


@query
def high_water_mark(s, d):
    return lib.high_water_mark(table(s, d, "items", "item_version"), "item_version")


@query
def ingest_stats(s, d):
    return lib.ingest_stats(table(s, d, "items", "item_key"), table(s, d, "tombstones", "item_key"), "item_key")


# ---- scores ----


@query
def recency_score(s, d):
    return candidates(s, d, "cand_id", "published").select("cand_id", rank.recency("published", as_of(), SCORING.decay_days).alias("recency_score"))


@query
def citation_score(s, d):
    told = candidates(s, d, "cand_id", "metrics").select("cand_id", rank.citations().alias("c"), rank.altmetric().alias("a"))
    return told.select("cand_id", *(F.when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), "inf").otherwise(F.format_string("%.6f", x)).alias(n) for x, n in ((F.col("c"), "citation_score"), (F.col("a"), "altmetric_score"))))


def _scored(s, d):
    works = candidates(s, d)
    similarity = works.select("cand_id", F.pmod("cand_id", F.lit(101)).cast("double").alias("n")).select("cand_id", (F.col("n") / 101).alias("similarity"))
    return rank.score_works(works, similarity, "cand_id", rank.journal_metrics(table(s, d, "venues"), "venue_id"), SCORING, as_of())


@query
def score_label(s, d):
    safe = F.when(F.isnan("score"), "nan").when(F.col("score") == float("inf"), "inf").otherwise(F.format_string("%.6f", "score"))
    return _scored(s, d).select("cand_id", safe.alias("score"), "label")


# ---- policy and order ----


@query
def recent_filter(s, d):
    return policy.recent(candidates(s, d, "cand_id", "published"), as_of(), 90).select("cand_id")


@query
def preprint_quota(s, d):
    return policy.preprint_quota(candidates(s, d, "cand_id", "source"), [F.col("cand_id").asc()]).select("cand_id")


@query
def stable_topk(s, d):
    orders = table(s, d, "orders", "o_orderkey", "o_orderpriority").withColumn("score", F.substring("o_orderpriority", 1, 1).cast("double"))
    return policy.top(orders, rank.by_score("o_orderkey"), 50).select("o_orderkey", "score")


# ---- library state ----


@query
def upsert_latest(s, d):
    items = table(s, d, "items", "item_id", "item_key", "item_version", "title")
    return lib.upsert(items.filter("false"), items, "item_key", ["item_id"])


@query
def upsert_keeps(s, d):
    """The first delivery of each key is the library, the later ones are synced: updates keep the vector, and what isn't synced stays."""
    items = table(s, d, "items", "item_id", "item_key", "item_version", "title", "embedding")
    first = items.groupBy("item_key").agg(F.min("item_id").alias("item_id"))
    old, new = items.join(first, ["item_key", "item_id"], "left_semi"), items.join(first, ["item_key", "item_id"], "left_anti")
    told = lib.upsert(old.select(items.columns), new.select(items.columns), "item_key", ["item_id"], keep=("embedding",))
    return told.select("item_id", "item_key", "item_version", "title", F.size("embedding").cast("long").alias("dim"))


@query
def set_vectors(s, d):
    """Vectors that another delivery of a key has go to deliveries without one."""
    items = table(s, d, "items", "item_id", "item_key", "embedding")
    held = lib.latest(items.filter(F.size("embedding") == DIM), "item_key", "item_id").select("item_key", "embedding")
    told = lib.with_vectors(items.filter("embedding is null"), held, "item_key")
    return told.select("item_id", F.size("embedding").cast("long").alias("dim"))


@query
def items_without_vector(s, d):
    return lib.without_vector(table(s, d, "items", "item_id", "updated_at", "embedding")).select("item_id")


@query
def items_with_vector(s, d):
    return lib.vectors(table(s, d, "items", "item_id", "embedding"), "item_id").select("item_id", F.size("embedding").cast("long").alias("dim"))


@query
def changed_items(s, d):
    """Of each delivery, whether its content is new against the first delivery of its key."""
    items = table(s, d, "items", "item_id", "item_key", "title", "abstract", "creators", "tags").withColumn("content_hash", text.item_hash())
    first = items.groupBy("item_key").agg(F.min_by("content_hash", "item_id").alias("content_hash"))
    return lib.changed(items, first, "item_key").select("item_id")


# ---- sinks ----


@query
def rss_fields(s, d):
    return sinks.rss_fields(candidates(s, d, "title", "url", "identifier", "published", "venue", "abstract"), as_of())


@query
def html_fields(s, d):
    told = _scored(s, d).filter("score is not null and not isnan(score)").withColumn("similarity", F.lit(0.5))
    return sinks.html_fields(told).select("href", "title", "label", "date_text", "venue_text", "abstract_text", "authors_text")


@query
def push_notes(s, d):
    told = candidates(s, d, "cand_id").withColumns({"score": F.pmod("cand_id", F.lit(7)) / 8, "label": F.lit("consider")})
    return sinks.notes(told)


# ---- pipelines ----


@query
def watch_flagship(s, d):
    works, items = candidates(s, d), library(s, d)
    held, _ = pipeline.build_profile(items.select("item_id", "title", "abstract", "creators", "tags", "publication_title"), "item_id", "publication_title", as_of())
    similarity = pipeline.similarity_of(works, held, "cand_id", vectors.HASHED_SIZE)
    ranked = pipeline.watch(works, items, similarity, "cand_id", table(s, d, "venues"), "venue_id", SCORING, as_of(), days=400, n=50)
    safe = F.when(F.isnan("score"), "nan").when(F.col("score") == float("inf"), "inf").otherwise(F.format_string("%.4f", "score"))
    return ranked.select("cand_id", "source", "title", safe.alias("score"), "label")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLE.items() if k in _queries}
