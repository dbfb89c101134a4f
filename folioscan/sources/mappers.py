"""Payload rows of each feed to the one candidate schema, and library payloads to items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_abstract, clean_title, full, item_hash, openalex_abstract, strip, year_of
from ..functions.values import numeric_only, parse_date



def _names(people: Column, *parts: str) -> Column:
    """Non-empty parts of each person's name joined by a space, blank names dropped."""
    whole = F.transform(people, lambda p: strip(F.concat_ws(" ", *(full(p[x]) for x in parts))))
    return F.filter(F.coalesce(whole, F.array().cast("array<string>")), lambda n: n != "")


def _metric(key: str, value: Column) -> Column:
    return F.create_map(F.lit(key), F.coalesce(value, F.lit(0.0)).cast("double"))


def _out(df: DataFrame, keep: tuple[str, ...], **fields: Column) -> DataFrame:
    """Candidate columns; rows with a blank title are left out."""
    fields["title"] = clean_title(fields["title"])
    order = ("source", "identifier", "title", "abstract", "authors", "doi", "url", "published", "venue", "metrics", "extra")
    return df.select(*keep, *(fields[n].alias(n) for n in order)).filter("title <> ''")


def public_api(df: DataFrame, *keep: str) -> DataFrame:
    """Rows of the public candidates API."""
    title = clean_title("title")
    authors = F.filter(F.transform(F.coalesce("authors", F.array().cast("array<string>")), lambda a: strip(a)), lambda a: a != "")
    extra = F.to_json(F.struct("candidate_group", "candidate_type", F.col("id").alias("public_id"), "updated_at"))
    return _out(
        df, keep, source=F.coalesce(full("source"), F.lit("public-api")), identifier=F.coalesce(full("source_identifier"), full("id"), title), title=title,
        abstract=F.col("abstract"), authors=authors, doi=F.col("doi"), url=F.col("url"), published=parse_date("published_at"), venue=F.col("venue"),
        metrics=F.coalesce(numeric_only("metrics"), F.create_map().cast("map<string,double>")), extra=extra,
    )


def openalex(df: DataFrame, *keep: str) -> DataFrame:
    place = F.col("primary_location")
    return _out(
        df, keep, source=F.lit("openalex"), identifier=F.coalesce(full("id"), full("ids.openalex"), full("doi"), clean_title("display_name")), title=F.col("display_name"),
        abstract=openalex_abstract(F.col("abstract"), F.col("abstract_inverted_index")),
        authors=F.transform(F.coalesce("authorships", F.array().cast(df.schema["authorships"].dataType)), lambda a: F.coalesce(a["author"]["display_name"], F.lit(""))),
        doi=F.col("doi"), url=F.coalesce(full(place["source"]["url"]), place["landing_page_url"]), published=parse_date("publication_date"), venue=place["source"]["display_name"],
        metrics=_metric("cited_by", F.col("cited_by_count")), extra=F.to_json(F.struct(F.transform("concepts", lambda c: c["display_name"]).alias("concepts"))),
    )


def crossref(df: DataFrame, *keep: str, venue: Column | None = None) -> DataFrame:
    """``venue``: the queried venue, where the rows answer a query for one."""
    extra = F.struct("type") if venue is None else F.struct(F.lit("top_venue").alias("source"), "type")
    return _out(
        df, keep, source=F.lit("crossref"), identifier=F.coalesce(full("DOI"), F.col("URL"), F.lit("unknown")), title=F.get("title", F.lit(0)), abstract=clean_abstract("abstract"),
        authors=_names(F.col("author"), "given", "family"), doi=F.col("DOI"), url=F.col("URL"), published=parse_date(F.col("created")["date-time"]),
        venue=F.get(F.col("container-title"), F.lit(0)) if venue is None else venue, metrics=_metric("is-referenced-by", F.col("is-referenced-by-count")), extra=F.to_json(extra),
    )


def arxiv(df: DataFrame, *keep: str) -> DataFrame:
    """Atom entries as the XML source reads them."""
    link = F.coalesce(F.get(F.filter("link", lambda x: x["_rel"] == "alternate"), F.lit(0)), F.get("link", F.lit(0)))["_href"]
    return _out(
        df, keep, source=F.lit("arxiv"), identifier=F.coalesce(full("id"), clean_title("title")), title=F.col("title"), abstract=full(strip("summary")),
        authors=F.transform("author", lambda a: a["name"]), doi=F.col("arxiv:doi"), url=link, published=parse_date("published"), venue=F.lit("arXiv"),
        metrics=F.create_map().cast("map<string,double>"), extra=F.to_json(F.struct(F.col("arxiv:primary_category")["_term"].alias("primary_category"))),
    )


def biorxiv(df: DataFrame, *keep: str, base: str = "biorxiv") -> DataFrame:
    """``base``: biorxiv or medrxiv."""
    authors = F.filter(F.transform(F.split(F.coalesce("authors", F.lit("")), ";"), lambda a: strip(a)), lambda a: a != "")
    resolved = F.when(F.col("doi") != "", F.concat(F.lit("https://doi.org/"), "doi"))
    return _out(
        df, keep, source=F.lit(base), identifier=F.coalesce(full("doi"), full("biorxiv_id"), clean_title("title")), title=F.col("title"), abstract=F.col("abstract"), authors=authors,
        doi=F.col("doi"), url=F.coalesce(full("rel_link"), full("url"), resolved), published=parse_date("date"), venue=F.lit(base),
        metrics=F.create_map().cast("map<string,double>"), extra=F.to_json(F.struct("category", "version")),
    )


def library_item(df: DataFrame, *keep: str) -> DataFrame:
    """Library payloads to items; ``raw`` is the payload. Null tags are dropped."""
    d = F.col("data")
    items = df.select(
        *keep, F.coalesce(full(d["key"]), "key").alias("key"), F.coalesce(F.nullif(d["version"], F.lit(0)), "version", F.lit(0)).cast("long").alias("version"),
        F.coalesce(d["title"], F.lit("")).alias("title"), d["abstractNote"].alias("abstract"), _names(d["creators"], "firstName", "lastName").alias("creators"),
        F.array_compact(F.transform(F.coalesce(d["tags"], F.array().cast("array<struct<tag:string>>")), lambda t: t["tag"])).alias("tags"),
        F.coalesce(d["collections"], F.array().cast("array<string>")).alias("collections"), year_of(d["date"]).alias("year"), d["DOI"].alias("doi"), d["url"].alias("url"),
        F.to_json(F.struct("key", "version", "data")).alias("raw"),
    )
    return items.withColumn("content_hash", item_hash())
