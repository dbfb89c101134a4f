"""Landed payloads through the mappers, the journal list, and the streaming ingest."""

import json
from datetime import UTC, datetime

from pyspark.sql import functions as F

from folioscan import schemas
from folioscan.operators.library import Store
from folioscan.sources import feeds, mappers
from folioscan.streaming.ingest import ingest_library


def land(path, name, payload):
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_text(payload if isinstance(payload, str) else json.dumps(payload), encoding="utf-8")
    return str(path)


def test_public(spark, tmp_path):
    page = {"data": [{"id": "1", "title": " T ", "source": "", "authors": [" a ", ""], "metrics": {"x": "1.5", "y": "no", "z": True}, "published_at": "2024-05-01"}, {"title": "  "}], "paging": {}}
    row = feeds.landed_public(spark, land(tmp_path / "p", "1.json", page)).collect()
    assert len(row) == 1
    r = row[0]
    assert (r.source, r.identifier, r.title, r.authors, r.metrics) == ("public-api", "1", "T", ["a"], {"x": 1.5})


def test_openalex(spark, tmp_path):
    page = {"results": [{"id": "", "ids": {"openalex": "W"}, "display_name": "T", "abstract_inverted_index": {"b": [1], "a": [0]}, "authorships": [{"author": {"display_name": "X"}}, {"author": {}}], "primary_location": {"landing_page_url": "l", "source": {"display_name": "V", "url": ""}}}]}
    r = feeds.landed_openalex(spark, land(tmp_path / "o", "1.json", page)).first()
    assert (r.identifier, r.abstract, r.authors, r.url, r.venue, r.metrics) == ("W", "a b", ["X", ""], "l", "V", {"cited_by": 0.0})


def test_crossref(spark, tmp_path):
    page = {"message": {"items": [{"title": ["T"], "DOI": "d", "author": [{"given": "A", "family": "B"}, {"family": " "}], "abstract": "<p>x &amp; y</p>", "created": {"date-time": "2024-05-01T00:00:00Z"}, "container-title": [], "is-referenced-by-count": 3}, {"title": []}]}}
    path = land(tmp_path / "c", "1.json", page)
    r = feeds.landed_crossref(spark, path).collect()
    assert len(r) == 1 and (r[0].identifier, r[0].authors, r[0].abstract, r[0].venue, r[0].metrics) == ("d", ["A B"], "x & y", None, {"is-referenced-by": 3.0})
    assert feeds.landed_crossref(spark, path, F.lit("Q")).first().venue == "Q"


def test_biorxiv(spark, tmp_path):
    page = {"collection": [{"title": "T", "doi": "10.1/x", "authors": "A; ;B ", "date": "2024-05-01"}]}
    r = feeds.landed_biorxiv(spark, land(tmp_path / "b", "1.json", page), "medrxiv").first()
    assert (r.source, r.url, r.authors, r.venue) == ("medrxiv", "https://doi.org/10.1/x", ["A", "B"], "medrxiv")


def test_arxiv(spark, tmp_path):
    atom = '<feed xmlns:arxiv="a"><entry><id>i</id><title> T </title><summary> s </summary><published>2024-05-01T00:00:00Z</published><author><name>N</name></author><arxiv:doi>d</arxiv:doi><link href="h" rel="alternate"/><arxiv:primary_category term="cs.LG"/></entry></feed>'
    r = feeds.landed_arxiv(spark, land(tmp_path / "a", "1.xml", atom)).first()
    assert (r.identifier, r.title, r.abstract, r.authors, r.url, r.venue) == ("i", "T", "s", ["N"], "h", "arXiv")


def test_library_item(spark):
    raw = {"key": "K", "version": 3, "data": {"title": None, "creators": [{"firstName": "A", "lastName": "B"}, {"lastName": ""}], "tags": [{"tag": "t"}, {"tag": None}], "date": "05-2024"}}
    df = spark.createDataFrame([(json.dumps(raw),)], "j string").select(F.from_json("j", schemas.LIBRARY_PAGE).alias("x")).select("x.*")
    r = mappers.library_item(df).first()
    assert (r.key, r.version, r.title, r.creators, r.tags, r.year) == ("K", 3, "", ["A B"], ["t"], 5)


def test_journals_and_venues(spark, tmp_path):
    path = land(tmp_path / "j", "m.csv", "title,sjr\nA,1\n")
    assert [(r.title, r.sjr) for r in feeds.journals_csv(spark, path).collect()] == [("A", "1")]
    assert feeds.journals_csv(spark, str(tmp_path / "none")).count() == 0
    prof = spark.createDataFrame([([("V", 2), ("", 1), ("W", 1), ("V", 1)],)], "top_venues array<struct<venue:string,count:long>>")
    assert [r.venue for r in feeds.top_venue_names(prof).collect()] == ["V", "W"]


def test_cache(spark, tmp_path):
    works = spark.createDataFrame([("s", "i", "t", None, ["a"], None, None, None, "v", {"m": 1.0}, "{}")], "source string, identifier string, title string, abstract string, authors array<string>, doi string, url string, published timestamp, venue string, metrics map<string,double>, extra string")
    at = datetime(2024, 3, 1, 12, tzinfo=UTC)
    assert feeds.write_cache(works, str(tmp_path / "cache"), at)
    fetched, again = feeds.read_cache(spark, str(tmp_path / "cache"))
    assert fetched == at and again.first().asDict() == works.first().asDict()
    assert feeds.read_cache(spark, str(tmp_path / "none")) is None
    (tmp_path / "file").write_text("x")
    assert not feeds.write_cache(works, str(tmp_path / "file"), at)


def test_streaming_ingest(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    landed = land(tmp_path / "landed", "1.json", [{"key": "A", "version": 1, "data": {"title": "one"}}, {"key": "B", "version": 4, "data": {"title": "two"}}])
    ingest_library(spark, landed, store, str(tmp_path / "cp"))
    land(tmp_path / "landed", "2.json", [{"key": "A", "version": 2, "data": {"title": "new"}}])
    ingest_library(spark, landed, store, str(tmp_path / "cp"))
    assert {r.key: r.title for r in store.items().collect()} == {"A": "new", "B": "two"}
    land(tmp_path / "landed", "3.json", [{"key": "C", "version": 5, "data": {"title": "three"}}])
    ingest_library(spark, landed, store, str(tmp_path / "cp"), feeds.tombstones(spark, land(tmp_path / "gone", "d.json", {"items": ["B", "unknown"]})))
    assert {r.key: r.title for r in store.items().collect()} == {"A": "new", "C": "three"}
