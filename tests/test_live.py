"""Requests against a local server, failure isolation, the cache's age, and the two commands end to end."""

import json
import threading
from datetime import UTC, datetime, timedelta
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from folioscan import cli, settings
from folioscan.sources import connectors, feeds, live

NOW = datetime(2024, 3, 1, tzinfo=UTC)
ATOM = '<feed xmlns:arxiv="a"><entry><id>i1</id><title> T one </title><published>2024-02-29T00:00:00Z</published><author><name>N</name></author></entry><entry><id>i2</id><title>Two</title></entry></feed>'


@pytest.fixture
def server():
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            url = urlparse(self.path)
            query = parse_qs(url.query)
            asked.append((url.path, query, self.headers.get("apikey")))
            body, code = {}, 200
            if url.path == "/openalex":
                body = {"results": [{"id": "W1", "display_name": "Soil carbon in moors", "abstract_inverted_index": {"b": [1], "a": [0]}, "publication_date": "2024-02-28", "cited_by_count": 2}]}
            elif url.path == "/crossref":
                body = {"message": {"items": [{"title": ["Peat in " + query.get("venue", ["all"])[0]], "DOI": "10.1/" + query.get("venue", ["x"])[0]}]}}
                code = 404 if query.get("venue") == ["Bad"] else 200
            elif url.path == "/biorxiv":
                code = 404
            elif url.path == "/arxiv":
                body = ATOM
            elif url.path == "/candidates":
                start = int(query["offset"][0])
                body = {"data": [{"id": str(start), "title": f"Public {start}", "published_at": "2024-02-28"}], "paging": {"next_offset": start + 1 if start < 2 else None}}
            elif url.path == "/lib/deleted":
                body = {"items": ["A", "B"]}
            elif url.path == "/lib/collections":
                body = [{"data": {"name": "Other", "key": "O"}}]
            told = (body if isinstance(body, str) else json.dumps(body)).encode()
            self.send_response(code)
            self.end_headers()
            self.wfile.write(told)

        def do_POST(self):
            asked.append((self.path, json.loads(self.rfile.read(int(self.headers["Content-Length"]))), None))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"successful": {"0": {"key": "NEW"}}}).encode())

        def log_message(self, *a):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", asked
    s.shutdown()


def conf(base, **on):
    public = settings.Feed(enabled=True, base_url=base if on.get("public") else "", publishable_key="secret")
    return settings.Settings(sources=settings.Sources(public_api=public, feeds={n: settings.Feed(enabled=on.get(n, False)) for n in settings.FEEDS}))


def address(base):
    return lambda source, since, until, mailto="", categories=None, venue=None: f"{base}/{source}" + (f"?venue={venue}" if venue else "")


def test_feeds_answer_and_fail_for_themselves(spark, server):
    base, asked = server
    got = live.fetchers(spark, conf(base, public=True, openalex=True, arxiv=True, biorxiv=True), NOW, address(base))
    works, keep = feeds.fetch_all(got, None, None, NOW)
    assert keep
    rows = {(r.ord.part, r.title) for r in works.collect()}
    assert rows == {(0, "Public 0"), (0, "Public 1"), (0, "Public 2"), (1, "Soil carbon in moors"), (2, "T one"), (2, "Two")}
    assert works.filter("title like 'Soil%'").first().abstract == "a b"
    assert {a[2] for a in asked if a[0] == "/candidates"} == {"secret"}
    assert all(a[1]["include_preprints"] == ["true"] and a[1]["published_to"] == ["2024-03-01"] for a in asked if a[0] == "/candidates")
    assert sum(a[0] == "/openalex" for a in asked) == 1  # asked once, though read twice
    assert feeds.fetch_all(live.fetchers(spark, conf(base, biorxiv=True), NOW, address(base)), None, None, NOW) == (None, False)


def test_top_venues(spark, server):
    base, _ = server
    works = live.top_venue_works(spark, ["A", "Bad", "B"], "2024-02-01", "2024-03-01", "", address(base))
    assert {(r.title, r.venue) for r in works.collect()} == {("Peat in A", "A"), ("Peat in B", "B")}
    assert live.top_venue_works(spark, ["Bad"], "", "", "", address(base)) is None


def test_library_requests(server):
    base, asked = server
    assert connectors.deleted_keys(f"{base}/lib", None, {}) == [] and connectors.deleted_keys(f"{base}/lib", 7, {}) == ["A", "B"]
    assert connectors.collection_key(f"{base}/lib", "Other", {}) == "O"
    assert connectors.collection_key(f"{base}/lib", "Mine", {}) == "NEW" and asked[-1][1] == [{"name": "Mine"}]


def test_profile_and_watch(spark, server, tmp_path):
    base, asked = server
    items = [("K1", "Soil carbon", "about moors", ["A. Smith"], ["t"], '{"data": {"publicationTitle": "V"}}', 1, "10.9/x", None), ("K2", "Peat fires", None, ["B. Jones"], [], "{}", 2, None, None)]
    spark.createDataFrame(items, "key string, title string, abstract string, creators array<string>, tags array<string>, raw string, ord long, doi string, url string").write.parquet(str(tmp_path / "lib"))
    out = str(tmp_path / "run")
    told = json.loads(cli.run_profile(spark, out, str(tmp_path / "lib"), NOW).read_text())
    assert told["item_count"] == 2 and told["top_venues"][0]["venue"] == "V" and len(told["centroid"]) == 256
    rss, page = cli.run_watch(spark, out, str(tmp_path / "lib"), conf(base, openalex=True, crossref=True), NOW, address=address(base))
    assert "Soil carbon in moors" not in rss.read_text() or rss.read_text().count("<item>") >= 1
    assert page.read_text().startswith("<!DOCTYPE html>")
    fetched, works = feeds.read_cache(spark, f"{out}/candidates")
    assert fetched == NOW and works.count() == 3
    # within twelve hours nothing is asked again
    before = len(asked)
    cli.run_watch(spark, out, str(tmp_path / "lib"), conf(base, openalex=True), NOW + timedelta(hours=11), address=address(base))
    assert len(asked) == before
    cli.run_watch(spark, out, str(tmp_path / "lib"), conf(base, openalex=True), NOW + timedelta(hours=13), address=address(base))
    assert len(asked) > before
