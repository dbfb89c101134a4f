"""Paged HTTP sources as Spark data sources, with the retry rules of polite clients.

A page's address comes from the page before it, so a source is one partition; what is
landed is plain JSON text that the readers of :mod:`folioscan.sources.feeds` map.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: How requests are repeated.
ATTEMPTS, WAIT_SECONDS = 3, 1.5
RETRIED = frozenset([408, 425, 429, 500, 502, 503, 504])
#: Fixed value: seconds that the Atom feed's operator asks clients to leave between requests.
ATOM_DELAY = 3.1


class Response:
    def __init__(self, status: int, headers: dict[str, str], body: str):
        self.status, self.headers, self.body = status, {k.lower(): v for k, v in headers.items()}, body


def open_url(url: str, headers: dict[str, str], timeout: float = 30) -> Response:
    request = urllib.request.Request(url, headers=headers)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return Response(r.status, dict(r.headers), r.read().decode("utf-8"))
    except urllib.error.HTTPError as e:
        return Response(e.code, dict(e.headers or {}), e.read().decode("utf-8", "replace"))


def get(url: str, headers: dict[str, str] | None = None, opened: Callable[..., Response] = open_url, sleep: Callable[[float], None] = time.sleep) -> Response:
    """A response below 400; connection errors and busy servers are tried again, a longer wait each time."""
    for attempt in range(1, ATTEMPTS + 1):
        last = attempt == ATTEMPTS
        try:
            r = opened(url, headers or {})
        except (TimeoutError, ConnectionError, urllib.error.URLError):
            if last:
                raise
        else:
            if r.status < 400:
                return r
            if last or r.status not in RETRIED:
                raise ConnectionError(f"{url}: status {r.status}")
        sleep(WAIT_SECONDS * attempt)
    raise AssertionError


def next_link(header: str | None) -> str | None:
    """The address of the part of a Link header that says rel="next"."""
    for part in (header or "").split(","):
        if 'rel="next"' in part and (m := re.search(r"<([^>]*)>", part)):
            return m[1]
    return None


def library_pages(base: str, since: int | None, page_size: int, headers: dict[str, str], delay: float, fetch=get) -> Iterator[Response]:
    """Pages of the library, oldest first, along the Link headers; nothing if it hasn't changed."""
    query = {"limit": page_size, "sort": "dateAdded", "direction": "asc"} | ({"since": since} if since else {})
    url: str | None = f"{base}/items?{urllib.parse.urlencode(query)}"
    first = dict(headers) | ({"If-Modified-Since-Version": str(since)} if since else {})
    while url:
        r = fetch(url, first)
        if r.status == 304:
            return
        yield r
        url, first = next_link(r.headers.get("link")), headers
        if url:
            time.sleep(delay)


def offset_pages(base: str, query: dict[str, object], page_size: int, headers: dict[str, str], fetch=get) -> Iterator[dict]:
    """Pages by offset, until there is no next one, it doesn't move, or a page is empty."""
    offset = 0
    while True:
        page = json.loads(fetch(f"{base}?{urllib.parse.urlencode(query | {'limit': page_size, 'offset': offset})}", headers).body)
        if not page.get("data"):
            return
        yield page
        after = (page.get("paging") or {}).get("next_offset")
        if after is None or after == offset:
            return
        offset = after


def queries_of(source: str, since: str, until: str, mailto: str = "", categories: list[str] | None = None, venue: str | None = None) -> str:
    """The address that a public feed is asked at."""
    if source == "openalex":
        return "https://api.openalex.org/works?" + urllib.parse.urlencode({"filter": f"from_publication_date:{since}", "sort": "publication_date:desc", "per-page": 200, "mailto": mailto})
    if source == "crossref":
        only = f",container-title:{venue}" if venue else ""
        return "https://api.crossref.org/works?" + urllib.parse.urlencode({"filter": f"from-pub-date:{since}{only}", "sort": "created", "order": "desc", "rows": 100 if venue else 200, "mailto": mailto})
    if source == "arxiv":
        asked = " OR ".join(f"cat:{c}" for c in categories or [])
        return "https://export.arxiv.org/api/query?" + urllib.parse.urlencode({"search_query": asked, "sortBy": "submittedDate", "sortOrder": "descending", "max_results": 50})
    if source in ("biorxiv", "medrxiv"):
        return f"https://api.biorxiv.org/details/{source}/{since}/{until}"
    raise ValueError(f"no feed {source!r}")


def deleted_keys(base: str, since: int | None, headers: dict[str, str], fetch=get) -> list[str]:
    """Keys of items deleted since a version of the library; none if it was never read."""
    if since is None:
        return []
    return (json.loads(fetch(f"{base}/deleted?since={since}", headers).body or "{}") or {}).get("items", [])


def collection_key(base: str, name: str, headers: dict[str, str], fetch=get, post: Callable[[str, dict[str, str], object], dict] | None = None) -> str:
    """The key of the library's collection of a name, which is made if there is none."""
    for c in json.loads(fetch(f"{base}/collections", headers).body):
        if c.get("data", {}).get("name") == name:
            return c["data"]["key"]
    made = (post or send_json)(f"{base}/collections", headers, [{"name": name}])
    return made["successful"]["0"]["key"]


def send_json(url: str, headers: dict[str, str], body: object) -> dict:
    request = urllib.request.Request(url, data=json.dumps(body).encode(), headers=headers | {"Content-Type": "application/json"}, method="POST")
    with urllib.request.urlopen(request, timeout=30) as r:
        return json.loads(r.read().decode("utf-8") or "{}")


class PagesSource(DataSource):
    """``spark.read.format("feed_pages").option("url", ...)``: (page int, body string).

    Options: ``url``; ``kind``: single (default), links or offsets; ``page_size``; ``delay``; ``since``;
    ``headers`` and ``query``: JSON objects.
    """

    @classmethod
    def name(cls) -> str:
        return "feed_pages"

    def schema(self) -> str:
        return "page int, body string"

    def reader(self, schema) -> DataSourceReader:
        return PagesReader(dict(self.options))


class PagesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition) -> Iterator[tuple[int, str]]:
        o, size = self.options, int(self.options.get("page_size", 100))
        headers, query, kind = json.loads(o.get("headers", "{}")), json.loads(o.get("query", "{}")), o.get("kind", "single")
        if kind == "links":
            since = int(o["since"]) if o.get("since") else None
            for i, r in enumerate(library_pages(o["url"], since, size, headers, float(o.get("delay", 0.2)))):
                yield i, r.body
        elif kind == "offsets":
            for i, page in enumerate(offset_pages(o["url"], query, size, headers)):
                yield i, json.dumps(page)
        else:
            time.sleep(float(o.get("delay", 0)))
            r = get(o["url"], headers)
            if "rate exceeded" in r.body.lower():
                raise ConnectionError("the feed's rate limit is exceeded")
            yield 0, r.body
