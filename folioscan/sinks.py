"""Where ranked works go: RSS, HTML, notes for the library's API, profile and cache files.

Ranked lists are cut to a top N before they come here; rows stream to the driver one
partition at a time.
"""

from __future__ import annotations

import html
import json
from collections.abc import Callable, Iterable
from datetime import UTC, datetime
from pathlib import Path
from xml.etree import ElementTree as ET

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .functions.values import iso_utc, rfc822

#: Tag and collection of pushed notes.
NOTE_TAG, COLLECTION = "Literature watch", "AI Suggested"


def rss_fields(works: DataFrame, as_of: Column) -> DataFrame:
    """One row per feed entry, in the order of ``works``: title, link, guid, pub_date, category, description."""
    described = F.concat_ws(
        "\n", F.nullif(F.col("abstract"), F.lit("")), F.concat(F.lit("Published: "), F.coalesce(iso_utc("published"), F.lit("Unknown"))),
        F.concat(F.lit("Venue: "), F.coalesce(F.nullif(F.col("venue"), F.lit("")), F.lit("Unknown"))),
    )
    return works.select(
        "title", F.nullif(F.col("url"), F.lit("")).alias("link"), F.col("identifier").alias("guid"), rfc822("published", as_of).alias("pub_date"),
        F.nullif(F.col("venue"), F.lit("")).alias("category"), described.alias("description"),
    )


def write_rss(works: DataFrame, path: str | Path, as_of: datetime, title: str = "Literature watch", link: str = "https://example.com", description: str = "Recommended works") -> Path:
    """An RSS 2.0 file; an empty list gives a feed without entries."""
    root = ET.Element("rss", version="2.0")
    channel = ET.SubElement(root, "channel")
    stamp = as_of.astimezone(UTC).strftime("%a, %d %b %Y %H:%M:%S +0000")
    for tag, text in (("title", title), ("link", link), ("description", description), ("lastBuildDate", stamp)):
        ET.SubElement(channel, tag).text = text
    for row in rss_fields(works, F.lit(as_of)).toLocalIterator():
        entry = ET.SubElement(channel, "item")
        for tag, field in (("title", "title"), ("link", "link"), ("guid", "guid"), ("pubDate", "pub_date"), ("category", "category"), ("description", "description")):
            if row[field] is not None:
                ET.SubElement(entry, tag).text = row[field]
    out = Path(path)
    out.parent.mkdir(parents=True, exist_ok=True)
    ET.ElementTree(root).write(out, encoding="utf-8", xml_declaration=True)
    return out


def html_fields(works: DataFrame) -> DataFrame:
    """What an article of the report shows, as text."""
    unknown = F.lit("Unknown")
    return works.select(
        F.coalesce(F.nullif(F.col("url"), F.lit("")), F.lit("#")).alias("href"), "title", "label", F.format_string("%.3f", "score").alias("score_text"),
        F.format_string("%.3f", "similarity").alias("similarity_text"), F.coalesce(F.date_format(F.col("published").cast("timestamp"), "yyyy-MM-dd"), unknown).alias("date_text"),
        F.coalesce(F.nullif(F.col("venue"), F.lit("")), unknown).alias("venue_text"), F.nullif(F.col("abstract"), F.lit("")).alias("abstract_text"),
        F.when(F.size("authors") > 0, F.array_join("authors", ", ")).otherwise(unknown).alias("authors_text"),
    )


def write_html(works: DataFrame, path: str | Path, as_of: datetime, title: str = "Recommended works") -> Path:
    """A report page; all text is escaped."""
    e = html.escape
    blocks = []
    for i, r in enumerate(html_fields(works).toLocalIterator(), 1):
        facts = (("Label", r.label), ("Score", r.score_text), ("Similarity", r.similarity_text), ("Published", r.date_text), ("Venue", r.venue_text))
        abstract = f"<p>{e(r.abstract_text)}</p>" if r.abstract_text else ""
        blocks.append(
            f'<section><h2>{i}. <a href="{e(r.href)}">{e(r.title)}</a></h2><ul>' + "".join(f"<li>{k}: {e(str(v))}</li>" for k, v in facts)
            + f"</ul>{abstract}<p>Authors: {e(r.authors_text)}</p></section>"
        )
    page = f'<!DOCTYPE html>\n<html lang="en"><head><meta charset="utf-8"><title>{e(title)}</title></head><body><h1>{e(title)}</h1><p>{e(as_of.isoformat())}</p>\n' + "\n".join(blocks) + "\n</body></html>\n"
    out = Path(path)
    out.parent.mkdir(parents=True, exist_ok=True)
    out.write_text(page, encoding="utf-8")
    return out


def report_name(works: DataFrame) -> str:
    """``report-YYYYMMDD.html`` by the first work's date; ``report-empty.html`` without works."""
    first = works.select("published").head(1)
    if not first:
        return "report-empty.html"
    return f"report-{first[0][0]:%Y%m%d}.html" if first[0][0] else "report.html"


def notes(works: DataFrame, collection: str = COLLECTION, template: Callable[[Row], str] | None = None) -> DataFrame:
    """(``note``): one JSON note per work. A template is a function of the row, else the score is told."""
    text = F.concat(F.lit("Recommended due to score "), F.format_string("%.3f", "score"))
    if template:
        text = F.udf(template)(F.struct(*works.columns))
    tags = F.array(F.struct(F.lit(NOTE_TAG).alias("tag")), F.struct(F.col("label").alias("tag")))
    return works.select(F.to_json(F.struct(F.lit("note").alias("itemType"), text.alias("note"), tags.alias("tags"), F.array(F.lit(collection)).alias("collections"))).alias("note"))


def push(works: DataFrame, send: Callable[[list[dict]], None], collection: str = COLLECTION, batch: int = 50) -> int:
    """Notes in batches to ``send`` (the API takes so many at once); how many there were. Nothing is sent for no works."""
    held, total = [], 0
    for row in notes(works, collection).toLocalIterator():
        held.append(json.loads(row.note))
        total += 1
        if len(held) == batch:
            send(held)
            held = []
    if held:
        send(held)
    return total


def write_profile(profile: DataFrame, path: str | Path) -> Path:
    """The one-row profile as JSON with sorted keys."""
    row = profile.first().asDict(recursive=True)
    out = Path(path)
    out.parent.mkdir(parents=True, exist_ok=True)
    out.write_text(json.dumps(row, ensure_ascii=False, sort_keys=True, indent=2), encoding="utf-8")
    return out


def log_lines(works: DataFrame, n: int = 10) -> Iterable[str]:
    """The first ``n`` works in a line each."""
    for i, r in enumerate(works.select("score", "label", "title").head(n), 1):
        yield f"{i}. {r.score:.3f} {r.label} {r.title}"
