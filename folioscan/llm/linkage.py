"""Matching records of two sources that share no key (problem 3)."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut, drop
from . import links
from .cells import pairs_of_cells, title_cells, word_cells, word_counts
from .keys import plain_doi, plain_identifier
from .links import components, star
from .works import MATCH, WEAK, described, judged, of_ids

#: What a like neighbour adds to a weak pair, of the likeness it passes on.
PASSED_ON = 0.5
#: Change below which confidences are stable.
STABLE = 0.01
RECORD = ("id", "doi", "identifier", "title", "authors", "published", "venue")


def records(df: DataFrame, id_col: str, doi_col: str | None = None, identifier_col: str | None = None) -> DataFrame:
    """(id, doi, identifier, title, authors, published, venue) of a table; columns that it lacks are null."""
    void = F.lit(None).cast("string")
    doi = plain_doi(F.col(doi_col)) if doi_col and doi_col in df.columns else void
    identifier = plain_identifier(F.col(identifier_col)) if identifier_col and identifier_col in df.columns else void
    venue = F.col("venue") if "venue" in df.columns else void
    return df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), doi.alias("doi"), identifier.alias("identifier"), "title", "authors", F.to_date("published").alias("published"), venue.alias("venue"))


def said():
    """A hash of what a record says; null without a title."""
    return F.when(F.col("title").rlike(r"(?U)\S"), F.xxhash64("title", "authors", "published", "venue"))


def first_of_copies(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records that are the first to say what they say, (first, id, doi, identifier, ...) of the others); one without a title is no copy."""
    rows = rows.withColumn("print", said())
    first = rows.filter("print is not null").groupBy("print").agg(F.min("id").alias("first"), F.max("id").alias("_last")).filter("first < _last").drop("_last")
    kept = [c for c in rows.columns if c not in ("print", "title", "authors", "published", "venue")]
    copies = cut(rows.select("print", *kept).join(first, "print").filter("id <> first").select("first", *kept), "copies")
    return rows.drop("print").join(copies.select("id"), "id", "left_anti"), copies


def _lifted(edges: list[tuple]) -> Iterator[tuple]:
    """(a, b, confidence) of a bounded number of edges (a, b, own) after the rounds of :func:`refined`."""
    near: dict[int, dict[int, float]] = defaultdict(dict)
    for a, b, own in edges:
        near[a][b] = near[b][a] = max(own, near[a].get(b, 0.0))
    own = {(a, b): near[a][b] for a, b, _ in edges}
    weak = [e for e, c in own.items() if c < MATCH]
    moved = True
    while moved:
        new = {}
        for a, b in weak:
            rest = 1.0
            for c in near[a].keys() & near[b].keys():
                rest *= 1 - PASSED_ON * min(near[a][c], near[b][c])
            new[a, b] = 1 - (1 - own[a, b]) * rest
        moved = any(c - near[a][b] > STABLE for (a, b), c in new.items())
        for (a, b), c in new.items():
            near[a][b] = near[b][a] = c
    for a, b in own:
        yield a, b, near[a][b]


def refined(scored: DataFrame) -> DataFrame:
    """Edges (a, b, confidence) of MATCH and more, after confidences have spread until they are stable; ``scored`` is a written table, a < b.

    A pair too weak by itself is lifted by each neighbour c that both are like: its
    confidence becomes 1 - (1 - own) * product of (1 - PASSED_ON * min(of a and c, of c
    and b)).  All weak pairs are updated in a round; rounds end when none changes by
    more than STABLE, which must happen as confidences only rise and stay below 1.
    Up to ONE_TASK_EDGES edges take their rounds in one task.
    """
    if scored.count() <= links.ONE_TASK_EDGES:

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            edges = [e for p in parts for e in zip(*(c.to_pylist() for c in p.columns))]
            rows = [e for e in _lifted(edges) if e[2] >= MATCH]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "confidence"])

        return scored.select("a", "b", "confidence").repartition(1).mapInArrow(run, "a long, b long, confidence double")
    now = scored.select("a", "b", "confidence", F.col("confidence").alias("own"))
    weak = now.filter(f"own < {MATCH}").select("a", "b")
    ends = cut(weak.select(F.explode(F.array("a", "b")).alias("n")).distinct(), "ends")
    # only edges at a weak pair's ends matter, and no others change
    near = cut(now.join(ends.withColumnRenamed("n", "a"), "a", "left_semi").unionByName(now.join(ends.withColumnRenamed("n", "b"), "b", "left_semi")).distinct(), "near")
    moved = True
    while moved:
        both = near.select("a", "b", "confidence").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "confidence"))
        of_a = both.select("a", F.col("b").alias("c"), F.col("confidence").alias("p"))
        of_b = both.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("confidence").alias("q"))
        lifts = weak.join(of_a, "a").join(of_b, ["b", "c"]).groupBy("a", "b").agg(F.sum(F.log1p(-PASSED_ON * F.least("p", "q"))).alias("lift"))
        lifted = near.join(lifts, ["a", "b"], "left").withColumn("_new", F.when(F.col("own") < MATCH, 1 - (1 - F.col("own")) * F.exp(F.coalesce("lift", F.lit(0.0)))).otherwise(F.col("own")))
        lifted = cut(lifted.select("a", "b", "confidence", "own", "_new"), "lifted")
        moved = lifted.filter(F.col("_new") - F.col("confidence") > STABLE).limit(1).count()
        drop(near)
        near = lifted.select("a", "b", F.col("_new").alias("confidence"), "own")
    risen = near.filter(f"own < {MATCH} and confidence >= {MATCH}").select("a", "b", "confidence")
    return now.filter(f"own >= {MATCH}").select("a", "b", "confidence").unionByName(risen)


def same_works(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, root) of records (as by :func:`records`) and the least id of their work, each once; edges (a, b, confidence) behind it.

    Columns of ``rows`` beside those of a record stay with its id.
    """
    more = [c for c in rows.columns if c not in RECORD]
    single, copies = first_of_copies(rows)
    told = cut(described(single, "id", "doi", "identifier", *more), "described")
    counts = word_counts(told)
    several = told.groupBy("own_title").agg(F.count("*").alias("n")).filter("n > 1 and own_title is not null").select("own_title")
    again = cut(told.select("id", "own_title").join(several, "own_title", "left_semi").select("id"), "again")
    alike = cut(of_ids(told.select("id", "own_title", "stock", "families", "venue", "day", "fs"), again), "alike")
    # equal titles with an author in common need no judging, nor do equal DOIs and identifiers
    marks = told.select("id", "doi", "identifier", *more).unionByName(copies.select("id", "doi", "identifier", *more))
    keys = alike.filter("not stock").select("id", "own_title", F.explode("fs").alias("f")).select(F.xxhash64(F.lit("author"), "own_title", "f").alias("key"), "id")
    for c in ("doi", "identifier"):
        keys = keys.unionByName(marks.filter(f"{c} is not null").select(F.xxhash64(F.lit(c), c).alias("key"), "id"))
    sure = star(written := cut(keys, "keys"), "key")
    cells = word_cells(told, counts).unionByName(title_cells(alike))
    pairs = pairs_of_cells(cells, told, counts)
    drop(alike, again)
    scored = cut(judged(pairs, told, pairs.count()).filter(f"confidence >= {WEAK}"), "scored")
    edges = refined(scored).unionByName(sure.select("a", "b", F.lit(0.9).alias("confidence")))
    edges = cut(edges, "edges")
    drop(pairs, scored, written)
    joined = edges.select("a", "b").unionByName(copies.select(F.col("first").alias("a"), F.col("id").alias("b")))
    return components(marks.select("id", *more).distinct(), joined, "id"), edges


def match_records(left: DataFrame, right: DataFrame, left_id: str, right_id: str, doi_col: str | None = "doi", identifier_col: str | None = "identifier") -> DataFrame:
    """(``left_id``, ``right_id``, ``confidence``): records of two tables that describe the same work.

    Both tables have an id, title, authors, published and perhaps venue; ids of the two must not meet.

    Method: collective graph linkage.  Records of both tables are nodes; candidate edges
    come from rare shared attributes (triples of a title's rarest words, and so on; see
    :mod:`cells`), block filtering keeps each record to its rarest, and cells too large
    are split by further words and authors.  Edges get a confidence from words, authors,
    dates and venues; weak ones are refined by their neighbours' likeness until nothing
    changes (:func:`refined`); what hangs together is one work.  Within a table equal
    DOIs and identifiers link too, where a table has them.

    Defined results: rows with null id are left out; a record without title words
    matches nothing by itself, nor does a stock heading without authors, venue or date;
    repeated rows match as often as their other forms do, once per pair of ids; an
    empty table gives no match.
    """
    a, b = records(left, left_id, doi_col, identifier_col), records(right, right_id, doi_col, identifier_col)
    # whose ids they are goes along with them, so that the tables needn't be read again
    classes, edges = same_works(a.withColumn("ours", F.lit(True)).unionByName(b.withColumn("ours", F.lit(False))))
    classes = cut(classes, "classes")
    best = edges.join(classes.select(F.col("id").alias("a"), "root"), "a").groupBy("root").agg(F.max("confidence").alias("_best"))
    both = classes.filter("ours").select(F.col("id").alias("a"), "root").join(classes.filter("not ours").select(F.col("id").alias("b"), "root"), "root").join(best, "root", "left")
    direct = edges.select(F.least("a", "b").alias("_x"), F.greatest("a", "b").alias("_y"), "confidence").groupBy("_x", "_y").agg(F.max("confidence").alias("confidence"))
    both = both.withColumn("_x", F.least("a", "b")).withColumn("_y", F.greatest("a", "b")).join(direct, ["_x", "_y"], "left")
    # what is matched through others only is a little less sure than they are
    return both.select(F.col("a").alias(left_id), F.col("b").alias(right_id), F.coalesce("confidence", 0.9 * F.col("_best"), F.lit(0.9)).alias("confidence"))
