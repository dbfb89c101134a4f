"""Deduplicating new batches against all history (problem 5)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import cut, drop, keep, shared_dir
from .cells import title_cells
from .linkage import records, said
from .links import components, star
from .works import _LITTLE, MATCH, described, judged

#: Views of a title that lie in the pivot table: all of it, its first and its last words.
WHOLE, FRONT, BACK = 0, 1, 2
#: Words of the first and of the last view.
VIEW_WORDS = 4
#: Distance up to which two titles are near in a view, as a count of letters that either has beyond the other.
RADIUS = (6, 3, 3)
#: Widths in the first pivot distance: of a stored range, of a cell within it.
RANGE, CELL = 16, 8
#: Arrivals are accepted together, with the same result, until they hold this share of what was accepted before.
SHARE = 0.5
#: Rows of a batch's own cells that are sent to every task, so that the stored ones aren't moved; of more both sides are.
BROADCAST_ROWS = 200_000
#: Stored slots of the keys that records can share exactly.
SLOTS = 64
#: First stored part of a view's ranges; parts below are slots.
_PARTS = 1000
#: Pivots: the empty title, and far ones.  A far pivot holds more of each of its letters
#: than any title, so the distance to it is exact in the title's counts.
PIVOTS = 12
#: Letters by how common they are, roughly; far pivot k has those whose place shares an odd number of bits with k.
_BY_USE = "etaoinsrhldcumfpgwybvkxjqz"
_LETTERS = 28
_NO_VIEW = 8


def _pivot_signs() -> np.ndarray:
    """Distances to the pivots, but for constants, as sums of the counts of letters:
    to the empty title the length, to a far pivot the other letters less its own."""
    out = np.ones((PIVOTS, _LETTERS), np.int32)
    for k in range(1, PIVOTS):
        for place, c in enumerate(_BY_USE):
            if (place & k).bit_count() % 2:
                out[k, ord(c) - 97] = -1
    return out


SIGNS = _pivot_signs()


def letter_counts(texts: list[str]) -> np.ndarray:
    """How often each text has each of a to z, digits, and others; spaces don't count."""
    bare = [t.replace(" ", "") for t in texts]
    codes = np.frombuffer("".join(bare).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(bare)), np.fromiter(map(len, bare), np.int64, len(bare)))
    sign = np.where((codes >= 97) & (codes <= 122), codes - 97, np.where((codes >= 48) & (codes <= 57), 26, 27))
    return np.bincount(row * _LETTERS + sign, minlength=len(bare) * _LETTERS).reshape(-1, _LETTERS)


def views(words: str) -> tuple[str, str, str]:
    """A title's words as a whole, its first ones and its last ones that say something."""
    content = [w for w in words.split() if w not in _LITTLE]
    return words, " ".join(content[:VIEW_WORDS]), " ".join(content[-VIEW_WORDS:])


def near(a: list[str], b: list[str], view: int) -> np.ndarray:
    """Whether titles are within the radius of a view, by the true distance of their letters."""
    x, y = (letter_counts([views(w)[view] for w in side]) for side in (a, b))
    return np.abs(x - y).sum(axis=1) <= RADIUS[view]


#: Distances lie four by four in longs, in lanes of so many bits; what is beyond a lane's range is cut, which never hides a pair.
LANE, LANES, _ZERO = 15, 4, 4096
_LONGS = PIVOTS // LANES
_Q = [f"q{i}" for i in range(_LONGS)]


def _lanes(n: int) -> int:
    return sum(n << (LANE * i) for i in range(LANES))


def with_pivots(told: DataFrame) -> DataFrame:
    """``told`` with the distances of each view of a title to the fixed pivots, as one array of longs, view after view."""
    schema = T.StructType([*told.schema.fields, T.StructField("pivots", T.ArrayType(T.LongType()))])
    at, width = told.columns.index("words"), len(RADIUS) * _LONGS

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            own = [views(w or "") for w in part.column(at).to_pylist()]
            d = np.stack([letter_counts([v[i] for v in own]) @ SIGNS.T for i in range(len(RADIUS))], axis=1)
            lanes = np.clip(d + _ZERO, 0, 2 * _ZERO - 1).astype(np.int64).reshape(len(own), width, LANES)
            flat = pa.array((lanes << (LANE * np.arange(LANES))).sum(axis=2).ravel())
            pivots = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * width), flat)
            yield pa.RecordBatch.from_arrays([*part.columns, pivots], names=schema.names)

    return told.mapInArrow(run, schema)


def _part(view, p0):
    """The stored range that a distance to the first pivot lies in."""
    return (_PARTS * (view + 1) + F.floor(p0 / RANGE)).cast("int")


def pivot_rows(works: DataFrame) -> DataFrame:
    """The pivot-distance table of described works: (part, key, id, tag, view, bare, p0, q0, q1, ...), tag being the title.

    p0 is the distance to the first pivot, the q are all distances in lanes.

    There is a row for each view of a title and each author, as near titles of a kind must have an author in
    common; and for its first and its last two words, where titles without authors
    (``bare`` has a bit 1 for these rows, and 2 where there are no authors) are compared.
    """
    row = lambda key, view, bare: F.struct(key.alias("key"), F.lit(view).alias("view"), *(F.col("pivots")[view * _LONGS + i].alias(q) for i, q in enumerate(_Q)), bare.cast("int").alias("bare"))
    of_people = F.flatten(F.transform("fs", lambda f: F.array(*(row(F.xxhash64("kind", f), v, F.lit(0)) for v in (WHOLE, FRONT, BACK)))))
    first, last = (F.xxhash64(F.lit(side), "kind", F.element_at("ws", x), F.element_at("ws", y)) for side, x, y in (("first", 1, 2), ("last", -1, -2)))
    alone = F.when(F.col("families") == "", 3).otherwise(1)
    none = F.array().cast("array<struct<key:bigint,view:int," + ",".join(f"{q}:bigint" for q in _Q) + ",bare:int>>")
    of_words = F.when(F.size("ws") >= 2, F.array(row(first, FRONT, alone), row(last, BACK, alone))).otherwise(none)
    rows = works.filter("not stock and own_title is not null").select("id", "own_title", F.explode(F.concat(of_people, of_words)).alias("r"))
    rows = rows.select("id", F.col("own_title").alias("tag"), "r.*").withColumn("p0", F.expr(f"cast((q0 & {2 * _ZERO - 1}) - {_ZERO} as int)"))
    return rows.select(_part(F.col("view"), F.col("p0")).alias("part"), "key", "id", "tag", "view", "bare", "p0", *_Q)


def near_rows(asks: DataFrame, held: DataFrame, small: bool = False) -> DataFrame:
    """(a, b, views): rows a of ``held`` and b of ``asks`` (pivot tables; ``small``: send them to every task) of one key that no pivot tells apart.

    A row asks the cells of the first pivot distance that its own reaches within the
    radius; there the triangle inequality is tested for all pivots.  ``views`` has a bit
    for each view in which a pair may be near.  Equal titles aren't compared.
    """
    radius = F.element_at(F.array(*map(F.lit, RADIUS)), F.col("view") + 1)
    reach = F.explode(F.sequence(F.floor((F.col("p0") - radius) / CELL).cast("int"), F.floor((F.col("p0") + radius) / CELL).cast("int"))).alias("at")
    x = asks.select("view", "key", reach, "id", "tag", "bare", *_Q).select(F.xxhash64("view", "key", "at").alias("cell"), F.col("id").alias("b"), F.col("tag").alias("_tag"), F.col("bare").alias("_bare"), *(F.col(q).alias("_" + q) for q in _Q))
    y = held.select(F.xxhash64("view", "key", F.floor(F.col("p0") / CELL).cast("int")).alias("cell"), F.col("id").alias("a"), "tag", "bare", "view", *_Q)
    both = y.join(F.broadcast(x) if small else x, "cell").filter("a <> b and tag <> _tag and (bare = 0 or bare = 3 or _bare = 3)")
    # all lanes at once: a difference is within the radius r if it and r together are from 0 to 2 r, and what is
    # above the next power of two is seen in the bits that are left, borrowed ones included
    by_view = lambda of: "case " + " ".join(f"when view = {v} then {of(r)}L" for v, r in enumerate(RADIUS)) + " end"
    some, rest = by_view(_lanes), by_view(lambda r: _lanes((1 << (2 * r).bit_length()) - 1))
    for q in _Q:
        both = both.filter(f"(({q} - _{q} + {some}) & ~({rest})) = 0")
    return both.select("a", "b", F.expr("shiftleft(1, view)").alias("views"))


def _mark(name: str, *columns) -> F.Column:
    return F.xxhash64(F.lit(name), *columns)


def _keyed(df: DataFrame, key, tag=None) -> DataFrame:
    """Rows of the keys that records can share, in the form of :func:`pivot_rows`; a null tag: equal keys are of one work."""
    void = F.lit(None)
    tag = void.cast("long") if tag is None else tag.cast("long")
    told = df.select(key.alias("key"), "id", tag.alias("tag"))
    return told.selectExpr(f"cast(pmod(key, {SLOTS}) as int) as part", "key", "id", "tag", "cast(null as int) as view", "cast(null as int) as bare", "cast(null as int) as p0", *(f"cast(null as long) as {q}" for q in _Q))


def shared_keys(told: DataFrame) -> DataFrame:
    """Keys of what a described record says: the text itself, its title and an author, its title where nobody is named; cells of equal titles."""
    titled = told.filter("not stock and own_title is not null")
    cells = title_cells(told)
    return (
        _keyed(told.filter("print is not null"), F.col("print")).unionByName(_keyed(titled.select("id", "own_title", F.explode("fs").alias("f")), _mark("author", "own_title", "f")))
        .unionByName(_keyed(titled.filter("families = '' and size(split(words, ' ')) >= 4"), _mark("nobody", "own_title"))).unionByName(_keyed(cells, F.col("key"), F.col("tag")))
    )


class History:
    """Everything accepted so far, as tables that batches are held against and appended to.

    - ``works``: what each record says, with its pivot distances.
    - ``cells``: the pivot-distance table, in parts by view and range of the first pivot
      distance; and what records can share exactly (the text itself, DOI, identifier, title and
      an author), in parts by slot of a hash.  Files are sorted by part and key.
    - ``links``: (a, b) of records of one work.

    A batch reads the parts that its own rows reach (a pushed-down filter, so other pages are
    skipped), and of ``works`` the records it may repeat; it rewrites nothing.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path, self.batches = spark, path or keep(spark, f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"), 0
        self.reached: list[int] = []

    def _append(self, df: DataFrame, name: str) -> DataFrame:
        folder = f"{self.path}/{name}/batch={self.batches}"
        df.write.parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder)

    def _before(self, name: str, like: DataFrame) -> DataFrame:
        """A table without the batch that is being accepted."""
        return self.spark.read.schema(like.schema).parquet(*(f"{self.path}/{name}/batch={i}" for i in range(self.batches))) if self.batches else like.filter("false")

    def accept(self, rows: DataFrame) -> DataFrame:
        """Hold a batch (as by :func:`linkage.records`) against everything accepted, append it, and return its links (a, b), a < b."""
        rows = rows.withColumn("print", said())
        told = self._append(with_pivots(described(rows, "id", "print", "doi", "identifier")), "works")
        cells = shared_keys(told).unionByName(pivot_rows(told))
        known = [_keyed(told.filter(f"{c} is not null"), _mark(c, c)) for c in ("doi", "identifier")]
        held = self._before("cells", cells)
        if self.batches:
            # parts are few: slots, and ranges of bounded width of distances that grow with titles, not with rows
            radius = F.element_at(F.array(*map(F.lit, RADIUS)), F.col("view") + 1)
            asked = F.when(F.col("view").isNull(), F.array("part")).otherwise(F.array(*(_part(F.col("view"), F.col("p0") + x * radius) for x in (-1, 0, 1))))
            everything = cells.unionByName(known[0]).unionByName(known[1])
            self.reached = sorted(r[0] for r in everything.select(F.explode(asked).alias("part")).distinct().collect())
            held = held.filter(F.col("part").isin(self.reached))
        # what says the same as an accepted record, or one of the batch, is a link and nothing else
        first = told.filter("print is not null").groupBy("print").agg(F.min("id").alias("first"))
        seen = held.filter("tag is null").join(first.select(F.col("print").alias("key")), "key").groupBy(F.col("key").alias("print")).agg(F.min("id").alias("seen"))
        first = first.join(seen, "print", "left").select("print", F.coalesce("seen", "first").alias("seen"))
        # written: it is joined with each of the tables that make up the cells
        again = cut(told.select("id", "print").join(first, "print").filter("id <> seen").select("id", "seen"), "again")
        copies = _keyed(again.select("id", F.col("seen").alias("key")), F.col("key")).withColumn("part", F.lit(-1))
        kept = cells.join(again.select("id").distinct(), "id", "left_anti").select(cells.columns).unionByName(known[0]).unionByName(known[1]).unionByName(copies)
        kept = self._append(kept.repartition("part").sortWithinPartitions("part", "key"), "cells")
        drop(again)
        copies, own = kept.filter("part = -1").select(F.col("key").alias("a"), F.col("id").alias("b")), kept.filter("part >= 0")

        small = own.count() <= BROADCAST_ROWS
        sent = F.broadcast if small else lambda df: df
        x = own.filter("view is null and tag is not null").select("key", F.col("id").alias("b"), F.col("tag").alias("_tag"))
        y = held.unionByName(own).filter("view is null and tag is not null").select("key", F.col("id").alias("a"), "tag")
        pairs = y.join(sent(x), "key").filter("tag <> _tag and a <> b").select("a", "b", F.lit(_NO_VIEW).alias("views"))
        close = near_rows(own.filter("view is not null"), held.unionByName(own).filter("view is not null"), small)
        pairs = pairs.unionByName(close).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "views")
        pairs = self._append(pairs.groupBy("a", "b").agg(F.bit_or("views").alias("views")), "pairs")

        exact = own.filter("tag is null").select("key", "id")
        met = held.filter("tag is null").select("key", F.col("id").alias("_held")).join(sent(exact.groupBy("key").agg(F.min("id").alias("b"))), "key").groupBy("key").agg(F.min("_held").alias("a"), F.first("b").alias("b")).select("a", "b")
        works = self._before("works", told).unionByName(told) if self.batches else told
        sure = judged(pairs, works, pairs.count(), "views", _verified).filter(f"confidence >= {MATCH}").select("a", "b")
        links = star(exact, "key").unionByName(met).unionByName(copies).unionByName(sure)
        out = self._append(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "links")
        self.batches += 1
        return out

    def links(self) -> DataFrame:
        """(a, b) of all batches."""
        return self.spark.read.schema("a long, b long").parquet(*(f"{self.path}/links/batch={i}" for i in range(self.batches)))


def _verified(masks: list[int], a: list[str], b: list[str]) -> np.ndarray:
    """Which pairs are near by the true distance in a view that the pivots left open, or are of one title."""
    masks_ = np.array(masks, np.int64)
    out = (masks_ & _NO_VIEW) > 0
    for view in (WHOLE, FRONT, BACK):
        at = np.flatnonzero(~out & ((masks_ >> view) & 1 > 0))
        if len(at):
            out[at] = near([a[i] for i in at], [b[i] for i in at], view)
    return out


def repeats(candidates: DataFrame, id_col: str, batch_col: str | None = None, doi_col: str | None = "doi", identifier_col: str | None = "identifier", share: float = SHARE) -> DataFrame:
    """(``accepted_id``, ``dup_id``): records whose work a record with a smaller id described, and the least such id.

    Method: the batches, in the order of ``batch_col`` (none: all rows are one batch), are
    accepted one after the other by a :class:`History` (arrivals wait until they hold a
    ``share`` of what was accepted, so that all of them together cost a few passes; 0: each by itself).  A record is linked with accepted
    ones that say the same, have its DOI or identifier, or its title and an author of
    it; and with near titles, found in a table of the distances of titles to fixed
    pivots (a metric: letters that either has beyond the other), pruned by the triangle
    inequality in ranges of the first pivot distance, verified by the true distance, and
    judged by words, authors and dates.

    Defined results: a null id is left out; null or empty DOI, identifier, title and
    author list link nothing by themselves; rows of a null batch come last; repeated
    rows of an id are one record.
    """
    spark = candidates.sparkSession
    history = History(spark)
    if batch_col is None:
        history.accept(records(candidates, id_col, doi_col, identifier_col))
    else:
        arrived = sorted(map(tuple, candidates.groupBy(batch_col).count().collect()), key=lambda n: (n[0] is None, n[0]))  # a row per arrival
        now, held, accepted = [], 0, 0
        for i, (n, size) in enumerate(arrived):
            now, held = [*now, n], held + size
            if held >= share * accepted or i + 1 == len(arrived):
                some = F.col(batch_col).isin([x for x in now if x is not None])
                some = some | F.col(batch_col).isNull() if None in now else some
                history.accept(records(candidates.filter(some), id_col, doi_col, identifier_col))
                now, held, accepted = [], 0, accepted + held
    if not history.batches:
        return spark.createDataFrame([], "accepted_id long, dup_id long")
    links = history.links()
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return components(nodes, links).filter("root <> node").select(F.col("root").alias("accepted_id"), F.col("node").alias("dup_id"))
