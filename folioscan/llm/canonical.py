"""Mapping free-entered values to the entries of a reference list (problem 4)."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from .edits import BKTree, typos

#: Reference entries of a shard; a list of one shard is sent to every task, a larger one is searched shard by shard.
SHARD_ENTRIES = 50_000
#: Edits that a value may be away from its entry (a swap counts as one), by length of the compared key.
EDITS, SHORT_KEY, SHORT_EDITS = 2, 12, 1
#: Of a key of this length and more, one edit more, but not within one word.
LONG_KEY = 24

#: Words that carry no meaning of their own in titles.
STOPWORDS = frozenset("a an and des de der du et for in la le of on the und".split())
#: Usual short forms of words in titles of serials.
SHORT_FORMS = {
    "acta": "acta", "adv": "advances", "ann": "annals", "arch": "archives", "bull": "bulletin", "comm": "communications", "commun": "communications",
    "conf": "conference", "eng": "engineering", "int": "international", "intl": "international", "j": "journal", "jour": "journal", "lett": "letters",
    "mag": "magazine", "meth": "methods", "proc": "proceedings", "q": "quarterly", "quart": "quarterly", "rep": "reports", "res": "research",
    "rev": "reviews", "sci": "science", "soc": "society", "theor": "theory", "trans": "transactions",
}
#: What is written around a title without belonging to it.
_AROUND = [
    re.compile(p)
    for p in (r"\[[^\]]*\]", r"\(\s*\d[^)]*\)", r"\bissn\b.*$", r",?\s*\bvol\b\.?\s*\d+.*$", r"\s/\s.*$", r"[\s,]+(1[89]|20)\d\d[.\s]*$")
]
_TURNED = re.compile(r"^(.*\S),\s*([^,]*\b(?:of|on|in|for))\W*$")
_GLUED = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORD = re.compile(r"([^\W_]+)(\.?)")


def plain(text: str) -> str:
    """Entities resolved, compatibility forms, lower case, no accents, single spaces."""
    while (bare := html.unescape(text)) != text:
        text = bare
    if text.isascii():
        return " ".join(text.lower().split())
    text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).casefold())
    return " ".join("".join(c for c in text if not unicodedata.combining(c)).split())


@dataclass
class Reading:
    """A title as words; ``short`` marks those written with a point."""

    words: list[str]
    short: list[bool]

    @property
    def glued(self) -> str:
        return "".join(self.words)

    @property
    def content(self) -> list[str]:
        return [w for w in self.words if w not in STOPWORDS]

    @property
    def key(self) -> str:
        return "".join(self.content)

    @property
    def initials(self) -> str:
        return "".join(w[0] for w in self.content)


def read(value: str, known: set[str] | frozenset[str] = frozenset()) -> Reading:
    """Words of a value; short forms are written out unless the reference uses them as words."""
    text = plain(_GLUED.sub(" ", value))
    for p in _AROUND:
        text = p.sub(" ", text)
    if m := _TURNED.match(text):
        text = f"{m[2]} {m[1]}"
    words, short = [], []
    found = [(m[1], bool(m[2])) for m in _WORD.finditer(text.replace("&", " and "))]
    for i, (word, point) in enumerate(found):
        after = found[i + 1][0] if i + 1 < len(found) else ""
        if point and word not in known and (full := SHORT_FORMS.get(word)):
            if (word, after == "and") == ("theor", False) or word == "rev" and after and after != "of":
                pass  # may stand for several words
            elif word == "rev":
                word, point = "review" if after else full, False
            else:
                word, point = full, False
        if word == "the" and not words:
            continue
        words.append(word)
        short.append(point and word not in known)
    return Reading(words, short)


def tokens(text: str) -> set[str]:
    """The words of a text for which it matters whether the reference knows them."""
    return {*read(text).words, *(m[1] for m in _WORD.finditer(plain(_GLUED.sub(" ", text)).replace("&", " and ")))}


#: Ways in which a value is found, the surest first: as written, with slips, with words cut short, by initials alone.
AS_WRITTEN, SLIPS, CUT_SHORT, INITIALS = range(4)


class Reference:
    """Reference entries, or a shard of them, searchable under typing errors, short forms and initials.

    ``known``: the words of all entries (of a shard: those of them that its own entries and the values have).
    """

    def __init__(self, ids: list[int], titles: list[str], known: frozenset[str] | None = None):
        self.known = frozenset(w for t in titles for w in read(t).words) if known is None else known
        readings = [read(t, self.known) for t in titles]
        self.ids, self.content = ids, [r.content for r in readings]
        self.of_key: dict[str, list[int]] = defaultdict(list)
        self.of_initials: dict[str, list[int]] = defaultdict(list)
        for i, r in enumerate(readings):
            for key in {r.glued, r.key} - {""}:
                self.of_key[key].append(i)
            if r.initials:
                self.of_initials[r.initials].append(i)
        self.words = {r.glued: r.words for r in reversed(readings) if r.glued}
        self.keys, self.initials = BKTree(list(self.words)), BKTree(list(self.of_initials))

    def _least(self, places: list[int]) -> int:
        return min(places, key=lambda i: self.ids[i])

    def match(self, values: list[str]) -> list[tuple[int, int, int, int] | None]:
        """For each value (way, distance, entry id, entries of these initials) of the closest entry within the limits, else None."""
        readings = [read(v, self.known) for v in values]
        asked: dict[str, list[int]] = defaultdict(list)
        for i, r in enumerate(readings):
            for key in {r.glued, r.key} - {""}:
                asked[key].append(i)
        best: dict[int, tuple[int, int, int, int]] = {}

        def offer(i: int, way: int, distance: int, place: int, n: int = 1) -> None:
            found = (way, distance, self.ids[place], n)
            if i not in best or found < best[i]:
                best[i] = found

        for key, who in asked.items():
            for i in who if key in self.of_key else ():
                offer(i, AS_WRITTEN, 0, self._least(self.of_key[key]))
        open_ = [i for i, r in enumerate(readings) if i not in best and r.glued]
        limit = np.array([SHORT_EDITS if (n := len(readings[i].glued)) < SHORT_KEY else EDITS + (n >= LONG_KEY) for i in open_], np.int64)
        # a swap of neighbours is two edits of the metric: the tree is searched twice as far
        for a, node, _ in self.keys.within([readings[i].glued for i in open_], 2 * limit):
            i, entry = open_[a], self.keys.words[node]
            if (d := typos(readings[i].glued, entry, int(limit[a]))) <= limit[a] and self._typed(readings[i].words, self.words[entry]):
                offer(i, SLIPS, d, self._least(self.of_key[entry]))
        # words cut short, and titles given by their initials alone
        cut = [i for i, r in enumerate(readings) if i not in best and any(r.short) and len(r.content) > 1]
        initials = [readings[i].initials for i in cut]
        for a, node, _ in self.initials.within(initials, np.ones(len(cut), np.int64)):
            i = cut[a]
            for place in self.of_initials[self.initials.words[node]]:
                if (d := self._cut_short(readings[i], place)) <= EDITS:
                    offer(i, CUT_SHORT, d, place)
        for i, r in enumerate(readings):
            if i not in best and len(r.words) == 1 and 2 < len(r.words[0]) and (places := self.of_initials.get(r.words[0])):
                offer(i, INITIALS, 0, self._least(places), len(places))
        return [best.get(i) for i in range(len(values))]

    def _typed(self, words: list[str], entry: list[str]) -> bool:
        """Whether differences may be slips: no word is another word of the reference, none differs by much."""
        if len(words) != len(entry):
            return True
        return all(w == e or w not in self.known and typos(w, e, EDITS) <= EDITS for w, e in zip(words, entry))

    def _cut_short(self, r: Reading, place: int) -> int:
        """Edits to an entry where a word with a point may stand for a longer one."""
        entry = self.content[place]
        mine = [(w, s) for w, s in zip(r.words, r.short) if w not in STOPWORDS]
        if len(mine) != len(entry):
            return EDITS + 1
        total = 0
        for (word, short), full in zip(mine, entry):
            left = EDITS - total
            d = typos(word, full, left)
            if d and not short and word in self.known:
                return EDITS + 1
            if short and d and len(word) < len(full):
                d = min([d, *(typos(word, full[:n], left) for n in (len(word) - 1, len(word), len(word) + 1) if n > 0)])
            total += d
            if total > EDITS:
                break
        return total


#: Values that are searched at once in a shard.
ASKED_ROWS = 5_000
_FOUND = "value string, way int, distance int, id long, n int"


def _answers(ref: Reference, asked: list[str]) -> pa.RecordBatch:
    hits = [(None,) * 4 if h is None else h for h in ref.match(asked)]
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(asked, pa.string()), *(pa.array(c, k) for c, k in zip(zip(*hits), kinds))], names=["value", "way", "distance", "id", "n"])


def _of_one_list(distinct: DataFrame, entries: DataFrame) -> DataFrame:
    held = entries.collect()  # bounded by SHARD_ENTRIES
    shared = distinct.sparkSession.sparkContext.broadcast(([r[0] for r in held], [r[1] for r in held]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ref = Reference(*shared.value)
        for part in parts:
            if part.num_rows:
                yield _answers(ref, part.column(0).to_pylist())

    tasks = max(4 * distinct.sparkSession.sparkContext.defaultParallelism, distinct.count() // ASKED_ROWS)
    return distinct.repartition(tasks, "value").mapInArrow(run, _FOUND)


def _of_shards(distinct: DataFrame, entries: DataFrame, number: int) -> DataFrame:
    """As :func:`_of_one_list`: what depends on the whole list, the words it knows and how many entries have the same initials, is told over all shards."""
    shards, salts = -(-number // SHARD_ENTRIES), max(1, -(-distinct.count() // ASKED_ROWS))

    def words(kind: Callable) -> Callable:
        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                rows = [(t, w) for t in part.column(0).to_pylist() for w in kind(t)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(2)], names=["value", "word"])

        return run

    title = entries.select(F.col("title").alias("value"))
    known = title.mapInArrow(words(lambda t: read(t).words), "value string, word string").select("word").distinct()
    typed = distinct.unionByName(title).distinct().mapInArrow(words(tokens), "value string, word string").join(known, "word").groupBy("value").agg(F.collect_set("word").alias("known"))
    left = entries.withColumnRenamed("title", "value").select(F.pmod(F.xxhash64("value"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("asks"), "id", "value")
    right = distinct.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.pmod(F.xxhash64("value"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("asks"), F.lit(None).cast("long").alias("id"), "value")
    rows = left.unionByName(right).join(cut(typed, "known"), "value", "left").select("shard", "salt", "asks", "id", "value", "known")

    def stream(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, titles, words_, asked = None, [], [], set(), []

        def answer() -> Iterator[pa.RecordBatch]:
            if asked:
                yield _answers(Reference(ids, titles, frozenset(words_)), asked)

        for part in parts:
            for shard, salt, asks, ident, value, own in zip(*(c.to_pylist() for c in part.columns)):
                if (shard, salt) != now:
                    yield from answer()
                    now, ids, titles, words_, asked = (shard, salt), [], [], set(), []
                words_.update(own or ())
                if asks:
                    asked.append(value)
                else:
                    ids.append(ident)
                    titles.append(value)
        yield from answer()

    return rows.repartition(max(shards * salts, 1), "shard", "salt").sortWithinPartitions("shard", "salt", "asks").mapInArrow(stream, _FOUND)


def map_to_canonical(values: DataFrame, value_col: str, reference: DataFrame, id_col: str, title_col: str) -> DataFrame:
    """(``value_col``, ``id_col``, ``distance``): every distinct value and its reference entry, -1 where none is meant.

    Method: a BK-tree over the reference's entries under the Levenshtein metric; the
    triangle inequality prunes it, every entry within the threshold is returned, and
    the closest one wins (ties: the smaller id).  Compared are titles as words without
    case, accents, usual short forms and what is written around them; once with and
    once without words of no meaning, so that lost spaces don't matter.  A second tree
    over initials finds titles whose words are cut short; initials alone are read where just
    one entry of the whole list has them.  A list of up to SHARD_ENTRIES entries is sent to
    every task; a larger one is cut into shards, every value is searched in each, in
    groups of ASKED_ROWS, and the shards' winners are merged; the result is the same.

    Defined results: null and blank values are left out; values repeated in the table
    come once; entries with null id or blank title are left out; an empty list leaves
    every value unmatched.
    """
    distinct = cut(values.select(F.col(value_col).cast("string").alias("value")).filter(F.col("value").rlike(r"(?U)\S")).distinct(), "values")
    entries = reference.select(F.col(id_col).cast("long").alias("id"), F.col(title_col).alias("title")).filter(F.col("id").isNotNull() & F.col("title").rlike(r"(?U)\S"))
    number = entries.count()
    found = _of_one_list(distinct, entries) if number <= SHARD_ENTRIES else _of_shards(distinct, entries, number)
    # the surest way first; initials count only if they are those of one entry
    best = F.min(F.when(F.col("way").isNotNull(), F.struct("way", "distance", "id")))
    found = found.groupBy("value").agg(best.alias("b"), F.sum("n").alias("n"))
    sure = F.col("b.way").isNotNull() & ((F.col("b.way") != INITIALS) | (F.col("n") == 1))
    return found.select(F.col("value").alias(value_col), F.when(sure, F.col("b.id")).otherwise(-1).alias(id_col), F.when(sure, F.col("b.distance")).alias("distance"))
