"""What a record says about the work it describes, and whether two records describe the same one."""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterator
from datetime import date
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .canonical import plain
from .edits import typos
from .names import NOBODY, ORG_WORDS, PARTICLES, TITLES, fold, parse

#: What publishers and servers put before a title.
_BEFORE = re.compile(r"^\W*(?:\[?\b(?:preprint|research article|original article|original paper|original research|full paper|article|paper)\b\s*[\]:–—-]\s*)+")
#: Beginnings that make a title the title of another work about it.
_ABOUT = re.compile(r"^\W*(addendum|author correction|comment|commentary|corrections?|corrigendum|errata|erratum|expression of concern|publisher correction|rejoinder|reply|response|retraction|review)\b\s*(?:to|on|of|for|:|-)")
_PART = re.compile(r"\b(?:part|pt|teil|partie|parte)\.?\s+([ivxl]+|\d+|one|two|three|four)\b")
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_WORD = re.compile(r"[^\W_]+")
#: Of ASCII letters and digits are words; the rest lies between them.
_SPACED = bytes(i if chr(i).isalnum() else 32 for i in range(128)) + bytes(128)
#: Where a title's first segment ends.
_SEGMENT = re.compile(r"[:?…]|\.\.\.|\s[-–—]\s")
#: Words whose loss or gain says nothing.
_LITTLE = frozenset("a an and at by d das de der des die du e el en et for from from in into l la las le les los near of on or the to un una und une with y zu".split())
#: Headings that many works have.
_STOCK = frozenset(
    ["announcements", "book review", "book reviews", "contents", "correction", "corrigendum", "editorial", "errata", "erratum", "foreword", "front matter", "in memoriam", "introduction", "issue information", "letter to the editor", "masthead", "news", "news and views", "obituary", "preface", "table of contents"]
)
#: Days between two dates of one work, at most, where only dates tell works apart.
NEAR_DAYS = 60
#: Days between two dates of one work, at most, where only a venue is beside them.
SAME_DAYS = 3
#: Confidence from which on two records are of one work, and from which on like neighbours may lift them there.
MATCH, WEAK = 0.5, 0.2

_EPOCH = date(1970, 1, 1).toordinal()
FIELDS = ("words", "families", "stock", "venue", "day")


def hashed(text: str) -> int:
    """64 bits of a text, as Spark's signed long."""
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


_hashed = lru_cache(maxsize=100_000)(hashed)


@lru_cache(maxsize=100_000)
def _short(text: str) -> int:
    return (xxhash.xxh3_64_intdigest(text) & 0xFFFF) - (1 << 15)


def ends(family: str) -> tuple[str, ...]:
    """Beginning and end of a family word, of which one edit leaves one whole (of short words the word itself)."""
    n = len(family)
    if n < 4:
        return (family,)
    out = [family] if n == 4 else []
    if n <= 7:
        out += [family[:2] + "-", "-" + family[-2:]]
    if n >= 7:
        out += [family[:3] + "-", "-" + family[-3:]]
    return tuple(out)


@lru_cache(maxsize=100_000)
def _told_of(families: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Hashes of the words of a family name, and of their ends."""
    words = families.split()
    return tuple(map(hashed, words)), tuple(_short(e) for w in words for e in ends(w))


_CAPITAL, _SMALL = "[A-ZÀ-ÖØ-Þ]", "[a-zà-öø-ÿ]"
_LETTER = "[A-Za-zÀ-ÖØ-öø-ÿ]"
#: One letter that folds to one letter, with or without a point.
_INITIAL = r"[A-Za-zÀ-ÅÇ-ÖØ-Ýà-åç-ïñ-öø-ýÿ]\.?"
_GIVEN = f"(?:{_CAPITAL}?{_SMALL}{{2,}}|{_CAPITAL}{_SMALL}|{_LETTER}{{4,}})(?:-{_LETTER}+)?"
_FAMILY = f"{_LETTER}{{4,}}(?:-{_LETTER}+)?"
_TITLE = r"(?:(?:Dr|Prof|Mr|Mrs|Ms)\.? )?"
#: The usual forms of a name, read without :func:`names.parse`, with the same result: "Given Family" with or without an initial
#: between, "G. Family", "Family, Given" or "Family, G.", "Family G." and "Family Given G.".
_USUAL = re.compile(
    f"{_TITLE}(?:(?P<given>{_GIVEN}) (?P<middle>{_INITIAL} )?(?P<last>{_FAMILY})|(?:{_INITIAL} )+(?P<after>{_FAMILY}))"
    f"|(?P<before>{_FAMILY})(?:, (?:{_GIVEN}(?: {_INITIAL})*|{_INITIAL}(?: {_INITIAL})*)| (?:{_GIVEN} )?{_INITIAL}(?: {_INITIAL})*)"
)
_OTHER = ORG_WORDS | TITLES | PARTICLES


@lru_cache(maxsize=150_000)
def _family(name: str) -> str | None:
    text = " ".join(name.split())
    if m := _USUAL.fullmatch(text):
        given, middle, last, after, before = m.groups()
        low = fold(text[m.start("given") :] if given else text)
        words = low.encode().translate(_SPACED).decode().split() if low.isascii() else _WORD.findall(low)
        if _OTHER.isdisjoint(words if given or before else words[1:]) and " ".join(words) not in NOBODY:
            family = fold(last or after or before).replace("-", "")
            if family not in _OTHER and (before is None or "".join(words[before.count("-") + 1 :]) not in TITLES):
                if not given:
                    return family
                first = fold(given).replace("-", "")
                if first not in _OTHER:
                    return family if middle else f"{min(first, family)} {max(first, family)}"
    r = parse(name)
    return r[2] if r and r[1] else f"{min(r[2], r[6])} {max(r[2], r[6])}" if r else None


def families(authors) -> list[str]:
    """Family names (and places of organisations); where the order is open both words, the smaller first."""
    return list(dict.fromkeys(f for a in authors or () if a and (f := _family(a))))


@lru_cache(maxsize=50_000)
def _venue(venue: str) -> str:
    """A venue's words but for little ones, four letters each, so that usual short forms meet."""
    return "".join(w[:4] for w in _WORD.findall(plain(venue)) if w not in _LITTLE and not w.isdigit())


def describe(title: str | None, authors, venue: str | None = None) -> tuple:
    """(words, families, stock heading, venue, kind, title, content words, those of the first segment, family words, their ends).

    Words and families are texts with a separator; ``kind`` is a hash of what must be equal (what the title
    is about another work, its part, its numbers), ``title`` one of the words in any order and the kind.
    """
    text = title or ""
    text = plain(_TAG.sub(" ", text) if "<" in text else text)
    if m := _BEFORE.match(text):
        text = text[m.end() :]
    about = m[1] if (m := _ABOUT.match(text)) else ""
    part = m[1] if ("part" in text or "pt" in text or "teil" in text) and (m := _PART.search(text)) else ""
    if part:
        text = _PART.sub(" ", text)
    text = text.replace("&", " and ")
    plainer = text.isascii()
    words = text.encode().translate(_SPACED).decode().split() if plainer else _WORD.findall(text)
    content = list(dict.fromkeys([w for w in words if w not in _LITTLE]))
    stock = len(content) < 2 or " ".join(words) in _STOCK
    numbers = " ".join(sorted(filter(str.isdigit, words)))
    kind = hashed(f"{about}\x1f{part}\x1f{numbers}")
    own = " ".join(sorted(words)).replace(" and ", " ")
    # most titles have but one segment, which is seen without searching
    several = not plainer or ":" in text or "?" in text or "..." in text or " - " in text
    first = len(set(_WORD.findall(text[: m.start()])) - _LITTLE) if several and (m := _SEGMENT.search(text)) else 0
    people = families(authors)
    single = list(map(_told_of, people))
    return (
        " ".join(words), "|".join(people), stock, _venue(venue) if venue else "", kind, hashed(f"{own}\x1f{kind}") if own else None,
        list(map(_hashed, content)), first if first < len(content) else 0, list(dict.fromkeys(chain.from_iterable([hs for hs, _ in single]))),
        list(dict.fromkeys(chain.from_iterable([es for _, es in single]))),
    )


def described(df: DataFrame, id_col: str, *keep: str) -> DataFrame:
    """``df`` (id, title, authors, published and perhaps venue) with what it says, and the columns of ``keep``.

    One narrow pass over the rows as they are read; ``fs`` are hashes of family words, ``ws`` of content words.
    """
    # dates before 1900 and the epoch's first day are no dates
    when = F.to_date("published")
    day = F.when((when > "1970-01-01") & (when < "2100-01-01"), F.datediff(when, F.lit("1970-01-01").cast("date")))
    venue = F.col("venue") if "venue" in df.columns else F.lit(None).cast("string")
    asked = df.select(F.col(id_col).alias("id"), day.alias("day"), *keep, "title", "authors", venue.alias("venue"))
    kept = asked.schema.fields[: 2 + len(keep)]
    long_, string = T.LongType(), T.StringType()
    told = [("words", string), ("families", string), ("stock", T.BooleanType()), ("venue", string), ("kind", long_), ("own_title", long_), ("ws", T.ArrayType(long_)), ("seg", T.IntegerType()), ("fs", T.ArrayType(long_)), ("ends", T.ArrayType(T.ShortType()))]
    schema = T.StructType([*kept, *(T.StructField(n, k) for n, k in told)])
    kinds = [pa.string(), pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int16())]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            own = zip(*(p.column(c).to_pylist() for c in ("title", "authors", "venue")))
            # what is told of a batch holds no cycles, and would be searched for them again and again while it grows
            gc.disable()
            try:
                columns = list(zip(*(describe(*x) for x in own))) or [()] * len(kinds)
            finally:
                gc.enable()
            yield pa.RecordBatch.from_arrays([*(p.column(i) for i in range(len(kept))), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=schema.names)

    return asked.mapInArrow(run, schema)


@lru_cache(maxsize=200_000)
def _letters(word: str) -> int:
    """The letters of a word as bits; different letters may share one."""
    bits = 0
    for c in word:
        bits |= 1 << (ord(c) & 63)
    return bits


def _slips(a: str, others: list[str]) -> Iterator[str]:
    """Those of ``others`` that are ``a`` but for an edit, or two in words of 6 letters and more."""
    size = len(a)
    if size < 3 or a.isdigit():
        return
    bits = _letters(a)
    for b in others:
        n = len(b)
        if -3 < n - size < 3 and n > 2:
            most = 1 if n < 6 or size < 6 else 2
            if -most <= n - size <= most and (bits ^ _letters(b)).bit_count() <= 2 * most and not b.isdigit() and typos(a, b, most) <= most:
                yield b


def _slip(a: str, b: str) -> bool:
    return any(True for _ in _slips(a, [b]))


def title_match(a: list[str], b: list[str]) -> float:
    """0 to 1: how sure two titles' words are those of one work; 0 if each has a word of its own."""
    if a == b:
        return 1.0 if a else 0.0
    rest = list(b)
    own = []
    for w in a:
        if w in rest:
            rest.remove(w)
        else:
            own.append(w)
    mine, theirs = [w for w in own if w not in _LITTLE], [w for w in rest if w not in _LITTLE]
    if mine and theirs:
        # the side with fewer words of its own must have each as a slip, the cut beginning or a part of the other's
        short, others = (mine, rest) if len(mine) <= len(theirs) else (theirs, own)
        glued = "".join(w for w in others if w not in _LITTLE)
        for w in short:
            if w not in glued and next(_slips(w, [*others, glued]), None) is None:
                return 0.0
    still = []
    for w in own:
        hit = next(_slips(w, rest), None)
        if hit is None:
            still.append(w)
        else:
            rest.remove(hit)
    mine, theirs = [w for w in still if w not in _LITTLE], [w for w in rest if w not in _LITTLE]
    if mine and theirs:  # a word cut off at the end of a shortened title, or two words run together
        short, long_ = (mine, theirs) if len(mine) <= len(theirs) else (theirs, mine)
        left = [w for w in short if not any(x.startswith(w) for x in long_)]
        glued = "".join(long_)
        left = [w for w in left if w not in glued and not (len(long_) > 1 and _slip(w, glued))]
        if left:
            return 0.0
    common = len(a) - len(still)
    return common / max(1, max(len(a), len(b))) if common >= min(3, len(a), len(b)) else 0.0


def authors_match(a: list[str], b: list[str]) -> float | None:
    """Share of the shorter list's families that the other has, with slips; None if either has none."""
    if not a or not b:
        return None
    short, other = (a, b) if len(a) <= len(b) else (b, a)
    pool = {w for f in other for w in f.split()}
    hits = 0
    for f in short:
        own = f.split()
        if any(w in pool for w in own) or any(len(w) > 4 and any(abs(len(w) - len(x)) < 2 and typos(w, x, 1) <= 1 for x in pool) for w in own):
            hits += 1
    return hits / len(short)


def confidence(x: tuple, y: tuple) -> float:
    """0 to 1: how sure two descriptions (FIELDS) of the same kind are of one work (MATCH and more: a match)."""
    words_x, people_x, stock_x, venue_x, day_x = x
    words_y, people_y, stock_y, venue_y, day_y = y
    title = title_match(words_x.split(), words_y.split())
    if not title:
        return 0.0
    a, b = people_x.split("|") if people_x else [], people_y.split("|") if people_y else []
    who = authors_match(a, b)
    days = abs(day_x - day_y) if day_x is not None and day_y is not None else None
    if stock_x or stock_y:
        # "introduction" and the like: authors and dates, or venues and dates, must tell
        if title < 1 and not _slip(words_x.replace(" ", ""), words_y.replace(" ", "")):
            return 0.0
        if who is None:
            return 0.55 if days is not None and days <= SAME_DAYS and venue_x and venue_x == venue_y else 0.0
        if who < 0.5:
            return 0.0
        near = days is not None and (days <= NEAR_DAYS or _coarse(day_x, day_y))
        return 0.6 + 0.3 * who if near else 0.55 if days is None and who == 1 and min(len(a), len(b)) > 1 else 0.0
    if who is None:
        sure = title >= 0.75 and min(words_x.count(" "), words_y.count(" ")) >= 3
        return 0.5 + 0.4 * title if sure else min(0.45, 0.4 * title + (0.05 if venue_x and venue_x == venue_y else 0.0))
    if who == 0:
        return 0.0
    far = days is not None and days > 400 and not _coarse(day_x, day_y)
    return min(1.0, 0.4 + 0.35 * title + 0.25 * who) * (0.9 if far else 1.0)


def _coarse(a: int, b: int) -> bool:
    """Whether one date is a mere year or month that the other lies in."""
    p, q = date.fromordinal(_EPOCH + a), date.fromordinal(_EPOCH + b)
    return any(one.day == 1 and one.year == other.year and (one.month == 1 or one.month == other.month) for one, other in ((p, q), (q, p)))


#: Ids that are sent to all tasks to pick their rows, so that others aren't moved.
BROADCAST_IDS = 1_000_000


def of_ids(told: DataFrame, ids: DataFrame, most: int | None = None) -> DataFrame:
    """The rows of ``told`` with an ``id`` in ``ids``, a written table; ``most``: as many ids it has at most."""
    few = (ids.count() if most is None else most) <= BROADCAST_IDS
    some = ids.select("id").distinct()
    return told.join(F.broadcast(some) if few else some, "id", "left_semi")


def judged(pairs: DataFrame, told: DataFrame, ids: int | None = None, mark: str | None = None, passes: Callable | None = None) -> DataFrame:
    """(a, b, confidence) of pairs of different descriptions of the same kind; ``told`` has their ids and FIELDS.

    ``ids``: an upper bound of the pairs, if known; up to BROADCAST_IDS the pairs' ids
    go to every task and only descriptions in a pair are shuffled.  ``passes`` may tell
    from a column ``mark`` and both titles' words which pairs are worth judging.
    """
    some = told.select("id", *FIELDS, "ends")
    if ids is not None:
        some = of_ids(some, pairs.select(F.explode(F.array("a", "b")).alias("id")), ids)
    marks = [mark] if mark else []
    out = pairs.select("a", "b", *marks)
    for key, side in (("a", "x_"), ("b", "y_")):
        out = out.join(some.select(F.col("id").alias(key), *(F.col(f).alias(side + f) for f in (*FIELDS, "ends"))), key)
    # authors of which no two can be within one edit: refused whatever the titles
    out = out.filter("x_families = '' or y_families = '' or arrays_overlap(x_ends, y_ends)")
    n, schema = len(FIELDS), T.StructType([pairs.schema["a"], pairs.schema["b"], T.StructField("confidence", T.DoubleType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            if passes:
                p = p.filter(pa.array(passes(*(p.column(c).to_pylist() for c in (mark, "x_words", "y_words"))), pa.bool_()))
            c = [p.column(i).to_pylist() for i in range(2, 2 + 2 * n)]
            sure = [confidence(x, y) for x, y in zip(zip(*c[:n]), zip(*c[n:]))]
            yield pa.RecordBatch.from_arrays([p.column(0), p.column(1), pa.array(sure, pa.float64())], names=schema.names)

    return out.select("a", "b", *("x_" + f for f in FIELDS), *("y_" + f for f in FIELDS), *marks).mapInArrow(run, schema)
