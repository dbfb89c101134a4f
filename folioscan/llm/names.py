"""Variant spellings of names typed by people (problem 2)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut, drop
from .links import components, within_one_edit

#: Entries that name nobody in particular (compared without case and points).
NOBODY = frozenset(
    ["anon", "anonymous", "and others", "author", "authors", "et al", "and al", "editor", "editors", "editorial board", "n a", "na", "nn", "no author", "no authors listed", "none", "nobody", "null", "others", "staff", "staff writer", "tba", "tbd", "unknown", "unknown author", "unnamed", "various", "various authors"]
)
#: Words of organisations, and the short forms they are written with.
ORG_WORDS = frozenset(
    "academy agency association bureau cent center centre centro college ctr committee cons consortium council department dept faculty foundation group inst institut institute instituto lab laboratory laboratories ministry museum network obs observatory office org organisation organization program programme project school soc society station surv survey team univ universidad universitat universite university wg working".split()
)
_FORMS = {"wg": ["working", "group"]}
_LITTLE = frozenset("a and at de des der du et for for in la of on the und".split())
#: Particles that belong to the family name after them.
PARTICLES = frozenset("af al ap ben bin da dal de del della den der des di dos du el ibn la le lo los mac mc san st ten ter van vande vander von zu zum zur".split())
#: Titles and suffixes that are no part of a name.
TITLES = frozenset("dr drs prof professor mr mrs ms miss mx sir dame phd md msc bsc jr sr ii iii iv esq rev hon".split())
#: Names from which on a word counts as a usual given name.
USUAL = 5
_BASE = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "ħ": "h"})


def fold(text: str) -> str:
    """Lower case, no accents, compatibility forms, dashes alike."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).casefold())
    text = "".join("-" if unicodedata.category(c) == "Pd" else c for c in text if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    return text.translate(_BASE)


def _letters(text: str) -> str:
    return text if text.isalnum() else "".join(c for c in text if c.isalnum())


def _token(raw: str, others_upper: bool) -> tuple[str, str]:
    """(kind, letters) of a word of a name: i initials, p the beginning of a name, f a whole one."""
    low = _letters(fold(raw))
    bare = _letters(raw)
    if len(low) <= 1 or re.fullmatch(r"(?:[^\W\d_]\.-?){2,}|[^\W\d_](?:-[^\W\d_])+\.?", raw):
        return "i", low
    if len(bare) <= 3 and bare.isupper() and not others_upper and low not in PARTICLES:
        return "i", low
    return ("p" if raw.endswith(".") else "f"), low


def parse(name: str) -> tuple | None:
    """(kind, sure, family, given, initials, beginning, family2, given2) of a name; None if it names nobody.

    ``sure`` is False where family and given name might be the other way round; the
    other reading is in the last two.  Organisations have their place as family and
    the beginnings of their other words as given.
    """
    text = " ".join(unicodedata.normalize("NFKC", name).split())
    flat = fold(text)
    bare = " ".join(re.findall(r"[^\W_]+", flat))
    if not bare or bare in NOBODY or not any(c.isalpha() for c in bare):
        return None
    words = bare.split()
    if any(w in ORG_WORDS for w in words) and (len(words) > 2 or not flat.count(",")):
        m = re.match(r"^(.*?)\s*(?:\(([^()]+)\)|,\s*([^,]+))\s*\W*$", flat)
        place, rest = (_letters(m[2] or m[3]), m[1]) if m else ("", flat)
        rest = [x for w in re.findall(r"[^\W_]+", rest) for x in _FORMS.get(w, [w]) if x not in _LITTLE]
        if not place and rest:
            place, rest = rest[0], rest[1:]
        return "o", True, place, " ".join(sorted({w[:3] for w in rest})), "", "", None, None
    parts = [p.strip() for p in text.split(",") if _letters(p)]
    parts = [p for i, p in enumerate(parts) if not i or _letters(fold(p)) not in TITLES]
    sides: list[list[tuple[str, str]]] = []
    for part in parts:
        raw = [w for w in part.split() if _letters(w)]
        while len(raw) > 1 and _letters(fold(raw[0])) in TITLES:
            raw = raw[1:]
        while len(raw) > 2 and _letters(fold(raw[-1])) in TITLES and not raw[-1].isupper():
            raw = raw[:-1]
        tokens = []
        for i, w in enumerate(raw):
            others = [x for j, x in enumerate(raw) if j != i and len(_letters(x)) > 1]
            tokens.append(_token(w, bool(others) and all(_letters(x).isupper() for x in others)))
        joined: list[tuple[str, str]] = []
        held = ""
        for i, (kind, low) in enumerate(tokens):
            if low in PARTICLES and kind != "i" and i + 1 < len(tokens):
                held += low
            else:
                joined.append((kind if not held else "f", held + low))
                held = ""
        if joined:
            sides.append(joined)
    if not sides:
        return None

    def given(tokens: list[tuple[str, str]], first: str = "") -> tuple[str, str, str]:
        whole = "".join(x for k, x in tokens if k == "f")
        initials = "".join(x if k == "i" else "" for k, x in tokens)
        begin = next((x for k, x in tokens if k == "p"), "")
        return whole, initials, begin

    if len(sides) > 1:
        g, i, b = given(sides[1])
        return "p", True, "".join(x for k, x in sides[0] if k != "i") or "".join(x for _, x in sides[0]), g, i, b, None, None
    tokens = sides[0]
    whole = [j for j, (k, _) in enumerate(tokens) if k == "f"]
    if not whole:
        return "p", True, "".join(x for _, x in tokens), "", "", "", None, None
    if len(tokens) == 1:
        return "p", True, tokens[0][1], "", "", "", None, None
    last_first = tokens[-1][0] != "f"
    first_last = tokens[0][0] != "f" or tokens[-1][0] == "f" and any(k == "i" for k, _ in tokens[1:-1])
    # behind a middle initial all words are of the family name
    cut_at = max((j + 1 for j, (k, _) in enumerate(tokens[:-1]) if k == "i" and j), default=len(tokens) - 1)
    a = ("".join(x for _, x in tokens[cut_at:]), *given(tokens[:cut_at]))
    b = (tokens[0][1], *given(tokens[1:]))
    if last_first:
        return "p", True, *b, None, None
    return "p", first_last, *a, *(b[:2] if not first_last else (None, None))


def _reading(names: DataFrame) -> DataFrame:
    schema = "name string, kind string, sure boolean, family string, given string, initials string, begin string, family2 string, given2 string"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(n, *r) for n in p["name"] if (r := parse(n))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return names.mapInPandas(run, schema)


def link_names(names: DataFrame, name_col: str, nicknames: DataFrame | None = None) -> DataFrame:
    """(``name_col``, ``entity``): every distinct name and the group of spellings it belongs to.

    Method: names are read as family and given name whatever their order (undecided
    orders by how often either word is seen in either place), nicknames are resolved,
    and the readings are linked: typing errors by a pigeonhole segment join with banded
    verification, over family names that share a given name and over given names that
    share a family name; components of these are spellings of one person, told
    apart by middle initials where they differ.  Initials and cut given names go to the
    person of that family name they fit if there is just one.  Organisations are linked
    by their place and the beginnings of their other words.

    Defined results: null and blank names and those that name nobody are left out;
    repeated names come once; a name that fits several persons stays apart from them,
    with the other spellings of the very same reading.  An empty table gives an empty one.
    """
    distinct = names.select(F.col(name_col).alias("name")).filter(F.col("name").rlike(r"(?U)\S")).distinct()
    read = cut(_reading(distinct), "readings")
    # which word is the family name: by the places words are seen in
    whole = read.filter("kind = 'p' and given <> ''")
    weight = F.when(F.col("sure"), 1.0).otherwise(0.5)
    seen = (
        whole.select(F.col("given").alias("word"), weight.alias("as_given"), F.lit(0.0).alias("as_family"))
        .unionByName(whole.select(F.col("family").alias("word"), F.lit(0.0).alias("as_given"), weight.alias("as_family")))
        .groupBy("word").agg(F.sum("as_given").alias("g"), F.sum("as_family").alias("f"))
        .select("word", F.log((F.col("g") + 0.5) / (F.col("f") + 0.5)).alias("lean"), (F.col("g") >= USUAL / 2).alias("usual"))
    )
    seen = cut(seen.withColumn("usual", F.col("usual") & (F.col("lean") > 1)), "places")
    # a word that is no usual given name, one edit away from just one that is, is a slip of that
    slips = within_one_edit(seen.filter(F.length("word") >= 4).withColumn("all", F.lit(0)), ["all"], "word")
    slips = slips.select("a", "b").unionByName(slips.select(F.col("b").alias("a"), F.col("a").alias("b")))
    slips = slips.join(seen.filter("usual").select(F.col("word").alias("b"), F.col("lean").alias("_lean")), "b").join(seen.filter("not usual").select(F.col("word").alias("a")), "a")
    slips = slips.groupBy(F.col("a").alias("word")).agg(F.min("b").alias("meant"), F.first("_lean").alias("_lean"), F.count("*").alias("_n")).filter("_n = 1").drop("_n")
    slips = cut(slips, "slips")
    seen = seen.join(slips, "word", "left").select("word", F.coalesce("_lean", "lean").alias("lean"))
    unsure = read.filter("not sure").select("name", "family", "given", "family2", "given2")
    for c in ("family", "given"):
        unsure = unsure.join(seen.select(F.col("word").alias(c), F.col("lean").alias(f"{c}_lean")), c, "left")
    turned = unsure.filter(F.coalesce("family_lean", F.lit(0.0)) > F.coalesce("given_lean", F.lit(0.0))).select("name", F.lit(True).alias("turn"))
    read = read.join(turned, "name", "left")
    for c in ("family", "given"):
        read = read.withColumn(c, F.when(F.col("turn"), F.col(f"{c}2")).otherwise(F.col(c)))
    if nicknames is not None:
        folded = F.pandas_udf(lambda x: x.map(lambda v: _letters(fold(v)), na_action="ignore"), "string")
        nick = nicknames.select(folded("nick").alias("given"), folded("given").alias("_full")).filter("given <> '' and _full <> ''")
        nick = nick.groupBy("given").agg(F.min("_full").alias("_full"), F.countDistinct("_full").alias("_n")).filter("_n = 1").drop("_n")
        read = read.join(nick, "given", "left").withColumn("given", F.when(F.col("kind") == "p", F.coalesce("_full", "given")).otherwise(F.col("given"))).drop("_full")
    meant = slips.select(F.col("word").alias("given"), "meant")
    read = read.join(meant, "given", "left").withColumn("given", F.when(F.col("kind") == "p", F.coalesce("meant", "given")).otherwise(F.col("given")))
    read = cut(read.select("name", "kind", "family", "given", "initials", "begin"), "read")

    sep = "\x1f"
    persons = read.filter("given <> '' or kind = 'o'").withColumn("node", F.concat_ws(sep, "kind", "family", "given"))
    nodes = persons.select("node", "kind", "family", "given").distinct()
    join = lambda x, f, g: F.concat_ws(sep, x, f, g)
    families = within_one_edit(nodes.filter(F.length("family") >= 5), ["kind", "given"], "family").select(join("kind", "a", "given").alias("a"), join("kind", "b", "given").alias("b"))
    often = nodes.filter("kind = 'p'").groupBy("given").agg(F.count("*").alias("n")).filter(f"n >= {USUAL}")
    givens = within_one_edit(nodes.filter((F.col("kind") == "p") & (F.length("given") >= 4)), ["kind", "family"], "given")
    # two given names that are both usual are no slips of each other
    for c in ("a", "b"):
        givens = givens.join(often.select(F.col("given").alias(c), F.lit(1).alias(f"often_{c}")), c, "left")
    givens = givens.filter("often_a is null or often_b is null").select(join("kind", "family", "a").alias("a"), join("kind", "family", "b").alias("b"))
    orgs = nodes.filter("kind = 'o'").select("family", "node", F.explode(F.split("given", " ")).alias("word"), F.size(F.split("given", " ")).alias("size"))
    left, right = orgs.select("family", "word", F.col("node").alias("a"), F.col("size").alias("m")), orgs.select("family", "word", F.col("node").alias("b"), F.col("size").alias("n"))
    same = left.join(right, ["family", "word"]).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("common"), F.first("m").alias("m"), F.first("n").alias("n"))
    same = same.filter("2 * common >= greatest(m, n) and common > 0").select("a", "b")
    roots = components(nodes.select("node"), families.unionByName(givens).unionByName(same))

    # middle initials tell apart the bearers of one name
    persons = persons.join(roots, "node").withColumn("middle", F.when(F.col("kind") == "p", F.col("initials")).otherwise(""))
    middles = persons.filter("middle <> ''").groupBy("root").agg(F.min("middle").alias("_least"), F.countDistinct(F.substring("middle", 1, 1)).alias("_kinds"))
    persons = persons.join(middles, "root", "left")
    persons = persons.withColumn("entity", F.when(F.col("_kinds") > 1, F.concat_ws(sep, "root", F.substring("middle", 1, 1))).otherwise(F.col("root")))
    persons = cut(persons.select("name", "kind", "family", "given", "middle", "entity"), "persons")

    # initials and cut given names
    cutoff = read.filter("kind = 'p' and given = ''").select("name", "family", F.when(F.col("begin") != "", F.col("begin")).otherwise(F.substring("initials", 1, 1)).alias("begin"), F.when(F.col("begin") == "", F.col("initials")).otherwise("").alias("initials"))
    some = cutoff.select("family", "begin", "initials").distinct()
    fits = persons.filter("kind = 'p'").select("family", "given", "middle", "entity").distinct()
    first = F.substring("begin", 1, 1)

    def matches(asked: DataFrame, known: DataFrame) -> DataFrame:
        both = asked.withColumn("_i", first).join(known.withColumn("_i", F.substring("given", 1, 1)), ["family", "_i"])
        after = F.expr("substring(initials, 2)")
        # further initials: the middle name's, perhaps behind one of the given name's own
        fit = F.col("given").startswith(F.col("begin")) & ((F.length("initials") < 2) | (F.col("middle") == "") | after.startswith(F.substring("middle", 1, 1)) | (F.substring(after, 2, 1) == F.substring("middle", 1, 1)))
        return both.filter(fit).groupBy("asked", "begin", "initials").agg(F.min("entity").alias("entity"), F.countDistinct("entity").alias("_n"))

    # each of these is read several times: written, or the plan of the result would hold all of it again for each
    exact = cut(matches(some.withColumn("asked", F.col("family")), fits), "exact")
    lost = cut(some.join(exact.select(F.col("asked").alias("family"), "begin", "initials"), ["family", "begin", "initials"], "left_anti"), "lost")
    around = fits.select("family", F.substring("given", 1, 1).alias("_i")).unionByName(lost.select("family", first.alias("_i"))).distinct().filter(F.length("family") >= 6)
    slips = near_slips = cut(within_one_edit(around, ["_i"], "family"), "slips")
    slips = slips.select("_i", F.col("a").alias("asked"), F.col("b").alias("family")).unionByName(slips.select("_i", F.col("b").alias("asked"), F.col("a").alias("family")))
    near = lost.withColumnRenamed("family", "asked").withColumn("_i", first).join(slips, ["asked", "_i"]).select("asked", "family", "begin", "initials")
    found = exact.unionByName(matches(near, fits)).filter("_n = 1").select(F.col("asked").alias("family"), "begin", "initials", "entity")
    rest = cutoff.join(found, ["family", "begin", "initials"], "left")
    rest = rest.select("name", F.coalesce("entity", F.concat_ws(sep, F.lit("i"), "family", "begin", "initials")).alias("entity"))
    linked = cut(persons.select("name", "entity").unionByName(rest), "linked")
    drop(exact, lost, near_slips, persons, read)
    return linked.withColumnRenamed("name", name_col)


def name_pairs(linked: DataFrame, name_col: str) -> DataFrame:
    """(``name_a``, ``name_b``), name_a < name_b by code points: all pairs of different spellings of a group."""
    a, b = (linked.select("entity", F.col(name_col).alias(c)) for c in ("name_a", "name_b"))
    return a.join(b, "entity").filter("name_a < name_b").select("name_a", "name_b").distinct()


__all__ = ["link_names", "name_pairs", "parse"]
