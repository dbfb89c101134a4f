"""Training-data operators against brute force, round trips and hand-made cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan.llm import bpe, cells, spans, works
from folioscan.llm.canonical import map_to_canonical
from folioscan.llm.edits import BKTree, codes, levenshtein_to, typos
from folioscan.llm.history import History, repeats
from folioscan.llm.linkage import match_records
from folioscan.llm.links import components, within_one_edit
from folioscan.llm.names import link_names, name_pairs, parse
from folioscan.llm.neighbours import nearest_neighbours, neighbour_pairs
from folioscan.llm.packing import pack
from folioscan.llm.spans import shared_shares, shared_spans
from folioscan.llm.tokens import count_tokens, decode, encode_corpus
from folioscan.llm.works import described


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j - 1] + (x != y), row[j] + 1, now[-1] + 1))
        row = now
    return row[-1]


def swaps(a, b):
    d = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def word(rng, letters, most):
    return "".join(rng.choice(letters) for _ in range(rng.randint(0, most)))


# ---- edit distances ----


@pytest.mark.parametrize("size", [1, 30, 63, 64, 65, 130])
def test_levenshtein(size):
    rng = random.Random(size)
    pattern = "".join(rng.choice("abc") for _ in range(size))
    texts = [word(rng, "abcd", size + 9) for _ in range(60)] + [pattern, ""]
    assert levenshtein_to(pattern, *codes(texts)).tolist() == [lev(pattern, t) for t in texts]


def test_typos_and_tree():
    rng = random.Random(1)
    for _ in range(500):
        a, b = word(rng, "ab", 7), word(rng, "abc", 7)
        for most in (0, 1, 2):
            assert typos(a, b, most) == min(swaps(a, b), most + 1)
    words = [word(rng, "ab", 10) for _ in range(150)]
    tree, asked = BKTree(words), words[:20] + ["", "bb"]
    got = {(i, tree.words[w]): d for i, w, d in tree.within(asked, np.full(len(asked), 2))}
    assert got == {(i, w): lev(a, w) for i, a in enumerate(asked) for w in set(words) if lev(a, w) <= 2}
    assert BKTree([]).within(["a"], np.array([1])) == []


# ---- 1 ----


def brute(vectors, k):
    ids = sorted(i for i, v in vectors if v is not None and len(v) == 8 and any(v))
    held = dict((i, np.array(v)) for i, v in vectors if i in ids)
    out = {}
    for i in ids:
        far = sorted((-round(float(held[i] @ held[j] / np.linalg.norm(held[i]) / np.linalg.norm(held[j])), 9), j) for j in ids if j != i)
        out[i] = [j for _, j in far[:k]]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    points = [(i, rng.standard_normal(8).round(3).tolist()) for i in range(300)]
    points += [(1000 + i, points[7][1]) for i in range(9)] + [(2000, None), (2001, []), (2002, [0.0] * 8), (2003, [1.0])]
    df = spark.createDataFrame(points, "item_id long, embedding array<float>").withColumn("key", F.lit("clash")).withColumn("vec", F.lit(1))
    got = {}
    for r in nearest_neighbours(df, dim=8).orderBy("item_id", "rank").collect():
        got.setdefault(r.item_id, []).append(r.neighbour_id)
    want = brute(points, 5)
    assert set(got) == set(want)
    assert all(len(v) == 5 and k not in v for k, v in got.items())
    assert sum(len(set(got[i]) & set(want[i])) for i in want) >= 0.95 * 5 * len(want)
    assert got[1008] == [7, 1000, 1001, 1002, 1003] and got[7] == [1000, 1001, 1002, 1003, 1004]
    pairs = [tuple(r) for r in neighbour_pairs(df, dim=8).collect()]
    assert len(pairs) == len(set(pairs)) and all(a < b for a, b in pairs)
    assert nearest_neighbours(df.filter("false"), dim=8).count() == 0
    assert [r.neighbour_id for r in nearest_neighbours(df.filter("item_id in (1, 2)"), dim=8).orderBy("item_id").collect()] == [2, 1]


# ---- 2 ----


@pytest.mark.parametrize(
    "name, family, given, initials",
    [
        ("Priya R. Nashushofi", "nashushofi", "priya", "r"), ("NASHUSHOFI, Priya R.", "nashushofi", "priya", "r"), ("Nashushofi Priya R.", "nashushofi", "priya", "r"),
        ("Zilarabrur JLS", "zilarabrur", "", "jls"), ("J.-L. Zilarabrur", "zilarabrur", "", "jl"), ("Dr. José C. VAN DER Bramasogi", "vanderbramasogi", "jose", "c"),
        ("Nomazolar DR", "nomazolar", "", "dr"), ("Hana P. Japesotho Kruril", "japesothokruril", "hana", "p"),
    ],
)
def test_parse(name, family, given, initials):
    r = parse(name)
    assert (r[2], r[3], r[4]) == (family, given, initials)


def test_nobody_and_organisations():
    assert all(parse(x) is None for x in ("", " ", "et al.", "Anonymous", "and others", "-", "\xa0"))
    forms = ["Dilikevas Institute of Plant Genomics", "The Dilikevas Inst. of Plant Genomics", "Institute of Plant Genomics (Dilikevas)", "Plant Genomics Institute, Dilikevas"]
    assert len({parse(x)[2:4] for x in forms}) == 1


def test_link_names(spark):
    groups = [
        ["Elizabeth K. Hoshubreko", "HOSHUBREKO, Elizabeth K.", "Hoshubreko Elizabeth K.", "Liz Hoshubreko", "Elizabeth K. Hoshubrekko", "E. K. Hoshubreko", "Elizabeth  Hoshubreko\xa0"],
        ["Gregory Hoshubreko", "gregory hoshubreko", "Hoshubreko, G."],
        ["Richard M. Hulaloshuk", "Hulaloshuk, Richard M."], ["Richard V. Hulaloshuk"],
        ["Dilikevas Institute of Plant Genomics", "Dilikevas Inst. Plant Genom."],
    ]
    names = [(n, "clash") for g in groups for n in g] + [("R. Hulaloshuk", ""), (None, ""), (" ", ""), ("et al.", ""), ("Gregory Hoshubreko", "")]
    df = spark.createDataFrame(names, "name string, entity string")
    nick = spark.createDataFrame([("Liz", "Elizabeth"), (None, "x")], "nick string, given string")
    linked = link_names(df, "name", nick)
    by = {}
    for r in linked.collect():
        by.setdefault(r.entity, set()).add(r.name)
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, [*map(set, groups), {"R. Hulaloshuk"}]))
    pairs = {tuple(r) for r in name_pairs(linked, "name").collect()}
    assert len(pairs) == 21 + 3 + 1 + 1 and all(a < b for a, b in pairs)
    assert link_names(df.filter("false"), "name", nick).count() == 0


def exchanges(df):
    """How often a plan moves rows; each takes a thread of the driver."""
    return sum("Exchange" in line for line in df._jdf.queryExecution().executedPlan().toString().splitlines())


def test_pairs_of_names_have_a_small_plan(spark):
    """The groups are read twice: what they are made of must not be planned and run with the pairs."""
    df = spark.createDataFrame([("Anna Kowalski",), ("A. Kowalski",), ("A. Kowalsky",), ("B. Someone",)], "name string")
    pairs = name_pairs(link_names(df, "name", spark.createDataFrame([("Nan", "Anna")], "nick string, given string")), "name")
    assert exchanges(pairs) <= 6
    assert {tuple(r) for r in pairs.collect()} == {("A. Kowalski", "A. Kowalsky"), ("A. Kowalski", "Anna Kowalski"), ("A. Kowalsky", "Anna Kowalski")}


def test_family_names_are_told_once(monkeypatch):
    """A name's hashes are kept: most of the time over records goes into names seen before."""
    calls, ends = [], works.ends
    monkeypatch.setattr(works, "ends", lambda w: calls.append(w) or ends(w))
    one, two = (works.describe("deep learning for protein folding", ["Zoë Quibblewick", "Ada M. Quibblewick"]) for _ in range(2))
    assert one == two and sorted(calls) == ["quibblewick", "quibblewick", "zoe"]
    assert len(one[8]) == len(set(one[8])) == 2 and len(one[9]) == len(set(one[9])) == 3


def test_usual_names_are_read_quickly(monkeypatch):
    """Usual forms of a name aren't parsed, with the same family name as if they were."""
    usual = [
        "Anna Lorukel", "Anna M. Lorukel", "anna lorukel", "ANNA LORUKEL", "Seo-yeon Lorukel", "Zoë  ØRSTED", "Dr. Anna Lorukel", "A. Lorukel", "A M Lorukel-Kim", "Lorukel, Anna", "Lorukel, A. M.",
        "LØRUKEL, Anna M.", "Lorukel A", "Lorukel Anna M.", "Lorukel-Kim A.", "Straße, Zoë",
    ]
    unusual = ["Lorukel, Jr.", "Þ Lorukel", "Lorukel Survey", "Unknown, A.", "Anna van Lorukel", "Anna Editor", "and others", "Dr. Lab Staff", "Lorukel, Dr", "Prof. Lorukel A."]
    calls, parse = [], works.parse
    monkeypatch.setattr(works, "parse", lambda n: calls.append(n) or parse(n))
    works._family.cache_clear()
    got = {n: works._family(n) for n in usual}
    assert calls == []
    for n, family in (got | {n: works._family(n) for n in unusual}).items():
        r = parse(n)
        assert family == (r and (r[2] if r[1] else f"{min(r[2], r[6])} {max(r[2], r[6])}")), n


def test_slips_are_those_of_the_distance():
    rng = random.Random(2)
    for _ in range(3000):
        a, b = word(rng, "abcé1", 9), word(rng, "abcé1", 9)
        n = min(len(a), len(b))
        assert works._slip(a, b) == (n > 2 and not a.isdigit() and not b.isdigit() and swaps(a, b) <= (1 if n < 6 else 2))


def test_matching_reads_its_tables_once(spark, tmp_path):
    """Whose ids they are is kept with them; the tables aren't read again for it."""
    for name, first in (("left", 0), ("right", 100)):
        records(spark, [(first + i, None, None, t, ["Anna Lorukel"], "2023-01-05") for i, t in enumerate(["Testing polar models of drainage", "Other notes on the layers"])]).write.parquet(f"{tmp_path}/{name}")
    got = match_records(spark.read.parquet(f"{tmp_path}/left"), spark.read.parquet(f"{tmp_path}/right"), "cand_id", "cand_id").toDF("a", "b", "confidence")
    assert not [f for f in got.inputFiles() if str(tmp_path / "left") in f or str(tmp_path / "right") in f]
    assert {(r.a, r.b) for r in got.collect()} == {(0, 100), (1, 101)}


def test_first_of_each_pair():
    rng = np.random.default_rng(3)
    x, y = rng.integers(-3, 3, 200), rng.integers(-(2**62), 2**62, 5)[rng.integers(0, 5, 200)]
    assert cells._once(x, y).tolist() == np.unique(np.stack([x, y], axis=1), axis=0, return_index=True)[1].tolist()
    assert cells._once(x[:0], y[:0]).tolist() == []


def test_accepting_has_small_plans(spark, monkeypatch):
    """What a batch repeats is found once, not once for each of the tables that make up its cells."""
    seen, append = [], History._append
    monkeypatch.setattr(History, "_append", lambda self, df, name: seen.append((name, exchanges(df))) or append(self, df, name))
    rows = [(i, i // 3, f"10.1/{i}", "u", f"deep learning for protein folding {i % 4}", ["A B"], "2020-01-01") for i in range(9)]
    df = spark.createDataFrame(rows, "cand_id long, batch_no long, doi string, identifier string, title string, authors array<string>, published string")
    assert repeats(df, "cand_id", "batch_no", share=0).count() == 8
    assert len(seen) == 12 and max(n for name, n in seen if name == "cells") <= 14


def test_segment_join_finds_all(spark):
    rng = random.Random(5)
    words = sorted({word(rng, "abc", 8) for _ in range(250)})
    df = spark.createDataFrame([(1, w) for w in words], "g int, w string")
    got = {(r.a, r.b) for r in within_one_edit(df, ["g"], "w").collect()}
    long = [w for w in words if len(w) >= 2]
    assert got == {(a, b) for a in long for b in long if a < b and swaps(a, b) <= 1}


@pytest.mark.parametrize("most", [0, 1000])
def test_components(spark, monkeypatch, most):
    from folioscan.llm import links

    monkeypatch.setattr(links, "ONE_TASK_EDGES", most)
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    nodes = spark.createDataFrame([(i,) for i in [*range(41), 100, 101, 500]], "node long")
    roots = {r.node: r.root for r in components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert roots == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 500: 500}


# ---- 3 and 5 ----

RECORD = "cand_id long, doi string, identifier string, title string, authors array<string>, published timestamp"


def records(spark, rows):
    import datetime as dt

    return spark.createDataFrame([(i, d, k, t, a, dt.datetime.fromisoformat(p) if p else None) for i, d, k, t, a, p in rows], RECORD)


ROWS = [
    (1, "10.1234/AB.1 ", "x1", "Testing polar models of layer drainage at Thanihon", ["Anna Lorukel", "B. Tasimo"], "2023-01-05"),
    (2, "https://doi.example/10.1234%2Fab.1", "x2", "other words", None, None),
    (3, None, " X1", None, [], None),
    (4, None, "x4", "[Preprint] Testing polar modles of layer drainage at <i>Thanihon</i>.", ["Lorukel, A."], "2023-01-20"),
    (5, None, "x5", "Correction to: Testing polar models of layer drainage at Thanihon", ["Anna Lorukel"], "2023-03-01"),
    (6, None, "x6", "Testing polar models of layer drainage at Thanihon. Part II", ["Anna Lorukel"], "2023-03-01"),
    (7, None, "x7", "Editorial", ["C. Vumeral", "D. Sotigan"], "2022-01-01"),
    (8, None, "x8", "Editorial", ["C. Vumeral", "D. Sotigan"], "2023-06-01"),
    (9, None, "x9", "editorial ", ["Vumeral C", "Dora Sotigan"], "2022-01-11"),
    (10, "", "", "", [None, ""], None),
    (11, "", "", "", [None, ""], None),
    (12, None, "x12", "Testing polar models of layer drainage at Gukifus", ["Anna Lorukel"], "2023-01-05"),
    (1, "10.1234/AB.1 ", "x1", "Testing polar models of layer drainage at Thanihon", ["Anna Lorukel", "B. Tasimo"], "2023-01-05"),
]


def test_repeats(spark):
    df = records(spark, ROWS).withColumn("print", F.lit(1)).withColumn("root", F.lit("clash"))
    got = sorted(tuple(r) for r in repeats(df, "cand_id").collect())
    # 10 and 11 say nothing, which makes them no copies
    assert got == [(1, 2), (1, 3), (1, 4), (7, 9)]
    assert repeats(df.filter("false"), "cand_id").count() == 0
    # in batches, the one of a null number last, and a single row each
    for batch in (F.when(F.col("cand_id") < 9, F.floor(F.col("cand_id") / 3)), F.col("cand_id"), -F.col("cand_id")):
        parts = repeats(df.withColumn("batch_no", batch), "cand_id", "batch_no", share=0)
        assert sorted(tuple(r) for r in parts.collect()) == got


def test_near_titles_are_all_near(spark):
    """The pivots lose no pair that is near in a view."""
    from folioscan.llm import history

    rng = random.Random(3)
    titles = [" ".join(rng.choice(["", "a", "e"]) + rng.choice(["reef", "soil", "pond", "moor", "peat", "fen"]) for _ in range(rng.randint(1, 7))) for i in range(150)]
    rows = [(i, None, None, t, ["A. Smith"] if i % 5 else [], None) for i, t in enumerate(titles)]
    told = history.with_pivots(described(records(spark, rows), "cand_id")).cache()
    table = history.pivot_rows(told)
    got = {(r.a, r.b): r.views for r in history.near_rows(table, table).filter("a < b").groupBy("a", "b").agg(F.bit_or("views").alias("views")).collect()}
    by = {r.id: r for r in told.collect()}
    for a in by:
        for b in by:
            x, y = by[a], by[b]
            if a < b and x.own_title != y.own_title and x.families and y.families and not x.stock and not y.stock:
                want = sum(1 << v for v in range(3) if history.near([x.words], [y.words], v)[0])
                assert want & got.get((a, b), 0) == want


def test_a_batch_reads_what_it_reaches_and_appends(spark):
    from folioscan.llm.history import History
    from folioscan.llm.linkage import records as as_records

    h = History(spark)
    rows = [(i, None, None, f"Notes on {w} and their uses in the {w}", [f"A. {w}son"], "2020-01-01") for i, w in enumerate(["rivers", "lakes", "soils", "ponds", "fens"])]
    h.accept(as_records(records(spark, rows), "cand_id"))
    first = sorted(r.part for r in spark.read.parquet(f"{h.path}/cells/batch=0").select("part").distinct().collect())
    links = h.accept(as_records(records(spark, [(9, None, None, "Notes on rivres and their uses in the rivers", ["A. Riversson"], None)]), "cand_id"))
    assert [tuple(r) for r in links.collect()] == [(0, 9)]
    assert set(first) - set(h.reached)
    assert h.batches == 2 and spark.read.parquet(f"{h.path}/works/batch=1").count() == 1
    # a copy is a link and no more
    links = h.accept(as_records(records(spark, [(10, None, None, *rows[2][3:])]), "cand_id"))
    assert [tuple(r) for r in links.collect()] == [(2, 10)]


def test_match_records(spark):
    feed = [
        (101, None, None, "testing polar models of layer drainage at thanihon", ["Anna Lorukel"], "2023-01-01"),
        (102, None, None, "Correction to: Testing polar models of layer drainage at Thanihon", ["A. Lorukel"], "2023-03-09"),
        (103, None, None, "Editorial", ["C. Vumeral", "D. Sotigan"], "2023-06-20"), (104, None, None, None, None, None),
        (105, None, None, "Something else of nobody at Kolire", ["Q. Zumer"], "2023-06-20"),
    ]
    right = records(spark, feed).withColumnRenamed("cand_id", "feed_id").drop("doi", "identifier").withColumn("confidence", F.lit("clash"))
    got = {(r.cand_id, r.feed_id): r.confidence for r in match_records(records(spark, ROWS), right, "cand_id", "feed_id").collect()}
    assert set(got) == {(1, 101), (2, 101), (3, 101), (4, 101), (5, 102), (8, 103)}
    assert all(0.4 < c <= 1 for c in got.values())
    assert match_records(records(spark, ROWS), right.filter("false"), "cand_id", "feed_id").count() == 0


@pytest.mark.parametrize("most", [0, 1000])
def test_weak_pairs_are_lifted_by_their_neighbours(spark, monkeypatch, most):
    """Rounds in one task and over tables give the same."""
    from folioscan.llm import linkage, links
    from folioscan.lineage import cut

    monkeypatch.setattr(links, "ONE_TASK_EDGES", most)
    edges = [(1, 2, 0.45), (1, 3, 0.9), (2, 3, 0.45), (4, 5, 0.45), (6, 7, 0.8), (8, 9, 0.3), (8, 10, 0.3), (9, 10, 0.3)]
    got = {(r.a, r.b): round(r.confidence, 3) for r in linkage.refined(cut(spark.createDataFrame(edges, "a long, b long, confidence double"), "scored")).collect()}
    assert got.keys() == {(1, 2), (1, 3), (2, 3), (6, 7)} and got[1, 3] == 0.9
    assert 0.55 < got[1, 2] == got[2, 3] < 0.7


def test_match_common_titles_and_words(spark):
    """More than 400 pairs of one title and author, and only common words beside a damaged beginning."""
    left = [(i, None, None, "Editorial", ["C. Vumeral"], f"{1900 + i}-05-02") for i in range(71, 171)]
    right = [(1000 + i, None, None, "Editorial", ["C. Vumeral"], f"{1900 + i}-05-09") for i in range(71, 171, 10)]
    places = [a + b for a in ("bal", "dor", "gim", "kel", "mun") for b in ("aro", "eti", "ilu", "osa", "uve")]
    left += [(2000 + i, None, None, f"Polar models of layer drainage at {p}", [f"A. {p}son"], "2020-01-01") for i, p in enumerate(places)]
    right += [(3000 + i, None, None, f"Pollar models of layer drainage at x{p[1:]}", [f"A. {p}son"], "2020-01-01") for i, p in enumerate(places)]
    right = records(spark, right).withColumnRenamed("cand_id", "feed_id")
    got = {tuple(r)[:2] for r in match_records(records(spark, left), right, "cand_id", "feed_id").collect()}
    assert got == {(i, 1000 + i) for i in range(71, 171, 10)} | {(2000 + i, 3000 + i) for i in range(len(places))}


def test_match_slips_of_authors_and_bare_titles(spark):
    left = [
        (1, None, None, "Testing polar models of layer drainage at Thanihon", ["Anna Lorukel"], "2023-01-05"),
        *((i, None, None, f"Other {w} of layer drainage", [], None) for i, w in enumerate(("rivers", "lakes", "soils", "ponds", "fens", "bogs"), 2)),
        (9, None, None, "Remarkable notes from layer drainage", ["Q. Zumer"], "2020-01-01"),
    ]
    right = [
        (101, None, None, "Tsting polar models of layer drainage at Thanihon", ["Anna Loruckel"], "2023-01-01"),
        (102, None, None, "Remarkible notes from layer drainage", [], None),
    ]
    right = records(spark, right).withColumnRenamed("cand_id", "feed_id")
    got = {tuple(r)[:2] for r in match_records(records(spark, left), right, "cand_id", "feed_id").collect()}
    assert got == {(1, 101), (9, 102)}


# ---- 4 ----


def test_canonical(spark):
    titles = ["Polar Limnology: Theory & Engineering", "Proceedings of the Gishemuia Society for Molecular Glaciology", "Journal of Coastal Rheology", "Advances in Industrial Agronomy"]
    venues = spark.createDataFrame([*enumerate(titles), (None, "x"), (9, " ")], "venue_id long, title string")
    asked = {
        "polar limnology: theory and  engineering": 0, "Polar Limnology: Theor. &amp; Eng.": 0, "PolarLimnology: Theory & Enigneering": 0, "Proc. Gishem. Soc. Mol. Glaciol.": 1,
        "PGSMG": 1, "Coastal Rheology, Journal of": 2, "The Advances in Industrial Agronomy (47:2)": 3, "Journal of Coastal Mycology": -1, "n/a": -1, "ADVANCES IN INDUSTRIAL AGRONOMY ISSN 1234-567X": 3,
        "Advances in IndustrialAgronomy / X Press": 3,
    }
    df = spark.createDataFrame([(a,) for a in [*asked, *asked, None, " \xa0"]], "venue string").withColumn("venue_id", F.lit("clash"))
    got = map_to_canonical(df, "venue", venues, "venue_id", "title")
    assert {r.venue: r.venue_id for r in got.collect()} == asked and got.count() == len(asked)
    assert {r.venue_id for r in map_to_canonical(df, "venue", venues.filter("false"), "venue_id", "title").collect()} == {-1}


def test_canonical_shards_agree(spark, monkeypatch):
    """Initials of two entries, words that only other entries know, and entries of one shard that look like another's."""
    from folioscan.llm import canonical

    names = ["Journal of Polar Studies", "Journal of Coastal Studies", "Journal of Marine Studies", "Journal of Urban Studies", "Polar Reports Quarterly Annals", "Planetary Research Quantum Acta", "Polar Reports", "Solar Reports", "Polar Records", "Lunar Records"]
    titles = spark.createDataFrame([*enumerate(names)], "venue_id long, title string")
    typed = ["Jornal of Polar Studies", "J. of Urban Studies", "nothing", "PRQA", "Solar Records", "JMS", "Polar Reprots", "polar records", "  "]
    df = spark.createDataFrame([(t,) for t in typed], "venue string")
    whole = {tuple(r) for r in map_to_canonical(df, "venue", titles, "venue_id", "title").collect()}
    assert {t[0]: t[1] for t in whole} == {"Jornal of Polar Studies": 0, "J. of Urban Studies": 3, "nothing": -1, "PRQA": -1, "Solar Records": -1, "JMS": 2, "Polar Reprots": 6, "polar records": 8}
    for size, asked in ((2, 2), (3, 100), (1, 1)):
        monkeypatch.setattr(canonical, "SHARD_ENTRIES", size)
        monkeypatch.setattr(canonical, "ASKED_ROWS", asked)
        assert {tuple(r) for r in map_to_canonical(df, "venue", titles, "venue_id", "title").collect()} == whole


# ---- 6 and 7 ----


def texts():
    rng = random.Random(0)
    parts = list("abst're'vlmd'  \n\t  é漢字١٢½²!?.-_'\"’") + ["'s", "'ll", " 's", "\r\n", "\x85", "​", "\x1c", "😀", "ſ", "\x00"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    return [None, "", " ", "x" * 5000, "ab " * 3000, *made, *("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 60))) for _ in range(500))]


def test_ids_are_the_tokenizers(spark):
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(bpe.DEFAULT_VOCABULARY)
    reference.encode_special_tokens = True
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: r.ids for r in encode_corpus(df).collect()}
    want = reference.encode_batch([t or "" for _, t in rows], add_special_tokens=False)
    assert got == {i: e.ids for (i, _), e in zip(rows, want)}
    assert all(decode(got[i]) == (t or "") for i, t in rows[:200])
    assert {r.doc_id: r.n_tokens for r in count_tokens(df).collect()} == {i: len(v) for i, v in got.items()}
    assert encode_corpus(df.filter("false")).count() == 0


def test_long_texts_in_pieces(monkeypatch):
    from folioscan.llm import tokens

    text = "ab cd " * 500 + "e" * 700 + " fg hi"
    encoder = bpe.Encoder()
    whole = encoder([text])[0].tolist()
    monkeypatch.setattr(tokens, "BATCH_CHARS", 100)
    out = [(a, b, ids.tolist()) for a, b, ids, _ in tokens.encoded(encoder, ["x", text, None, "y"])]
    assert [x for x in out if x[:2] == (1, 2)] == [(1, 2, whole)] and out[0][:2] == (0, 1) and out[-1][1] == 4


def test_packing(spark):
    rng = random.Random(1)
    sizes = [(i, rng.choice([0, rng.randint(1, 300), rng.randint(1, 2048)])) for i in range(3000)] + [(9000, 5000), (9001, 2048), (9002, None), (9003, -4), (None, 7), (5, 11)]
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens int").withColumn("container_id", F.lit("clash"))
    rows = pack(df).collect()
    assert len(rows) == len(sizes) + 2
    fill = {}
    for r in rows:
        fill.setdefault(r.container_id, []).append(r)
        assert 0 <= r.n_tokens <= 2048
    assert all(sum(x.n_tokens for x in v) == v[0].container_tokens <= 2048 for v in fill.values())
    total = sum(max(0, n or 0) for _, n in sizes)
    assert sum(r.n_tokens for r in rows) == total
    assert len(fill) <= 1.02 * total / 2048 + 1
    assert sorted((r.piece, r.token_start, r.n_tokens) for r in rows if r.doc_id == 9000) == [(0, 0, 2048), (1, 2048, 2048), (2, 4096, 904)]
    assert max(r.piece for r in rows if r.doc_id != 9000) == 0
    assert pack(df.filter("false")).count() == 0
    again = {(r.doc_id, r.piece, r.container_id) for r in pack(df.repartition(3)).collect()}
    assert again == {(r.doc_id, r.piece, r.container_id) for r in rows}


# ---- 8 ----


def brute_spans(rows, least):
    seen = {}
    for i, t in rows:
        for s in range(len(t or "") - least + 1):
            seen.setdefault(t[s : s + least], set()).add(i)
    out = set()
    for i, t in rows:
        start = end = None
        for s in range(len(t or "") - least + 1):
            if len(seen[t[s : s + least]]) > 1:
                if start is not None and s <= end:
                    end = s + least
                else:
                    if start is not None:
                        out.add((i, start, end - start))
                    start, end = s, s + least
        if start is not None:
            out.add((i, start, end - start))
    return out


@pytest.mark.parametrize("seed, spread", [(0, 5000), (1, 2)])
def test_shared_spans(spark, monkeypatch, seed, spread):
    rng = random.Random(seed)
    pieces = [word(rng, "abcé漢 ", 60) for _ in range(12)]
    rows = [(i, "".join(rng.choice([word(rng, "abcdef ", 40), rng.choice(pieces)]) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "ab"), (103, rows[3][1]), (104, rows[3][1]), (105, "x" * 300), (106, "x" * 90), (107, "ab" * 500)]
    monkeypatch.setattr(spans, "GROUP_CONTEXTS", spread)
    df = spark.createDataFrame([*rows, (None, rows[5][1])], "doc_id long, text string").withColumn("gram", F.lit("clash"))
    found = shared_spans(df, least=20)
    got = [tuple(r) for r in found.collect()]
    assert set(got) == brute_spans(rows, 20) and len(got) == len(set(got))
    shares = {r.doc_id: r.share for r in shared_shares(df.filter("doc_id is not null"), found).collect()}
    assert shares[100] == shares[101] == 0.0 and 0 <= min(shares.values()) <= max(shares.values()) <= 1 and len(shares) == len(rows)
    assert shared_spans(df.filter("false"), least=20).count() == 0


def test_spans_of_long_texts_in_parts(spark, monkeypatch):
    rng = random.Random(9)
    common = "".join(rng.choice("abcdefgh") for _ in range(400))
    rows = [(1, "".join(rng.choice("abcdefgh") for _ in range(700)) + common), (2, common + "".join(rng.choice("abcdefgh") for _ in range(900)))]
    monkeypatch.setattr(spans, "BATCH_POINTS", 128)
    pieces = list(spans._pieces([t for _, t in rows], 20))
    assert len(pieces) > 10
    assert {tuple(r) for r in shared_spans(spark.createDataFrame(rows, "doc_id long, text string"), least=20).collect()} == brute_spans(rows, 20)
