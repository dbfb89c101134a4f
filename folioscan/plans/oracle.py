"""ANSI SQL (as DuckDB runs it) with the results that the core's queries must have."""

from __future__ import annotations

#: White space as the text functions see it, for patterns that know ASCII's only.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
AS_OF = "TIMESTAMP '2024-03-01 00:00:00'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def title(x: str) -> str:
    collapsed = f"regexp_replace(coalesce({x}, ''), '{WS}+', ' ', 'g')"
    return f"lower({strip(collapsed)})"


def ident(x: str) -> str:
    return strip(f"lower(coalesce({x}, ''))")


def iso(x: str) -> str:
    return f"(strftime({x}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({x}) % 1000000 = 0 THEN '' ELSE '.' || lpad(((epoch_us({x}) % 1000000 + 1000000) % 1000000)::VARCHAR, 6, '0') END || '+00:00')"


_JOURNALS = f"""SELECT lower({strip('title')}) AS journal, arg_max(TRY_CAST({strip('sjr')} AS DOUBLE), venue_id) AS sjr FROM venues
WHERE title IS NOT NULL AND {strip('title')} <> '' AND sjr <> '' AND TRY_CAST({strip('sjr')} AS DOUBLE) IS NOT NULL GROUP BY 1"""

_RECENCY = f"""CASE WHEN published IS NULL THEN 0.0
 WHEN greatest(0, floor((epoch_us({AS_OF}) - epoch_us(published)) / 86400000000.0)) <= 30 THEN 1.0
 WHEN greatest(0, floor((epoch_us({AS_OF}) - epoch_us(published)) / 86400000000.0)) <= 180 THEN 0.7
 WHEN greatest(0, floor((epoch_us({AS_OF}) - epoch_us(published)) / 86400000000.0)) <= 720 THEN 0.4 ELSE 0.1 END"""

_CITED = "coalesce(metrics['cited_by'], metrics['is-referenced-by'], 0.0)"
_ALT = "coalesce(metrics['altmetric'], 0.0)"


def ln1(x: str) -> str:
    return f"CASE WHEN isnan({x}) THEN 'nan'::DOUBLE WHEN {x} = 0 THEN 0.0 WHEN {x} > -1 THEN ln(1 + {x}) WHEN {x} = -1 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END"


def shown(x: str) -> str:
    return f"CASE WHEN isnan({x}) THEN 'nan' WHEN isinf({x}) THEN 'inf' ELSE printf('%.6f', {x}) END"


_AUTHORS = "CASE WHEN len(list_filter(coalesce(authors, []), lambda a: lower(a) IN ('gaël jestubashak', 'priya r. nashushofi'))) > 0 THEN 1.0 ELSE 0.0 END"
_VENUE = "CASE WHEN lower(venue) = 'advances in industrial agronomy' THEN 1.0 ELSE 0.0 END"

_SCORED = f"""SELECT c.*, (cand_id % 101) / 101.0::DOUBLE * 0.45 + ({_RECENCY}) * 0.15 + ({ln1(_CITED)}) * 0.15 + ({ln1(_ALT)}) * 0.10
 + coalesce(greatest(1.0, ln(1 + j.sjr)), 1.0) * 0.08 + ({_AUTHORS}) * 0.02 + ({_VENUE}) * 0.05 AS score
 FROM candidates c LEFT JOIN ({_JOURNALS}) j ON j.journal = lower({strip('c.venue')})"""
_LABEL = "CASE WHEN isnan(score) THEN 'ignore' WHEN score >= 0.75 THEN 'must_read' WHEN score >= 0.5 THEN 'consider' ELSE 'ignore' END"


def short(x: str) -> str:
    return f"CASE WHEN length({x}) > 80 THEN {x}[1:80] || '…' ELSE {x} END"


def unescape(x: str) -> str:
    """The references that occur, the ampersand's last."""
    for ref, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", "\xa0"), ("&amp;", "&")):
        x = f"replace({x}, '{ref}', '{char}')"
    return x


_UNTAGGED = f"regexp_replace({unescape('abstract')}, '<[^>]+>', ' ', 'g')"
_COLLAPSED = f"regexp_replace({_UNTAGGED}, '{WS}+', ' ', 'g')"

ORACLE: dict[str, str] = {
    "clean_title": f"SELECT cand_id, {strip('title')} AS title FROM candidates WHERE title IS NOT NULL AND {strip('title')} <> ''",
    "normalize_title": f"SELECT item_id, {title('title')} AS title FROM items",
    "normalize_identifier": f"SELECT cand_id, {ident('identifier')} AS identifier, {ident('doi')} AS doi FROM candidates",
    "year_of": "SELECT item_id, CAST(TRY_CAST(list_filter(string_split(date_text, '-'), lambda x: regexp_full_match(x, '[0-9]+'))[1] AS INTEGER) AS BIGINT) AS pub_year FROM items",
    "clean_abstract": f"SELECT cand_id, nullif({strip(_COLLAPSED)}, '') AS abstract FROM candidates",
    "numeric_metrics": "SELECT event_id, k AS name, TRY_CAST(json_extract_string(props, '$.' || k) AS DOUBLE) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events WHERE props IS NOT NULL) WHERE TRY_CAST(json_extract_string(props, '$.' || k) AS DOUBLE) IS NOT NULL",
    "content_hash": "SELECT item_id, sha256(concat(coalesce(title, ''), coalesce(abstract, ''), coalesce(array_to_string(creators, ','), ''), coalesce(array_to_string(tags, ','), ''))) AS content_hash FROM items",
    "embedding_text_library": r"SELECT item_id, concat_ws(E'\n', nullif(title, ''), nullif(abstract, ''), nullif(array_to_string(creators, '; '), ''), nullif(array_to_string(tags, '; '), '')) AS content FROM items",
    "embedding_text_candidate": r"SELECT cand_id, concat_ws(E'\n', nullif(title, ''), nullif(abstract, ''), nullif(array_to_string(authors, '; '), '')) AS content FROM candidates",
    "parse_dates": r"SELECT item_id, CAST(CASE WHEN regexp_full_match(date_text, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN epoch(TRY_CAST(date_text AS TIMESTAMP)) WHEN regexp_full_match(date_text, '[0-9]{8}') THEN epoch(try_strptime(date_text, '%Y%m%d')) WHEN regexp_full_match(date_text, '[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9:.]+Z?') THEN epoch(TRY_CAST(replace(date_text, 'Z', '') AS TIMESTAMP)) END AS BIGINT) AS epoch FROM items",
    "iso_dates": f"SELECT cand_id, {iso('published')} AS iso FROM candidates",
    "shortened_extra": f"SELECT cand_id, {short('abstract')} AS abstract, {short('title')} AS title FROM candidates",
    "sorted_json": """SELECT cand_id, '{"batch_no":' || batch_no || ',"cand_id":' || cand_id || '}' AS json FROM candidates""",
    "map_public_api": f"""SELECT cand_id, coalesce(nullif(source, ''), 'public-api') AS source, coalesce(nullif(identifier, ''), {strip('title')}) AS identifier, {strip('title')} AS title,
 CAST(len(list_filter(coalesce(authors, []), lambda a: a IS NOT NULL AND {strip('a')} <> '')) AS BIGINT) AS n_authors, epoch_us(published) AS published,
 CAST(coalesce(cardinality(metrics), 0) AS BIGINT) AS n_metrics FROM candidates WHERE title IS NOT NULL AND {strip('title')} <> ''""",
    "map_openalex": f"""SELECT cand_id, coalesce(nullif(identifier, ''), nullif(doi, ''), {strip('title')}) AS identifier, {strip('title')} AS title, venue, url, CAST(batch_no AS DOUBLE) AS cited_by,
 CAST(epoch(CAST(published AS DATE)) AS BIGINT) AS published FROM candidates WHERE title IS NOT NULL AND {strip('title')} <> ''""",
    "map_crossref": f"""SELECT cand_id, coalesce(nullif(doi, ''), url, 'unknown') AS identifier, {strip('title')} AS title, venue, epoch_us(fetched_at) AS published, 0.0::DOUBLE AS cited
 FROM candidates WHERE title IS NOT NULL AND {strip('title')} <> ''""",
    "map_biorxiv": f"""SELECT cand_id, coalesce(nullif(doi, ''), {strip('title')}) AS identifier, {strip('title')} AS title, CASE WHEN doi <> '' THEN 'https://doi.org/' || doi END AS url, 'biorxiv' AS venue,
 CAST(epoch(CAST(published AS DATE)) AS BIGINT) AS published FROM candidates WHERE title IS NOT NULL AND {strip('title')} <> ''""",
    "map_library_item": "SELECT item_id, item_key AS key, item_version AS version, coalesce(title, '') AS title, CAST(len(list_filter(coalesce(tags, []), lambda t: t IS NOT NULL)) AS BIGINT) AS n_tags, CAST(TRY_CAST(list_filter(string_split(date_text, '-'), lambda x: regexp_full_match(x, '[0-9]+'))[1] AS INTEGER) AS BIGINT) AS year, doi, url FROM items",
    "source_union": "SELECT 0::BIGINT AS part, cand_id AS at, source, identifier, title FROM candidates UNION ALL SELECT 1, feed_id, source, identifier, title FROM feed_works",
    "enabled_source_rows": "SELECT lower(source) AS source, count(*) AS n FROM candidates WHERE lower(source) IN ('crossref', 'arxiv', 'biorxiv') GROUP BY 1",
    "distinct_venues_in_order": "SELECT venue FROM candidates WHERE venue <> '' GROUP BY venue ORDER BY min(cand_id)",
    "journal_last_wins": _JOURNALS,
    "anti_library_doi": f"SELECT cand_id FROM candidates c WHERE {ident('doi')} = '' OR NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT {ident('doi')} AS k FROM items) i WHERE i.k = {ident('c.doi')})",
    "anti_library_url": f"SELECT cand_id FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT {ident('url')} AS k FROM items WHERE url <> '') i WHERE i.k = {ident('c.identifier')})",
    "batch_first_wins_key": f"SELECT min(cand_id) AS cand_id, {ident('identifier')} AS key FROM candidates GROUP BY 2",
    "top1_similarity": """WITH lib AS (SELECT list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS v FROM (SELECT embedding::DOUBLE[] AS e FROM items WHERE len(embedding) = 64) WHERE list_sum(list_transform(e, lambda y: y * y)) > 0)
 SELECT vec_id, round(max(list_inner_product(q.embedding::DOUBLE[], lib.v)), 5) AS similarity FROM embeddings q, lib WHERE len(q.embedding) = 64 GROUP BY vec_id""",
    "journal_quality": f"SELECT cand_id, round(coalesce(greatest(1.0, ln(1 + sjr)), 1.0), 9) AS journal_quality, sjr AS journal_sjr FROM candidates c LEFT JOIN ({_JOURNALS}) j ON j.journal = lower({strip('c.venue')})",
    "whitelist_bonus": f"SELECT cand_id, CAST({_AUTHORS} AS DOUBLE) AS author_bonus, CAST({_VENUE} AS DOUBLE) AS venue_bonus FROM candidates",
    "delete_tombstones": "SELECT item_id, item_key FROM items WHERE item_key NOT IN (SELECT item_key FROM tombstones WHERE item_key IS NOT NULL)",
    "top_authors": "WITH x AS (SELECT item_id, unnest(creators) AS author, generate_subscripts(creators, 1) AS p FROM items) SELECT author, count(*) AS count FROM x WHERE author IS NOT NULL GROUP BY author ORDER BY count(*) DESC, min((item_id, p)) LIMIT 20",
    "top_venues": "SELECT publication_title AS venue, count(*) AS count FROM items WHERE publication_title <> '' GROUP BY 1 ORDER BY 2 DESC, min(item_id) LIMIT 20",
    "centroid": "WITH x AS (SELECT unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS place FROM items WHERE len(embedding) = 64), m AS (SELECT place, avg(v) AS m FROM x GROUP BY place) SELECT CAST(place AS BIGINT) AS place, round(m / (SELECT sqrt(sum(m * m)) + 1e-12 FROM m), 6) AS value FROM m",
    "profile_summary": """SELECT '2024-03-01T00:00:00+00:00' AS generated_at, (SELECT count(*) FROM items) AS item_count, 'given' AS model, 64::BIGINT AS dim,
 (WITH x AS (SELECT item_id, unnest(creators) AS author, generate_subscripts(creators, 1) AS p FROM items) SELECT author FROM x WHERE author IS NOT NULL GROUP BY author ORDER BY count(*) DESC, min((item_id, p)) LIMIT 1) AS author,
 (SELECT publication_title FROM items WHERE publication_title <> '' GROUP BY 1 ORDER BY count(*) DESC, min(item_id) LIMIT 1) AS venue""",
    "high_water_mark": "SELECT max(item_version) AS high_water_mark FROM items",
    "ingest_stats": "SELECT (SELECT count(*) FROM items) AS fetched, (SELECT count(*) FROM items) AS updated, (SELECT count(item_key) FROM tombstones) AS removed",
    "recency_score": f"SELECT cand_id, CAST({_RECENCY} AS DOUBLE) AS recency_score FROM candidates",
    "citation_score": f"SELECT cand_id, {shown('c')} AS citation_score, {shown('a')} AS altmetric_score FROM (SELECT cand_id, {ln1(_CITED)} AS c, {ln1(_ALT)} AS a FROM candidates)",
    "score_label": f"SELECT cand_id, {shown('score')} AS score, {_LABEL} AS label FROM ({_SCORED})",
    "recent_filter": f"SELECT cand_id FROM candidates WHERE published >= {AS_OF} - INTERVAL 90 DAY",
    "preprint_quota": """WITH RECURSIVE r AS (SELECT cand_id, row_number() OVER (ORDER BY cand_id) AS i, CASE WHEN lower(source) IN ('arxiv', 'biorxiv', 'medrxiv') THEN 1 ELSE 0 END AS p FROM candidates),
 g AS (SELECT 0::BIGINT AS i, 0::BIGINT AS cand_id, 0 AS kp, 0 AS kt, false AS keep
 UNION ALL SELECT r.i, r.cand_id, kp + CASE WHEN p = 1 AND (kp + 1) * 10 <= (kt + 1) * 3 THEN 1 ELSE 0 END, kt + CASE WHEN p = 0 OR (kp + 1) * 10 <= (kt + 1) * 3 THEN 1 ELSE 0 END, p = 0 OR (kp + 1) * 10 <= (kt + 1) * 3 FROM g JOIN r ON r.i = g.i + 1)
 SELECT cand_id FROM g WHERE keep""",
    "stable_topk": "SELECT o_orderkey, CAST(o_orderpriority[1] AS DOUBLE) AS score FROM orders ORDER BY 2 DESC, 1 LIMIT 50",
    "upsert_latest": "SELECT item_id, item_key, item_version, title FROM (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY item_id DESC) AS rn FROM items) WHERE rn = 1",
    "items_without_vector": "SELECT item_id FROM items WHERE embedding IS NULL",
    "items_with_vector": "SELECT item_id, CAST(len(embedding) AS BIGINT) AS dim FROM items WHERE embedding IS NOT NULL",
    "changed_items": "WITH h AS (SELECT item_id, item_key, sha256(concat(coalesce(title, ''), coalesce(abstract, ''), coalesce(array_to_string(creators, ','), ''), coalesce(array_to_string(tags, ','), ''))) AS x FROM items) SELECT item_id FROM h WHERE NOT EXISTS (SELECT 1 FROM (SELECT item_key, arg_min(x, item_id) AS x FROM h GROUP BY 1) f WHERE f.item_key = h.item_key AND f.x = h.x)",
    "rss_fields": rf"""SELECT title, nullif(url, '') AS link, identifier AS guid, strftime(coalesce(published, {AS_OF}), '%a, %d %b %Y %H:%M:%S') || ' +0000' AS pub_date, nullif(venue, '') AS category,
 concat_ws(E'\n', nullif(abstract, ''), 'Published: ' || coalesce({iso('published')}, 'Unknown'), 'Venue: ' || coalesce(nullif(venue, ''), 'Unknown')) AS description FROM candidates""",
    "html_fields": f"""SELECT coalesce(nullif(url, ''), '#') AS href, title, {_LABEL} AS label, coalesce(strftime(published, '%Y-%m-%d'), 'Unknown') AS date_text, coalesce(nullif(venue, ''), 'Unknown') AS venue_text,
 nullif(abstract, '') AS abstract_text, CASE WHEN len(authors) > 0 THEN array_to_string(authors, ', ') ELSE 'Unknown' END AS authors_text FROM ({_SCORED}) WHERE NOT isnan(score)""",
    "push_notes": """SELECT '{"itemType":"note","note":"Recommended due to score ' || printf('%.3f', (cand_id % 7) / 8.0) || '","tags":[{"tag":"Literature watch"},{"tag":"consider"}],"collections":["AI Suggested"]}' AS note FROM candidates""",
}


def _sets(name: str, rows: str) -> str:
    """CTE: different titles of ``rows`` (column title) as sets of words, with their letters."""
    letters = "list_transform(range(0, 64), lambda i: len(list_filter(string_split(array_to_string(ws, ' '), ''), lambda c: unicode(c) % 64 = i)))"
    return f"""{name} AS MATERIALIZED (SELECT t, ws, array_to_string(ws, ' ') AS j, {letters} AS h FROM
 (SELECT t, list_sort(list_distinct(list_filter(string_split(t, ' '), lambda w: w <> ''))) AS ws FROM (SELECT DISTINCT title AS t FROM ({rows}) WHERE title <> '')) WHERE len(ws) > 0)"""


def _common_letters(a: str, b: str) -> str:
    """Length of the longest common subsequence of two texts: a row of the table for each letter of ``a``."""
    row = f"list_transform(range(1, len({b}) + 1), lambda k: list_max(list_transform(range(1, k + 1), lambda m: greatest(acc[m], (CASE WHEN m > 1 THEN acc[m - 1] ELSE 0 END) + (CASE WHEN x[1] = unicode({b}[m]) THEN 1 ELSE 0 END)))))"
    steps = f"list_concat([list_transform(range(0, len({b})), lambda z: 0::BIGINT)], list_transform(string_split({a}, ''), lambda c: [unicode(c)::BIGINT]))"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE coalesce(list_max(list_reduce({steps}, lambda acc, x: {row})), 0) END"


def _alike(name: str, left: str, right: str, only: str) -> str:
    """CTEs: (a, b) of two CTEs of :func:`_sets` whose token-set ratio is 0.9 or more."""
    return f"""{name}_all AS MATERIALIZED (SELECT x.t AS a, y.t AS b, x.ws AS xw, y.ws AS yw, len(x.j) AS m, len(y.j) AS n, list_intersect(x.ws, y.ws) AS c,
  list_sum(list_transform(range(1, 65), lambda i: least(x.h[i], y.h[i]))) AS l FROM {left} x, {right} y WHERE {only}),
 {name}_some AS MATERIALIZED (SELECT *, len(array_to_string(list_sort(c), ' ')) AS s, array_to_string(list_sort(list_filter(xw, lambda w: NOT list_contains(yw, w))), ' ') AS p,
  array_to_string(list_sort(list_filter(yw, lambda w: NOT list_contains(xw, w))), ' ') AS q FROM {name}_all WHERE 2 * l >= 0.9 * (m + n) OR (len(c) > 0 AND (len(c) = len(xw) OR len(c) = len(yw) OR 2 * (list_sum(list_transform(c, lambda w: len(w))) + len(c) - 1) >= 0.9 * (list_sum(list_transform(c, lambda w: len(w))) + len(c) - 1 + least(m, n))))),
 {name} AS MATERIALIZED (SELECT a, b FROM {name}_some WHERE CASE WHEN len(c) > 0 AND (p = '' OR q = '') THEN TRUE
  WHEN len(c) > 0 AND greatest(2.0 * s / (s + m), 2.0 * s / (s + n)) * 100 / 100 >= 0.9 THEN TRUE
  WHEN 2 * l < 0.9 * (m + n) THEN FALSE
  ELSE 2.0 * ((CASE WHEN len(c) > 0 THEN s + 1 ELSE 0 END) + {_common_letters("p", "q")}) / (m + n) >= 0.9 END)"""


_LIBRARY_TITLES = f"SELECT {title('title')} AS title FROM items"
ORACLE["anti_library_title"] = f"""WITH w AS MATERIALIZED (SELECT cand_id, {title('title')} AS title FROM candidates),
 {_sets("cs", "SELECT title FROM w")}, {_sets("ls", _LIBRARY_TITLES)}, {_alike("near", "cs", "ls", "TRUE")}
 SELECT cand_id FROM w WHERE title NOT IN (SELECT a FROM near)"""

_DEDUPED = f"""WITH RECURSIVE lib AS MATERIALIZED (SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY item_key ORDER BY item_id DESC) = 1),
 w AS MATERIALIZED (SELECT cand_id, nullif({ident('doi')}, '') AS doi, {ident('identifier')} AS k, {title('title')} AS title FROM candidates),
 fresh0 AS MATERIALIZED (SELECT * FROM w WHERE (doi IS NULL OR doi NOT IN (SELECT {ident('doi')} FROM lib WHERE {ident('doi')} <> ''))
  AND k NOT IN (SELECT {ident('url')} FROM lib WHERE url IS NOT NULL AND url <> '')),
 {_sets("cs", "SELECT title FROM fresh0")}, {_sets("ls", f"SELECT {title('title')} AS title FROM lib")}, {_alike("known", "cs", "ls", "TRUE")},
 fresh AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY cand_id) AS i FROM fresh0 WHERE title NOT IN (SELECT a FROM known)),
 {_sets("fs", "SELECT title FROM fresh")}, {_alike("near", "fs", "fs", "x.t < y.t")},
 either_way AS MATERIALIZED (SELECT a, b FROM near UNION ALL SELECT b, a FROM near UNION ALL SELECT t, t FROM fs),
 keys AS MATERIALIZED (SELECT i, k AS e FROM fresh WHERE k IS NOT NULL UNION SELECT i, doi FROM fresh WHERE doi IS NOT NULL),
 meets AS MATERIALIZED (SELECT DISTINCT y.i, x.i AS o FROM keys x JOIN keys y ON x.e = y.e AND x.i < y.i
  UNION SELECT DISTINCT y.i, x.i FROM either_way JOIN fresh x ON x.title = either_way.a JOIN fresh y ON y.title = either_way.b WHERE x.i < y.i),
 earlier AS MATERIALIZED (SELECT fresh.i, coalesce(list(o) FILTER (o IS NOT NULL), []) AS os FROM fresh LEFT JOIN meets ON meets.i = fresh.i GROUP BY fresh.i),
 walk AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL
  SELECT earlier.i, CASE WHEN list_has_any(walk.kept, earlier.os) THEN walk.kept ELSE list_append(walk.kept, earlier.i) END FROM walk JOIN earlier ON earlier.i = walk.i + 1),
 kept_works AS MATERIALIZED (SELECT cand_id FROM fresh WHERE i IN (SELECT unnest(kept) FROM (SELECT kept FROM walk ORDER BY i DESC LIMIT 1)))"""
ORACLE["greedy_dedupe"] = f"{_DEDUPED} SELECT cand_id FROM kept_works"


def _counted(name: str, key: str, rows: str) -> str:
    """CTE: (key, place, value) of the offline encoder's vectors of length one, without zeros; ``rows`` has key and content."""
    words = f"list_filter(regexp_split_to_array(lower(coalesce(content, '')), '{WS}+'), lambda w: w <> '')"
    return f"""{name} AS MATERIALIZED (SELECT {key}, place, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS value FROM
 (SELECT {key}, substr(md5(word), 3, 2) AS place, count(*)::DOUBLE AS n FROM (SELECT {key}, unnest({words}) AS word FROM ({rows})) GROUP BY 1, 2))"""


_SIMILAR = "coalesce(similarity, 0.0)"
_FLAG_SCORE = ORACLE["score_label"].replace("(cand_id % 101) / 101.0::DOUBLE", _SIMILAR)
_FLAG_ROWS = _FLAG_SCORE[_FLAG_SCORE.index("(SELECT c.*") :].rstrip()[1:-1].replace("FROM candidates c", "FROM (SELECT x.*, similarity FROM candidates x JOIN kept_works USING (cand_id) LEFT JOIN nearest USING (cand_id)) c")
ORACLE["watch_flagship"] = f"""{_DEDUPED},
 {_counted("cv", "cand_id", ORACLE["embedding_text_candidate"])},
 {_counted("lv", "item_id", ORACLE["embedding_text_library"].replace("FROM items", "FROM lib"))},
 nearest AS MATERIALIZED (SELECT cand_id, max(s) AS similarity FROM (SELECT cand_id, item_id, sum(cv.value * lv.value) AS s FROM cv JOIN lv USING (place) GROUP BY 1, 2) GROUP BY 1),
 scored AS MATERIALIZED ({_FLAG_ROWS}),
 ranked AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY CASE WHEN isnan(score) THEN NULL ELSE score END DESC NULLS LAST, cand_id) AS i, CASE WHEN lower(source) IN ('arxiv', 'biorxiv', 'medrxiv') THEN 1 ELSE 0 END AS p
  FROM scored WHERE published >= {AS_OF} - INTERVAL 400 DAY),
 quota AS (SELECT 0::BIGINT AS i, 0 AS kp, 0 AS kt, false AS keep
  UNION ALL SELECT r.i, kp + CASE WHEN p = 1 AND (kp + 1) * 10 <= (kt + 1) * 3 THEN 1 ELSE 0 END, kt + CASE WHEN p = 0 OR (kp + 1) * 10 <= (kt + 1) * 3 THEN 1 ELSE 0 END, p = 0 OR (kp + 1) * 10 <= (kt + 1) * 3 FROM quota g JOIN ranked r ON r.i = g.i + 1)
 SELECT cand_id, source, title, CASE WHEN isnan(score) THEN 'nan' WHEN isinf(score) THEN 'inf' ELSE printf('%.4f', score) END AS score,
  CASE WHEN isnan(score) THEN 'ignore' WHEN score >= 0.75 THEN 'must_read' WHEN score >= 0.5 THEN 'consider' ELSE 'ignore' END AS label
 FROM ranked JOIN quota USING (i) WHERE keep ORDER BY i LIMIT 50"""

ORACLE["inverted_abstract"] = f"SELECT cand_id, nullif({strip("array_to_string(list_filter(string_split(coalesce(title, ''), ' '), lambda w: w <> ''), ' ')")}, '') AS abstract FROM candidates"
ORACLE["upsert_keeps"] = """WITH f AS (SELECT item_key, min(item_id) AS first, max(item_id) AS last FROM items GROUP BY 1)
 SELECT l.item_id, l.item_key, l.item_version, l.title, CAST(len(o.embedding) AS BIGINT) AS dim FROM f JOIN items l ON l.item_id = f.last JOIN items o ON o.item_id = f.first"""
ORACLE["set_vectors"] = """WITH v AS (SELECT item_key, CAST(len(embedding) AS BIGINT) AS dim FROM items WHERE len(embedding) = 64 QUALIFY row_number() OVER (PARTITION BY item_key ORDER BY item_id DESC) = 1)
 SELECT item_id, v.dim FROM items LEFT JOIN v USING (item_key) WHERE embedding IS NULL"""
