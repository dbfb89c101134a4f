"""Explicit schemas of records and payloads; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, D, I, B = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType(), T.BooleanType()  # noqa: E741
STRINGS = T.ArrayType(S)


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


LIBRARY = struct(key=S, version=L, title=S, abstract=S, creators=STRINGS, tags=STRINGS, collections=STRINGS, year=I, doi=S, url=S, raw=S, content_hash=S, embedding=T.ArrayType(T.FloatType()), updated_at=T.TimestampType(), ord=L)
CANDIDATE = struct(source=S, identifier=S, title=S, abstract=S, authors=STRINGS, doi=S, url=S, published=T.TimestampType(), venue=S, metrics=T.MapType(S, D), extra=S, ord=L)

LIBRARY_PAGE = struct(
    key=S, version=L,
    data=struct(key=S, version=L, title=S, abstractNote=S, creators=T.ArrayType(struct(firstName=S, lastName=S)), tags=T.ArrayType(struct(tag=S)), collections=STRINGS, date=S, DOI=S, url=S, publicationTitle=S),
)
PUBLIC_PAGE = struct(
    data=T.ArrayType(struct(id=S, source=S, source_identifier=S, title=S, abstract=S, authors=STRINGS, doi=S, url=S, published_at=S, venue=S, metrics=T.MapType(S, S), candidate_type=S, candidate_group=S, updated_at=S)),
    paging=struct(next_offset=L),
)
OPENALEX_PAGE = struct(
    results=T.ArrayType(struct(
        id=S, ids=struct(openalex=S), display_name=S, doi=S, abstract=S, abstract_inverted_index=T.MapType(S, T.ArrayType(I)),
        authorships=T.ArrayType(struct(author=struct(display_name=S))), primary_location=struct(landing_page_url=S, source=struct(display_name=S, url=S)),
        publication_date=S, cited_by_count=D, concepts=T.ArrayType(struct(display_name=S)),
    )),
)
CROSSREF_PAGE = struct(
    message=struct(items=T.ArrayType(T.StructType([
        T.StructField("title", STRINGS), T.StructField("DOI", S), T.StructField("URL", S), T.StructField("author", T.ArrayType(struct(given=S, family=S))),
        T.StructField("abstract", S), T.StructField("created", T.StructType([T.StructField("date-time", S)])), T.StructField("container-title", STRINGS),
        T.StructField("is-referenced-by-count", D), T.StructField("type", S),
    ]))),
)
BIORXIV_PAGE = struct(collection=T.ArrayType(struct(title=S, doi=S, biorxiv_id=S, rel_link=S, url=S, abstract=S, authors=S, date=S, category=S, version=S)))
ARXIV_ENTRY = T.StructType([
    T.StructField("id", S), T.StructField("title", S), T.StructField("summary", S), T.StructField("published", S),
    T.StructField("author", T.ArrayType(struct(name=S))), T.StructField("arxiv:doi", S),
    T.StructField("link", T.ArrayType(struct(_href=S, _rel=S))), T.StructField("arxiv:primary_category", struct(_term=S)),
])
TOMBSTONES = struct(items=STRINGS)
PROFILE = struct(generated_at=S, item_count=L, model=S, centroid=T.ArrayType(D), top_authors=T.ArrayType(struct(author=S, count=L)), top_venues=T.ArrayType(struct(venue=S, count=L)))
JOURNALS = struct(title=S, sjr=S)
