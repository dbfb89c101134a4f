"""The registered queries of the training-data problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut
from ..tables import table
from .canonical import map_to_canonical
from .history import repeats
from .linkage import match_records
from .names import link_names, name_pairs
from .neighbours import neighbour_pairs
from .packing import pack
from .spans import shared_spans
from .tokens import count_tokens, encode_corpus


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbour_pairs(table(spark, folder, "items", "item_id", "embedding"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    typed = table(spark, folder, "items", "creators").unionAll(table(spark, folder, "candidates", "authors"))
    names = typed.select(F.explode("creators").alias("name"))
    return name_pairs(link_names(names, "name", table(spark, folder, "nicknames", "nick", "given")), "name")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    works = table(spark, folder, "candidates", "cand_id", "doi", "identifier", "title", "authors", "published", "venue")
    feed = table(spark, folder, "feed_works", "feed_id", "title", "authors", "published", "venue")
    return match_records(works, feed, "cand_id", "feed_id").select("cand_id", "feed_id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    venues = table(spark, folder, "venues", "venue_id", "title")
    typed = table(spark, folder, "candidates", "cand_id", "venue").filter(F.col("venue").rlike(r"(?U)\S"))
    typed = typed.join(venues.select(F.col("title").alias("venue")), "venue", "left_anti")
    meant = cut(map_to_canonical(typed, "venue", venues, "venue_id", "title"), "meant")
    return typed.join(meant, "venue").select("cand_id", "venue_id")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return repeats(table(spark, folder, "candidates", "cand_id", "batch_no", "doi", "identifier", "title", "authors", "published", "venue"), "cand_id", "batch_no")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(table(spark, folder, "documents", "doc_id", "text"))


def p7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(count_tokens(table(spark, folder, "documents", "doc_id", "text")))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans(table(spark, folder, "documents", "doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found, "p6_ids": p6_ids, "p7_packing": p7_packing, "p8_found": p8_found}


def oracle_sql() -> dict[str, str]:
    return {}
