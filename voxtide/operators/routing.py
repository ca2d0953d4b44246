"""Routing messages to business lines: tiered keywords, else vector search, else the default route."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtide.config import DEFAULTS, Settings
from voxtide.functions.text import keyword_cell
from voxtide.operators.dedup import best_per_key, top_k


def keyword_table(dictionary: DataFrame) -> DataFrame:
    """(gm_code, goc_product_line, tier, keyword) of rows with delimited ``entity`` and ``action`` cells; entities are tier 1."""
    tiers = F.array(*[F.struct(F.lit(i).alias("tier"), keyword_cell(F.col(c)).alias("keywords")) for i, c in ((1, "entity"), (2, "action"))])
    rows = dictionary.select("gm_code", "goc_product_line", F.explode(tiers).alias("t"))
    return rows.select("gm_code", "goc_product_line", "t.tier", F.explode("t.keywords").alias("keyword")).distinct()


def keyword_route(titles: DataFrame, keywords: DataFrame, k: int = DEFAULTS.text_route_top_k, id_col: str = "id", tokens_col: str = "tokens") -> DataFrame:
    """id, gm_code, goc_product_line, match_count, document, rank: the ``k`` routes with most matched words, by
    entities if any entity matches, else by actions. An equi-join on the word: no title meets a route that shares none."""
    words = titles.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(tokens_col)).alias("keyword"))
    hits = words.join(keywords, "keyword").groupBy("id", "tier", "gm_code", "goc_product_line")
    hits = hits.agg(F.count("*").alias("match_count"), F.array_join(F.array_sort(F.collect_set("keyword")), ", ").alias("document"))
    best = hits.groupBy("id").agg(F.min("tier").alias("tier"))
    order = [F.col("match_count").desc(), F.col("gm_code").asc(), F.col("goc_product_line").asc()]
    return top_k(hits.join(best, ["id", "tier"]), ["id"], order, k, "rank")


def semantic_routes(hits: DataFrame, k: int = DEFAULTS.rerank_top_k) -> DataFrame:
    """Sorted hits, one of each code (the best), the ``k`` best: id, gm_code, score, ..."""
    best = best_per_key(hits, ["id", "gm_code"], "score", "document")
    return top_k(best, ["id"], [F.col("score").desc(), F.col("gm_code").asc()], k, "rank")


def hybrid_route(titles: DataFrame, text_routes: DataFrame, semantic, s: Settings = DEFAULTS, id_col: str = "id") -> DataFrame:
    """id, gm_code, goc_product_line, score, collection_name, document.

    ``semantic``: a function of the titles without a keyword route, which gives scored routes; it never
    sees the others. A title with no route of at least ``route_score`` gets the default one.
    """
    columns = ["id", "gm_code", "goc_product_line", "score", "collection_name", "document"]
    text = text_routes.withColumn("score", F.lit(2.0)).withColumn("collection_name", F.lit("keywords")).select(*columns)
    all_ids = titles.select(F.col(id_col).alias("id"))
    missed = titles.join(text_routes.select(F.col("id").alias(id_col)).distinct(), id_col, "left_anti")
    found = semantic(missed).where(F.col("score") >= s.route_score).select(*columns)
    routed = text.unionByName(found)
    rest = all_ids.join(routed.select("id").distinct(), "id", "left_anti")
    default = rest.select("id", F.lit(s.default_code).alias("gm_code"), F.lit(s.default_line).alias("goc_product_line"), F.lit(-1.0).alias("score"), F.lit("x").alias("collection_name"), F.lit("x").alias("document"))
    return routed.unionByName(default)


def gather_routes(routes: DataFrame) -> DataFrame:
    """id, routes: array of structs, best score first, scores to two digits."""
    one = F.struct((-F.col("score")).alias("o"), "gm_code", "goc_product_line", F.round("score", 2).alias("voice_router_score"), "collection_name", "document")
    rows = routes.groupBy("id").agg(F.array_sort(F.collect_list(one)).alias("r"))
    return rows.select("id", F.transform("r", lambda x: F.struct(*[x[c].alias(c) for c in ("gm_code", "goc_product_line", "voice_router_score", "collection_name", "document")])).alias("routes"))


def filter_routes(voices: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Voices without a blocked code and, where a limit is set, with no more routes than it allows."""
    kept = voices
    if s.blocked_codes:
        kept = kept.where(~F.exists("routes", lambda r: r["gm_code"].isin(*s.blocked_codes)))
    return kept.where(F.size("routes") <= s.max_routes) if s.max_routes is not None else kept
