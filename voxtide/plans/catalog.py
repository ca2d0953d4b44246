"""The registered queries over the test tables, each beside its DuckDB oracle (none where SQL can't express it)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtide import fixtures as fx
from voxtide import job, models
from voxtide.config import Settings
from voxtide.fixtures import with_views
from voxtide.functions import payloads, scoring, text
from voxtide.operators import accounting, baseline, clusters, dedup, matching, routing, snapshot, vector_search
from voxtide.operators.components import connected_components
from voxtide.plans import stages
from voxtide.plans.stages import Rules, clean_and_filter
from voxtide.sources import tables
from voxtide.streaming import worker

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql:
            ORACLES[query.__name__] = sql
        return query

    return add


def at(time: str):
    return F.lit(time).cast("timestamp_ntz")


# Scans and cursors


@register(with_views("voice_source") + "SELECT id, voice_id, title, gmt_create, uid FROM voice_source WHERE id > 5000 ORDER BY id LIMIT 400")
def incremental_scan(spark, sf_dir):
    return tables.incremental_scan(fx.voice_source(spark, sf_dir).select("id", "voice_id", "title", "gmt_create", "uid"), 5000, 400)


@register(with_views("voice_source") + "SELECT id, voice_id, gmt_create FROM voice_source WHERE gmt_create >= TIMESTAMP '2024-01-10' ORDER BY gmt_create, id LIMIT 400")
def initial_scan(spark, sf_dir):
    return tables.initial_scan(fx.voice_source(spark, sf_dir).select("id", "voice_id", "gmt_create"), at("2024-01-10"), 400)


@register(with_views("voice_source") + "SELECT * FROM voice_source WHERE gmt_create >= TIMESTAMP '2024-01-10' AND gmt_create < TIMESTAMP '2024-01-12'")
def time_range_scan(spark, sf_dir):
    return tables.time_range_scan(fx.voice_source(spark, sf_dir), at("2024-01-10"), at("2024-01-12")).orderBy("add_date", "id")


@register(with_views("voice_source") + "SELECT coalesce((SELECT id FROM voice_source WHERE gmt_create >= TIMESTAMP '2024-01-10' ORDER BY gmt_create, id LIMIT 1), 0)::BIGINT AS anchor_id")
def anchor_lookup(spark, sf_dir):
    return tables.anchor_id(fx.voice_source(spark, sf_dir), at("2024-01-10"))


@register(with_views("voice_source") + "SELECT coalesce(max(id), 5000)::BIGINT AS cursor FROM (SELECT id FROM voice_source WHERE id > 5000 ORDER BY id LIMIT 400)")
def cursor_advance(spark, sf_dir):
    return tables.next_cursor(incremental_scan(spark, sf_dir), 5000)


@register(with_views("voice_source") + """SELECT id, voice_id, title AS voice_title, strftime(gmt_create, '%Y-%m-%d %H:%M:%S') AS gmt_create,
    strftime(add_date, '%Y-%m-%d %H:%M:%S') AS add_date, uid FROM voice_source""")  # fmt: skip
def nested_voice_projection(spark, sf_dir):
    good, _ = tables.nested_voices(fx.voice_source(spark, sf_dir))
    return good.select("id", "voice_id", "voice_title", "source_metadata.gmt_create", "source_metadata.add_date", "source_metadata.uid")


@register(with_views("risk_event") + "SELECT risk_event_id, status, risk_event_volume FROM risk_event WHERE risk_event_id IN (SELECT CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_quantity = 50)")
def event_lookup(spark, sf_dir):
    ids = fx.table(spark, sf_dir, "lineitem").where("l_quantity = 50").select(F.col("l_orderkey").cast("string").alias("risk_event_id"))
    return tables.lookup(fx.risk_event(spark, sf_dir), ids, "risk_event_id").select("risk_event_id", "status", "risk_event_volume")


@register(with_views("risk_event") + "SELECT risk_event_id, risk_event_volume FROM risk_event WHERE status = 'active' AND risk_event_id > '5' ORDER BY risk_event_id LIMIT 6000")
def keyset_page(spark, sf_dir):
    return tables.incremental_scan(fx.risk_event(spark, sf_dir).where("status = 'active'").select("risk_event_id", "risk_event_volume"), "5", 6000, "risk_event_id")


@register("SELECT vec_id, label FROM embeddings WHERE label = 3 AND vec_id >= 100 AND vec_id % 4 IN (0, 2)")
def vector_collection_filter(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "embeddings").withColumn("part", F.col("vec_id") % 4)
    return rows.where(tables.vector_filter({"label": 3}, {"vec_id": 100}, {"part": [0, 2]})).select("vec_id", "label")


# Cleaning and rules

RULES = Rules(
    prefixes=(("The ", 40), ("Is ", 30)), any_of=("Apache License", "worthless", "###"), all_of=(("ouaux", "tre"), ("nicht", "ung")),
    all_within=((("ing", "the"), 60),), include_exclude=((("tion",), ("th", "en")),),
)
_MASKED = r"regexp_replace(regexp_replace(regexp_replace(title, '(?i)((?:支付宝|对方|个人|实名)?(?:账号|手机号|手机号码|身份证号|身份证号码)(?:\s*(?:是|为))?)\s*([0-9A-Za-z\*\-@\.]+)', '\1*', 'g'), '\d{5,}', '*', 'g'), '\d+(\.\d+)?元', '*元', 'g')"
_PREFIX = "((starts_with(title, 'The ') AND length(title) <= 40) OR (starts_with(title, 'Is ') AND length(title) <= 30))"
_ANY = "(contains(title, 'Apache License') OR contains(title, 'worthless') OR contains(title, '###'))"
_ALL = "((contains(title, 'ouaux') AND contains(title, 'tre')) OR (contains(title, 'nicht') AND contains(title, 'ung')))"
_WITHIN = "(contains(title, 'ing') AND contains(title, 'the') AND length(title) <= 60)"
_EXCLUDE = "(contains(title, 'tion') AND NOT contains(title, 'th') AND NOT contains(title, 'en'))"
_BAND = "(length(title) > 12 AND length(title) < 80)"


@register(with_views("voice_lines") + f"SELECT id, {_MASKED} AS masked FROM voice_lines")
def mask_pii(spark, sf_dir):
    return fx.voice_lines(spark, sf_dir).select("id", text.mask(F.col("title")).alias("masked"))


def _lines(spark, sf_dir, keep):
    return fx.voice_lines(spark, sf_dir).where(keep(F.col("title"))).select("id", "title")


@register(with_views("voice_lines") + f"SELECT id, title FROM voice_lines WHERE {_BAND}")
def length_band(spark, sf_dir):
    return _lines(spark, sf_dir, text.length_band)


@register(with_views("voice_lines") + f"SELECT id, title FROM voice_lines WHERE NOT {_PREFIX}")
def prefix_len(spark, sf_dir):
    return _lines(spark, sf_dir, lambda t: ~text.prefix_rule(t, RULES.prefixes))


@register(with_views("voice_lines") + f"SELECT id, title FROM voice_lines WHERE NOT {_ANY}")
def or_keywords(spark, sf_dir):
    return _lines(spark, sf_dir, lambda t: ~text.any_keyword(t, RULES.any_of))


@register(with_views("voice_lines") + f"SELECT id, title FROM voice_lines WHERE NOT {_ALL}")
def and_keywords(spark, sf_dir):
    return _lines(spark, sf_dir, lambda t: ~text.all_keywords(t, RULES.all_of))


@register(with_views("voice_lines") + f"SELECT id, title FROM voice_lines WHERE NOT {_WITHIN}")
def keywords_len(spark, sf_dir):
    return _lines(spark, sf_dir, lambda t: ~text.keywords_within(t, RULES.all_within))


@register(with_views("voice_lines") + f"SELECT id, title FROM voice_lines WHERE NOT {_EXCLUDE}")
def include_exclude(spark, sf_dir):
    return _lines(spark, sf_dir, lambda t: ~text.include_exclude(t, RULES.include_exclude))


@register(with_views("voice_lines") + f"SELECT id, title FROM (SELECT id, {_MASKED} AS title FROM voice_lines) WHERE {_BAND} AND NOT ({_PREFIX} OR {_ANY} OR {_ALL} OR {_WITHIN} OR {_EXCLUDE})")
def clean_and_filter_voices(spark, sf_dir):
    return clean_and_filter(fx.voice_lines(spark, sf_dir), RULES).select("id", "title")


@register(with_views("voice_lines") + """, k AS (SELECT unnest(['The ', 'Is ', 'Apache License', 'worthless', '###', 'ouaux', 'tre', 'nicht', 'ung', 'ing', 'the', 'tion', 'th', 'en']) AS keyword)
    SELECT keyword, count(title) AS titles FROM k LEFT JOIN voice_lines ON contains(title, keyword) GROUP BY keyword""")  # fmt: skip
def rule_keywords(spark, sf_dir):
    """The keywords of all rules, and how many titles have each: one narrow pass of sums."""
    words = RULES.keywords()
    sums = fx.voice_lines(spark, sf_dir).agg(*[F.count_if(F.col("title").contains(w)).alias(f"n{i}") for i, w in enumerate(words)])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(w).alias("keyword"), F.col(f"n{i}").alias("titles")) for i, w in enumerate(words)])))


@register(with_views("voice_source") + "SELECT id, title FROM voice_source WHERE id % 11 = 0 OR id % 13 = 0")
def quarantined_voices(spark, sf_dir):
    rows = fx.voice_source(spark, sf_dir).withColumn("voice_id", F.when(F.col("id") % 11 != 0, F.col("voice_id")))
    _, bad = tables.nested_voices(rows.withColumn("gmt_create", F.when(F.col("id") % 13 != 0, F.col("gmt_create"))))
    return bad.select("id", "title")


# Distinct rows


@register(with_views("voice_source") + "SELECT voice_id, id, title FROM voice_source QUALIFY row_number() OVER (PARTITION BY voice_id ORDER BY id) = 1")
def dedup_keep_first(spark, sf_dir):
    return dedup.keep_first(fx.voice_source(spark, sf_dir), "voice_id", "id").select("voice_id", "id", "title")


@register(with_views("voice_source") + "SELECT voice_id, id, title FROM voice_source QUALIFY row_number() OVER (PARTITION BY voice_id ORDER BY id DESC) = 1")
def dedup_keep_last(spark, sf_dir):
    return dedup.keep_last(fx.voice_source(spark, sf_dir), "voice_id", "id").select("voice_id", "id", "title")


@register("SELECT label AS gm_code, vec_id, round(embedding[1]::DOUBLE, 6) AS score FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(embedding[1]::DOUBLE, 6) DESC, vec_id) = 1")
def max_score_per_key(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "embeddings").select(F.col("label").alias("gm_code"), "vec_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("score"))
    return dedup.best_per_key(rows, ["gm_code"], "score", "vec_id")


# Words and routes

DICTIONARY = [("R1", "line_a", "ring,rod", "red^blue"), ("R2", "line_b", " bolt ,gear{x}", None), ("R3", "line_c", "ring^widget", "hot,cold"), ("R4", "line_d", "", "small,,hot")]
_DICTIONARY = "d(gm_code, goc_product_line, entity, action) AS (VALUES ('R1','line_a','ring,rod','red^blue'), ('R2','line_b',' bolt ,gear{x}',NULL), ('R3','line_c','ring^widget','hot,cold'), ('R4','line_d','','small,,hot'))"
_CELL = "list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(coalesce({}, ''), '[^,^{{^}}]+'), lambda x: upper(trim(x))), lambda x: x != '')))"
_KEYWORDS = f"""{_DICTIONARY}, k AS (SELECT gm_code, goc_product_line, 1 AS tier, unnest({_CELL.format('entity')}) AS keyword FROM d
    UNION SELECT gm_code, goc_product_line, 2, unnest({_CELL.format('action')}) FROM d)"""
_TOKENS = "list_slice(list_filter(regexp_extract_all(upper(p_name), '[0-9A-Z一-龥]+'), lambda w: length(w) > 1), 1, 10)"
_HITS = f"""w AS (SELECT DISTINCT p_partkey AS id, unnest({_TOKENS}) AS keyword FROM part),
    h AS (SELECT id, tier, gm_code, goc_product_line, count(*) AS match_count, string_agg(keyword, ', ' ORDER BY keyword) AS document FROM w JOIN k USING (keyword) GROUP BY ALL),
    r AS (SELECT h.*, row_number() OVER (PARTITION BY id ORDER BY match_count DESC, gm_code, goc_product_line) AS rank
          FROM h JOIN (SELECT id, min(tier) AS tier FROM h GROUP BY id) USING (id, tier) QUALIFY rank <= 3)"""


def _dictionary(spark):
    return spark.createDataFrame(DICTIONARY, "gm_code string, goc_product_line string, entity string, action string")


def _titles(spark, sf_dir):
    return fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), text.tokens(F.col("p_name")).alias("tokens"))


@register(f"SELECT p_partkey AS id, array_to_string({_TOKENS}, ' ') AS words FROM part")
def tokenise(spark, sf_dir):
    return _titles(spark, sf_dir).select("id", F.array_join("tokens", " ").alias("words"))


_PART_CELLS = """SELECT p_brand AS gm_code, p_type AS goc_product_line, CASE WHEN p_partkey % 5 != 0 THEN ' ' || replace(p_name, ' ', ',, ') || '{x}' END AS entity,
    p_size || '^' || lower(p_type) || ' ^' || upper(p_type) AS action FROM part"""
_PART_KEYWORDS = f"""d AS ({_PART_CELLS}), k AS (SELECT gm_code, goc_product_line, 1 AS tier, unnest({_CELL.format('entity')}) AS keyword FROM d
    UNION SELECT gm_code, goc_product_line, 2, unnest({_CELL.format('action')}) FROM d)"""


def _cells(spark, sf_dir):
    """A dictionary of brands and types: cells with blanks, empty entries, each delimiter, words in two cases, and nulls."""
    kind = F.col("p_type")
    entity = F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit(",, ")), F.lit("{x}")))
    action = F.concat(F.col("p_size").cast("string"), F.lit("^"), F.lower(kind), F.lit(" ^"), F.upper(kind))
    return fx.table(spark, sf_dir, "part").select(F.col("p_brand").alias("gm_code"), kind.alias("goc_product_line"), entity.alias("entity"), action.alias("action"))


@register(f"WITH {_PART_KEYWORDS} SELECT gm_code, goc_product_line, tier, keyword FROM k")
def keyword_extract(spark, sf_dir):
    return routing.keyword_table(_cells(spark, sf_dir))


def _written(df, name, kind):
    """A source of a kind, in the shared folder."""
    folder = worker.work_folder(df.sparkSession, name)
    getattr(df.write, kind)(folder, **({"header": True} if kind == "csv" else {}))
    return folder


@register(f"WITH {_PART_KEYWORDS} SELECT gm_code, goc_product_line, tier, keyword FROM k")
def keyword_source(spark, sf_dir):
    """``keyword_extract`` over a dictionary that is read from CSV files."""
    return routing.keyword_table(tables.keyword_dictionary(spark, _written(_cells(spark, sf_dir), "keywords.csv", "csv"), "csv"))


@register("SELECT p_partkey AS id, array_to_string(list_slice(list_filter(regexp_extract_all(upper(p_name), '[0-9A-Z一-龥]+'), lambda w: length(w) > 1 AND w NOT IN ('RED', 'HOT', 'PLATE')), 1, 10), ' ') AS words FROM part")
def tokenise_stopwords(spark, sf_dir):
    lines = spark.range(1).select(F.explode(F.array(*[F.lit(w) for w in ("red", " Hot ", "", "PLATE")])).alias("value"))
    skipped = tables.stopwords(spark, _written(lines, "stopwords.txt", "text"))
    return fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(text.tokens(F.col("p_name"), skipped), " ").alias("words"))


#: A user dictionary: words within others, and one over the place of a comma.
WORDS = ["花登无借订", "花登", "败还借", "额支退失", "支退", "订款花", "法登转订", "ring"]
_CUT = "|".join(sorted(WORDS[:-1], key=len, reverse=True)) + "|[0-9A-Z]+|[一-龥]"
_CHINESE = f"c AS (SELECT p_partkey AS id, translate(p_name, 'abcdefghijklmnopqrstuvwxyz ', '{fx.LETTERS}，') AS title FROM part)"
_WORDS = f"list_slice(list_filter(regexp_extract_all(replace(upper(title), '，', ''), '{_CUT}'), lambda w: length(w) > 1), 1, 10)"
_LINES = "l(gm_code, goc_product_line, tier, keyword) AS (VALUES ('C1', 'line_a', 1, '花登无借订'), ('C1', 'line_a', 2, '败还借'), ('C2', 'line_b', 1, '额支退失'), ('C2', 'line_b', 2, '法登转订'))"


def _chinese(spark, sf_dir):
    return fx.chinese_titles(spark, sf_dir).withColumn("tokens", text.tokens(F.col("title"), words=WORDS))


@register(f"WITH {_CHINESE} SELECT id, array_to_string({_WORDS}, ' ') AS words FROM c")
def segment_titles(spark, sf_dir):
    return _chinese(spark, sf_dir).select("id", F.array_join("tokens", " ").alias("words"))


@register(f"""WITH {_CHINESE}, {_LINES}, w AS (SELECT DISTINCT id, unnest({_WORDS}) AS keyword FROM c),
    h AS (SELECT id, tier, gm_code, goc_product_line, count(*) AS match_count, string_agg(keyword, ', ' ORDER BY keyword) AS document FROM w JOIN l USING (keyword) GROUP BY ALL)
    SELECT h.*, row_number() OVER (PARTITION BY id ORDER BY match_count DESC, gm_code, goc_product_line)::INT AS rank FROM h JOIN (SELECT id, min(tier) AS tier FROM h GROUP BY id) USING (id, tier)""")  # fmt: skip
def keyword_route_segmented(spark, sf_dir):
    rows = [("C1", "line_a", "花登无借订", "败还借"), ("C2", "line_b", "额支退失", "法登转订")]
    lines = spark.createDataFrame(rows, "gm_code string, goc_product_line string, entity string, action string")
    return routing.keyword_route(_chinese(spark, sf_dir), routing.keyword_table(lines), 3)


def _text_routes(spark, sf_dir):
    return routing.keyword_route(_titles(spark, sf_dir), routing.keyword_table(_dictionary(spark)), 3)


@register(f"WITH {_KEYWORDS}, {_HITS} SELECT id, tier, gm_code, goc_product_line, match_count, document, rank::INT AS rank FROM r")
def keyword_route_tiered(spark, sf_dir):
    return _text_routes(spark, sf_dir)


_SEMANTIC = """s AS (SELECT p_partkey AS id, 'S' || (p_size % 5) AS gm_code, 'semantic' AS goc_product_line, p_size / 100.0::DOUBLE AS score, 'kb' AS collection_name, p_type AS document
    FROM part WHERE p_partkey NOT IN (SELECT id FROM r) AND p_size / 100.0 >= 0.25)"""
_HYBRID = f"""{_KEYWORDS}, {_HITS}, {_SEMANTIC}, f AS (SELECT id, gm_code, goc_product_line, 2.0::DOUBLE AS score, 'keywords' AS collection_name, document FROM r UNION ALL SELECT * FROM s),
    a AS (SELECT * FROM f UNION ALL SELECT p_partkey, 'default', 'default', -1.0, 'x', 'x' FROM part WHERE p_partkey NOT IN (SELECT id FROM f))"""


def _hybrid(spark, sf_dir):
    def semantic(missed):
        rows = missed.join(fx.table(spark, sf_dir, "part"), missed["id"] == F.col("p_partkey"))
        return rows.select("id", F.concat(F.lit("S"), F.col("p_size") % 5).alias("gm_code"), F.lit("semantic").alias("goc_product_line"), (F.col("p_size") / 100.0).alias("score"), F.lit("kb").alias("collection_name"), F.col("p_type").alias("document"))

    return routing.hybrid_route(_titles(spark, sf_dir), _text_routes(spark, sf_dir), semantic, Settings(route_score=0.25))


@register(f"WITH {_HYBRID} SELECT id, gm_code, goc_product_line, score, collection_name, document FROM a")
def hybrid_route(spark, sf_dir):
    return _hybrid(spark, sf_dir)


@register(f"WITH {_HYBRID} SELECT id, count(*) AS n_routes FROM a GROUP BY id HAVING count(*) <= 1 AND count_if(gm_code IN ('R2', 'S1')) = 0")
def route_filters(spark, sf_dir):
    kept = routing.filter_routes(routing.gather_routes(_hybrid(spark, sf_dir)), Settings(max_routes=1, blocked_codes=("R2", "S1")))
    return kept.select("id", F.size("routes").cast("long").alias("n_routes"))


@register(f"WITH {_HYBRID} SELECT id, gm_code, round(score * 1.23456, 2) AS voice_router_score FROM a")
def route_rounding(spark, sf_dir):
    rows = routing.gather_routes(_hybrid(spark, sf_dir).withColumn("score", F.col("score") * 1.23456))
    return rows.select("id", F.explode("routes").alias("r")).select("id", "r.gm_code", "r.voice_router_score")


class LetterEmbedder:
    """How often each letter of a to z is in a text: vectors that SQL can make, too."""

    def embed(self, texts):
        return [[float(t.count(c)) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts]


class LengthReranker:
    """1 / (1 + difference of lengths)."""

    def scores(self, query, texts):
        return [1 / (1 + abs(len(query) - len(t))) for t in texts]


@register("""WITH h AS (SELECT vec_id % 50 AS id, label AS gm_code, round(embedding[1]::DOUBLE, 6) AS score, CAST(vec_id AS VARCHAR) AS document FROM embeddings),
    b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY id, gm_code ORDER BY score DESC, document) = 1)
    SELECT id, gm_code, score, document, row_number() OVER (PARTITION BY id ORDER BY score DESC, gm_code)::INT AS rank FROM b QUALIFY rank <= 3""")  # fmt: skip
def dedup_by_code(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "embeddings")
    hits = rows.select((F.col("vec_id") % 50).alias("id"), F.col("label").alias("gm_code"), F.round(F.col("embedding")[0].cast("double"), 6).alias("score"), F.col("vec_id").cast("string").alias("document"))
    return routing.semantic_routes(hits, 3)


_LETTERS = "list_transform(string_split('a b c d e f g h i j k l m n o p q r s t u v w x y z', ' '), lambda x: (length(t) - length(replace(t, x, '')))::DOUBLE)"


@register(f"""WITH q AS (SELECT t, {_LETTERS} AS v FROM (SELECT DISTINCT p_name AS t FROM part)), b AS (SELECT id, t, c, {_LETTERS} AS v, part FROM (SELECT p_partkey AS id, p_name AS t, 'S' || (p_size % 7) AS c, p_partkey % 40 AS part FROM part WHERE p_partkey % 20 = 0)),
    n AS (SELECT q.t AS id, b.id AS hit, b.t AS document, c AS gm_code, round(1 / (1.0::DOUBLE + abs(length(q.t) - length(b.t))), 4) AS score,
        row_number() OVER (PARTITION BY q.t, part ORDER BY round(1 - greatest(-1, least(1, list_cosine_similarity(q.v, b.v))), 6), b.id) AS near FROM q, b QUALIFY near <= 5),
    d AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY id, gm_code ORDER BY score DESC, document) = 1)
    SELECT id, gm_code, score, document, row_number() OVER (PARTITION BY id ORDER BY score DESC, gm_code)::INT AS rank FROM d QUALIFY rank <= 3""")  # fmt: skip
def semantic_route(spark, sf_dir):
    part = fx.table(spark, sf_dir, "part")
    titles = part.select(F.col("p_name").alias("id"), F.col("p_name").alias("title")).distinct()
    known = part.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("vec_id"), F.col("p_name").alias("document"), F.concat(F.lit("S"), F.col("p_size") % 7).alias("gm_code"), F.col("p_type").alias("goc_product_line"))
    known = models.embedded(known, "vec_id", "document", LetterEmbedder)
    collections = {f"kb{i}": known.where(F.col("vec_id") % 40 == 20 * i) for i in (0, 1)}
    return stages.semantic_search(titles, collections, LetterEmbedder, LengthReranker).select("id", "gm_code", "score", "document", "rank")


# Vectors

_DISTANCE = "round(1 - greatest(-1, least(1, list_cosine_similarity(q.embedding, b.embedding))), 6)"
_KNN = f"""SELECT q.vec_id AS query_id, b.vec_id AS hit_id, {_DISTANCE} AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DISTANCE}, b.vec_id) AS rank
    FROM cluster_vectors q JOIN risk_event_kb b USING (gm_code) QUALIFY rank <= 10"""


@register(with_views("risk_event_kb", "cluster_vectors") + f"SELECT query_id, hit_id, distance, rank::INT AS rank FROM ({_KNN})")
def knn_topk(spark, sf_dir):
    return vector_search.knn(fx.cluster_vectors(spark, sf_dir), fx.risk_event_kb(spark, sf_dir), 10, "gm_code").select("query_id", "hit_id", "distance", "rank")


@register(with_views("risk_event_kb", "cluster_vectors") + f"""SELECT query_id, hit_id, distance, collection_name FROM (SELECT q.vec_id AS query_id, b.vec_id AS hit_id, {_DISTANCE} AS distance, 'kb' || (b.vec_id % 3) AS collection_name,
    row_number() OVER (PARTITION BY q.vec_id, b.vec_id % 3 ORDER BY {_DISTANCE}, b.vec_id) AS rank FROM cluster_vectors q JOIN risk_event_kb b USING (gm_code) QUALIFY rank <= 3)""")  # fmt: skip
def knn_multi_collection(spark, sf_dir):
    base = fx.risk_event_kb(spark, sf_dir)
    parts = {f"kb{i}": base.where(F.col("vec_id") % 3 == i) for i in range(3)}
    return vector_search.multi_collection_knn(fx.cluster_vectors(spark, sf_dir), parts, 10, "gm_code").select("query_id", "hit_id", "distance", "collection_name")


@register(with_views("risk_event_kb", "cluster_vectors") + f""", k AS ({_KNN}), s AS (SELECT query_id AS cluster_id, hit_id AS risk_event_id, rank AS near, round(1 / (1.0::DOUBLE + abs(length('cluster ' || query_id) - length('event no ' || hit_id * hit_id))), 4) AS score FROM k)
    SELECT cluster_id, risk_event_id, 'event no ' || risk_event_id * risk_event_id AS risk_event_title, score, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, near)::INT AS rank FROM s QUALIFY rank <= 3""")  # fmt: skip
def rerank_topk(spark, sf_dir):
    query = fx.cluster_vectors(spark, sf_dir).select(F.col("vec_id").alias("cluster_id"), "gm_code", F.concat(F.lit("cluster "), "vec_id").alias("title"), "embedding")
    title = F.concat(F.lit("event no "), F.col("vec_id") * F.col("vec_id"))
    known = fx.risk_event_kb(spark, sf_dir).select(F.col("vec_id").alias("risk_event_id"), "gm_code", title.alias("risk_event_title"), "embedding")
    return stages.reranked_candidates(query, known, LengthReranker)


_PAIRS = f"""e AS (SELECT vec_id, label, embedding::DOUBLE[] AS embedding FROM embeddings),
    p AS (SELECT q.vec_id AS a, b.vec_id AS b, q.label AS label, {_DISTANCE} AS distance FROM e q JOIN e b ON q.label = b.label AND q.vec_id < b.vec_id WHERE {_DISTANCE} < 0.7)"""
_COMPONENTS = f"""{_PAIRS}, u AS (SELECT a AS x, b AS y FROM p UNION SELECT b, a FROM p),
    reach(id, node) AS (SELECT vec_id, vec_id FROM e UNION SELECT reach.id, u.y FROM reach JOIN u ON u.x = reach.node), c AS (SELECT id, min(node) AS component FROM reach GROUP BY id)"""


def _similar(spark, sf_dir):
    return vector_search.similarity_pairs(fx.table(spark, sf_dir, "embeddings"), 0.7, "label")


@register(f"WITH {_PAIRS} SELECT a, b, label, distance FROM p")
def similarity_pairs(spark, sf_dir):
    return _similar(spark, sf_dir)


@register(f"WITH RECURSIVE {_COMPONENTS} SELECT id, component FROM c")
def components(spark, sf_dir):
    return connected_components(fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")), _similar(spark, sf_dir))


@register(f"WITH RECURSIVE {_COMPONENTS} SELECT id, 'evt' || substr(sha256(concat_ws('|', label, component)), 1, 24) AS cluster_id FROM c JOIN e ON e.vec_id = c.id")
def cluster_labels(spark, sf_dir):
    nodes = fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return connected_components(nodes, _similar(spark, sf_dir)).select("id", text.stable_id("evt", F.col("label"), F.col("component")).alias("cluster_id"))


@register()
def lsh_pairs(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "embeddings")
    dim = len(rows.first()["embedding"])
    return vector_search.lsh_pairs(rows, 0.7, "label", dim, recall=0.95, bits=4)


@register(f"WITH {_PAIRS} SELECT count(*) AS exact, 0 AS wrong, true AS enough, true AS fewer FROM p")
def lsh_recall(spark, sf_dir):
    """``lsh_pairs`` held against the exact pairs: none is wrong, nine in ten are found, and fewer pairs are compared than all that are possible."""
    rows = fx.table(spark, sf_dir, "embeddings")
    dim = len(rows.first()["embedding"])
    tables = vector_search.tables_for(0.7, 4, 0.95)
    exact = _similar(spark, sf_dir).select("a", "b", F.lit(1).alias("exact"))
    found = vector_search.lsh_pairs(rows, 0.7, "label", dim, recall=0.95, bits=4).select("a", "b", F.lit(1).alias("found"))
    counts = exact.join(found, ["a", "b"], "full").agg(F.count("exact").alias("exact"), F.count_if(F.col("exact").isNull()).cast("int").alias("wrong"), F.count("found").alias("found"))
    tried = vector_search.lsh_tried(rows, "label", dim, tables, 4).select("tried")
    every = rows.groupBy("label").count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2).alias("every"))
    together = counts.unionByName(tried, allowMissingColumns=True).unionByName(every, allowMissingColumns=True)
    return together.agg(*[F.max(c).alias(c) for c in together.columns]).select("exact", "wrong", (F.col("found") >= 0.9 * F.col("exact")).alias("enough"), (F.col("tried") < F.col("every")).alias("fewer"))


# Titles without a cluster


@register(with_views("voice_lines") + "SELECT 'unc' || substr(sha256(t), 1, 24) AS event_id, t AS title, count(*) AS voices FROM (SELECT trim(title, '。,，.!') AS t FROM voice_lines) WHERE t != '' GROUP BY t")
def unclustered_dedup(spark, sf_dir):
    rows = fx.voice_lines(spark, sf_dir).select(F.btrim("title", F.lit("。,，.!")).alias("title")).where("title != ''")
    return rows.groupBy("title").agg(F.count("*").alias("voices")).withColumn("event_id", text.stable_id("unc", F.col("title")))


@register(with_views("voice_lines") + r"""SELECT voice_channel, gm_code, arg_min(clean, (length(clean), id)) AS fallback_title FROM (SELECT *, coalesce(nullif(regexp_replace(title, '[，,。!！？?；;\s]+', '', 'g'), ''), title) AS clean FROM voice_lines) GROUP BY ALL""")
def fallback_title(spark, sf_dir):
    clean = text.fallback_title(F.col("title"))
    return fx.voice_lines(spark, sf_dir).groupBy("voice_channel", "gm_code").agg(F.min_by(clean, F.struct(F.length(clean), "id")).alias("fallback_title"))


# Clusters


@register(f"""WITH {_HYBRID}, o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY -score, gm_code) AS i FROM a)
    SELECT gm_code, count(*) AS voices, coalesce(arg_max(goc_product_line, id), 'unknown') AS goc_product_line FROM o WHERE i = 1 GROUP BY gm_code""")  # fmt: skip
def primary_codes(spark, sf_dir):
    return clusters.primary_codes(routing.gather_routes(_hybrid(spark, sf_dir)))


@register("SELECT n_regionkey, array_to_string(list_slice(list_sort(list(DISTINCT n_name)), 1, 3), '|') AS contexts FROM nation GROUP BY 1")
def context_summaries(spark, sf_dir):
    rows = clusters.context_summaries(fx.table(spark, sf_dir, "nation"), ["n_regionkey"], "n_name", 3)
    return rows.select("n_regionkey", F.array_join("context_summaries", "|").alias("contexts"))


_SPLIT = '{"summaries":[{"text":"first","original_indices":[0,1,2]},{"text":"second","original_indices":[2,3,4,77]}]}'


@register("""WITH m AS (SELECT n_regionkey AS cluster_id, n_nationkey AS id, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS pos FROM nation),
    f AS (SELECT cluster_id, arg_min(regexp_replace(n_name, '[，,。!！？?；;\\s]+', '', 'g'), (length(regexp_replace(n_name, '[，,。!！？?；;\\s]+', '', 'g')), pos)) AS fallback FROM m GROUP BY 1)
    SELECT cluster_id, id, CASE WHEN cluster_id = 0 THEN 1 ELSE 0 END AS success, CASE WHEN cluster_id != 0 THEN fallback WHEN pos >= 2 THEN 'second' ELSE 'first' END AS batch_cluster_title,
        'sub' || substr(sha256(concat_ws('|', cluster_id, CASE WHEN cluster_id = 0 AND pos >= 2 THEN 1 ELSE 0 END)), 1, 24) AS sub_cluster_id FROM m JOIN f USING (cluster_id)""")  # fmt: skip
def cluster_split(spark, sf_dir):
    n = fx.table(spark, sf_dir, "nation")
    first = n.select(F.col("n_regionkey").alias("cluster_id"), F.col("n_nationkey").alias("id"), F.col("n_name").alias("title"))
    members = dedup.top_k(first, ["cluster_id"], [F.col("id").asc()], 2**31 - 1, "rank").withColumn("pos", (F.col("rank") - 1).cast("int")).drop("rank")
    answers = first.select("cluster_id").distinct().withColumn("answer", F.when(F.col("cluster_id") == 0, _SPLIT).when(F.col("cluster_id") == 1, '{"summaries":[{"text":"x","original_indices":[0]}]}'))
    return clusters.split(members, answers)


@register("SELECT o_orderkey AS id, 'UNCLUSTERED' AS batch_cluster_id, false AS batch_cluster_success FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def unclustered_complement(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return clusters.unclustered(orders, fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id")))


@register("SELECT DISTINCT p_name FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size > 45)")
def embedding_cache_misses(spark, sf_dir):
    part = fx.table(spark, sf_dir, "part")
    return clusters.cache_misses(part, part.where("p_size > 45").select("p_name").distinct(), "p_name")


@register("""SELECT p_brand AS cluster_id, p_type AS gm_code, p_name AS title, count(*) AS voices FROM part WHERE p_size % 5 != 0 AND p_size % 7 != 0 AND p_type != 'ECONOMY' GROUP BY ALL""")
def search_tasks(spark, sf_dir):
    part = fx.table(spark, sf_dir, "part")
    code = F.when(F.col("p_type") != "ECONOMY", F.col("p_type")).otherwise("unknown")
    voices = part.select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 5 != 0, F.col("p_brand")).otherwise("UNCLUSTERED").alias("batch_cluster_id"),
        F.when(F.col("p_size") % 7 != 0, F.col("p_name")).otherwise("").alias("batch_cluster_title"), code.alias("gm_code"),
    )
    return matching.search_tasks(voices)[0]


# Matching

NOW = "2001-08-01"
MATCH = Settings(decay_per_day=0.0005, decision_score=0.15, false_positive_distance=0.62)
_SCORED = f"""k AS ({_KNN.replace(", 6)", ", 9)")}), act AS (SELECT o_orderkey AS hit_id, o_orderdate AS last_active FROM orders WHERE o_orderkey % 3 = 0),
    d AS (SELECT query_id, hit_id, rank, round(1 - distance, 9) AS score, CASE WHEN last_active IS NULL THEN 14.0 ELSE greatest(epoch(TIMESTAMP '{NOW}') - epoch(last_active), 0) / 86400.0 END AS days FROM k LEFT JOIN act USING (hit_id)),
    s AS (SELECT query_id AS cluster_id, hit_id AS risk_event_id, score, round(exp(-0.0005 * days), 4) AS time_decay_factor, round(score * exp(-0.0005 * days), 4) + 0.0 AS decision_score, rank FROM d),
    sr AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY decision_score DESC, rank) AS decision_rank FROM s)"""
_FP = f"fp AS (SELECT q.vec_id AS cluster_id, min({_DISTANCE}) AS fp_distance FROM cluster_vectors q JOIN risk_event_kb b USING (gm_code) WHERE b.vec_id % 6 = 0 GROUP BY 1)"
_DECIDED = f"""{_SCORED}, {_FP}, o AS (SELECT q.vec_id AS cluster_id, t.risk_event_id AS top_id, t.decision_score AS top_score, fp_distance,
    CASE WHEN fp_distance <= 0.62 THEN 'suppress_as_false_positive' WHEN t.decision_score IS NULL THEN 'create_new:no_candidates' WHEN t.decision_score < 0.15 THEN 'create_new:below_threshold'
         WHEN q.vec_id % 4 = 0 THEN 'create_new:no_context' ELSE 'ask' END AS outcome
    FROM cluster_vectors q LEFT JOIN (SELECT * FROM sr WHERE decision_rank = 1) t ON t.cluster_id = q.vec_id LEFT JOIN fp ON fp.cluster_id = q.vec_id)"""
_MATCH = with_views("risk_event_kb", "cluster_vectors") + ", "


def _scored(spark, sf_dir):
    hits = vector_search.knn(fx.cluster_vectors(spark, sf_dir), fx.risk_event_kb(spark, sf_dir), 10, "gm_code", digits=9)
    candidates = hits.select(F.col("query_id").alias("cluster_id"), F.col("hit_id").alias("risk_event_id"), F.round(1 - F.col("distance"), 9).alias("score"), "rank")
    activity = fx.table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("risk_event_id"), F.col("o_orderdate").alias("last_active_timestamp"))
    return matching.decision_scores(candidates, activity, at(NOW), MATCH)


def _decided(spark, sf_dir):
    wrong = vector_search.knn(fx.cluster_vectors(spark, sf_dir), fx.risk_event_kb(spark, sf_dir).where("vec_id % 6 = 0"), 1, "gm_code")
    clusters = fx.cluster_vectors(spark, sf_dir).select(F.col("vec_id").alias("cluster_id"), F.when(F.col("vec_id") % 4 == 0, 0).otherwise(1).alias("contexts"))
    return matching.decisions(clusters, _scored(spark, sf_dir), wrong.select(F.col("query_id").alias("cluster_id"), F.col("distance").alias("fp_distance")), MATCH)


@register(_MATCH + f"{_SCORED} SELECT cluster_id, risk_event_id, score, time_decay_factor, decision_score, decision_rank::INT AS decision_rank FROM sr")
def time_decay_rank(spark, sf_dir):
    return _scored(spark, sf_dir).select("cluster_id", "risk_event_id", "score", "time_decay_factor", "decision_score", "decision_rank")


@register(_MATCH + f"{_DECIDED} SELECT cluster_id, top_id, top_score, fp_distance, outcome FROM o")
def decision_gate(spark, sf_dir):
    return _decided(spark, sf_dir).select("cluster_id", "top_id", "top_score", "fp_distance", "outcome")


@register(_MATCH + f"{_FP} SELECT cluster_id, fp_distance FROM fp WHERE fp_distance <= 0.62")
def fp_suppress(spark, sf_dir):
    return _decided(spark, sf_dir).where("outcome = 'suppress_as_false_positive'").select("cluster_id", "fp_distance")


@register(_MATCH + f"""{_DECIDED} SELECT cluster_id, CASE WHEN outcome = 'ask' THEN 'merge' ELSE split_part(outcome, ':', 1) END AS decision,
    CASE WHEN outcome = 'ask' THEN CAST(top_id AS VARCHAR) ELSE CAST(cluster_id AS VARCHAR) END AS final_event_id FROM o""")  # fmt: skip
def final_event_id(spark, sf_dir):
    scored = _scored(spark, sf_dir).withColumn("risk_event_id", F.col("risk_event_id").cast("string"))
    decided = _decided(spark, sf_dir).withColumn("top_id", F.col("top_id").cast("string"))
    return matching.resolve(decided, None, scored, MATCH).select("cluster_id", "decision", "final_event_id")


@register(with_views("risk_event") + "SELECT risk_event_id FROM risk_event WHERE status = 'active' AND initial_timestamp >= TIMESTAMP '2000-06-01' - INTERVAL 14 DAY AND gm_code = '1-URGENT' AND 'feedback' = 'feedback'")
def kb_filter(spark, sf_dir):
    rows = fx.risk_event(spark, sf_dir).withColumn("data_source", F.lit("feedback"))
    return rows.where(matching.kb_filter(at("2000-06-01"), code="1-URGENT", source="feedback")).select("risk_event_id")


# Accounting

_RECENT = "TIMESTAMP '2024-01-20 12:00:00'"


@register(with_views("voice_source") + f"SELECT id, gmt_create FROM voice_source WHERE gmt_create >= {_RECENT} - INTERVAL 6 HOUR")
def age_filter(spark, sf_dir):
    return accounting.countable(fx.voice_source(spark, sf_dir), at("2024-01-20 12:00:00")).select("id", "gmt_create")


_DELTAS = "d AS (SELECT risk_event_id, count(*) AS delta, min(voice_date) AS first_time FROM voice_mapping WHERE voice_date >= TIMESTAMP '2000-01-01' GROUP BY 1), known AS (SELECT * FROM risk_event WHERE CAST(risk_event_id AS BIGINT) % 3 != 0)"


def _deltas(spark, sf_dir):
    voices = fx.voice_mapping(spark, sf_dir).where(F.col("voice_date") >= at("2000-01-01")).withColumn("title", F.lit("t"))
    return accounting.rollup(voices, order="voice_id", time_col="voice_date"), fx.risk_event(spark, sf_dir).where(F.col("risk_event_id").cast("long") % 3 != 0)


@register(with_views("risk_event", "voice_mapping") + f", {_DELTAS} SELECT risk_event_id, delta, risk_event_id IN (SELECT risk_event_id FROM known) AS known FROM d")
def new_vs_existing(spark, sf_dir):
    new, old = accounting.split_known(*_deltas(spark, sf_dir))
    return new.withColumn("known", F.lit(False)).unionByName(old.withColumn("known", F.lit(True))).select("risk_event_id", "delta", "known")


@register(with_views("risk_event", "voice_mapping") + f""", {_DELTAS} SELECT risk_event_id, CAST(coalesce(risk_event_volume, 0) + coalesce(delta, 0) AS BIGINT) AS risk_event_volume,
    CASE WHEN k.risk_event_id IS NULL THEN first_time WHEN d.risk_event_id IS NOT NULL THEN TIMESTAMP '2001-01-01' ELSE initial_timestamp END AS last_active_timestamp
    FROM known k FULL JOIN d USING (risk_event_id)""")  # fmt: skip
def volume_merge(spark, sf_dir):
    deltas, events = _deltas(spark, sf_dir)
    state = events.withColumn("last_active_timestamp", F.col("initial_timestamp"))
    return accounting.merge_volumes(state, deltas, at("2001-01-01")).select("risk_event_id", "risk_event_volume", "last_active_timestamp")


@register(with_views("voice_source") + "SELECT uid AS risk_event_id, count(*) AS delta, arg_min(title, id) AS risk_event_title, min(gmt_create) AS first_time FROM voice_source GROUP BY uid")
def event_rollup(spark, sf_dir):
    return accounting.rollup(fx.voice_source(spark, sf_dir).withColumnRenamed("uid", "risk_event_id"))


@register(with_views("voice_mapping") + "SELECT risk_event_id, count(voice_id) AS incremental_volume FROM voice_mapping WHERE voice_date >= TIMESTAMP '2000-06-01' - INTERVAL 720 HOUR GROUP BY 1")
def incremental_volume(spark, sf_dir):
    return accounting.incremental_volume(fx.voice_mapping(spark, sf_dir), at("2000-06-01"), Settings(alert_window_hours=720))


@register(with_views("voice_source") + "SELECT id, uid, gmt_create, count(*) OVER (PARTITION BY uid ORDER BY CAST(epoch_us(gmt_create) // 1000000 AS BIGINT) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS volume FROM voice_source")
def rolling_1h_volume(spark, sf_dir):
    return accounting.rolling_volume(fx.voice_source(spark, sf_dir), 3600, "uid", "gmt_create", "id")


# Snapshots

_LATEST = "greatest(coalesce(initial_timestamp, TIMESTAMP '1970-01-01'), coalesce(threshold_breach_timestamp, TIMESTAMP '1970-01-01'), coalesce(last_alerted_timestamp, TIMESTAMP '1970-01-01'))"


@register(with_views("risk_event") + f"SELECT risk_event_id, risk_event_volume FROM risk_event WHERE status = 'active' AND {_LATEST} >= TIMESTAMP '2001-06-01'")
def active_events(spark, sf_dir):
    return snapshot.active_events(fx.risk_event(spark, sf_dir), at("2001-06-01")).select("risk_event_id", "risk_event_volume")


@register(with_views("volume_timeline") + "SELECT risk_event_id, max(snapshot_time) AS last_snapshot FROM volume_timeline GROUP BY 1")
def last_snapshot(spark, sf_dir):
    return snapshot.last_snapshots(fx.volume_timeline(spark, sf_dir))


@register(with_views("risk_event", "voice_mapping") + f""", tl AS (SELECT risk_event_id, max(initial_timestamp + INTERVAL 30 DAY) AS last_snapshot FROM risk_event WHERE CAST(risk_event_id AS BIGINT) % 2 = 0 GROUP BY 1),
    act AS (SELECT * FROM risk_event LEFT JOIN tl USING (risk_event_id) WHERE status = 'active' AND {_LATEST} >= TIMESTAMP '1999-01-01')
    SELECT a.risk_event_id, TIMESTAMP '2000-06-01' AS snapshot_time, any_value(a.risk_event_volume) AS volume_at_snapshot, count(m.voice_id) AS incremental_volume_at_snapshot
    FROM act a LEFT JOIN voice_mapping m ON m.risk_event_id = a.risk_event_id AND m.voice_date <= TIMESTAMP '2000-06-01'
     AND CASE WHEN a.last_snapshot IS NOT NULL THEN m.voice_date > a.last_snapshot ELSE m.voice_date >= a.initial_timestamp END GROUP BY 1""")  # fmt: skip
def snapshot_increment(spark, sf_dir):
    events = fx.risk_event(spark, sf_dir)
    timeline = events.where(F.col("risk_event_id").cast("long") % 2 == 0).select("risk_event_id", (F.col("initial_timestamp") + F.expr("INTERVAL 30 DAYS")).alias("snapshot_time"))
    return snapshot.snapshot(events, timeline, fx.voice_mapping(spark, sf_dir), at("2000-06-01"), cutoff=at("1999-01-01"))


# Alerts

BASE = Settings(baseline_days=7, baseline_std_floor=0.5, alert_min_incremental=3)
_GRID = """g AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-09', TIMESTAMP '2024-01-30', INTERVAL 1 HOUR)) AS as_of), c AS (SELECT DISTINCT event_type AS risk_event_id, as_of FROM events, g),
    t AS (SELECT risk_event_id, CAST(ceil(epoch_us(snapshot_time) / 3600000000.0) AS BIGINT) AS hour, CAST(sum(incremental_volume_at_snapshot) AS BIGINT) AS n FROM volume_timeline GROUP BY 1, 2),
    v AS (SELECT risk_event_id, as_of, day, coalesce(n, 0) AS n FROM c, (SELECT unnest(range(0, 8)) AS day) LEFT JOIN t USING (risk_event_id)
          WHERE false),
    x AS (SELECT c.risk_event_id, c.as_of, d.day, coalesce(t.n, 0) AS n FROM c CROSS JOIN (SELECT unnest(range(0, 8)) AS day) d LEFT JOIN t ON t.risk_event_id = c.risk_event_id AND t.hour = CAST(epoch_us(c.as_of) // 3600000000 AS BIGINT) - 24 * d.day),
    y AS (SELECT risk_event_id, as_of, max(n) FILTER (day = 0) AS volume, avg(n) FILTER (day > 0) AS mean, coalesce(stddev_samp(n) FILTER (day > 0), 0) AS std FROM x GROUP BY 1, 2),
    z AS (SELECT *, greatest(mean + 2 * greatest(std, 0.5), 3.0) AS threshold FROM y)"""
_GRID = _GRID[: _GRID.index("    v AS")] + _GRID[_GRID.index("    x AS") :]


def _checks(spark, sf_dir):
    hours = spark.range(1).select(F.explode(F.sequence(at("2024-01-09"), at("2024-01-30"), F.expr("INTERVAL 1 HOUR"))).alias("as_of"))
    codes = fx.table(spark, sf_dir, "events").select(F.col("event_type").alias("risk_event_id")).distinct()
    return codes.join(F.broadcast(hours)).withColumn("gm_code", F.col("risk_event_id"))  # one row per hour of the grid


def _judged(spark, sf_dir, s=BASE):
    return baseline.judged(baseline.history(_checks(spark, sf_dir), fx.volume_timeline(spark, sf_dir), s), s)


@register(with_views("volume_timeline") + f""", {_GRID} SELECT risk_event_id, as_of, volume, round(mean, 4) AS historical_mean, round(std, 4) AS historical_std, round(threshold, 4) AS threshold,
    CASE WHEN volume < 3 THEN 'below_static' WHEN volume > threshold THEN 'alert' ELSE 'below_dynamic' END AS verdict FROM z""")  # fmt: skip
def dynamic_baseline(spark, sf_dir):
    digits = [F.round(c, 4).alias(c) for c in ("historical_mean", "historical_std", "threshold")]
    return _judged(spark, sf_dir).select("risk_event_id", "as_of", "volume", *digits, "verdict")


@register("SELECT DISTINCT event_type AS gm_code, CASE event_type WHEN 'click' THEN 5 WHEN 'view' THEN 7 ELSE 3 END AS static_threshold FROM events")
def threshold_override(spark, sf_dir):
    codes = fx.table(spark, sf_dir, "events").select(F.col("event_type").alias("gm_code")).distinct()
    return codes.withColumn("static_threshold", scoring.static_threshold(F.col("gm_code"), Settings(special_thresholds={"click": 5, "view": 7})))


_ALERT = """SELECT risk_event_id, CASE WHEN NOT known OR threshold_breach_timestamp IS NULL THEN 'first_alert' WHEN last_alerted_timestamp IS NOT NULL AND epoch(TIMESTAMP '2000-01-01') - epoch(last_alerted_timestamp) > 7200 THEN 're_alert'
    WHEN last_alerted_timestamp IS NULL THEN 're_alert' END AS alert_type, CASE WHEN known THEN coalesce(threshold_breach_timestamp, TIMESTAMP '2000-01-01') ELSE initial_timestamp END AS new_breach
    FROM (SELECT *, CAST(risk_event_id AS BIGINT) % 7 != 0 AS known FROM risk_event)"""


@register(with_views("risk_event") + _ALERT)
def alert_state_machine(spark, sf_dir):
    checks = fx.risk_event(spark, sf_dir).withColumn("known", F.col("risk_event_id").cast("long") % 7 != 0).withColumn("first_time", F.col("initial_timestamp"))
    return accounting.alerts(checks, at("2000-01-01")).select("risk_event_id", "alert_type", "new_breach")


@register(with_views("voice_source") + """SELECT count(*) AS voices, count(DISTINCT voice_id) AS distinct_voices, min(gmt_create) AS first_time, max(gmt_create) AS last_time, count_if(k < 50) AS low_k FROM voice_source""")
def batch_stats(spark, sf_dir):
    return fx.voice_source(spark, sf_dir).agg(F.count("*").alias("voices"), F.countDistinct("voice_id").alias("distinct_voices"), F.min("gmt_create").alias("first_time"), F.max("gmt_create").alias("last_time"), F.count_if(F.col("k") < 50).alias("low_k"))


@register(_MATCH + f"{_DECIDED} SELECT split_part(outcome, ':', 1) AS decision, count(*) AS clusters FROM o GROUP BY 1")
def decision_counts(spark, sf_dir):
    return _decided(spark, sf_dir).groupBy(F.split_part("outcome", F.lit(":"), F.lit(1)).alias("decision")).agg(F.count("*").alias("clusters"))


@register("""SELECT event_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS epoch_seconds, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown, date_trunc('second', ts) AS seconds,
    round(greatest(0, epoch(TIMESTAMP '2024-01-20') - CAST(epoch_us(ts) // 1000000 AS BIGINT)) / 86400.0, 6) AS age_days FROM events""")  # fmt: skip
def time_conversions(spark, sf_dir):
    e, instant = fx.table(spark, sf_dir, "events"), F.col("ts").cast("timestamp")
    age = F.greatest(F.lit(0), scoring.seconds_between(F.col("ts"), at("2024-01-20"))) / 86400.0
    return e.select("event_id", F.unix_timestamp(instant).alias("epoch_seconds"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("shown"), F.date_trunc("second", F.col("ts")).cast("timestamp_ntz").alias("seconds"), F.round(age, 6).alias("age_days"))


@register("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{"id":"' || event_id || '","type":"' || event_type || '"}' AS payload FROM events""")
def json_columns(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    payload = F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("type")))
    return e.select("event_id", F.from_json("props", "k long")["k"].alias("k"), payload.alias("payload"))


@register("SELECT p_partkey AS id, 'Summarize the message in one sentence.' || chr(10) || p_name AS prompt FROM part")
def prompt_texts(spark, sf_dir):
    return fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.prompt(models.SUMMARIZE, title=F.col("p_name")).alias("prompt"))


@register("SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events")
def json_literals(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    raw = F.when(F.col("event_id") % 4 == 0, F.col("props")).when(F.col("event_id") % 4 == 3, "no {json").otherwise(F.concat(F.lit("{'none': None, 'yes': True, 'k': "), k, F.lit(",}")))
    return fx.table(spark, sf_dir, "events").select("event_id", payloads.parsed(raw, "k long")["k"].alias("k"))


# Model answers

#: Answers of a language model to a part's name and type, by the part's number: whole, short, empty, without the field, not JSON, and out of range.
SUMMARY_ANSWERS = [
    '{"summaries":[{"text":" NAME ","original_indices":[0,1]},{"text":"TYPE","original_indices":[2]}]}', '{"summaries":[{"text":"NAME","original_indices":[0]}]}', '{"summaries":[]}', "{}", "junk NAME",
    '{"summaries":[{"text":"","original_indices":[0,1,2]},{"text":"TYPE","original_indices":[2,1,0,9,-1]},{"text":"NAME","original_indices":[7]}]}',
]
#: Answers to the candidates of an order, by its number: a merge with each of them, with a stranger, with none, a new event, not JSON.
DECISION_ANSWERS = [
    '{"decision":"merge","matched_risk_event_id":"E-NEXT","reason":"r"}', '{"decision":"merge","matched_risk_event_id":"E-SELF"}', '{"decision":"merge","matched_risk_event_id":"E9"}', '{"decision":"merge"}', '{"decision":"create_new"}', "junk SELF", '{"decision":"drop"}',
]


def _answer(key, answers, parts):
    """The answer whose turn it is by a key, with its words filled in."""
    raw = F.element_at(F.array(*[F.lit(a) for a in answers]), (key % len(answers) + 1).cast("int"))
    return reduce(lambda text, part: F.replace(text, F.lit(part), parts[part].cast("string")), parts, raw)


def _answer_sql(key, answers, parts):
    raw = "[" + ", ".join(f"'{a}'" for a in answers) + f"][{key} % {len(answers)} + 1]"
    return reduce(lambda text, part: f"replace({text}, '{part}', CAST({parts[part]} AS VARCHAR))", parts, raw)


@register(f"""WITH a AS (SELECT p_partkey AS id, p_name, 1 + p_size % 4 AS m, {_answer_sql('p_partkey', SUMMARY_ANSWERS, {'NAME': 'p_name', 'TYPE': 'p_type'})} AS answer FROM part),
    x AS (SELECT id, p_name, m, CASE WHEN json_valid(answer) THEN json_extract(answer, '$.summaries[*]') ELSE [] END AS xs FROM a),
    y AS (SELECT id, p_name, m, list_filter(list_transform(xs, lambda x: struct_pack(text := trim(x->>'$.text'), own := list_filter(CAST(x->'$.original_indices' AS INT[]), lambda i: i >= 0 AND i < m))),
        lambda x: x.text != '' AND len(x.own) > 0) AS kept FROM x),
    z AS (SELECT *, len(list_distinct(flatten(list_transform(kept, lambda x: x.own)))) = m AS good FROM y)
    SELECT id, good::INT AS success, CASE WHEN good THEN array_to_string(list_transform(kept, lambda x: x.text || ':' || array_to_string(x.own, ',')), '|')
        ELSE p_name || ':' || array_to_string(range(m), ',') END AS summaries FROM z""")  # fmt: skip
def llm_summary_validate(spark, sf_dir):
    """Answers about clusters of one to four members; those that leave a member out give one summary of all."""
    answer = _answer(F.col("p_partkey"), SUMMARY_ANSWERS, {"NAME": F.col("p_name"), "TYPE": F.col("p_type")})
    v = scoring.valid_summaries(answer, 1 + F.col("p_size") % 4, F.col("p_name"))
    rows = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), v.alias("v"))
    flat = F.array_join(F.transform("v.summaries", lambda x: F.concat(x["text"], F.lit(":"), F.array_join(x["original_indices"].cast("array<string>"), ","))), "|")
    return rows.select("id", F.col("v.success").alias("success"), flat.alias("summaries"))


@register(f"""WITH a AS (SELECT o_orderkey AS id, 'E-' || o_orderkey AS self, 'E-' || (o_orderkey + 1) AS next, o_custkey % 10 / 10.0 AS score,
        {_answer_sql('o_orderkey', DECISION_ANSWERS, {'SELF': 'o_orderkey', 'NEXT': 'o_orderkey + 1'})} AS answer FROM orders),
    b AS (SELECT *, CASE WHEN json_valid(answer) THEN answer->>'$.decision' END AS d, CASE WHEN json_valid(answer) THEN answer->>'$.matched_risk_event_id' END AS e FROM a),
    c AS (SELECT *, CASE WHEN d = 'merge' AND (e = self OR e = next) THEN 'merge' WHEN d = 'create_new' THEN 'new' WHEN score >= 0.6 THEN 'top' ELSE 'low' END AS kind FROM b)
    SELECT id, CASE WHEN kind IN ('merge', 'top') THEN 'merge' ELSE 'create_new' END AS decision, CASE kind WHEN 'merge' THEN e WHEN 'top' THEN self END AS matched_risk_event_id,
        CASE WHEN kind IN ('merge', 'new') THEN 'model' ELSE 'fallback' END AS source FROM c""")  # fmt: skip
def llm_decision_validate(spark, sf_dir):
    """Answers about orders with two candidates each; what isn't an answer is decided by the score of the first."""
    key = F.col("o_orderkey")
    name = lambda k: F.concat(F.lit("E-"), k.cast("string"))
    answer = _answer(key, DECISION_ANSWERS, {"SELF": key, "NEXT": key + 1})
    v = scoring.valid_decision(answer, F.array(name(key), name(key + 1)), name(key), F.col("o_custkey") % 10 / 10)
    return fx.table(spark, sf_dir, "orders").select(key.alias("id"), v.alias("v")).select("id", "v.decision", "v.matched_risk_event_id", "v.source")


# Streams

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _stream(spark, sf_dir):
    return worker.file_stream(spark, f"{sf_dir}/events.parque[t]", EVENTS)  # a pattern: the table is a file, or a folder of parts


@register("""SELECT event_type, time_bucket(INTERVAL 10 MINUTE, ts) AS window_start, count(*) AS n FROM events GROUP BY 1, 2
    HAVING time_bucket(INTERVAL 10 MINUTE, any_value(ts)) + INTERVAL 10 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")  # fmt: skip
def stream_timeline(spark, sf_dir):
    return worker.drained(worker.windowed_counts(_stream(spark, sf_dir), "ts", "event_type"), "timeline")


@register("SELECT DISTINCT CAST(event_id - event_id%7%2 AS VARCHAR) AS voice_id FROM events")
def stream_dedup(spark, sf_dir):
    voices = _stream(spark, sf_dir).withColumn("voice_id", (F.col("event_id") - F.col("event_id") % 7 % 2).cast("string"))
    return worker.drained(worker.first_seen(voices, "ts", "voice_id", "40 days").select("voice_id"), "dedup")


@register("""SELECT event_type AS risk_event_id, 'active' AS status, count(*) AS risk_event_volume, min(ts) AS initial_timestamp FROM events
    WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 6 HOUR GROUP BY 1""")  # fmt: skip
def stream_event_state(spark, sf_dir):
    def decide(batch):
        return batch.select(F.col("event_id").alias("id"), F.col("event_id").cast("string").alias("voice_id"), F.col("event_type").alias("title"), F.col("event_type").alias("gm_code"), F.col("ts").alias("gmt_create"), F.col("event_type").alias("risk_event_id"), F.lit(None).cast("string").alias("decision"))

    folder = worker.work_folder(spark, "worker")
    job = worker.Worker(spark, folder, decide)
    job.start(_stream(spark, sf_dir), f"{folder}/checkpoint", availableNow=True).awaitTermination()
    return job.events.version().select("risk_event_id", "status", "risk_event_volume", "initial_timestamp")


@register(r"""WITH v AS (SELECT event_id, ts, event_type AS t, 'Customer reports a problem with ' || event_type AS title FROM events), e AS (SELECT t, any_value(title) AS title, min(event_id) AS first FROM v GROUP BY t)
    SELECT 'evt' || substr(sha256(concat_ws('|', 'G_' || t, first)), 1, 24) AS risk_event_id, regexp_replace(any_value(e.title), '\s+', '', 'g') AS risk_event_title, 'active' AS status, 'G_' || t AS gm_code, 'line_' || t AS goc_product_line, 'feedback' AS data_source,
        count(*) AS risk_event_volume, min(ts) AS initial_timestamp, 1 AS known, CASE WHEN count(*) >= 3 THEN 'first_alert' END AS alert_type
    FROM v JOIN e USING (t) WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 6 HOUR GROUP BY t, first""")  # fmt: skip
def engine_job(spark, sf_dir):
    """All stages, from raw voices to events, knowledge and alerts, in one streaming run."""
    kinds = ["view", "signup", "purchase", "click", "error"]
    lines = spark.createDataFrame([(f"G_{k}", f"line_{k}", k, None) for k in kinds], "gm_code string, goc_product_line string, entity string, action string")
    folder = worker.work_folder(spark, "engine")
    resources = job.Resources(routing.keyword_table(lines), model=models.OfflineModel)
    engine = job.Engine(spark, folder, resources, Settings(split_members=0))
    title = F.concat(F.lit("Customer reports a problem with "), "event_type")
    voices = _stream(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("event_id").cast("string").alias("voice_id"), title.alias("title"), F.col("ts").alias("gmt_create"))
    engine.start(voices, f"{folder}/checkpoint", availableNow=True).awaitTermination()
    known = engine.knowledge.read().groupBy("risk_event_id").agg(F.count("*").cast("int").alias("known"))
    events = engine.events.version().select("risk_event_id", "risk_event_title", "status", "gm_code", "goc_product_line", "data_source", "risk_event_volume", "initial_timestamp")
    return events.join(known, "risk_event_id", "left").join(engine.alerts.read().select("risk_event_id", "alert_type"), "risk_event_id", "left")
