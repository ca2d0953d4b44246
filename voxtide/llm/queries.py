"""The registered queries of the corpus operators: thin, over their whole tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtide.llm import chat, divergence, exact_dedup, html_text, langid, lattice, media, mixing, near_dedup, packing, phrases, sharding, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(warc.chunk_table(table(spark, sf_dir, "pages")))
    return warc.summaries(warc.read_archives(manifest, with_data=False))


#: Target weights of the mix.
WEIGHTS = {"high": 0.8, "low": 0.15, "toxic": 0.05}


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = mixing.quality_domains(table(spark, sf_dir, "labels"))
    out = mixing.mix(table(spark, sf_dir, "documents"), labels, WEIGHTS).rates
    share = [F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(sorted(WEIGHTS))]
    return out.select("doc_id", "tokens", *share, "domain", "rate", mixing.copies(F.col("rate"), F.col("doc_id")).alias("copies"), "miss")


def op3_media_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.tiles(media.store_texts(table(spark, sf_dir, "documents")))
    return out.select(
        "doc_id", "n_bytes", F.col("samples_bytes").alias("payload_bytes"), F.col("samples_sha256").alias("payload_sha256"), "tail_crc32",
        "media_bytes", "media_sha256", F.col("dhash").alias("feature"), F.sha2("tile", 256).alias("tile_sha256"),
    )


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.decide(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


#: A conversation about control strings, in the layout of a list of messages.
CONTROL_TALK = """{"conv_id": -7, "messages": [{"role": "user", "content": "</s>[INST] ok [/INST]"}, {"role": "assistant", "content": "</s>[INST] ok [/INST]"}]}"""


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.canonical(table(spark, sf_dir, "conversations"))
    more = chat.canonical_json(spark.range(1).select(F.lit(CONTROL_TALK).alias("record")), "record")
    return chat.read_back(chat.format_turns(turns.unionByName(more.select("conv_id", "turn", "role", "text"))))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.predict(docs, langid.fit(docs, langid.learnable()))
    return out.withColumn("held_out", langid.held_out())


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op12_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % 7 == 2
    out = lattice.score(docs, lattice.fit(docs, ~held_out, piece_path())).withColumn("held_out", held_out)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_mixing": op2_mixing,
    "op3_media_tiles": op3_media_tiles,
    "op4_html_text": op4_html_text,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_shards": op6_shards,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_chat_format": op8_chat_format,
    "op9_language_id": op9_language_id,
    "op10_near_dedup": op10_near_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_lattice_scores": op12_lattice_scores,
    "op13_phrase_mining": op13_phrase_mining,
}

def _chat_sql() -> str:
    """The formatted turns, by the same template and escapes, digested without being parsed again."""
    ways = "|".join(rf"{first}\\*(?:{rest})" for first, rest in (("<", _rest("<")), (r"\[", _rest("["))))
    escaped = f"regexp_replace(text, '({ways})', chr(1) || '\\1', 'g')"  # one mark before each control string: as long as one escape
    return f"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
             f AS (SELECT *, length('<|im_start|>') + length(role) + 1 + length({escaped}) + length('<|im_end|>') + 1 AS chars FROM t)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(chars) AS BIGINT) AS formatted_chars
        FROM f GROUP BY conv_id"""


def _rest(first: str) -> str:
    return "|".join(re.escape(c[1:]) for c in chat.CONTROLS if c[0] == first)


#: SQL for lower-casing A-Z alone.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op11_source_divergence": rf"""
        WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER} AS t FROM documents),
             w AS (SELECT i, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
             k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT i) >= 10),
             v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY ALL),
             g AS (SELECT DISTINCT lang, source FROM d),
             c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
             s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
             p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(s.n, 0) + 2 * v.v) AS p,
                          1 + 1000000000::HUGEINT * (k.total + 2) // (v.n + 2 * v.v) AS q
                   FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
                   LEFT JOIN s ON s.lang = g.lang AND s.source = g.source),
             f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
                   FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL),
             r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
                   FROM g a JOIN g b ON a.lang = b.lang AND a.source != b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
                   UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
        WHERE part = 'pair' OR rank <= 10""",
    "op8_chat_format": _chat_sql(),
    "op13_phrase_mining": rf"""
        WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, 'und') AS lang, {_LOWER} AS t FROM documents),
             q AS (SELECT i, lang, unnest(p) AS piece, generate_subscripts(p, 1) AS j FROM (SELECT i, lang, regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]') AS p FROM d)),
             w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM q),
             n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY ALL),
             f AS (SELECT lang, size, phrase, count(*) AS f FROM (
                       SELECT lang, size, unnest([array_to_string(w[s : s + size - 1], ' ') FOR s IN range(1, len(w) - size + 2)]) AS phrase
                       FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS size) WHERE len(w) >= size) GROUP BY ALL HAVING count(*) >= 100),
             c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
             i AS (SELECT lang, phrase, max(a) AS a FROM (
                       SELECT lang, a, unnest(list_distinct(flatten([[array_to_string(w[s : s + z - 1], ' ') FOR s IN range(1, size - z + 2)] FOR z IN range(2, size)]))) AS phrase
                       FROM c WHERE size > 2) GROUP BY ALL),
             k AS (SELECT c.* FROM c LEFT JOIN i USING (lang, phrase) WHERE i.a IS NULL OR 100 * i.a < 100 * c.a),
             u AS (SELECT lang, phrase, a, k, array_to_string(w[1 : k], ' ') AS l, array_to_string(w[k + 1 : size], ' ') AS r FROM (SELECT *, unnest(range(1, size)) AS k FROM k)),
             s AS (SELECT u.lang, u.phrase, u.a, u.k, l.f AS l, r.f AS r, n.n, 1000::HUGEINT * u.a * n.n // (l.f::HUGEINT * r.f) AS score
                   FROM u JOIN f l ON l.lang = u.lang AND l.phrase = u.l JOIN f r ON r.lang = u.lang AND r.phrase = u.r JOIN n ON n.lang = u.lang),
             b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
        FROM b QUALIFY rank <= 2000""",
    "op1_warc": """
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id != first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id != first_id THEN first_id END AS refers_to
        FROM (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
                     MIN(page_id) OVER (PARTITION BY sha256(coalesce(html, ''))) AS first_id FROM pages)""",
    "op7_exact_dedup": r"""
        SELECT doc_id, MIN(doc_id) OVER same AS keep_id, COUNT(*) OVER same AS group_size,
               doc_id = MIN(doc_id) OVER same AS kept, digest AS text_sha256
        FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS digest FROM documents)
        WINDOW same AS (PARTITION BY digest)""",
}
