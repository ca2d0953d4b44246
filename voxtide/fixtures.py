"""The engine's logical tables, bound to the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: 26 Chinese letters for those of the alphabet: titles without a space to be cut at.
LETTERS = "无法付款订单失败支账号登录退还花呗额度借转收到微信余"


def chinese_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, title: part names in other letters, with a comma where a space was."""
    title = F.translate("p_name", "abcdefghijklmnopqrstuvwxyz ", LETTERS + "，")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), title.alias("title"))


def voice_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("voice_channel"), F.col("lang").alias("gm_code"), F.posexplode(F.split("text", "\n")).alias("pos", "title"))
    return rows.select((F.col("doc_id") * 10_000_000 + F.col("pos") + 1).alias("id"), "title", "voice_channel", "gm_code")


def voice_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), (F.col("event_id") - F.col("event_id") % 7 % 2).cast("string").alias("voice_id"), F.col("event_type").alias("title"), F.col("ts").alias("gmt_create"),
        (F.col("ts") - F.make_dt_interval(mins=(F.col("event_id") % 30).cast("int"))).alias("add_date"), F.col("user_id").cast("string").alias("uid"), F.col("event_type").alias("gm_code"), F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def risk_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(
        key.cast("string").alias("risk_event_id"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("closed").alias("status"), F.col("o_orderpriority").alias("gm_code"), (key % 50).alias("risk_event_volume"),
        F.col("o_orderdate").alias("initial_timestamp"), F.when(key % 5 == 0, F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("threshold_breach_timestamp"),
        F.when(key % 10 == 0, F.col("o_orderdate") + F.expr("INTERVAL 2 DAYS")).alias("last_alerted_timestamp"),
    )


def voice_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("voice_id"), F.col("l_orderkey").cast("string").alias("risk_event_id"), F.col("l_shipdate").alias("voice_date"))


def volume_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-minute snapshots; one at e covers (e - 10 min, e]."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    end = F.timestamp_micros((F.ceil(at / 600_000_000) * 600_000_000).cast("long")).cast("timestamp_ntz")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("risk_event_id"), end.alias("snapshot_time")).agg(F.count("*").alias("incremental_volume_at_snapshot"))


def risk_event_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 2 == 0).withColumn("gm_code", F.col("label"))


def cluster_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 2 == 1).withColumn("gm_code", F.col("label"))


#: The same bindings for the oracle.
SQL = {
    "voice_lines": """SELECT doc_id*10000000+pos AS id, line AS title, source AS voice_channel, lang AS gm_code
        FROM (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)""",
    "voice_source": """SELECT event_id AS id, CAST(event_id - event_id%7%2 AS VARCHAR) AS voice_id, event_type AS title, ts AS gmt_create,
        ts - to_minutes(CAST(event_id%30 AS INT)) AS add_date, CAST(user_id AS VARCHAR) AS uid, event_type AS gm_code, CAST(json_extract(props,'$.k') AS INT) AS k FROM events""",
    "risk_event": """SELECT CAST(o_orderkey AS VARCHAR) AS risk_event_id, CASE WHEN o_orderstatus='O' THEN 'active' ELSE 'closed' END AS status, o_orderpriority AS gm_code,
        o_orderkey%50 AS risk_event_volume, o_orderdate AS initial_timestamp, CASE WHEN o_orderkey%5=0 THEN o_orderdate + INTERVAL 1 DAY END AS threshold_breach_timestamp,
        CASE WHEN o_orderkey%10=0 THEN o_orderdate + INTERVAL 2 DAY END AS last_alerted_timestamp FROM orders""",
    "voice_mapping": "SELECT l_orderkey*100+l_linenumber AS voice_id, CAST(l_orderkey AS VARCHAR) AS risk_event_id, l_shipdate AS voice_date FROM lineitem",
    "volume_timeline": """SELECT event_type AS risk_event_id, make_timestamp(CAST(ceil(epoch_us(ts)/600000000.0) AS BIGINT)*600000000) AS snapshot_time,
        count(*) AS incremental_volume_at_snapshot FROM events GROUP BY 1, 2""",
    "risk_event_kb": "SELECT vec_id, label AS gm_code, embedding::DOUBLE[] AS embedding FROM embeddings WHERE vec_id%2=0",
    "cluster_vectors": "SELECT vec_id, label AS gm_code, embedding::DOUBLE[] AS embedding FROM embeddings WHERE vec_id%2=1",
}


def with_views(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names)
