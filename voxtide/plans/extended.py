"""More registered queries: word lattices, an index of vectors, rules in one pass, prefix sums, moments and keyed stream state."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtide import fixtures as fx
from voxtide import job, models
from voxtide.config import Settings
from voxtide.fixtures import with_views
from voxtide.operators import increments, routing, rule_automaton, segmentation
from voxtide.plans.catalog import EVENTS, _ALL, _ANY, _CHINESE, _EXCLUDE, _KNN, _PREFIX, _WITHIN, BASE, ORACLES, RULES, WORDS, _checks, _stream, at, register
from voxtide.sources import vector_index
from voxtide.sources.cursor_stream import cursor_stream
from voxtide.sources.shared import work_folder, written
from voxtide.sources.sinks import EpochTable
from voxtide.streaming import state

# Words

_OWN = "[" + ", ".join(f"'{w}'" for w in segmentation.dictionary(WORDS)) + "]"
_SIZES = sorted({1, *map(len, segmentation.dictionary(WORDS))})


@register(f"""WITH {_CHINESE}, r AS (SELECT id, replace(title, '，', '') AS run FROM c), s AS (SELECT run, count(*) AS m FROM r GROUP BY run),
    x AS (SELECT w, sum(m) AS n FROM (SELECT m, unnest(flatten([[run[i : i + z - 1] FOR i IN range(1, length(run) - z + 2)] FOR z IN {_SIZES}])) AS w FROM s) WHERE length(w) = 1 OR list_contains({_OWN}, w) GROUP BY w),
    k AS (SELECT map_from_entries(list(struct_pack(k := w, v := CAST(round(1000 * ln((SELECT sum(n) FROM x) / n)) AS BIGINT)))) AS u FROM x),
    p AS (SELECT run, list_reduce(list_prepend([struct_pack(cost := 0::BIGINT, path := '', one := false)], [[struct_pack(cost := i, path := '', one := false)] FOR i IN range(1, length(run) + 1)]),
        lambda a, b: list_append(a, list_min([struct_pack(cost := a[b[1].cost - z + 1].cost + u[run[b[1].cost - z + 1 : b[1].cost]],
            path := a[b[1].cost - z + 1].path || CASE WHEN z = 1 AND a[b[1].cost - z + 1].one THEN '' ELSE ' ' END || run[b[1].cost - z + 1 : b[1].cost], one := z = 1)
            FOR z IN {_SIZES} IF b[1].cost >= z AND u[run[b[1].cost - z + 1 : b[1].cost]] IS NOT NULL]))) AS best FROM s, k)
    SELECT id, array_to_string(list_slice(list_filter(string_split(trim(best[-1].path), ' '), lambda w: length(w) > 1), 1, 10), ' ') AS words FROM r JOIN p USING (run)""")  # fmt: skip
def segment_lattice(spark, sf_dir):
    """Titles cut by the cheapest path; costs from all edges of their lattices."""
    titles = fx.chinese_titles(spark, sf_dir)
    return segmentation.tokens(titles, segmentation.learn(titles, WORDS, rounds=0)).select("id", F.array_join("tokens", " ").alias("words"))


@register()
def segment_lattice_learned(spark, sf_dir):
    """As ``segment_lattice``, with two rounds of expectation; tests hold it against all segmentations."""
    titles = fx.chinese_titles(spark, sf_dir)
    return segmentation.tokens(titles, segmentation.learn(titles, WORDS, rounds=2)).select("id", F.array_join("tokens", " ").alias("words"))

# Vectors


@register(with_views("risk_event_kb", "cluster_vectors") + f"SELECT query_id, hit_id, distance, rank::INT AS rank, true AS proven FROM ({_KNN})")
def knn_indexed(spark, sf_dir):
    """``knn_topk`` by an inverted-file index: the lists that the triangle inequality doesn't rule out."""
    index = vector_index.build(fx.risk_event_kb(spark, sf_dir), work_folder(spark, "vectors"))
    return vector_index.search(fx.cluster_vectors(spark, sf_dir), index, 10)


@register()
def knn_probed(spark, sf_dir):
    """The nearest lists alone, as many as a sample needs for a recall of 0.97; a test asserts 0.95 against ``knn_topk``."""
    index = vector_index.build(fx.risk_event_kb(spark, sf_dir), work_folder(spark, "vectors"))
    return vector_index.search(fx.cluster_vectors(spark, sf_dir), index, 10, probes=vector_index.probes_for(index, 10, 0.97), exact=False)


# Rules


@register(with_views("voice_lines") + f""" SELECT id, title FROM voice_lines WHERE NOT ({_PREFIX} OR {_ANY} OR {_ALL} OR {_WITHIN} OR {_EXCLUDE})""")
def rules_one_pass(spark, sf_dir):
    """All keyword rules by one automaton."""
    return rule_automaton.tested(fx.voice_lines(spark, sf_dir), RULES).where("size(drops) = 0").select("id", "title")


@register(with_views("voice_lines") + f""" SELECT unnest(['prefix', 'any', 'all', 'within', 'include']) AS kind, unnest([count_if({_PREFIX}), count_if({_ANY}), count_if({_ALL}), count_if({_WITHIN}), count_if({_EXCLUDE})]) AS titles FROM voice_lines""")
def rule_hits(spark, sf_dir):
    """How many titles each kind of rule drops, in one pass."""
    rows = rule_automaton.tested(fx.voice_lines(spark, sf_dir), RULES).select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), rule_automaton.meets(k).cast("int").alias("n")) for k in rule_automaton.KINDS])).alias("x"))
    return rows.groupBy("x.kind").agg(F.sum("x.n").alias("titles"))


# Prefix sums and moments


@register(ORACLES["snapshot_increment"])
def snapshot_prefix(spark, sf_dir):
    """``snapshot_increment`` from prefix sums that were extended twice; no voice is joined but those of the intervals' first and last hours."""
    events, voices = fx.risk_event(spark, sf_dir), fx.voice_mapping(spark, sf_dir)
    timeline = events.where(F.col("risk_event_id").cast("long") % 2 == 0).select("risk_event_id", (F.col("initial_timestamp") + F.expr("INTERVAL 30 DAYS")).alias("snapshot_time"))
    first = F.col("voice_id") % 3 == 0
    prefix = written(increments.extended(written(increments.extended(None, voices.where(first)), "prefix"), voices.where(~first)), "prefix")
    return increments.snapshot(events, timeline, prefix, voices, at("2000-06-01"), cutoff=at("1999-01-01"))


@register(ORACLES["dynamic_baseline"])
def baseline_moments(spark, sf_dir):
    """``dynamic_baseline`` from moments: one window over the days of an event's hour of day."""
    digits = [F.round(c, 4).alias(c) for c in ("historical_mean", "historical_std", "threshold")]
    return increments.moments(_checks(spark, sf_dir), increments.hour_volumes(fx.volume_timeline(spark, sf_dir)), BASE).select("risk_event_id", "as_of", "volume", *digits, "verdict")


# Keyed stream state

WATCH = Settings(alert_min_incremental=6)


@register("""WITH RECURSIVE v AS (SELECT event_type AS e, ts, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM events),
    q AS (SELECT e, ts, max(n) AS n FROM v WHERE n >= 6 GROUP BY ALL),
    a AS (SELECT e, min(ts) AS ts, 'first_alert' AS kind FROM q GROUP BY e
          UNION ALL SELECT a.e, (SELECT min(q.ts) FROM q WHERE q.e = a.e AND q.ts > a.ts + INTERVAL 2 HOUR), 're_alert' FROM a WHERE a.ts IS NOT NULL)
    SELECT a.e AS risk_event_id, a.ts AS alert_timestamp, q.n AS volume_at_alert, a.kind AS alert_type FROM a JOIN q ON q.e = a.e AND q.ts = a.ts""")  # fmt: skip
def stream_alerts(spark, sf_dir):
    """Alerts of a stream, from keyed state."""
    return state.drained(state.alerts(_stream(spark, sf_dir), "event_type", "ts", WATCH), "alerts")


@register("""WITH b AS (SELECT event_type AS e, make_timestamp(CAST(ceil(epoch_us(ts) / 600000000.0) AS BIGINT) * 600000000) AS t, count(*) AS n FROM events GROUP BY ALL),
    g AS (SELECT e, unnest(generate_series(min(t), (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE, INTERVAL 10 MINUTE)) AS t FROM b GROUP BY e)
    SELECT g.e AS risk_event_id, g.t AS snapshot_time, CAST(sum(coalesce(b.n, 0)) OVER (PARTITION BY g.e ORDER BY g.t) AS BIGINT) AS volume_at_snapshot, coalesce(b.n, 0) AS incremental_volume_at_snapshot
    FROM g LEFT JOIN b ON b.e = g.e AND b.t = g.t""")  # fmt: skip
def stream_snapshots(spark, sf_dir):
    """A snapshot of every event each ten minutes, from timers of its state."""
    return state.drained(state.snapshots(_stream(spark, sf_dir), "event_type", "ts"), "snapshots")


@register("""SELECT (row_number - 1) // 2000 AS batch, count(*) AS voices, min(event_id) AS first_id, max(event_id) AS last_id, min(ts) AS first_time, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k
    FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS row_number FROM events) GROUP BY 1""")  # fmt: skip
def stream_cursor(spark, sf_dir):
    """Events by their ids, 2000 a batch, up to 256 batches in an epoch; from a copy in the order of ids, in the shared folder."""
    folder = work_folder(spark, "cursor")
    fx.table(spark, sf_dir, "events").repartitionByRange("event_id").sortWithinPartitions("event_id").write.parquet(f"{folder}/events")
    batches = EpochTable(spark, f"{folder}/batches", f"batch long, {EVENTS}")
    batches.ensure()
    stream = cursor_stream(spark, f"{folder}/events", EVENTS, f"{folder}/position", 2000, "event_id", ahead=256)
    query = stream.writeStream.foreachBatch(lambda rows, epoch: batches.write(rows.select("batch", *[c for c in rows.columns if c != "batch"]), epoch)).option("checkpointLocation", f"{folder}/checkpoint").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    k = F.get_json_object("props", "$.k").cast("long")
    return batches.read().groupBy("batch").agg(F.count("*").alias("voices"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.min("ts").alias("first_time"), F.sum(k).alias("k"))


# All stages over two epochs


@register(r"""WITH v AS (SELECT event_id, ts, event_type AS t, ts >= TIMESTAMP '2024-01-30 06:00:00' AS late FROM events WHERE ts >= TIMESTAMP '2024-01-30 06:00:00' OR event_type IN ('view', 'signup', 'purchase')),
    f AS (SELECT t, min(late) AS late, arg_min(event_id, (late, event_id)) AS first FROM v GROUP BY t),
    i AS (SELECT t, late, 'sub' || substr(sha256(concat_ws('|', 'evt' || substr(sha256(concat_ws('|', 'G_' || t, first)), 1, 24), 0)), 1, 24) AS risk_event_id FROM f)
    SELECT i.risk_event_id, 'Customer reports a problem with ' || t AS risk_event_title, CASE WHEN v.late AND NOT i.late THEN 'merge' ELSE 'create_new' END AS decision, count(*) AS voices,
        count_if(v.ts >= (SELECT max(ts) FROM v x WHERE x.late = v.late) - INTERVAL 6 HOUR) AS counted
    FROM v JOIN i USING (t) GROUP BY ALL""")  # fmt: skip
def engine_epochs(spark, sf_dir):
    """All stages over two epochs, clusters split by the model: kinds of voices that the first epoch knows are merged by the second, the others are new events."""
    kinds = ["view", "signup", "purchase", "click", "error"]
    lines = spark.createDataFrame([(f"G_{k}", f"line_{k}", k, None) for k in kinds], "gm_code string, goc_product_line string, entity string, action string")
    engine = job.Engine(spark, work_folder(spark, "engine"), job.Resources(routing.keyword_table(lines), model=models.OfflineModel))
    title = F.concat(F.lit("Customer reports a problem with "), "event_type")
    voices = fx.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_id").cast("string").alias("voice_id"), title.alias("title"), F.col("ts").alias("gmt_create"), "event_type")
    late = F.col("gmt_create") >= at("2024-01-30 06:00:00")
    engine.process(voices.where(~late & F.col("event_type").isin(kinds[:3])).drop("event_type"), 0)
    engine.process(voices.where(late).drop("event_type"), 1)
    decided = engine.decided.epoch(0).withColumn("latest", F.lit(0)).unionByName(engine.decided.epoch(1).withColumn("latest", F.lit(1)))
    ends = decided.groupBy("latest").agg(F.max("gmt_create").alias("end"))
    known = engine.events.version().select("risk_event_id", "risk_event_title")
    counted = (F.col("gmt_create") >= F.col("end") - F.expr("INTERVAL 6 HOURS")).cast("int")
    return decided.join(ends, "latest").join(known, "risk_event_id").groupBy("risk_event_id", "risk_event_title", "decision").agg(F.count("*").alias("voices"), F.sum(counted).alias("counted"))
