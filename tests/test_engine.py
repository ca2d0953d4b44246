"""Operators, stages and the streaming worker on small cases."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtide import models, schemas
from voxtide.config import Settings
from voxtide.operators import accounting, dedup, routing, snapshot, vector_search
from voxtide.operators.components import connected_components
from voxtide.plans.stages import Rules, cluster, decider, manage_events, match_and_decide, route_and_enrich, summarize_clusters
from voxtide.job import Engine, Resources, main
from voxtide.streaming.worker import Worker, cadence, file_stream

NOW = datetime(2024, 1, 15, 12)
MAPPING = "voice_id string, risk_event_id string, voice_date timestamp_ntz"


def at(t):
    return F.lit(t).cast("timestamp_ntz")


def test_keep_first_keeps_rows_without_a_key(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "id long, voice_id string")
    assert sorted(r["id"] for r in dedup.keep_first(df, "voice_id", "id").collect()) == [1, 3, 4]
    assert [r["id"] for r in dedup.keep_last(df, "voice_id", "id").collect()] == [2]


def test_clusters_chain_but_never_cross_codes(spark):
    def unit(angle):
        return [float(np.cos(angle)), float(np.sin(angle))]

    step = float(np.arccos(0.88))  # neighbours are nearer than 0.15, ends are not
    rows = [(1, "A", unit(0)), (2, "A", unit(step)), (3, "A", unit(2 * step)), (4, "B", unit(0)), (5, "A", [0.0, 0.0]), (6, "A", unit(3.0))]
    df = spark.createDataFrame(rows, "id long, gm_code string, v array<double>")
    pairs = vector_search.similarity_pairs(df, 0.15, "gm_code", "id", "v")
    assert sorted((r["a"], r["b"]) for r in pairs.collect()) == [(1, 2), (2, 3)]
    got = {r["id"]: r["component"] for r in connected_components(df.select("id"), pairs).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}


def test_long_chain_of_components(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert connected_components(spark.range(201), edges).agg(F.max("component")).first()[0] == 0


def test_lsh_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    exact = {(r["a"], r["b"]) for r in vector_search.similarity_pairs(df, 0.7, "label").collect()}
    found = {(r["a"], r["b"]) for r in vector_search.lsh_pairs(df, 0.7, "label", 64, bits=4).collect()}
    assert found <= exact and len(found) >= 0.95 * len(exact) > 100


def test_lsh_by_its_defaults(spark):
    """One large key of loose clusters: planned tables, nearly all pairs, far fewer candidates than pairs; a small key is compared exactly."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((600, 32))
    vectors = np.repeat(centres, 5, 0) + 0.3 * rng.standard_normal((3000, 32))
    df = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(vectors)] + [(9000, None, vectors[0].tolist()), (9001, 1, None)], "vec_id long, label int, embedding array<double>")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    distance = np.round(1 - unit @ unit.T, 6)
    exact = {(a, b) for a, b in zip(*np.nonzero(distance < 0.15), strict=True) if a < b}
    tables, bits = vector_search.lsh_plan(0.15, 0.95, 3000)
    assert vector_search.lsh_plan(0.15, 0.95, 100) is None and vector_search.lsh_plan(0.7, 0.95, 10**6) is None
    assert vector_search.lsh_candidates(df, "label", 32, tables, bits).count() < 3000 * 2999 / 2 / 20
    found = {(r["a"], r["b"]) for r in vector_search.lsh_pairs(df, 0.15, "label", 32).collect()}
    assert found <= exact and len(found) >= 0.95 * len(exact) > 100
    small = {(r["a"], r["b"]) for r in vector_search.lsh_pairs(df.where("vec_id < 60"), 0.15, "label", 32).collect()}
    assert small == {(a, b) for a, b in exact if b < 60}


def test_sign_buckets(spark):
    rng = np.random.default_rng(6)
    vectors = rng.standard_normal((50, 8))
    df = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, label int, embedding array<double>")
    got = {(r["id"], r["bucket"] >> 5): r["bucket"] & 31 for r in vector_search.sign_buckets(df, "label", 8, 7, 5).collect()}
    planes = np.random.default_rng(42).standard_normal((7, 5, 8))
    assert got == {(i, t): sum(int(planes[t, b] @ v > 0) << b for b in range(5)) for i, v in enumerate(vectors) for t in range(7)}


@pytest.mark.parametrize("bits, tables", [(2, 5), (5, 6)])
def test_pairs_of_buckets_are_decided_where_they_meet(spark, monkeypatch, bits, tables):
    """Over keys of several blocks: each pair once, those that share a bucket and no others; candidates are neither shuffled nor made distinct."""
    monkeypatch.setattr(vector_search, "tables_for", lambda *_: tables)
    monkeypatch.setattr(vector_search.over_blocks, "__defaults__", (16, 16, None))
    rng = np.random.default_rng(8)
    rows = [(i, "A" if i % 4 else "B", (rng.standard_normal(8) if i % 40 else np.zeros(8)).tolist() if i % 61 else None) for i in range(260)]
    df = spark.createDataFrame([*rows, (999, None, [1.0] * 8)], "id long, k string, v array<float>")
    buckets: dict = {}
    for r in vector_search.sign_buckets(df, "k", 8, tables, bits, "id", "v").collect():
        buckets.setdefault((r["key"], r["bucket"]), []).append(r["id"])
    shared = {(a, b) for ids in buckets.values() for a in ids for b in ids if a < b}
    unit = {i: np.float32(v) / max(np.linalg.norm(np.float32(v)), 1e-9) for i, _, v in rows if v}
    got = vector_search.lsh_candidates(df, "k", 8, tables, bits, "id", "v").collect()
    assert len(got) == len(shared) and {(r["a"], r["b"]) for r in got} == shared
    assert vector_search.lsh_tried(df, "k", 8, tables, bits, "id", "v").first()[0] == len(shared)
    found = vector_search.lsh_pairs(df, 0.6, "k", 8, bits=bits, id_col="id", vector_col="v")
    above = found._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    assert not any(x in above for x in ("Join", "Aggregate", "Sort"))
    assert {(r["a"], r["b"]) for r in found.collect()} == {(a, b) for a, b in shared if 1 - float(unit[a] @ unit[b]) < 0.6}


def test_route_filters(spark):
    df = spark.createDataFrame([(1, [("A",)]), (2, [("A",), ("B",)])], "id long, routes array<struct<gm_code:string>>")
    assert routing.filter_routes(df).count() == 2
    assert [r["id"] for r in routing.filter_routes(df, Settings(max_routes=1)).collect()] == [1]
    assert [r["id"] for r in routing.filter_routes(df, Settings(blocked_codes=("B",))).collect()] == [1]


def test_accounting_edge(spark):
    rows = [(1, NOW - timedelta(hours=6)), (2, NOW - timedelta(hours=6, seconds=1)), (3, None)]
    df = spark.createDataFrame(rows, "id long, gmt_create timestamp_ntz")
    assert [r["id"] for r in accounting.countable(df, at(NOW)).collect()] == [1]


def test_snapshot_interval(spark):
    last = NOW - timedelta(minutes=10)
    events = spark.createDataFrame([("old", "active", 5, NOW - timedelta(hours=2), None, None), ("new", "active", 2, last, None, None)], "risk_event_id string, status string, risk_event_volume long, initial_timestamp timestamp_ntz, threshold_breach_timestamp timestamp_ntz, last_alerted_timestamp timestamp_ntz")
    timeline = spark.createDataFrame([("old", last)], "risk_event_id string, snapshot_time timestamp_ntz")
    voices = [("1", "old", last), ("2", "old", NOW), ("3", "old", NOW + timedelta(seconds=1)), ("4", "new", last), ("5", "new", last - timedelta(seconds=1))]
    got = snapshot.snapshot(events, timeline, spark.createDataFrame(voices, MAPPING), at(NOW))
    assert {r["risk_event_id"]: r["incremental_volume_at_snapshot"] for r in got.collect()} == {"old": 1, "new": 1}


def test_model_failures_are_null_with_a_reason(spark):
    class Broken:
        def answer(self, prompt):
            raise RuntimeError("no")

        def embed(self, texts):
            raise RuntimeError("no")

    df = spark.createDataFrame([(1, "A"), (2, "B"), (3, "A")], "id long, title string")
    got = models.summarized(df, "id", "title", Broken).orderBy("id").collect()
    assert [r["initial_summary_text"] for r in got] == ["A", "B", "A"] and all("no" in r["summary_error"] for r in got)
    assert [r["initial_summary_text"] for r in models.summarized(df, "id", "title", models.EchoModel).orderBy("id").collect()] == ["A", "B", "A"]
    assert models.embedded(df, "id", "title", Broken).where("embedding IS NULL").count() == 3


def test_rerank(spark):
    df = spark.createDataFrame([("red ring", "red ring"), ("red ring", "blue bolt"), ("x", None)], "q string, t string").where("t IS NOT NULL")
    got = {r["t"]: r["score"] for r in models.reranked(df, "q", "t", models.CosineReranker).collect()}
    assert got["red ring"] == 1.0 > got["blue bolt"]


def test_stages_end_to_end(spark):
    titles = ["the red ring is broken again", "the red ring is broken again!", "cold gear shipment is late now", "too short"]
    voices = spark.createDataFrame([(i, str(i), t, NOW) for i, t in enumerate(titles)], "id long, voice_id string, title string, gmt_create timestamp_ntz")
    words = routing.keyword_table(spark.createDataFrame([("R1", "l", "ring", None)], "gm_code string, goc_product_line string, entity string, action string"))
    nothing = lambda missed: missed.select("id", F.lit("S").alias("gm_code"), F.lit("l").alias("goc_product_line"), F.lit(0.1).alias("score"), F.lit("c").alias("collection_name"), F.lit("d").alias("document"))
    enriched = route_and_enrich(voices, Rules(), words, nothing, models.HashEmbedder, models.EchoModel)
    assert {r["id"]: r["gm_code"] for r in enriched.collect()} == {0: "R1", 1: "R1", 2: "default"}
    grouped = cluster(enriched, Settings(cluster_distance=0.2))
    ids = {r["id"]: r["batch_cluster_id"] for r in grouped.collect()}
    assert ids[0] == ids[1] != ids[2]
    vector = models.HashEmbedder().embed(["theredringisbrokenagain"])[0]
    kb = spark.createDataFrame([("E1", "R1", "theredringisbrokenagain", vector)], "risk_event_id string, gm_code string, risk_event_title string, embedding array<double>")
    activity = spark.createDataFrame([("E1", NOW)], "risk_event_id string, last_active_timestamp timestamp_ntz")
    decided = match_and_decide(grouped, kb, kb.limit(0), activity, at(NOW), models.HashEmbedder)
    final = {r["id"]: (r["decision"], r["risk_event_id"]) for r in decided.collect()}
    assert final[0] == ("merge", "E1") and final[2] == ("create_new", ids[2])
    asked = match_and_decide(grouped, kb, kb.limit(0), activity, at(NOW), models.HashEmbedder, decider(models.OfflineModel), reranker=models.CosineReranker)
    assert {r["id"]: r["decision"] for r in asked.collect()}[1] == "merge"
    whole = summarize_clusters(grouped, models.OfflineModel)
    assert {r["id"]: (r["batch_cluster_title"], r["batch_cluster_success"]) for r in whole.collect()}[1] == (titles[0], True)
    large = summarize_clusters(grouped, models.OfflineModel, Settings(split_members=1)).where("id = 1").first()
    assert large["batch_cluster_title"] in titles[:2] and large["batch_cluster_success"]  # over two prompts
    none = summarize_clusters(grouped, models.OfflineModel, Settings(split_members=0)).where("id = 1").first()
    assert (none["batch_cluster_title"], none["batch_cluster_success"], none["batch_cluster_id"]) == ("theredringisbrokenagain", False, ids[0])


def _decided(rows, spark):
    return spark.createDataFrame(rows, "id long, voice_id string, title string, gm_code string, gmt_create timestamp_ntz, risk_event_id string, decision string")


def test_manage_events(spark):
    events = spark.createDataFrame([("E1", "t", "active", "A", None, None, 10, NOW - timedelta(days=1), NOW, None, None)], schemas.RISK_EVENT)
    rows = [(i, str(i), "x", "A", NOW, "E1", "merge") for i in range(4)] + [(9, "9", "y", "B", NOW, "E2", "create_new"), (10, "10", "z", "B", NOW, "E3", "suppress_as_false_positive"), (11, "11", "w", "B", NOW - timedelta(hours=7), "E4", None)]
    out = manage_events(_decided(rows, spark), events, spark.createDataFrame([], MAPPING), spark.createDataFrame([], schemas.VOLUME_TIMELINE), at(NOW))
    state = {r["risk_event_id"]: r for r in out.events.collect()}
    assert state["E1"]["risk_event_volume"] == 14 and state["E2"]["risk_event_volume"] == 1 and set(state) == {"E1", "E2"}
    alerts = out.alerts.collect()
    assert [(r["risk_event_id"], r["alert_type"], r["volume_at_alert"]) for r in alerts] == [("E1", "first_alert", 14)]
    assert [(r["risk_event_id"], r["risk_event_title"], r["goc_product_line"], r["data_source"]) for r in out.knowledge.collect()] == [("E2", "y", "unknown", "feedback")]
    assert state["E1"]["threshold_breach_timestamp"] == NOW == state["E1"]["last_alerted_timestamp"]
    assert out.stats.first().asDict() == {"mappings": 7, "new_events": 1, "updated_events": 1, "alerts_triggered": 1, "suppressed_voices": 1}


@pytest.fixture
def voices(spark, tmp_path):
    rows = [(i, str(i), "t", f"C{i % 3}", NOW + timedelta(minutes=i), f"E{i % 5}", None) for i in range(60)]
    for part in range(3):
        _decided(rows[part * 20 : part * 20 + 20], spark).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return tmp_path


def _state(worker):
    return sorted((r["risk_event_id"], r["risk_event_volume"], r["initial_timestamp"]) for r in worker.events.version().collect())


def test_stream_restart_and_replay(spark, voices):
    schema = "id long, voice_id string, title string, gm_code string, gmt_create timestamp_ntz, risk_event_id string, decision string"
    job = Worker(spark, f"file://{voices}/a", lambda b: b)
    for _ in range(2):  # the second run finds nothing new
        job.start(file_stream(spark, str(voices / "in"), schema, 1), f"file://{voices}/a/checkpoint", availableNow=True).awaitTermination()
    assert sum(v for _, v, _ in _state(job)) == 60 and job.mapping.read().count() == 60
    before, batch = _state(job), spark.read.schema(schema).parquet(str(voices / "in")).where("id >= 40")
    again = Worker(spark, f"file://{voices}/b", lambda b: b)
    for epoch, low in enumerate((0, 20, 40)):
        again.process(spark.read.schema(schema).parquet(str(voices / "in")).where(F.col("id").between(low, low + 19)), epoch)
    once = _state(again)
    again.process(batch, 2)  # a replay of the last epoch
    assert _state(again) == once and sum(v for _, v, _ in once) == sum(v for _, v, _ in before)


def test_answers_that_vary_are_taken_once(spark, voices):
    """An epoch that is processed again keeps its decisions, and all its tables with them."""
    asked = []

    def decide(batch):
        asked.append(1)
        return batch.withColumn("risk_event_id", F.concat(F.lit(f"R{len(asked)}-"), "risk_event_id"))

    schema = "id long, voice_id string, title string, gm_code string, gmt_create timestamp_ntz, risk_event_id string, decision string"
    rows = spark.read.schema(schema).parquet(str(voices / "in"))
    job = Worker(spark, f"file://{voices}/w", decide, embedder=models.HashEmbedder)
    tables = (job.events, job.mapping, job.alerts, job.timeline, job.knowledge, job.decided)
    seen = []
    for epoch in (0, 1, 1):
        job.process(rows.where(F.col("id").between(epoch * 30, epoch * 30 + 29)), epoch)
        seen.append([sorted(map(str, t.read().collect())) for t in tables])
    assert len(asked) == 2 and seen[1] == seen[2]
    assert {r["risk_event_id"] for r in job.mapping.epoch(1).collect()} == {r["risk_event_id"] for r in job.knowledge.epoch(1).collect()} == {f"R2-E{i}" for i in range(5)}


def _sources(spark, folder):
    """Two files of voices, an hour apart, and a keyword dictionary."""
    for part, (title, n) in enumerate((("the red ring is broken again today", 4), ("the red ring is broken again today", 5))):
        rows = [(100 * part + i, f"{part}-{i}", title, NOW + timedelta(minutes=60 * part + i), None, "app", "u", "x") for i in range(n)]
        rows += [(100 * part + 50, None, title, NOW, None, "app", "u", "x"), (100 * part + 51, f"{part}-51", "short", NOW, None, "app", "u", "x")]
        spark.createDataFrame(rows, schemas.VOICE_SOURCE).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    (folder / "words.csv").write_text("gm_code,goc_product_line,entity,action\nR1,line_a,ring,\n")
    (folder / "stop.txt").write_text("the\n\nis\n")


def test_events_of_one_batch_are_found_by_the_next(spark, tmp_path):
    _sources(spark, tmp_path)
    keywords = routing.keyword_table(spark.read.csv(f"{tmp_path}/words.csv", header=True, schema="gm_code string, goc_product_line string, entity string, action string"))
    engine = Engine(spark, f"file://{tmp_path}/e", Resources(keywords))
    for epoch in (0, 1):
        engine.process(spark.read.parquet(f"{tmp_path}/in").where(F.col("id").between(100 * epoch, 100 * epoch + 99)), epoch)
    assert [(r["risk_event_volume"], r["gm_code"], r["goc_product_line"], r["status"]) for r in engine.events.version().collect()] == [(9, "R1", "line_a", "active")]
    assert {r["decision"] for r in engine.decided.epoch(1).collect()} == {"merge"}
    assert engine.mapping.read().count() == 9 and engine.knowledge.read().count() == 1 and engine.alerts.read().count() >= 1
    assert engine.timeline.read().agg(F.sum("incremental_volume_at_snapshot")).first()[0] == 9


def test_entry_job(spark, tmp_path):
    _sources(spark, tmp_path)
    failures = main(["--source", f"{tmp_path}/in", "--folder", f"file://{tmp_path}/job", "--keywords", f"{tmp_path}/words.csv", "--stopwords", f"{tmp_path}/stop.txt", "--every", "0", "--runs", "2"])
    assert failures == []
    state = spark.read.parquet(f"{tmp_path}/job/risk_event")
    assert state.where("epoch = 1").agg(F.sum("risk_event_volume")).first()[0] == 9 and state.agg(F.max("epoch")).first()[0] == 1


def test_cadence_backs_off():
    waits, runs = [], iter([RuntimeError("down"), None, None])

    class Run:
        def awaitTermination(self):  # noqa: N802
            if error := next(runs):
                raise error

    assert cadence(Run, every=120, pause=10, runs=3, sleep=waits.append) == ["RuntimeError: down"]
    assert waits[0] == 10 and 119 < waits[1] <= 120 and len(waits) == 2


def test_snapshots_keep_their_distance(spark, tmp_path):
    schema = "id long, voice_id string, title string, gm_code string, gmt_create timestamp_ntz, risk_event_id string, decision string"
    job = Worker(spark, f"file://{tmp_path}/s", lambda b: b)
    for epoch, minute in enumerate((0, 5, 12)):
        job.process(spark.createDataFrame([(epoch, str(epoch), "t", "A", NOW + timedelta(minutes=minute), "E", None)], schema), epoch)
    got = {r["snapshot_time"]: r["incremental_volume_at_snapshot"] for r in job.timeline.read().collect()}
    assert got == {NOW: 1, NOW + timedelta(minutes=12): 2}


def test_blocks_give_what_all_pairs_give(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "A" if i % 3 else "B", (rng.standard_normal(8) if i % 50 else np.zeros(8)).tolist() if i % 61 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k string, v array<double>")
    want = {}
    for i, k, v in rows:
        for j, m, w in rows:
            if i < j and k == m and v and w:
                size = np.linalg.norm(v) * np.linalg.norm(w)
                want[i, j] = round(1 - (np.dot(v, w) / size if size > 1e-8 else 0), 6)
    every = lambda d, a, b: np.nonzero(d < 0.5)
    for block in (16, 1024):
        got = {(r["a"], r["b"]): r["distance"] for r in vector_search.block_join(df, df, "k", "id", "v", 6, every, block).where("a < b").collect()}
        assert got == pytest.approx({p: d for p, d in want.items() if d < 0.5}, abs=2e-6)
    near = vector_search.knn(df.where("id < 20"), df, 3, None, "id", "v").where("query_id = 4").orderBy("rank").collect()
    assert near[0]["hit_id"] == 4 and near[0]["distance"] == 0 and [r["rank"] for r in near] == [1, 2, 3]
