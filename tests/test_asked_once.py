"""Models are asked once, whatever they answer; batches leave no tables behind; streams read tables of parts."""

import json
import os
import sys
import uuid
from collections import Counter

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from voxtide import job, models
from voxtide.config import Settings
from voxtide.operators import routing
from voxtide.plans import catalog, stages
from voxtide.sources.embedding_cache import EmbeddingCache
from voxtide.sources.shared import scratch, shared_folder, written
from voxtide.streaming import worker

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't import tests
SF = "/root/testdata/sf0.01"


class Logged:
    """Notes each call in a file that all workers append to."""

    def __init__(self, path):
        self.path = path

    def note(self, *calls):
        with open(self.path, "a") as f:
            f.writelines(c.replace("\n", " ") + "\n" for c in calls)


class CountingEmbedder(Logged):
    def embed(self, texts):
        self.note(*(f"embed {t}" for t in texts))
        return models.HashEmbedder().embed(texts)


class CountingReranker(Logged):
    def scores(self, query, texts):
        self.note(f"rerank {query}")
        return models.CosineReranker().scores(query, texts)


class VaryingModel(Logged):
    """Never says the same twice."""

    def answer(self, prompt):
        self.note(f"prompt {prompt}")
        return f"summary {uuid.uuid4()}"


def calls(path):
    return Counter(open(path).read().splitlines()) if os.path.exists(path) else Counter()


@pytest.fixture
def setting(spark, tmp_path):
    log = str(tmp_path / "calls")
    voices = spark.createDataFrame([(i, f"v{i}", f"payment number {'abcdef'[i]} failed again") for i in range(6)], "id long, voice_id string, title string")
    keywords = routing.keyword_table(spark.createDataFrame([("G1", "line", "nothing", None)], "gm_code string, goc_product_line string, entity string, action string"))
    rows = [(f"d{i}", models.HashEmbedder().embed([d])[0], "G1", "line", d) for i, d in enumerate(["payment failed", "login failed"])]
    collections = {"faq": spark.createDataFrame(rows, "vec_id string, embedding array<double>, gm_code string, goc_product_line string, document string")}

    def semantic(missed):
        return stages.semantic_search(missed, collections, lambda: CountingEmbedder(log), lambda: CountingReranker(log))

    return log, voices, keywords, semantic


def test_each_text_is_asked_once_and_no_voice_is_lost(setting):
    log, voices, keywords, semantic = setting
    out = stages.route_and_enrich(voices, stages.Rules(), keywords, semantic, lambda: CountingEmbedder(log), lambda: VaryingModel(log), Settings(route_score=0.0))
    rows = out.collect()
    assert len(rows) == 6 == len({r["initial_summary_text"] for r in rows}) and all(r["initial_summary_embedding"] for r in rows)
    seen = calls(log)
    assert set(seen.values()) == {1}
    assert Counter(k.split()[0] for k in seen) == {"prompt": 6, "embed": 12, "rerank": 6}  # 6 titles and 6 summaries


def test_titles_meet_their_voices_once(setting, monkeypatch):
    log, voices, keywords, semantic = setting
    copies = voices.crossJoin(voices.sparkSession.range(5).select(F.col("id").alias("copy"))).withColumn("id", F.col("id") * 5 + F.col("copy")).drop("copy")
    seen, summarized, embedded = [], models.summarized, models.embedded
    monkeypatch.setattr(models, "summarized", lambda df, *a, **k: (seen.append(df.count()), summarized(df, *a, **k))[1])
    monkeypatch.setattr(models, "embedded", lambda df, *a, **k: (seen.append(df.count()), embedded(df, *a, **k))[1])
    out = stages.route_and_enrich(copies, stages.Rules(), keywords, semantic, lambda: CountingEmbedder(log), lambda: VaryingModel(log), Settings(route_score=0.0))
    rows = out.collect()
    assert len(rows) == 30 == len({r["initial_summary_id"] for r in rows}) and len({r["initial_summary_text"] for r in rows}) == 6
    assert seen == [6, 6, 6]  # titles, not voices: to be searched for, summarized, embedded
    grouped = stages.cluster(out)
    assert grouped.count() == 30 and "initial_summary_embedding" not in grouped.columns


def test_hybrid_route_asks_once(setting):
    log, voices, keywords, semantic = setting
    titles = voices.withColumnRenamed("title", "t").selectExpr("t AS id", "t AS title", "split(upper(t), ' ') AS tokens")
    routes = routing.hybrid_route(titles, routing.keyword_route(titles, keywords), semantic, Settings(route_score=0.0))
    assert {r["gm_code"] for r in routes.collect()} == {"G1"} and routes.count() >= 6
    assert Counter(k.split()[0] for k in calls(log).elements()) == {"embed": 6, "rerank": 6}


def folders(spark):
    return set(os.listdir(shared_folder(spark).removeprefix("file://")))


def test_scratch_tables_go(spark):
    before = folders(spark)
    with pytest.raises(ZeroDivisionError), scratch():
        kept = written(spark.range(3), "inside")
        assert kept.count() == 3 and len(folders(spark)) == len(before) + 1
        1 / 0
    assert folders(spark) == before


def test_batches_leave_no_tables_and_few_versions(spark, tmp_path):
    def decide(batch):
        return written(batch, "decided-by")

    job = worker.Worker(spark, str(tmp_path / "state"), decide)
    before = folders(spark)
    for epoch in range(5):
        rows = [(epoch * 10 + i, f"v{epoch}-{i}", "t", "G", f"2024-01-01T0{epoch}:00:00", f"E{i % 2}", "create_new") for i in range(4)]
        batch = spark.createDataFrame(rows, "id long, voice_id string, title string, gm_code string, gmt_create string, risk_event_id string, decision string")
        job.process(batch.withColumn("gmt_create", batch.gmt_create.cast("timestamp_ntz")), epoch)
        assert len(job.events.versions()) == 2
    assert folders(spark) == before
    assert {r["risk_event_id"]: r["risk_event_volume"] for r in job.events.version().collect()} == {"E0": 10, "E1": 10}
    job.process(batch.withColumn("gmt_create", batch.gmt_create.cast("timestamp_ntz")), 4)  # a replay
    assert {r["risk_event_id"]: r["risk_event_volume"] for r in job.events.version().collect()} == {"E0": 10, "E1": 10}


@pytest.mark.parametrize("name", ["stream_timeline", "stream_dedup", "stream_event_state"])
def test_streams_read_tables_of_parts(spark, tmp_path, name):
    spark.read.parquet(f"{SF}/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    one, parts = (sorted(map(tuple, catalog.QUERIES[name](spark, d).collect())) for d in (SF, str(tmp_path)))
    assert one == parts and one


def test_each_text_is_embedded_once_over_all_epochs(spark, tmp_path):
    log = str(tmp_path / "calls")
    keywords = routing.keyword_table(spark.createDataFrame([("G1", "line", "payment", None)], "gm_code string, goc_product_line string, entity string, action string"))
    engine = job.Engine(spark, str(tmp_path / "engine"), job.Resources(keywords, embedder=lambda: CountingEmbedder(log)))
    for epoch in range(3):
        rows = [(epoch * 10 + i, None if i == 5 else f"v{epoch}-{i}", f"payment number {'abcdefgh'[i + epoch]} failed again", f"2024-01-01T0{epoch}:00:00") for i in range(6)]
        batch = spark.createDataFrame(rows, "id long, voice_id string, title string, t string").withColumn("gmt_create", F.col("t").cast("timestamp_ntz")).drop("t")
        engine.process(batch, epoch)
    seen = calls(log)
    assert set(seen.values()) == {1} and len(seen) == 7  # a to g, as titles, summaries and clusters
    kept = engine.quarantine.read().collect()
    assert [(r["id"], r["reason"]) for r in sorted(kept)] == [(5, "no voice_id"), (15, "no voice_id"), (25, "no voice_id")]
    assert set(engine.replayed().columns) == {"id", "voice_id", "title", "gmt_create", "add_date", "voice_channel", "uid", "voice_detail_link"}


def test_cache_of_texts(spark, tmp_path):
    cache = EmbeddingCache(spark, str(tmp_path / "cache"), 4)
    texts = spark.createDataFrame([("a",), ("b",), ("a",)], "t string")
    assert cache.found(texts, "t").count() == 0
    for vector in ([2.0, 1.0], [1.0, 3.0]):
        cache.add(spark.createDataFrame([("a", vector), ("c", None)], "t string, v array<double>"), "t", "v")
    assert [tuple(r) for r in cache.found(texts.distinct(), "t").collect()] == [("a", [1.0, 3.0])]


def test_large_clusters_are_split_over_prompts(spark):
    rows = [(i, "c1" if i < 40 else "c2", f"summary {'ab'[i % 2]}{i % 20}" if i != 7 else None) for i in range(60)]
    clustered = spark.createDataFrame(rows, "id long, batch_cluster_id string, initial_summary_text string").withColumn("batch_cluster_title", F.lit("t"))

    class ByLetter:
        """Groups messages by their letter; prompts of other clusters get no answer that holds."""

        def answer(self, prompt):
            messages = json.loads(prompt.rsplit("\n", 1)[-1])
            assert len(messages) <= 12 and messages == sorted(messages)
            groups = {}
            for i, m in enumerate(messages):
                groups.setdefault(m[8], []).append(i)
            return json.dumps({"summaries": [{"text": f"problem {k}", "original_indices": v} for k, v in sorted(groups.items())]})

    out = stages.summarize_clusters(clustered, ByLetter, Settings(split_members=6)).collect()
    assert len(out) == 60
    for c in ("c1", "c2"):
        mine = [r for r in out if (r["id"] < 40) == (c == "c1") and r["id"] != 7]
        assert {(r["batch_cluster_title"], r["batch_cluster_success"]) for r in mine} == {("problem a", True), ("problem b", True)} and len({r["batch_cluster_id"] for r in mine}) == 2
    assert next((r["batch_cluster_id"], r["batch_cluster_success"]) for r in out if r["id"] == 7) == ("c1", False)


def test_a_batch_is_reduced_once(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(stages, "written", lambda df, name="table": (seen.append(name), written(df, name))[1])
    keywords = routing.keyword_table(spark.createDataFrame([("G1", "line", "payment", None)], "gm_code string, goc_product_line string, entity string, action string"))
    engine = job.Engine(spark, str(tmp_path / "engine"), job.Resources(keywords))
    rows = [(i, f"v{i // 2}", "payment number one failed again", "2024-01-01T00:00:00") for i in range(6)]
    engine.process(spark.createDataFrame(rows, "id long, voice_id string, title string, t string").withColumn("gmt_create", F.col("t").cast("timestamp_ntz")).drop("t"), 0)
    assert engine.mapping.read().count() == 3 and [r["risk_event_volume"] for r in engine.events.version().collect()] == [3]
    assert {n: seen.count(n) for n in ("kept", "routes", "parts", "final", "voices", "deltas", "judged")} == dict.fromkeys(("kept", "routes", "parts", "final", "voices", "deltas", "judged"), 1)


def test_only_what_is_counted_is_written_by_voice(spark, tmp_path, monkeypatch):
    made = []
    monkeypatch.setattr(stages, "written", lambda df, name="table": (made.append((name, t := written(df, name), t.count())), t)[1])
    keywords = routing.keyword_table(spark.createDataFrame([("G1", "line", "payment", None)], "gm_code string, goc_product_line string, entity string, action string"))
    engine = job.Engine(spark, str(tmp_path / "engine"), job.Resources(keywords))
    rows = [(i, f"v{i}", f"payment number {'abc'[i % 3]} failed again", "2024-01-01T00:00:00") for i in range(30)]
    engine.process(spark.createDataFrame(rows, "id long, voice_id string, title string, t string").withColumn("gmt_create", F.col("t").cast("timestamp_ntz")).drop("t"), 0)
    assert {name for name, _, n in made if n > 3} == {"kept", "voices"}  # the others have a row of each title or fewer
    assert engine.decided.epoch(0).count() == engine.mapping.read().count() == 30 == sum(r["risk_event_volume"] for r in engine.events.version().collect())
