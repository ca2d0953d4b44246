"""Word lattices, the index of vectors, the automaton of rules, prefix sums and keyed stream state against brute force."""

import itertools
import math
import random
import time
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtide.config import Settings
from voxtide.functions import text
from voxtide.operators import increments, rule_automaton, segmentation, vector_search
from voxtide.plans import catalog, extended
from voxtide.sources import vector_index
from voxtide.streaming import state, worker

SF = "/root/testdata/sf0.01"
WORDS = ["无法", "付款", "无法付", "款订", "订单", "单失败", "失败", "a付"]


def paths(run, costs):
    """All segmentations of a run, with their costs."""
    if not run:
        yield 0, []
        return
    for n in costs.lengths:
        if n <= len(run) and (cost := costs.words.get(run[:n], costs.unseen if n == 1 else None)) is not None:
            for rest, words in paths(run[n:], costs):
                yield cost + rest, [run[:n], *words]


def merged(words):
    groups = itertools.groupby(words, key=lambda w: len(w) == 1)
    return [w for single, ws in groups for w in (["".join(ws)] if single else ws)]


def test_cheapest_path_is_that_of_all_segmentations():
    rng = random.Random(1)
    for _ in range(200):
        costs = segmentation.Costs({w: rng.randrange(1, 20) for w in [*segmentation.dictionary(WORDS), *"无法付款订单失败"]}, 15, (1, 2, 3))
        run = "".join(rng.choice("无法付款订单失败额") for _ in range(rng.randrange(1, 10)))
        cost, words = segmentation.cheapest(run, costs)
        every = list(paths(run, costs))
        assert cost == min(c for c, _ in every) and words in [merged(w) for c, w in every if c == cost] and "".join(words) == run
        uses, want, whole = Counter(), Counter(), sum(math.exp(-c / 1000) for c, _ in every)
        segmentation.expected(run, costs, uses, 3.0)
        for c, w in every:
            want.update({x: 3.0 * math.exp(-c / 1000) / whole * k for x, k in Counter(w).items()})
        assert all(abs(uses[x] - want[x]) < 1e-9 for x in uses | want)


def test_words_of_titles(spark):
    titles = spark.createDataFrame([(1, "无法付，款订单失败 abc"), (2, None), (3, ""), (4, "额度额度"), (5, "订单失败"), (5, "订单失败"), (6, "x 付款 RED 1")], "id long, title string")
    costs = segmentation.learn(titles, WORDS, rounds=3)
    assert costs.lengths == (1, 2, 3) and costs.words["失败"] < costs.unseen
    got = {r["id"]: r["tokens"] for r in segmentation.tokens(titles, costs, F.array(F.lit("RED"))).collect()}
    assert got[2] == got[3] == [] and got[4] == ["额度额度"] and got[6] == ["付款"] and got[1][-1] == "ABC" and "".join(got[1][:-1]) == "无法付款订单失败"
    assert segmentation.learn(titles.limit(0), WORDS).words == {"A付": 0} | {w: 0 for w in WORDS[:-1]}


def vectors(n, keys, seed, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 16))
    return [(i, f"k{i % keys}", [float(v) for v in (centres[i % 12] + spread * rng.normal(size=16) if i % 50 else np.zeros(16))]) for i in range(n)]


def test_index_is_exact_and_probing_proves(spark, tmp_path):
    kinds = "vec_id long, gm_code string, embedding array<double>"
    base, asked = spark.createDataFrame(vectors(900, 3, 5, 0.3) + [(9001, None, [1.0] * 16), (9002, "k0", None)], kinds), spark.createDataFrame(vectors(130, 4, 6, 0.3), kinds)
    index = vector_index.build(base, str(tmp_path / "index"), lists=12)
    want = {(r["query_id"], r["rank"]): (r["hit_id"], r["distance"]) for r in vector_search.knn(asked, base, 5, "gm_code").collect()}
    for opened in (index, vector_index.opened(spark, str(tmp_path / "index"))):
        got = {(r["query_id"], r["rank"]): (r["hit_id"], r["distance"]) for r in vector_index.search(asked, opened, 5, probes=2).collect()}
        assert got == want
    probed = vector_index.search(asked, index, 5, probes=3, exact=False).collect()
    found = {(r["query_id"], r["hit_id"]) for r in probed}
    real = {q: {h for (i, _), (h, _) in want.items() if i == q} for q, _ in want}
    clear = [q for q in real if q % 50]  # a zero vector is as far from all
    assert sum(len(real[q] & {h for i, h in found if i == q}) for q in clear) >= 0.95 * sum(len(real[q]) for q in clear)
    proven = {r["query_id"] for r in probed if r["proven"]}
    assert all(real[q] == {h for i, h in found if i == q} for q in proven)
    assert vector_index.search(asked.limit(0), index, 5).count() == 0
    assert vector_index.search(asked, vector_index.build(base.limit(0), str(tmp_path / "none")), 5).count() == 0


def test_a_query_travels_once_a_shelf(spark, tmp_path, monkeypatch):
    """Not once for each list that it needs; with shelves of 60 vectors, still the exact result."""
    kinds = "vec_id long, gm_code string, embedding array<double>"
    base, asked = spark.createDataFrame(vectors(900, 3, 5, 3.0), kinds), spark.createDataFrame(vectors(130, 3, 6, 3.0), kinds)
    sent, join = [], vector_index.over_blocks

    def counted(left, *rest, **more):
        sent.append(left.count())
        return join(left, *rest, **more)

    monkeypatch.setattr(vector_index, "over_blocks", counted)
    want = {(r["query_id"], r["rank"]): (r["hit_id"], r["distance"]) for r in vector_search.knn(asked, base, 5, "gm_code").collect()}
    for shelf, most in ((10_000, 130), (60, 130 * 6)):
        sent.clear()
        monkeypatch.setattr(vector_index, "SHELF", shelf)
        index = vector_index.build(base, str(tmp_path / f"index{shelf}"), lists=30)
        got = {(r["query_id"], r["rank"]): (r["hit_id"], r["distance"]) for r in vector_index.search(asked, index, 5, probes=2).collect()}
        assert got == want and len(sent) == 2 and all(n <= most for n in sent)


def test_recall_of_probing(spark):
    real = {(r["query_id"], r["hit_id"]) for r in catalog.QUERIES["knn_topk"](spark, SF).collect()}
    found = {(r["query_id"], r["hit_id"]) for r in extended.knn_probed(spark, SF).collect()}
    assert len(real & found) >= 0.95 * len(real)


def test_rules_in_one_pass(spark):
    rng = random.Random(2)
    letters = ["".join(x) for n in (1, 2, 3) for x in itertools.product("abc", repeat=n)]

    def pick(n):
        return tuple(rng.sample(letters, n))

    rules = catalog.Rules(
        prefixes=tuple((rng.choice(letters), rng.randrange(1, 9)) for _ in range(10)), any_of=pick(3), all_of=tuple(pick(3) for _ in range(15)) + (("cab", "cab"),),
        all_within=tuple((pick(2), rng.randrange(3, 9)) for _ in range(15)), include_exclude=tuple((pick(2), pick(2)) for _ in range(15)),
    )
    rows = [("".join(rng.choice("abcd") for _ in range(rng.randrange(0, 10))),) for _ in range(400)] + [(None,)]
    df = rule_automaton.tested(spark.createDataFrame(rows, "title string"), rules)
    t = F.col("title")
    plain = {"prefix": text.prefix_rule(t, rules.prefixes), "any": text.any_keyword(t, rules.any_of), "all": text.all_keywords(t, rules.all_of), "within": text.keywords_within(t, rules.all_within), "include": text.include_exclude(t, rules.include_exclude)}
    assert df.where(" OR ".join(["false"])).count() == 0
    for kind, rule in plain.items():
        assert df.where(~rule_automaton.meets(kind).eqNullSafe(rule)).count() == 0, kind


def test_cost_follows_hits_not_rules():
    rng = random.Random(3)
    titles = ["".join(rng.choice("abcdefgh ") for _ in range(60)) for _ in range(300)]

    def seconds(n):
        groups = [tuple("".join(rng.choice("ijklmnop") for _ in range(6)) for _ in range(3)) for _ in range(n)]
        automaton = rule_automaton.Automaton(all_of=groups)
        began = time.perf_counter()
        for t in titles:
            assert not automaton.met(t)
        return time.perf_counter() - began

    assert min(seconds(5000) for _ in range(3)) < 5 * min(seconds(50) for _ in range(3)) + 0.01


def test_prefix_sums(spark):
    rng, start = random.Random(4), datetime(2024, 1, 1)
    voices = [(None if i % 31 == 0 else i, f"e{rng.randrange(4)}", start + timedelta(minutes=10 * rng.randrange(0, 400))) for i in range(600)]
    df = spark.createDataFrame(voices, "voice_id long, risk_event_id string, voice_date timestamp_ntz").withColumn("part", F.col("voice_date") > F.lit("2024-01-02").cast("timestamp_ntz"))
    prefix = increments.extended(increments.extended(None, df.where("part")), df.where("NOT part"))
    once = increments.extended(None, df)
    assert sorted(map(tuple, prefix.collect())) == sorted(map(tuple, once.collect()))
    asked = [(f"e{i}", start + timedelta(minutes=10 * low), closed, start + timedelta(minutes=10 * high)) for i in range(5) for low, closed, high in [[rng.randrange(0, 400), rng.random() < 0.5, 0]] for high in [low + rng.randrange(-2, 60)]]
    got = increments.interval_counts(spark.createDataFrame(asked, "risk_event_id string, low timestamp_ntz, closed boolean, high timestamp_ntz"), prefix, df)
    want = {e: sum(v is not None and who == e and (low <= t <= high if closed else low < t <= high) for v, who, t in voices) if low <= high else 0 for e, low, closed, high in asked}
    assert {r["risk_event_id"]: r["n"] for r in got.collect()} == want


def split_by_time(spark, folder, n):
    rows = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts", "event_id").toPandas()
    for i, part in enumerate(np.array_split(np.arange(len(rows)), n)):
        frame = rows.iloc[part].assign(ts=rows.iloc[part]["ts"].astype("datetime64[us]"))
        yield lambda i=i, frame=frame: frame.to_parquet(f"{folder}/part-{i}.parquet")


@pytest.mark.parametrize("name", ["alerts", "snapshots"])
def test_state_goes_on_after_a_restart(spark, tmp_path, name):
    (tmp_path / "in").mkdir()
    kept = state.alerts if name == "alerts" else state.snapshots
    for write in split_by_time(spark, tmp_path / "in", 3):
        write()
        stream = worker.file_stream(spark, str(tmp_path / "in"), catalog.EVENTS, 1)
        out = state.drained(kept(stream, "event_type", "ts", extended.WATCH), name, str(tmp_path / "run"))
    want = catalog.QUERIES[f"stream_{name}"](spark, SF)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_silent_events_have_snapshots_until_they_are_forgotten(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [("a", start + timedelta(minutes=1)), ("a", start + timedelta(minutes=10)), ("b", start + timedelta(hours=9)), ("a", start + timedelta(hours=8)), (None, start), ("c", None)]
    spark.createDataFrame(rows, "e string, t timestamp_ntz").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = worker.file_stream(spark, str(tmp_path / "in"), "e string, t timestamp_ntz")
    got = state.drained(state.snapshots(stream, "e", "t", Settings(snapshot_lookback_hours=2)), "beat").where("risk_event_id = 'a'").collect()
    by_end = {r["snapshot_time"]: (r["volume_at_snapshot"], r["incremental_volume_at_snapshot"]) for r in got}
    assert by_end[start + timedelta(minutes=10)] == (2, 2) and by_end[start + timedelta(minutes=20)] == (2, 0)
    assert len(by_end) == len(got) and max(by_end) <= start + timedelta(hours=9) - timedelta(minutes=10)
    assert by_end[start + timedelta(hours=8)] == (3, 1) and by_end[start + timedelta(hours=8, minutes=50)] == (3, 0)


def test_prefix_sums_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(increments, "ROWS", 50)
    rows = [(i, f"E{i % 40}", datetime(2024, 1, 1) + timedelta(minutes=7 * i)) for i in range(1000)]
    voices = spark.createDataFrame(rows, "voice_id long, risk_event_id string, voice_date timestamp_ntz")
    first = increments.extended(None, voices.where("voice_id < 600"))
    whole = increments.extended(first, voices.where("voice_id >= 600"))
    assert first.rdd.getNumPartitions() >= 600 // 50 and whole.rdd.getNumPartitions() >= 1000 // 50  # tasks grow with the rows, so a task doesn't
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, increments.extended(None, voices).collect()))
    assert sum(r["n"] for r in whole.collect()) == 1000 == sum(r["u"] for r in whole.groupBy("risk_event_id").agg(F.max("upto").alias("u")).collect())
