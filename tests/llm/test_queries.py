"""Every registered corpus query without SQL, and the whole pipeline, against brute force over a small table."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from helpers import near_groups

import corpus_pipeline as cp
from voxtide.llm import langid, near_dedup, packing, queries
from voxtide.llm.common import discard, maybe_among, stored
from voxtide.llm.queries import tokenizer_path

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def test_mixing(spark, texts):
    got = queries.QUERIES["op2_mixing"](spark, SMALL).toPandas()
    assert list(got.columns) == ["doc_id", "tokens", "p_high", "p_low", "p_toxic", "domain", "rate", "copies", "miss"]
    assert dict(zip(got.doc_id, got.tokens, strict=True)) == {d: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t in texts.items()}
    p = got[["p_high", "p_low", "p_toxic"]].to_numpy()
    totals = (got.tokens * got.rate).to_numpy() @ p / got.tokens.sum()
    assert abs(np.abs(totals - [queries.WEIGHTS[d] for d in ("high", "low", "toxic")]).max() - got.miss[0]) < 1e-6
    assert ((got.copies - got.rate).abs() < 1).all() and (got.domain == np.array(["high", "low", "toxic"])[p.argmax(axis=1)]).all()


def test_media(spark, texts):
    got = queries.QUERIES["op3_media_tiles"](spark, SMALL).toPandas().set_index("doc_id")
    assert set(got.index) == set(texts)
    for d, t in texts.items():
        raw = t.encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        image = b"P6\n64 %d\n255\n" % (len(payload) // 192) + payload
        r = got.loc[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(image), hashlib.sha256(image).hexdigest())
        grey = np.frombuffer(payload, np.uint8).reshape(-1, 64, 3) @ np.array([0.299, 0.587, 0.114])
        fine = np.repeat(np.repeat(grey, 8, 0), 9, 1).reshape(8, len(grey), 9, 64).mean(axis=(1, 3))  # whole pixels of each area
        clear = np.abs(fine[:, :-1] - fine[:, 1:]) > 1e-6
        bits = np.unpackbits(np.frombuffer(bytes.fromhex(r.feature), np.uint8)).reshape(8, 8).astype(bool)
        assert (bits == (fine[:, :-1] < fine[:, 1:]))[clear].all()


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    got = queries.QUERIES["op5_best_fit_packing"](spark, SMALL).toPandas()
    library, want = Tokenizer.from_file(tokenizer_path()), {}
    for d, t in texts.items():
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4")
        for piece, start in enumerate(range(0, len(ids), 4096)):
            want[d, piece] = (start, len(ids[start : start + 4096]), zlib.crc32(ids[start : start + 4096].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    loads = got.groupby("sequence_id").length.sum()
    assert loads.max() <= 4096 and len(loads) == -(-got.length.sum() // 4096)


def test_sharding(spark, texts):
    got = queries.QUERIES["op6_shards"](spark, SMALL).toPandas().set_index("doc_id")
    assert {d: (r["size"], r["text_crc32"]) for d, r in got.iterrows()} == {d: (len(t.encode()) + 16, zlib.crc32(t.encode())) for d, t in texts.items()}
    groups: dict[str, list[int]] = {}
    for d, t in texts.items():
        groups.setdefault(t, []).append(d)
    assert all(got.loc[g, "shard"].nunique() == 1 for g in groups.values()) and set(got["law"]) == {"bytes"} and got.grown_shard.isna().all()
    assert all(sorted(x["slot"]) == list(range(len(x))) for _, x in got.groupby("shard")) and got["shard"].between(0, 39).all()
    # greedy bound: no shard is above the mean by more than the largest group that shares one
    sizes, loads = sorted((sum(got.loc[g, "size"]) for g in groups.values()), reverse=True), got.groupby("shard")["size"].sum()
    assert loads.max() <= max(sizes[0], -(-sum(sizes) // 40) * 1.35)


def test_language(spark, texts):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = queries.QUERIES["op9_language_id"](spark, SMALL).toPandas().set_index("doc_id")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert set(got.index) == set(texts) and {d: bool(r["held_out"]) for d, r in got.iterrows()} == {d: zlib.crc32(str(d).encode()) % 4 == 2 for d in texts}
    model = langid.fit(docs, langid.learnable())
    for d, r in got.iterrows():  # the nearest centroid by dense vectors and plain counting
        if not any(map(str.isalpha, texts[d])):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        at, count = next(langid.vectors([texts[d].encode()]))
        dense = np.zeros(langid.BUCKETS)
        dense[at] = (1 + np.log(count)) * model.idf[at]
        cosine = model.centroids.astype(float) @ (dense / np.linalg.norm(dense))
        assert model.languages[int(cosine.argmax())] == r["lang_pred"] and abs(r["score"] - cosine.max()) < 1e-5
    told = [d for d in texts if lang[d] and got.loc[d, "held_out"] and any(map(str.isalpha, texts[d]))]
    assert sum(got.loc[d, "lang_pred"] == lang[d] for d in told) >= 0.9 * len(told)


def test_near(spark, texts):
    got = queries.QUERIES["op10_near_dedup"](spark, SMALL).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == near_groups(list(texts.items()), 2)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_pipeline(spark, texts):
    got = cp.run(spark, SMALL).toPandas()
    first: dict[str, int] = {}
    for d in sorted(texts):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[d]), d)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    known = {r["doc_id"] for r in cp.language_id(spark, docs, SMALL).select("doc_id").collect()}
    first = {}
    for d in sorted(known):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[d]), d)
    stay = {d for d, (_, root) in near_groups([(d, texts[d]) for d in first.values()], 5).items() if d == root}
    assert set(got.doc_id) <= stay and len(set(got.doc_id)) >= 0.9 * len(stay)
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all() and got.groupby("sequence_id").length.sum().max() <= 4096


def test_mix_stage_meets_its_targets(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = cp.mixing.quality_domains(spark.read.parquet(f"{folder}/labels.parquet"))
    fitted = cp.mixing.mix(docs, labels, cp.FACTORS, of_present=True, least=cp.LEAST)
    rates = fitted.rates.toPandas()
    assert fitted.settled and fitted.miss < 1e-3 and (rates.rate[rates.domain != "toxic"] >= 1).all()
    p, before = np.array(rates.p.tolist()), rates.set_index("doc_id").tokens
    times = cp.mix(spark, docs, folder).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    came = (before.index.map(times).fillna(0).to_numpy() * before.to_numpy()) @ p
    assert np.allclose(came, fitted.targets, rtol=0.05) and set(rates.doc_id[rates.domain != "toxic"]) <= set(times.index)


def test_stars_and_filters(spark):
    """A star of many partners is verified in parts, and a filter never loses a key, however full it is."""
    base = [f"w{i}" for i in range(50)]
    rng = random.Random(1)
    rows = [(i, " ".join([*base[: 50 - i % 12], *(f"x{rng.random()}" for _ in range(i % 12))])) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = stored(spark.createDataFrame([(0, i) for i in range(1, 80)] + [(5, 17)], "a long, b long"), "pairs")
    got = {tuple(r) for r in near_dedup.verified(pairs, docs, 2, 80, star=7).collect()}
    groups = lambda a, b: near_groups([rows[a], rows[b]], 2)[b][1] == a
    assert got == {(a, b) for a, b in [(0, i) for i in range(1, 80)] + [(5, 17)] if groups(a, b)}
    keys = spark.range(0, 5000, 7).withColumnRenamed("id", "k")
    all_ids = spark.range(5000)
    for words in (64, 1 << 19):
        maybe = all_ids.where(maybe_among([all_ids["id"]], keys, words))
        assert maybe.where("id % 7 = 0").count() == keys.count() and (words == 64 or maybe.count() < 1.2 * keys.count())
    assert all_ids.where(maybe_among([all_ids["id"]], keys.limit(0))).count() == 0
    discard(pairs)
    assert packing.MEMO > 0
