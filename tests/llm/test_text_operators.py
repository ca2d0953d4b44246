import hashlib
import random
import re
import struct
import time
import tracemalloc
import zlib
from collections import Counter
from html.parser import HTMLParser
from unittest import mock

import numpy as np
import pytest
from conftest import SF, rows_of
from helpers import TEXTS, documents
from pyspark.sql import functions as F

from voxtide.llm import chat, html_text, langid, media, mixing, queries, warc


# Language ID


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 4000")
    got = langid.predict(docs, langid.fit(docs, langid.learnable())).join(docs.select("doc_id", "lang"), "doc_id").where(langid.held_out())
    right, every, gone = got.agg(F.count_if(F.col("lang_pred") == F.col("lang")), F.count("*"), F.count_if("rejected")).first()
    assert right >= 0.98 * every and gone == 0


def test_language_cases(spark):
    docs = documents(spark)
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"), langid.learnable())
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["rejected"] and got[i]["score"] == 0 for i in (3, 4, 7))
    assert got[11]["rejected"] and not got[0]["rejected"] and all(0 <= r["score"] <= 1 for r in got.values())
    kept = langid.keep_known(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["rejected"]}
    nothing = langid.fit(docs.limit(0), langid.learnable())
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_language_of_mostly_copies_is_learned(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").select("doc_id", "text", "lang").limit(100)
    bits = ["der Hund läuft nach Hause", "die Straße ist groß", "wir fahren morgen früh", "das Kind spielt im Garten", "ein Haus steht am Fluss", "heute scheint die Sonne"]
    copies = spark.range(10**6, 10**6 + 60_000).select(F.col("id").alias("doc_id"), F.element_at(F.array(*map(F.lit, bits)), (F.col("id") % 6 + 1).cast("int")).alias("text"), F.lit("xx").alias("lang"))
    model = langid.fit(docs.unionByName(copies), F.lit(True))
    assert set(model.languages) == {"en", "xx"} and model.languages.count("xx") == langid.CENTROIDS
    wordless = spark.createDataFrame([(1, "123", "en"), (2, "...", "en")], docs.schema)
    assert langid.fit(wordless, F.lit(True)).languages == []


def test_language_rejects_what_was_not_learned(spark):
    rng = random.Random(1)
    others = [
        "Il gatto dorme sul divano mentre la pioggia cade lentamente sulla città e i bambini giocano nella stanza accanto con le loro macchinine colorate.",
        "Kissa nukkuu sohvalla, kun sade putoaa hitaasti kaupungin ylle ja lapset leikkivät viereisessä huoneessa värikkäillä autoillaan.",
        "Kedi kanepede uyurken yağmur şehrin üzerine yavaşça yağıyor ve çocuklar yan odada renkli arabalarıyla oynuyorlar.",
        "Kot śpi na kanapie, podczas gdy deszcz powoli pada na miasto, a dzieci bawią się w sąsiednim pokoju kolorowymi samochodzikami.",
        "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(3000)),
        "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(5000)),
    ]
    for folder in (SF, "/root/testdata/sf0.1"):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        model = langid.fit(docs, langid.learnable())
        strange = spark.createDataFrame(list(enumerate(others)), "doc_id long, text string")
        assert all(r["rejected"] for r in langid.predict(strange, model).collect())
        assert langid.predict(docs, model).where("rejected").count() == 0


# Mixing


def test_mix_meets_targets(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), mixing.quality_domains(spark.read.parquet(f"{SF}/labels.parquet"))
    fitted = mixing.mix(docs, labels, {"high": 0.8, "low": 0.15, "toxic": 0.05})
    got = fitted.rates.toPandas()
    assert fitted.settled and set(got.miss) == {fitted.miss} and fitted.miss < 1e-4
    tokens, p, r = got.tokens.to_numpy(float), np.array(got.p.tolist()), got.rate.to_numpy()
    assert len(got) == docs.count() and (r >= 0).all() and np.allclose(p.sum(axis=1), 1)
    assert np.allclose((tokens * r) @ p / tokens.sum(), [0.8, 0.15, 0.05], atol=1e-4)
    text = dict(docs.select("doc_id", "text").collect())
    assert all(t == len(re.findall(r"[^\x20\x09-\x0D]+", text[d])) for d, t in zip(got.doc_id, got.tokens, strict=True))


def _solved(tokens, p, least, goal, steps=40_000):
    """Rates by many small projected-gradient steps in the metric of the least squares."""
    metric = np.linalg.pinv((tokens[:, None] * p).T @ p, rcond=1e-9, hermitian=True)
    r = np.maximum(least, 1.0)
    for _ in range(steps):
        r = np.maximum(least, r - p @ (metric @ ((tokens * r) @ p - goal)))
    return r, metric


@pytest.mark.parametrize(("factors", "low"), [((1.3, 0.6, 0.4), (0, 0, 0)), ((1.0, 1.0, 0.5), (1, 1, 0)), ((1.0, 1.0, 0.0), (1, 1, 0)), ((0.2, 0.2, 5.0), (0, 0.5, 0)), ((1.0, 1.0, 1.0), (0, 0, 0))])
def test_rates_against_a_plain_solver(spark, factors, low):
    rng = np.random.default_rng(4)
    tokens, p = rng.integers(0, 900, 160).astype(float), rng.dirichlet([0.3, 0.2, 0.1], 160)
    least = np.array(low, float)[p.argmax(axis=1)]
    goal = (tokens @ p) * np.array(factors)
    rows = [(i, int(t), x.tolist(), float(m)) for i, (t, x, m) in enumerate(zip(tokens, p, least, strict=True))]
    fitted = mixing.fit_rates(spark.createDataFrame(rows, "doc_id long, tokens long, p array<double>, least double"), goal.tolist())
    r = fitted.rates.orderBy("doc_id").toPandas().rate.to_numpy()
    want, metric = _solved(tokens, p, least, goal)
    off, best = ((tokens * x) @ p - goal for x in (r, want))
    assert fitted.settled and (r >= least).all() and np.allclose(off + goal, fitted.totals) and np.isclose(np.abs(off).max() / goal.sum(), fitted.miss)
    assert off @ metric @ off <= 1.02 * (best @ metric @ best) + 1e-6 * goal.sum()


def test_posteriors_against_brute_force(spark):
    folder = SF
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), mixing.quality_domains(spark.read.parquet(f"{folder}/labels.parquet"))
    domains = ["high", "low", "toxic"]
    model = mixing.fit(docs, labels, domains)
    aside = {r["doc_id"]: r["x"] % 4 == 0 for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit("calibrate")).alias("x")).collect()}
    sets = {r["doc_id"]: {w for w in re.split(r"[\x20\x09-\x0D]+", (r["text"] or "").lower()) if w} for r in docs.collect()}
    domain = {r["doc_id"]: r["domain"] for r in labels.collect() if r["doc_id"] in sets}
    n = {d: sum(domain[i] == d and not aside[i] for i in domain) for d in domains}
    sizes = {d: sum(x == d for x in domain.values()) for d in domains}
    xlogx = lambda x: x * np.log(x) if x > 0 else 0.0
    table: dict[str, list[float]] = {}
    counts = {d: Counter(w for i in domain if domain[i] == d and not aside[i] for w in sets[i]) for d in domains}
    for w in set().union(*counts.values()):
        c, row = {d: counts[d][w] for d in domains}, []
        for d in domains:
            size = sum(sizes[e] for e in domains if e != d)
            other = size * size / sum(sizes[e] ** 2 / n[e] for e in domains if e != d)
            there = sum(c[e] * sizes[e] / n[e] for e in domains if e != d) * other / size
            cells = [(c[d], n[d]), (there, other)]
            g = 2 * (sum(xlogx(x) + xlogx(m - x) - xlogx(m) for x, m in cells) - xlogx(c[d] + there) - xlogx(n[d] + other - c[d] - there) + xlogx(n[d] + other))
            row.append(np.log((c[d] + 0.5) / (n[d] + 1)) - np.log((there + 0.5) / (other + 1)) if g >= mixing.TELLING else 0.0)
        if any(row):
            table[w] = row
    assert {r["word"]: pytest.approx(r["w"]) for r in model.table.collect()} == table and table
    for r in mixing.posteriors(docs, model).collect():
        found = np.array([table[w] for w in sets[r["doc_id"]] if w in table]).reshape(-1, 3)
        z = [b + x * np.maximum(found[:, i], 0).sum() + y * np.minimum(found[:, i], 0).sum() for i, (b, (x, y)) in enumerate(zip(model.bias, model.weights, strict=True))]
        odds = np.exp(np.array(z) - max(z))
        assert np.allclose(r["p"], odds / odds.sum())


def test_posteriors_are_calibrated(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), mixing.quality_domains(spark.read.parquet(f"{folder}/labels.parquet"))
    unseen = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    model = mixing.fit(docs, labels.where(~unseen), ["high", "low", "toxic"])
    got = mixing.posteriors(docs, model).join(labels.where(unseen), "doc_id").toPandas()
    p, y = np.array(got.p.tolist()), np.array([["high", "low", "toxic"].index(d) for d in got.domain])
    share = np.bincount(y, minlength=3) / len(y)
    assert -np.log(p[np.arange(len(y)), y]).mean() < 0.5 * -(share * np.log(share)).sum()
    for k in range(3):
        bins = [(p[:, k] >= low) & (p[:, k] < low + 0.1) for low in np.arange(0, 1, 0.1)]
        assert sum(abs((p[x, k] - (y[x] == k)).sum()) for x in bins) < 0.03 * len(y)
    toxic = y == 2
    assert (p[toxic].argmax(axis=1) == 2).mean() > 0.75 and (p[~toxic].argmax(axis=1) == 2).mean() < 0.005


def test_mix_finds_toxic_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scored = mixing.mix(docs, mixing.quality_domains(labels), {"high": 1, "low": 1, "toxic": 0.3}, of_present=True).rates.join(labels, "doc_id").toPandas()
    toxic = scored.domain == "toxic"
    assert (toxic == (scored.toxic == 1)).mean() > 0.9 and scored.rate[toxic].mean() < 0.4


def test_mix_takes_no_label_without_a_document(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), mixing.quality_domains(spark.read.parquet(f"{SF}/labels.parquet"))
    gone = spark.range(10**9, 10**9 + 2000).select(F.col("id").alias("doc_id"), F.lit("toxic").alias("domain"))
    want, got = (mixing.posteriors(docs, mixing.fit(docs, x, ["high", "low", "toxic"])).orderBy("doc_id").toPandas() for x in (labels, labels.unionByName(gone)))
    assert np.allclose(got.p.tolist(), want.p.tolist())


def test_mix_does_not_thin_a_rare_domain(spark):
    rows = [(i, ("common " if i >= 40 else "rare ") + ("plain" if i % 2 else "words"), "b" if i >= 40 else "a") for i in range(4000)]
    all_rows = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    model = mixing.fit(all_rows.drop("domain"), all_rows.drop("text"), ["a", "b"], sample=400)
    assert {r["word"] for r in model.table.collect()} >= {"rare", "common"}
    got = mixing.posteriors(all_rows, model).join(all_rows, "doc_id").where((F.col("p")[0] > 0.5) != (F.col("domain") == "a"))
    assert got.count() == 0


def test_mix_cases(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(0, "a"), (6, "b"), (99, "a"), (8, None)], "doc_id long, domain string")
    got = mixing.mix(docs, labels, {"a": 0.5, "b": 0.5}).rates
    assert got.count() == docs.count() and got.where("rate IS NULL OR rate < 0").count() == 0
    assert mixing.mix(docs, labels.limit(0), {"a": 0.5, "b": 0.5}).rates.count() == docs.count()
    assert mixing.mix(docs.limit(0), labels, {"a": 0.5, "b": 0.5}).rates.count() == 0
    both = spark.createDataFrame([(0, "b"), (0, "a"), (6, "b")], "doc_id long, domain string")  # the least of two labels counts
    one = spark.createDataFrame([(0, "a"), (6, "b")], "doc_id long, domain string")
    want, got = (mixing.mix(docs, x, {"a": 0.5, "b": 0.5}).rates.orderBy("doc_id", "tokens").toPandas() for x in (one, both))
    assert np.allclose(want.p.tolist(), got.p.tolist())
    n = spark.range(20000).select(mixing.copies(F.lit(1.3), F.col("id")).alias("c")).agg(F.avg("c"), F.max("c")).first()
    assert abs(n[0] - 1.3) < 0.02 and n[1] == 2


# WARC


def test_warc_against_sql(spark, duck):
    got = queries.QUERIES["op1_warc"](spark, SF).toPandas()
    assert rows_of(got) == rows_of(duck.sql(queries.ORACLES["op1_warc"]).df())


def test_warc_round_trip(spark):
    big = "é\r\n\r\nWARC/1.1 " * 50_000
    rows = [(5, "u", big), (3, None, big), (1, "u 2", None), (2, "v", "x"), (4, "v", "x"), (None, "q", big), (7, "w", ""), (3, None, big)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string")
    manifest = warc.write_archives(warc.chunk_table(pages))
    chunks = warc.read_archives(manifest)
    assert chunks.agg(F.max(F.length("data"))).first()[0] <= warc.CHUNK
    summary = {(r["page_id"], r["record_type"]): r for r in warc.summaries(chunks).collect()}
    assert summary[5, "revisit"]["refers_to"] == 3 and summary[4, "response"]["refers_to"] is None and summary[1, "response"]["payload_bytes"] == 0
    assert {r["payload_digest"] for k, r in summary.items() if k[0] in (3, 5, None)} == {hashlib.sha256(big.encode()).hexdigest()}
    whole = b"".join(r["data"] for r in chunks.where("page_id IS NULL").orderBy("chunk_no").collect())
    assert whole == big.encode()
    assert warc.read_archives(warc.write_archives(warc.chunk_table(pages.limit(0)))).count() == 0


# Media


def test_media_features(spark):
    got = {r["doc_id"]: r for r in media.tiles(media.store_texts(documents(spark))).collect()}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        image = b"P6\n64 %d\n255\n" % (len(payload) // 192) + payload
        want = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest())
        assert tuple(got[i][c] for c in ("n_bytes", "samples_bytes", "samples_sha256", "tail_crc32", "media_bytes", "media_sha256")) == want
    assert got[0]["dhash"] == got[2]["dhash"] and np.load(__import__("io").BytesIO(got[0]["tile"])).shape == (8, 8, 3)
    assert media.tiles(media.store_texts(documents(spark).limit(0))).count() == 0


def test_decoders():
    p2 = media.decode(b"P2 # c\n2 2\n255\n0 1\n2 255\n")
    assert p2[:, :, 0].tolist() == [[0, 1], [2, 255]]
    assert media.decode(b"P1\n3 1\n1 0 1\n")[:, :, 0].tolist() == [[0, 255, 0]]
    assert media.decode(b"P4\n3 2\n\xa0\x40")[:, :, 0].tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P5\n1 1\n65535\n\x01\x02")[0, 0, 0] == 258
    header = b"BM" + (14 + 40 + 16).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (1).to_bytes(4, "little") + (2).to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24)
    assert media.decode(header + b"\x01\x02\x03\x00\x04\x05\x06\x00").tolist() == [[[6, 5, 4]], [[3, 2, 1]]]


def _bmp(header, start, rest):
    return b"BM" + bytes(8) + start.to_bytes(4, "little") + header + rest


def test_decoders_of_odd_images():
    assert media.decode(b"P3\n1 1\n255\n1 # a comment 9 9\n2 3\n").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P1\n# 1 1\n2 1\n1 # 0\n0\n")[:, :, 0].tolist() == [[0, 255]]
    assert media.decode(b"P5\n3 1\n15\n\x00\x05\x0f")[:, :, 0].tolist() == [[0, 85, 255]]
    assert media.decode(b"P2\n2 1\n1023\n0 1023\n")[:, :, 0].tolist() == [[0, 65535]]
    core = struct.pack("<IHHHH", 12, 2, 1, 1, 8)
    assert media.decode(_bmp(core, 14 + 12 + 6, b"\x01\x02\x03\x04\x05\x06" + b"\x01\x00\x00\x00")).tolist() == [[[6, 5, 4], [3, 2, 1]]]
    info = struct.pack("<IiiHHIIIIII", 40, 1, -1, 1, 32, 3, 0, 0, 0, 0, 0)
    assert media.decode(_bmp(info, 66, struct.pack("<III", 0xFF, 0xFF00, 0xFF0000) + b"\x0a\x0b\x0c\x0d")).tolist() == [[[10, 11, 12]]]  # red is the lowest byte
    info = struct.pack("<IiiHHIIIIII", 40, 1, 1, 1, 16, 0, 0, 0, 0, 0, 0)
    assert media.decode(_bmp(info, 54, struct.pack("<H", 0x7C1F) + b"\0\0")).tolist() == [[[255, 0, 255]]]
    for broken in (b"P5\n1 1\n15\n\x10", b"P5\n1 1\n0\n\x00", b"P2\n-1 1\n9\n1", b"BM" + b"\xff" * 60, b"BM"):
        with pytest.raises((ValueError, IndexError, OverflowError, struct.error)):
            media.decode(broken)


def test_media_clash(spark):
    with pytest.raises(ValueError, match="dhash"):
        media.tiles(spark.createDataFrame([(bytearray(b"x"), 1)], "media binary, dhash long"))


@pytest.mark.parametrize("shape", [(7, 5, 3, 3, 4), (3, 64, 3, 8, 9), (1, 1, 1, 8, 8)])
def test_area_resize(shape):
    h, w, depth, to_h, to_w = shape
    image = np.random.default_rng(0).integers(0, 256, (h, w, depth)).astype(np.uint8)
    fine = np.repeat(np.repeat(image.astype(float), to_h, 0), to_w, 1)  # every target area is whole pixels of this
    want = fine.reshape(to_h, h, to_w, w, depth).mean(axis=(1, 3))
    assert np.allclose(media.area_resize(image, to_h, to_w), want)
    with mock.patch.object(media, "STRIP", 50):
        assert np.allclose(media.area_resize(image, to_h, to_w), want)
        if image.shape[2] == 3:
            mixed = media.area_resize(image, to_h, to_w, media.GREY)
            assert np.allclose(mixed, media.area_resize((image @ media.GREY)[:, :, None], to_h, to_w)) and np.allclose(mixed[:, :, 0], want @ media.GREY)


@pytest.mark.parametrize("size", [(100_000, 64), (64, 100_000), (2530, 2530)])
def test_large_images_take_little_beside_themselves(size):
    rng = np.random.default_rng(4)
    data = b"P6\n%d %d\n255\n" % size + rng.integers(0, 256, 3 * size[0] * size[1], np.uint8).tobytes()
    tracemalloc.start()
    image = media.decode(data)
    tile, dhash = media.npy_tile(image), media.difference_hash(image)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(tile) > 64 and len(dhash) == 16 and peak < 16_000_000


def test_media_of_broken_bytes(spark):
    df = spark.createDataFrame([(1, None), (2, bytearray(b"junk")), (3, bytearray(b"P6\n9 9\n255\n")), (4, bytearray(b""))], "id long, media binary")
    assert all(r["error"] and r["dhash"] is None for r in media.tiles(df).collect())


# Chat


def test_chat_query(spark):
    got = {r["conv_id"]: r for r in queries.QUERIES["op8_chat_format"](spark, SF).collect()}
    talks: dict[int, list] = {}
    for r in sorted(spark.read.parquet(f"{SF}/conversations.parquet").collect(), key=lambda r: (r["conv_id"], r["turn"])):
        talks.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    talks[-7] = [(role, "</s>[INST] ok [/INST]") for role in ("user", "assistant")]
    assert set(got) == set(talks)
    for conv, turns in talks.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(loss))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_escapes(spark):
    rng = random.Random(3)
    bits = [*chat.CONTROLS, "\\", "<", "[", "|im_start|>", "a", "\n", "$1", "/INST]"]
    cases = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) for _ in range(2000)]
    for r in spark.createDataFrame([(c,) for c in cases], "t string").select("t", chat.escape(F.col("t")).alias("e")).collect():
        assert chat.unescape(r["e"]) == r["t"] and not any(c in r["e"] for c in chat.CONTROLS)


def test_chat_layouts_and_cases(spark):
    records = ['{"id":1,"instruction":"do","input":"x","output":"y"}', '{"id":2,"conversations":[{"from":"human","value":"hi"},{"from":"gpt","value":"yo"}]}', '{"id":3,"zzz":1}', "oops", None]
    got = chat.canonical_json(spark.createDataFrame([(r,) for r in records], "j string"), "j").collect()
    assert [(r["conv_id"], r["role"], r["text"]) for r in got if not r["error"]] == [(1, "user", "do\n\nx"), (1, "assistant", "y"), (2, "user", "hi"), (2, "assistant", "yo")]
    assert sum(r["error"] is not None for r in got) == 3
    turns = spark.createDataFrame([(1, 0, None, None, "e"), (1, 0, None, None, "e"), (None, 3, "assistant", "x", "e")], "conv_id long, turn long, role string, text string, formatted string")
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(chat.canonical(turns))).collect()}
    assert out[1]["n_turns"] == 2 and out[None]["loss_chars"] == 1
    assert chat.read_back(chat.format_turns(chat.canonical(turns.limit(0)))).count() == 0


def test_chat_records_that_broke_a_task(spark):
    bad = ['{"id":1e30,"prompt":"a","response":"b"}', '{"id":Infinity,"prompt":"a","response":"b"}', '{"id":1,"prompt":"\\ud800","response":"b"}', '{"id":1.5,"prompt":"a","response":"b"}', "[" * 100_000, '{"id":true,"prompt":"a","response":"b"}', '{"id":1,"messages":7}', '{"id":1,"messages":[3]}']
    good = ['{"id":5,"messages":[]}', '{"id":6,"messages":[{"role":"user"},{"role":"assistant","name":"n"}],"source":"web"}', '{"id":7,"prompt":"p","messages":[{"role":"user","content":"m"}]}']
    got = chat.canonical_json(spark.createDataFrame([(r,) for r in bad + good], "j string"), "j").collect()
    assert sum(r["error"] is not None and r["role"] is None for r in got) == len(bad)
    assert [(r["conv_id"], r["role"], r["text"]) for r in got if not r["error"]] == [(6, "user", ""), (6, "assistant", ""), (7, "user", "m")]


def test_chat_layout_of_most_fields():
    paths = lambda *x: chat.mark_of(x)
    assert chat.layout_of(*paths("id", "instruction", "input", "output")).parts[0] == ("user", ("instruction", "input"))
    assert chat.layout_of(*paths("id", "instruction", "output", "more")).parts[0] == ("user", ("instruction",))
    assert chat.layout_of(*paths("id", "prompt", "output", "response")).parts[1] == ("assistant", ("response",))  # equal: the first listed
    assert chat.layout_of(*paths("zzz")) is None


def test_chat_fingerprint_selects_the_mapping():
    mark, named = chat.mark_of(["conv_id", "messages[].role", "messages[].content", "extra", "meta.more"])
    assert named == {"conv_id", "messages[].role", "messages[].content"} and chat.layout_of(mark, frozenset()).turns == "messages"
    for form, layout in chat.FORMS:
        assert chat.mappings()[chat.fingerprint(form)] in {x for f, x in chat.FORMS if f <= form}
        assert chat.layout_of(chat.fingerprint(chat.FORMS[0][0]), form) == chat.LAYOUTS[0]  # the fingerprint alone decides
        assert set(layout.paths()) & form
    for i in range(50):  # fields that no layout names leave nothing behind
        assert chat.layout_of(*chat.mark_of(["conv_id", "messages[].role", f"x{i}"])).role == "role"
    assert chat._unlisted.cache_info().currsize <= 4096
    three = chat.mark_of(["conv_id", "id", "messages[].role", "turns[].speaker", "turns[].text", "prompt", "answer", "question"])
    assert three[0] not in chat.mappings() and chat.layout_of(*three).turns == "turns"


def test_chat_turns_are_found_in_the_whole_text(spark):
    rng = random.Random(9)
    bits = [*chat.CONTROLS, "\\", "\n", "\r\n", "user", "<", "[", "é😀", "<|im_end|>\n<|im_start|>assistant\n"]
    say = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 6)))
    turns = [(c, i, rng.choice(["user", "assistant", say()]), say()) for c in range(30) for i in range(rng.randint(1, 9))]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    formatted: dict[int, list] = {}
    for r in chat.format_turns(frame).orderBy("conv_id", "turn").collect():
        formatted.setdefault(r["conv_id"], []).append(r)
    read = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(frame)).collect()}
    for c, rows in formatted.items():
        want = [(role, text) for d, _, role, text in turns if d == c]
        whole = "".join(r["formatted"] for r in rows)
        assert chat.parse(whole) == want
        pieces = chat._Conversation(c)
        begin = 0
        for r in rows:  # spans first, then the text in pieces that know nothing of turns
            if r["loss_from"] is not None:
                pieces.spans.append((begin + r["loss_from"], begin + r["loss_to"]))
            begin += len(r["formatted"])
        at = 0
        while at < len(whole):
            step = rng.randint(1, 20)
            pieces.add(whole[at : at + step], None, None)
            at += step
        digest = hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in want).encode()).hexdigest()
        assert pieces.row() == tuple(read[c]) and read[c]["turns_sha256"] == digest and read[c]["n_turns"] == len(want)


# HTML


class _Visible(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("head", "script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("head", "script", "style")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def test_html_loses_no_visible_text(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    bare = lambda s: re.sub(r"[\s-]+", "", s)  # noqa: E731  list marks are added
    for r in queries.QUERIES["op4_html_text"](spark, SF).collect():
        parser = _Visible()
        parser.feed(pages[r["page_id"]])
        parser.close()
        assert bare(r["text"]) == bare("".join(parser.out))


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<p>a<b>c</b> d<p>e<ul><li>x<li>y<ol start=3><li>q<li>r</ol></ul>z", "ac d\n\ne\n\n- x\n- y\n  3. q\n  4. r\n\nz"),
        ("<table><tr><th>Name<th>N<tr><td>ab<td align=right>1<tr><td rowspan=2>r<td>22<tr><td>3</table>after", "Name  N\nab     1\nr     22\n      3\n\nafter"),
        ("a<br>b<pre>\n x\n   y\n</pre><div hidden>no</div><p style='display: none'>no</p><details><summary>S</summary>no</details>", "a\nb\n\n x\n   y\n\nS"),
        ("<script>var t='</p>'</script>1 < 2 &amp; 3<textarea>k\n l</textarea>", "1 < 2 & 3\n\nk\n l"),
        ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
        ("<div>" * 5000 + "deep" + "</div>" * 5000, "deep"),
        ("", ""),
        ("no <tags", "no"),
    ],
)
def test_html_layout(source, text):
    assert html_text.render(source) == text


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ('<p class="a"">Hello one</p><p class="b"">World two</p>', "Hello one\n\nWorld two"),
        ("<a title=it's>visible words</a> don't <b>stop", "visible words don't stop"),
        ("<!-->shown text<!-- c -->", "shown text"),
        ("<!--->shown<!-- a --!> too", "shown too"),
        ('<a href="x>y" title=\'>\' b = c>in</a>', "in"),
        ("<p a=>b", "b"),
        ("<p title=it's>hello</p> fine it's ok <b>z</b>", "hello\nfine it's ok z"),
        ('<a href=foo">link</a> hello <b class="x">y</b> end', "link hello y end"),
        ("<div>" * 130 + "<div hidden>SECRET</div>" + "</div>" * 130, ""),
        ("<table><tr><td rowspan=3 colspan=2>a<td>b<tr><td>c<tr><td>d<tr><td>e<td>f</table>", "a     b\n      c\n      d\ne  f"),
        ("<math><mi>x</mi><annotation>no</annotation></math> <svg><title>no</title><defs>no</defs><text>one</text><text>two</text></svg>", "x one two"),
        ("<div>" * 200 + "<b hidden>no<i>no</i></b>yes<p hidden>no<p>yes" + "</div>" * 200 + "<b>end", "yes\nyes\nend"),
        ("<div>" * 118 + "<section hidden>" + "<b>" * 9 + "no" + "</b>" * 9 + "no</section>yes", "yes"),
        ("<div hidden>" + "<b>" * 200 + "no" + "</b>" * 200 + "no</div>yes", "yes"),
    ],
)
def test_html_loses_nothing_to_odd_markup(source, text):
    assert re.sub("\n+", "\n", html_text.render(source)) == re.sub("\n+", "\n", text)


def test_html_time_follows_length():
    for bit in ('<a b="', "<a b='x\"", "<a " + "b=" * 3, "<i></b>", "<a b", "<!--", "<p hidden>"):
        assert html_text.render(bit * 40_000) is not None
    began = time.process_time()
    assert html_text.render("<p x=\"" + "<a " * 350_000 + "'") is not None
    assert time.process_time() - began < 5


def test_html_cases(spark):
    pages = spark.createDataFrame([(1, None, "t"), (1, None, "t"), (2, "", None), (None, "<p>x", "t")], "page_id long, html string, text string")
    assert sorted((str(r["page_id"]), r["text"]) for r in html_text.extract(pages).where("page_id IS NULL OR page_id > 1").collect()) == [("2", ""), ("None", "x")]
    assert html_text.extract(pages.limit(0)).count() == 0
    wide = "<table>" + "<tr><td>" + "w" * 100_000 + "<td>b" + "<tr><td>a<td>b" * 500 + "</table>"
    assert len(html_text.render(wide)) < 200_000


def test_html_tables_of_row_spans_stay_small():
    for page in ("<table>" + "<tr><td rowspan=65534>a" * 43_000, "<table>" + "<tr><td rowspan=300>a<td>b" * 30_000):
        began = time.perf_counter()
        text = html_text.render(page)
        assert len(text) < 2_000_000 and text.count("a") == page.count(">a") and time.perf_counter() - began < 20
    assert html_text.render("<table><tr><td rowspan=2>a<td>b<td rowspan=3>c<tr><td>d<tr><td>e<td>f<tr><td>g<td>h<td>i</table>") == "a  b  c\n   d\ne  f\ng  h  i"
