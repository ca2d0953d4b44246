"""Source divergences, lattice scores and phrases against brute force, and the slices that they are cut from."""

import math
import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest import rows_of
from helpers import documents

from voxtide.llm import divergence, lattice, phrases, queries, slices

SMALL, SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text):
    return (text or "").translate(A_Z)


# slices


def cut(texts, inside=slices.lookup(0x20, 0x0A)):
    block = next(slices.text_blocks(pa.array(texts)))
    return slices.padded(block.raw), *slices.runs(inside[block.raw], block.bounds)


def test_runs_end_at_text_bounds():
    raw, starts, ends = cut(["ab c", "d", "", None, " É é", "ef"])
    assert [bytes(raw[a:b]).decode() for a, b in zip(starts, ends, strict=True)] == ["ab", "c", "d", "É", "é", "ef"]


def test_blocks_of_a_sliced_column():
    column = pa.array(["no", "Aa", None, "x" * 50, "", "Zz"]).slice(1)
    got = [(b.first + i, bytes(b.raw[b.bounds[i] : b.bounds[i + 1]]).decode()) for b in slices.text_blocks(column, 10) for i in range(len(b))]
    assert got == [(0, "aa"), (1, ""), (2, "x" * 50), (3, ""), (4, "zz")]
    assert not list(slices.text_blocks(pa.array([], pa.string())))


def test_hashes_are_those_of_the_library_and_of_spark(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcé日") for _ in range(n)) for n in [*range(1, 110), 300, 1000]]
    raw, starts, ends = cut([" ".join(words)])
    mine = slices.xxh64(raw, starts, ends)
    assert mine.tolist() == [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words]
    seeds = phrases.lang_seeds(["de", "", "É"])
    rows = spark.createDataFrame([(lang, w) for lang in ("de", "", "É") for w in words[:40]], "lang string, gram string").selectExpr("xxhash64(lang, gram) AS h").collect()
    got = np.concatenate([slices.xxh64(raw, starts[:40], ends[:40], np.full(40, s)) for s in seeds])
    assert got.view("i8").tolist() == [r["h"] for r in rows]


@pytest.mark.parametrize("hashes", ["real", "all alike"])
def test_groups_are_of_equal_bytes(monkeypatch, hashes):
    if hashes != "real":
        monkeypatch.setattr(slices, "_hash_of_length", lambda lanes, at, length, seed: np.zeros(len(at), "u8"))
    rng = random.Random(5)
    words = ["".join(rng.choice("ab") for _ in range(rng.choice([1, 2, 3, 9, 17, 40]))) for _ in range(3000)] + ["q" * 300, "r" * 300, "q" * 300]
    raw, starts, ends = cut([" ".join(words)])
    heads, group = slices.grouped(raw, starts, ends)
    assert len(heads) == len(set(words)) and [bytes(raw[starts[heads[g]] : ends[heads[g]]]).decode() for g in group] == words


# 11


def brute_divergence(rows, min_docs, top=10):
    rows = [(lang or "", source or "", [w for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t))]) for lang, source, t in rows]
    out = set()
    for lang in {r[0] for r in rows}:
        docs, all_n = Counter(), Counter()
        for name, _, w in rows:
            if name == lang:
                docs.update(set(w))
                all_n.update(w)
        kept = sorted(t for t in docs if docs[t] >= min_docs)
        groups = {s: Counter() for name, s, _ in rows if name == lang}
        for name, s, w in rows:
            if name == lang:
                groups[s].update(t for t in w if docs[t] >= min_docs)

        def share(c, total, kept=kept):
            return 1 + 10**9 * (c + 2) // (total + 2 * len(kept))

        p = {s: {t: share(c[t], sum(c.values())) for t in kept} for s, c in groups.items()}
        q = {t: share(all_n[t], sum(all_n[x] for x in kept)) for t in kept}
        for s in groups:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o.encode()) for o in groups if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t])), t.encode()) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)}
    return out


def test_divergences(spark):
    rng = random.Random(7)
    words = ["the", "Of", "naïve", "x1y", "日本", "straße"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["a", "b", "", None, "ü"]), rng.choice([None, "", "12 !"]) if rng.random() < 0.1 else " ".join(rng.choices(words, k=rng.randrange(1, 30)))) for _ in range(150)]
    rows += [rows[0]] * 30 + [("xx", "alone", "the the"), ("yy", "p", None), ("yy", "q", "")]
    docs = spark.createDataFrame([(*r, "n", 1) for r in rows], "lang string, source string, text string, term string, block int")
    for blocks in (8192, 3):
        got = divergence.audit(docs, min_docs=5, block_terms=blocks).collect()
        assert {tuple(r) for r in got} == brute_divergence(rows, 5) and len(got) == len({tuple(r) for r in got})
    assert divergence.audit(docs.limit(0)).count() == 0
    assert {tuple(r) for r in divergence.audit(documents(spark), min_docs=2).collect()} == brute_divergence([(r["lang"], r["source"], r["text"]) for r in documents(spark).collect()], 2)


def test_shares_are_exact():
    rng = random.Random(11)
    for _ in range(300):
        total, kinds = rng.randrange(1, 8 * 10**15), rng.randrange(1, 10**9)
        c = rng.randrange(0, total + 1)
        assert int(divergence.share(np.array([c]), total, kinds)[0]) == 1 + 10**9 * (c + 2) // (total + 2 * kinds)


# 12


def all_paths(word, pieces):
    """The summed probability of all segmentations, one by one."""
    if not word:
        return 1.0
    return sum(p * all_paths(word[n:], pieces) for n in range(1, len(word) + 1) for p in pieces.get(word[:n], ()))


@pytest.fixture(scope="module")
def pieces():
    """Bytes -> probabilities of the pieces that have them, read from the file by itself."""
    import sentencepiece

    v = lattice.vocabulary(queries.piece_path())
    model = sentencepiece.SentencePieceProcessor(model_file=queries.piece_path())
    weight: dict[bytes, list[float]] = {}
    scores = {}
    for i in range(model.get_piece_size()):
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)):
            scores[model.id_to_piece(i).replace("▁", " ").encode()] = -model.get_score(i)
    usable = {b: s for b, s in scores.items() if b" " not in b[1:] and not re.search(rb"[A-Z\x09-\x0d]", b)}
    last = 1 + max(usable.values())
    for b, s in usable.items():
        weight.setdefault(b, []).append(1 / (s + 1))
    for b in range(256):
        weight.setdefault(bytes([b]), []).append(1 / (last + 1))
    total = sum(sum(w) for w in weight.values())
    assert len(v) == sum(map(len, weight.values()))
    return {b: [x / total for x in w] for b, w in weight.items()}


def test_lattice_sums_over_all_segmentations(pieces):
    v = lattice.vocabulary(queries.piece_path())
    words = ["a", "the", "tion", "straße", "日本", "wordless", "\x00x", "q" * 12]
    block = next(slices.text_blocks(pa.array(words)))
    got = lattice.word_scores(slices.padded(block.raw), block.bounds[:-1], block.bounds[1:], v, lattice.normalised(1 / (v.ranks + 1))[None])[:, 0]
    assert np.allclose(got, [math.log(all_paths(b" " + w.encode(), pieces)) for w in words], rtol=1e-9)


def test_long_words_are_scored_like_short_ones(monkeypatch):
    v = lattice.vocabulary(queries.piece_path())
    words = ["international", "straßenbahn", "x" * 70, "a", "thetionthetion" * 9]
    block, log_p = next(slices.text_blocks(pa.array(words))), lattice.normalised(1 / (v.ranks + 1))
    args = slices.padded(block.raw), block.bounds[:-1], block.bounds[1:]
    found = []
    for longest in (0, 10_000):
        monkeypatch.setattr(lattice, "LONG_WORD", longest)
        found.append((lattice.word_scores(*args, v, log_p[None]), lattice.expected(*args, np.array([1.0, 2, 3, 4, 5]), v, log_p)))
    assert np.allclose(found[0][0], found[1][0]) and np.allclose(found[0][1], found[1][1], atol=1e-9)


def test_expected_uses(pieces):
    """Uses by the derivative of the log probability: d log P / d log p of a piece."""
    v = lattice.vocabulary(queries.piece_path())
    block, log_p = next(slices.text_blocks(pa.array(["nation"]))), lattice.normalised(1 / (v.ranks + 1))
    args = slices.padded(block.raw), block.bounds[:-1], block.bounds[1:]
    uses = lattice.expected(*args, np.ones(1), v, log_p)
    for piece in [*np.flatnonzero(uses > 0.01), *np.flatnonzero(uses == 0)[:3]]:
        moved = [log_p.copy(), log_p.copy()]
        moved[0][piece] += 1e-5
        moved[1][piece] -= 1e-5
        up, down = (lattice.word_scores(*args, v, m[None])[0, 0] for m in moved)
        assert abs((up - down) / 2e-5 - uses[piece]) < 1e-5


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", lower(text)) if w]


def brute_scores(rows, model, paths):
    """(n_tokens, n_known, base_score, score) of (doc_id, text, lang) rows; ``paths``: word -> log P in each component."""
    train = [r for r in rows if zlib.crc32((str(r[0]) if r[0] is not None else "").encode()) % 7 != 2]
    sizes = Counter(r[2] or "" for r in train)
    names = sorted(sizes, key=lambda x: (-sizes[x], x))
    each = [Counter(w for r in train if (r[2] or "") == name for w in split(r[1])) for name in names]
    whole = sum(each, Counter())
    n, v = sum(whole.values()) + len(train), len(whole) + 1
    out = []
    for _, text, _ in rows:
        words = split(text)
        base = sum(math.log10((whole[w] + 1) / (n + v + 1)) for w in words) + math.log10((len(train) + 1) / (n + v + 1))
        parts = []
        for k, name in enumerate(names):
            count, kinds = each[k], max(1, len(each[k]))
            stop = (sizes[name] + 1) / (sum(count.values()) + sizes[name] + 2)
            parts.append(math.log((sizes[name] + 1) / (len(train) + len(names)) * stop) + sum(math.log((1 - stop) * (count[w] + kinds * math.exp(paths[w][k])) / (sum(count.values()) + kinds)) for w in words))
        top = max(parts)
        out.append((len(words) + 1, sum(whole[w] > 0 for w in words) + 1, n, base, (top + math.log(sum(math.exp(x - top) for x in parts))) / math.log(10)))
    return out


@pytest.mark.parametrize("often", [lattice.OFTEN, 3])
def test_lattice_scores(spark, often):
    from pyspark.sql import functions as F

    docs = documents(spark)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % 7 == 2
    v, model = lattice.vocabulary(queries.piece_path()), lattice.fit(docs, ~held, queries.piece_path(), often=often)
    words = sorted({w for r in rows for w in split(r[1])})
    block = next(slices.text_blocks(pa.array(words)))
    paths = dict(zip(words, lattice.word_scores(slices.padded(block.raw), block.bounds[:-1], block.bounds[1:], v, model.log_p), strict=True))
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4), round(r["score"], 4)) for r in lattice.score(docs, model).collect())
    want = sorted((-1 if r[0] is None else r[0], *b[:3], round(b[3], 4), round(b[4], 4)) for r, b in zip(rows, brute_scores(rows, model, paths), strict=True))
    assert len(got) == len(want) and np.allclose(np.array(got), np.array(want), rtol=1e-6, atol=2e-4)
    assert lattice.score(docs.limit(0), lattice.fit(docs.limit(0), ~held, queries.piece_path())).count() == 0


def test_no_more_than_certainty(spark):
    """Over all texts of one word of up to two letters, probabilities sum to less than 1; nothing learned is needed for a score."""
    from pyspark.sql import functions as F

    texts = ["", *("".join(x) for n in (1, 2) for x in product("abcdefghijklmnopqrstuvwxyz", repeat=n))]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    for learn in (F.lit(True), F.lit(False)):
        out = lattice.score(docs, lattice.fit(docs, learn, queries.piece_path())).toPandas()
        assert 0.001 < (10**out.score).sum() < 1
    assert (out.train_tokens == 0).all() and (out.base_score == 0).all() and (out.n_known == 0).all()


def test_held_out_texts_are_likelier_than_by_counts_alone(spark):
    """The base gives all unknown words one share; over 1000 documents, where a sixth of the words are unknown, that is as good."""
    out = queries.QUERIES["op12_lattice_scores"](spark, "/root/testdata/sf0.1").toPandas()
    held = out[out.held_out]
    assert len(out) == 10_000 and held.score.sum() / held.n_tokens.sum() > held.base_score.sum() / held.n_tokens.sum() + 0.15 and (held.score > held.base_score).mean() > 0.8


# 13


def brute_phrases(rows, least, words=5, top=2000):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, words + 1) for i in range(len(w) - k + 1))
    found = {c: a for c, a in f.items() if a >= least and len(c) > 2}
    inside = Counter()
    for (lang, *w), a in found.items():
        for z in range(2, len(w)):
            for i in range(len(w) - z + 1):
                inside[lang, *w[i : i + z]] = max(a, inside[lang, *w[i : i + z]])
    ranked: dict[str, list] = {}
    for (lang, *w), a in found.items():
        if 100 * inside[lang, *w] >= 100 * a:
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, *w[:k]] * f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w)))
        ranked.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return {(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, x in ranked.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top])}


def test_phrases(spark, monkeypatch):
    rng = random.Random(13)
    words = ["the", "Of", "and", "naïve", "日本", "x", "a" * 300]
    texts = [" ".join(rng.choices(words, [9, 9, 9, 3, 3, 3, 1], k=rng.randrange(0, 25))) for _ in range(200)]
    texts += ["the  of\tand, the of\n\nthe . of", None, "", " \t", "x x x x x x", "x x x x x x", "!?", "\x0bthe\x0cof", "of and the naïve 日本 x of"] * 3 + ["one two three four five six"] * 8
    rows = [(rng.choice(["en", "de", None]), t) for t in texts]
    docs = spark.createDataFrame([(*r, "p", 1) for r in rows], "lang string, text string, phrase string, m int")
    for gathered, top in ((phrases.GATHERED, 2000), (500, 7)):
        monkeypatch.setattr(phrases, "GATHERED", gathered)
        got = phrases.collocations(docs, least=4, top=top).collect()
        assert {tuple(r) for r in got} == brute_phrases(rows, 4, top=top) and len(got) == len({tuple(r) for r in got})
    assert phrases.collocations(docs.limit(0)).count() == 0
    assert {tuple(r) for r in phrases.collocations(documents(spark), least=2).collect()} == brute_phrases([(r["lang"], r["text"]) for r in documents(spark).collect()], 2)


def test_scores_pass_64_bits(spark):
    """a * n * 1000 and l * r beyond 2**63."""
    a, n, left, right = 4 * 10**12, 9 * 10**14, 5 * 10**12, 6 * 10**12
    got = spark.range(1).selectExpr(f"{phrases.SCORE} AS s".replace("n AS", f"{n} AS").replace("(a AS", f"({a} AS").replace("(l AS", f"({left} AS").replace("(r AS", f"({right} AS")).first()["s"]
    assert got == 1000 * a * n // (left * right)


@pytest.mark.parametrize("name", ["op11_source_divergence", "op13_phrase_mining"])
def test_queries_against_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.ORACLES[name]).df()
    assert rows_of(got) == rows_of(want) and len(got)


def test_short_batches_of_pieces_are_counted_together(monkeypatch):
    pieces = [("en" if i % 3 else "de", f"the {'cat dog hen'.split()[i % 3]} sat down", i + 1) for i in range(300)]
    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*pieces, strict=True)], names=["lang", "piece", "m"])
    cut, blocks = [], phrases.text_blocks
    monkeypatch.setattr(phrases, "text_blocks", lambda column: (cut.append(len(column)), blocks(column))[1])

    def counted(batches, k):
        out = [pa.ipc.open_stream(block.as_buffer()).read_all() for b in phrases.phrase_blocks(k, np.full(64, -1), 4)(iter(batches)) for block in b.column(1)]
        return sorted((r["lang"], r["gram"], r["m"]) for t in out for r in t.to_pylist())

    for k in (1, 2, 3):
        expected = counted([whole], k)
        cut.clear()
        assert counted([whole.slice(i, 1) for i in range(300)], k) == expected and expected
        assert cut == [300]  # not 300 times a piece
    assert ("en", "the dog sat", sum(range(2, 301, 3))) in expected and counted([], 1) == []
