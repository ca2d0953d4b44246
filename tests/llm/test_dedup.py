import hashlib
import random
import re

import numpy as np
import pytest
from conftest import SF, rows_of
from helpers import TEXTS, documents, near_groups, shingles

from voxtide.llm import exact_dedup, near_dedup, queries
from voxtide.llm.components import components
from voxtide.llm.shingles import blocks, shingle_sets, superminhash


def test_exact(spark):
    docs = documents(spark)
    got = exact_dedup.decide(docs).toPandas()
    assert len(got) == docs.count()
    by_id = got.drop_duplicates("doc_id").set_index("doc_id")
    assert by_id.loc[2, "keep_id"] == 0 and by_id.loc[0, "group_size"] == 3 and not by_id.loc[1, "kept"] == (TEXTS[1] == TEXTS[0])
    assert by_id.loc[4, "keep_id"] == 3  # null is empty
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {0, 1, 3, 5, 6, 7, 8, 9, 10, 11, 12, None}
    assert exact_dedup.decide(docs.limit(0)).count() == 0


@pytest.mark.parametrize("slots", [2, 16, 1024])
def test_exact_heavy_hitters(spark, slots):
    rows = [(i, "hot \n text" if i % 3 == 0 else f"t{i % 200}" if i % 3 == 1 else f"u{i}") for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    groups: dict[str, list[int]] = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), []).append(i)
    want = {i: (min(g), len(g), hashlib.sha256(t.encode()).digest()) for t, g in groups.items() for i in g}
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], bytes(r["digest"])) for r in exact_dedup.decide(frame, slots=slots).collect()}
    assert got == want
    if slots < 1024:
        assert exact_dedup.heavy_digests(exact_dedup.digests(frame), slots).count() == (1 if slots > 2 else 0)


def test_exact_against_sql(spark, duck):
    got = queries.QUERIES["op7_exact_dedup"](spark, SF).toPandas()
    assert rows_of(got) == rows_of(duck.sql(queries.ORACLES["op7_exact_dedup"]).df())


@pytest.mark.parametrize("k", [1, 2, 5])
def test_shingle_sets(k):
    texts = [t.encode() if t else b"" for t in TEXTS] + [b"a b a b a", b"A B", b"x" * 3_000_000]
    for first, part in blocks(texts):
        sets, bounds = shingle_sets(part, k)
        for i, t in enumerate(part):
            own = sets[bounds[i] : bounds[i + 1]]
            assert len(own) == len(shingles(t.decode(), k)) == len(set(own.tolist())) and (np.diff(own.astype(object)) > 0).all()
    sets, bounds = shingle_sets([b"p q r s", b"zz P q R s"], 2)
    assert len(set(sets[: bounds[1]].tolist()) & set(sets[bounds[1] :].tolist())) == 3


def test_superminhash_estimates():
    rng, errors = random.Random(5), []
    for _ in range(60):
        shared = [rng.getrandbits(64) for _ in range(rng.randint(20, 300))]
        a, b = ([*shared, *(rng.getrandbits(64) for _ in range(rng.randint(0, 200)))] for _ in range(2))
        sketch = superminhash(np.array(a + b, "u8"), np.array([0, len(a), len(a) + len(b)]), 252)
        j = len(shared) / (len(a) + len(b) - len(shared))
        errors.append(((sketch[0] == sketch[1]).mean() - j) / max(0.01, (j * (1 - j) / 252) ** 0.5))
    assert abs(np.mean(errors)) < 0.5 and np.std(errors) < 1.1
    tiny = superminhash(np.array([7], "u8"), np.array([0, 1, 1]), 252)
    assert sorted((tiny[0] >> np.uint64(32)).tolist()) == list(range(252))  # one element: each register has another rank


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(300)] + [(1000 + rng.randint(0, 300), 1000 + rng.randint(0, 300)) for _ in range(200)] + [(5000, 5000 + i) for i in range(500)]
    parent: dict[int, int] = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("k", "small"), [(2, 16), (5, 16), (2, 2)])
def test_near_against_all_pairs(spark, k, small):
    rng = random.Random(k)
    common = [f"c{i}" for i in range(40)]  # a passage that many share, of about half of each text
    rows = [(i, " ".join([*common, *(f"r{rng.random()}" for _ in range(30))])) for i in range(40)]
    base = [f"b{i}" for i in range(60)]
    for i in range(40, 100):  # a chain of near copies
        base[rng.randrange(60)] = f"n{i}"
        rows.append((i, " ".join(base)))
    rows += [(100 + i, t) for i, t in enumerate(TEXTS)] + [(200, rows[50][1].upper()), (201, " ".join(common))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(frame, k, 80, small=small).collect()}
    assert got == near_groups(rows, k)


def test_near_cases(spark):
    docs = documents(spark)
    got = near_dedup.near_duplicates(docs, 2)
    rows = got.collect()
    assert len(rows) == docs.count() and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows if r["doc_id"] is not None)
    assert [r["kept"] for r in rows if r["doc_id"] is None] == [True]
    assert {r["n_shingles"] for r in rows if r["doc_id"] in (3, 4, 7)} == {0}
    assert near_dedup.near_duplicates(docs.limit(0), 2).count() == 0
