"""Every stage of the pipeline against a brute-force version over its own input."""

import re

from conftest import SF
from helpers import TEXTS, documents, near_groups

import corpus_pipeline as cp


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    known = cp.language_id(spark, docs, SF).cache()
    assert known.columns == docs.columns and known.count() == len(rows)  # all are in one of the four languages
    exact = cp.exact(spark, known, SF).cache()
    first: dict[str, int] = {}
    for d in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[d]), d)
    assert {r["doc_id"] for r in exact.collect()} == set(first.values())
    near = cp.near(spark, exact, SF).cache()
    groups = near_groups([(d, rows[d]) for d in first.values()], 5)
    assert {r["doc_id"] for r in near.collect()} == {d for d, (_, root) in groups.items() if d == root}
    mixed = cp.mix(spark, near, SF).cache()
    assert mixed.columns == docs.columns
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    insults = re.compile(r"\b(worthless|pathetic|moron|scum|idiot|clown|loser|trash|stupid|disgusting)\b", re.I)
    before, after = {r["doc_id"] for r in near.collect()}, {r["doc_id"] for r in mixed.collect()}
    clean = {d for d in before - toxic if not insults.search(rows[d])}
    assert len(clean - after) <= 0.01 * len(clean) and len((before & toxic) - after) > 0.5 * len(before & toxic)
    packed = cp.pack(spark, mixed, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == after


def test_odd_documents_pass_through(spark):
    docs = documents(spark)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF).cache()
        assert docs.count() > 0
    empty = documents(spark).limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, SF).count() == 0
    assert len(TEXTS) == 13


def test_texts_pass_workers_in_small_batches(spark):
    known = cp.language_id(spark, documents(spark), SF)
    assert "MapInArrow" not in known._jdf.queryExecution().toString()  # its reader's batches would hold 10,000 texts
    assert known.count() > 0
