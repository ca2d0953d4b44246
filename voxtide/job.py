"""The engine as one job: from raw voices to alerts, batch by batch, and its entry point (``python -m voxtide.job``)."""

from __future__ import annotations

import argparse
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtide import models, schemas
from voxtide.config import DEFAULTS, Settings
from voxtide.operators import routing, segmentation
from voxtide.plans import stages
from voxtide.sources import tables
from voxtide.sources.embedding_cache import EmbeddingCache
from voxtide.sources.shared import nothing
from voxtide.sources.sinks import EpochTable
from voxtide.streaming.worker import Worker, cadence, file_stream, shaped


@dataclass
class Resources:
    """What the stages look things up in and ask; clients are made in the workers that use them."""

    keywords: DataFrame
    rules: stages.Rules = field(default_factory=stages.Rules)
    words: Sequence[str] = ()
    stopwords: Column | None = None
    costs: segmentation.Costs | None = None
    collections: dict[str, DataFrame] = field(default_factory=dict)
    false_positives: DataFrame | None = None
    embedder: Callable = models.HashEmbedder
    reranker: Callable | None = models.CosineReranker
    model: Callable = models.OfflineModel


class Engine(Worker):
    """A worker that takes raw voices (id, voice_id, title, gmt_create) through all stages; those without an id or a time are kept in quarantine. Events that an epoch makes are known to the
    next ones by the vector of their title."""

    def __init__(self, spark: SparkSession, folder: str, resources: Resources, s: Settings = DEFAULTS, clock: Callable[[DataFrame], Column] | None = None) -> None:
        super().__init__(spark, folder, None, s, clock, models.Cached(resources.embedder, EmbeddingCache(spark, f"{folder}/embeddings")))
        self.resources = resources
        self.quarantine = EpochTable(spark, f"{folder}/quarantine", schemas.QUARANTINE)
        self.quarantine.ensure()

    def replayed(self) -> DataFrame:
        """Quarantined rows in the shape of the source, to be mended and handed in again."""
        return shaped(self.quarantine.read(), schemas.VOICE_SOURCE)

    def _semantic(self, missed: DataFrame) -> DataFrame:
        columns = "id string, gm_code string, goc_product_line string, score double, collection_name string, document string"
        if not self.resources.collections:
            return nothing(self.spark, columns)
        r = self.resources
        return stages.semantic_search(missed, r.collections, self.embedder, r.reranker, self.settings)

    def decisions(self, batch: DataFrame, epoch: int) -> DataFrame:
        r, s = self.resources, self.settings
        as_of = self.now(batch)
        if as_of is None:
            return batch.limit(0)
        good, bad = tables.timed_voices(batch)
        self.quarantine.write(shaped(bad.withColumn("reason", tables.quarantine_reason()), schemas.QUARANTINE), epoch)
        known, state = self.knowledge.read(before=epoch), self.events.version(before=epoch)
        wrong = r.false_positives if r.false_positives is not None else known.limit(0).select("risk_event_id", "gm_code", "embedding")
        live = state.where("status = 'active'").select("risk_event_id")

        def decide(kept: DataFrame) -> DataFrame:
            titles = stages.enriched_titles(kept, r.keywords, self._semantic, self.embedder, r.model, s, r.words, r.stopwords, r.costs)
            grouped = stages.summarize_clusters(stages.cluster(titles, s), r.model, s)
            decided = stages.match_and_decide(grouped, known.join(live, "risk_event_id", "left_semi"), wrong, state, as_of, self.embedder, stages.decider(r.model), s, r.reranker)
            return decided.select("title", "gm_code", "goc_product_line", "initial_summary_text", "batch_cluster_title", "decision", "risk_event_id")

        return stages.decided_by_title(good, r.rules, decide)


def load(spark: SparkSession, keywords: str, stopwords: str | None = None, words: str | None = None, **services: Callable) -> Resources:
    """Resources from files: a keyword dictionary, a list of stopwords, a user dictionary."""
    own = [r["value"].strip() for r in spark.read.text(words).collect()] if words else []  # a hand-kept list
    skipped = tables.stopwords(spark, stopwords) if stopwords else None
    return Resources(routing.keyword_table(tables.keyword_dictionary(spark, keywords)), words=[w for w in own if w], stopwords=skipped, **services)


def main(arguments: Sequence[str] | None = None) -> list[str]:
    options = argparse.ArgumentParser(description="Watch a folder of voices and keep events, alerts and the timeline.")
    for name in ("source", "folder", "keywords"):
        options.add_argument(f"--{name}", required=True)
    for name in ("stopwords", "words", "embed-url", "rerank-url", "model-url"):
        options.add_argument(f"--{name}")
    options.add_argument("--start", help="voices before this time are left out")
    options.add_argument("--every", type=float, default=120.0)
    options.add_argument("--files", type=int, default=1, help="files of a batch")
    options.add_argument("--runs", type=int, help="ends after so many runs")
    o = options.parse_args(arguments)
    spark = SparkSession.builder.appName("voxtide").getOrCreate()
    services: dict[str, Callable] = {}
    for name, kind, url in (("embedder", models.HttpEmbedder, o.embed_url), ("reranker", models.HttpReranker, o.rerank_url), ("model", models.HttpModel, o.model_url)):
        if url:
            services[name] = lambda kind=kind, url=url: kind(url)
    engine = Engine(spark, o.folder, load(spark, o.keywords, o.stopwords, o.words, **services))

    def start():
        stream = file_stream(spark, o.source, schemas.VOICE_SOURCE, o.files)
        if o.start:
            stream = stream.where(F.col("gmt_create") >= F.lit(o.start).cast("timestamp_ntz"))
        return engine.start(stream, f"{o.folder}/checkpoint", availableNow=True)

    return cadence(start, o.every, runs=o.runs)


if __name__ == "__main__":
    main()
