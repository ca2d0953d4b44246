"""The engine's stages as chains of DataFrame functions: route and enrich, aggregate, match and decide, manage events.

What a model has answered is written before it is used: it is asked once, however often its answers are read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxtide import models
from voxtide.config import DEFAULTS, Settings
from voxtide.functions import text
from voxtide.operators import accounting, baseline, clusters, matching, routing, segmentation, vector_search
from voxtide.operators.components import connected_components
from voxtide.operators.dedup import keep_last, top_k
from voxtide.sources.shared import written


@dataclass(frozen=True)
class Rules:
    """Filter rules as data."""

    prefixes: tuple[tuple[str, int], ...] = ()
    any_of: tuple[str, ...] = ()
    all_of: tuple[tuple[str, ...], ...] = ()
    all_within: tuple[tuple[tuple[str, ...], int], ...] = ()
    include_exclude: tuple[tuple[tuple[str, ...], tuple[str, ...]], ...] = ()

    def keeps(self, title: Column) -> Column:
        drop = text.prefix_rule(title, self.prefixes) | text.any_keyword(title, self.any_of) | text.all_keywords(title, self.all_of)
        drop = drop | text.keywords_within(title, self.all_within) | text.include_exclude(title, self.include_exclude)
        return text.length_band(title) & ~drop

    def keywords(self) -> list[str]:
        """The distinct keywords of all rules."""
        return text.all_words(self.prefixes, self.any_of, self.all_of, self.all_within, self.include_exclude)


def clean_and_filter(voices: DataFrame, rules: Rules, title: str = "title") -> DataFrame:
    """Masked titles that the rules keep. The mask is computed once a row: a generator's column isn't copied into its uses."""
    masked = voices.withColumn("_masked", F.explode(F.array(text.mask(F.col(title)))))
    return masked.where(rules.keeps(F.col("_masked"))).withColumn(title, F.col("_masked")).drop("_masked")


def semantic_search(titles: DataFrame, collections: dict[str, DataFrame], embedder, reranker, s: Settings = DEFAULTS) -> DataFrame:
    """id, gm_code, goc_product_line, score, collection_name, document, rank: embed, search all collections, rerank, best of each code, top k.

    ``titles``: id, title; ``collections``: by name, vec_id, embedding, gm_code, goc_product_line, document. A title whose
    embedding or reranking fails has no route.
    """
    asked = models.embedded(titles.select("id", "title"), "id", "title", embedder)
    queries = asked.where(F.col("embedding").isNotNull()).select(F.col("id").alias("vec_id"), "embedding")
    keep = ["gm_code", "goc_product_line", "document"]
    hits = vector_search.multi_collection_knn(queries, collections, s.retrieval_top_k, keep=keep)
    hits = hits.where(F.coalesce("hit_document", F.lit("")) != "").join(titles.select(F.col("id").alias("query_id"), "title"), "query_id")
    scored = models.reranked(hits, "title", "hit_document", reranker).where(F.col("score").isNotNull())
    named = scored.select(F.col("query_id").alias("id"), *[F.col(f"hit_{c}").alias(c) for c in keep], "score", "collection_name")
    return routing.semantic_routes(named, s.rerank_top_k)


def route_and_enrich(
    voices: DataFrame, rules: Rules, keywords: DataFrame, semantic: Callable[[DataFrame], DataFrame], embedder, summarizer,
    s: Settings = DEFAULTS, words: Sequence[str] = (), stopwords: Column | None = None, costs: segmentation.Costs | None = None,
) -> DataFrame:
    """Clean voices (id, title, ...) with routes, primary code, summary and its vector; those without one of them go."""
    kept = written(clean_and_filter(voices, rules), "kept")
    about = enriched_titles(kept, keywords, semantic, embedder, summarizer, s, words, stopwords, costs)
    routed = kept.join(about.drop("id"), "title").withColumn("initial_summary_id", models.summary_id(F.col("id"), F.col("initial_summary_text")))
    return written(routed, "enriched")


def enriched_titles(
    kept: DataFrame, keywords: DataFrame, semantic: Callable[[DataFrame], DataFrame], embedder, summarizer,
    s: Settings = DEFAULTS, words: Sequence[str] = (), stopwords: Column | None = None, costs: segmentation.Costs | None = None,
) -> DataFrame:
    """A row of each title of clean voices (id, title) with routes, primary code, summary and its vector, and the least ``id`` of its voices;
    titles without one of them go.

    Titles are routed, summarized and embedded once each (``title`` is the routing id). What is known of them is a written table: where it is small, no
    voice that meets it is shuffled, so one title of very many voices stays spread. ``words``: the dictionary that
    Chinese titles are cut by, with ``costs`` that were learned of it, or that these titles teach; ``stopwords``: an array of words that don't count.
    """
    firsts = written(kept.groupBy("title").agg(F.min("id").alias("id")), "titles")
    titles = firsts.select("title", F.col("title").alias("id"))
    if words or costs:
        costs = costs or segmentation.learn(titles, words)
        titles = titles.join(segmentation.tokens(titles, costs, stopwords), "id")
    else:
        titles = titles.withColumn("tokens", text.tokens(F.col("title"), stopwords))
    by_text = written(routing.keyword_route(titles, keywords, s.text_route_top_k), "matched")
    routes = routing.gather_routes(routing.hybrid_route(titles, by_text, semantic, s)).withColumnRenamed("id", "title")
    about = models.summarized(routing.filter_routes(written(routes, "routes"), s), "title", "title", summarizer).drop("initial_summary_id")
    about = models.embedded(about, "title", "initial_summary_text", embedder, column="initial_summary_embedding")
    about = about.where(F.col("initial_summary_text").isNotNull() & F.col("initial_summary_embedding").isNotNull())
    first = F.try_element_at("routes", F.lit(1))
    about = about.join(firsts, "title").withColumn("gm_code", first["gm_code"]).withColumn("goc_product_line", first["goc_product_line"])
    return written(about, "enriched-titles")


def decided_by_title(voices: DataFrame, rules: Rules, decide: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Clean voices (id, title, ...) with what ``decide`` says of their titles; those of titles that it leaves out go.

    Routes, clusters, matches and decisions depend on a voice's title alone, so ``cluster``, ``summarize_clusters`` and ``match_and_decide`` take the rows
    of ``enriched_titles`` in place of voices: voices are written once before all this, and meet its end once."""
    kept = written(clean_and_filter(voices, rules), "kept")
    return kept.join(written(decide(kept), "verdicts"), "title")


def cluster(voices: DataFrame, s: Settings = DEFAULTS, exact: bool = True, dim: int = 64) -> DataFrame:
    """Voices with batch_cluster_id and batch_cluster_title; clusters are components of near summaries within a code.

    Voices of one code and summary are together anyway: only the first of them meets the others, and the vectors stay behind.
    """
    title = text.fallback_title(F.col("title"))
    same = ["gm_code", "initial_summary_text"]
    first = written(voices.groupBy(*same).agg(F.min("id").alias("id")), "firsts")  # no vectors, so counted by hash and not by sorting
    first = voices.select(*same, "id", F.col("initial_summary_embedding").alias("vector")).join(first, [*same, "id"]).dropDuplicates(same)
    first = written(first, "summaries")
    if exact:
        pairs = vector_search.similarity_pairs(first, s.cluster_distance, "gm_code", "id", "vector")
    else:
        pairs = vector_search.lsh_pairs(first, s.cluster_distance, "gm_code", dim, id_col="id", vector_col="vector")
    grouped = written(connected_components(first.select(*same, "id"), pairs).drop("id"), "components")
    grouped = voices.drop("initial_summary_embedding").join(grouped, same)
    each = grouped.groupBy("gm_code", "component", "title").agg(F.min("id").alias("id"))  # the title is cleaned once, not once a voice
    named = each.groupBy("gm_code", "component").agg(F.min_by(title, F.struct(F.length(title), F.col("id"))).alias("batch_cluster_title"))
    named = written(named.withColumn("batch_cluster_id", text.stable_id("evt", F.col("gm_code"), F.col("component"))), "named")
    return written(grouped.join(named, ["gm_code", "component"]).drop("component"), "clustered")


def summarize_clusters(clustered: DataFrame, model, s: Settings = DEFAULTS) -> DataFrame:
    """``clustered`` with the clusters split and titled by a language model: batch_cluster_id, batch_cluster_title, batch_cluster_success.

    A prompt lists distinct summaries, not voices, and ``split_members`` at most on average: a cluster with more of them is dealt over
    several prompts by a hash, and groups of one text in different prompts are one. A prompt whose answer doesn't cover its messages leaves
    them in the cluster, under its shortest title. Voices without a summary stay there too.
    With ``split_members`` 0 nothing is asked.
    """
    if s.split_members <= 0:
        return clustered.withColumn("batch_cluster_success", F.lit(False))
    texts = clustered.where("initial_summary_text IS NOT NULL").select("batch_cluster_id", F.col("initial_summary_text").alias("title")).distinct()
    prompts = texts.groupBy("batch_cluster_id").agg(F.ceil(F.count("*") / F.lit(s.split_members)).alias("prompts"))
    dealt = texts.join(prompts, "batch_cluster_id").withColumn("part", F.pmod(F.xxhash64("title"), F.col("prompts")))
    dealt = dealt.withColumn("cluster_id", F.when(F.col("prompts") == 1, F.col("batch_cluster_id")).otherwise(F.concat_ws("#", "batch_cluster_id", "part")))
    place = F.row_number().over(W.partitionBy("cluster_id").orderBy("title")) - 1
    members = written(dealt.select("batch_cluster_id", "cluster_id", "prompts", F.col("title").alias("id"), "title", place.cast("int").alias("pos")), "members")
    listed = members.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "title"))), lambda m: m["title"]).alias("messages"))
    asked = listed.select("cluster_id", text.prompt(models.SPLIT, messages=F.to_json("messages")).alias("prompt"))
    answers = models.answered(asked, "cluster_id", "prompt", model).select("cluster_id", models.without_thoughts(F.col("answer")).alias("answer"))
    answers = written(answers, "answers")
    parts = clusters.split(members.select("cluster_id", "pos", "id", "title"), answers).where("success = 1").join(members.select("cluster_id", F.col("id"), "prompts", F.col("batch_cluster_id").alias("_of")), ["cluster_id", "id"])
    whole = F.when(F.col("prompts") == 1, F.col("sub_cluster_id")).otherwise(text.stable_id("sub", F.col("_of"), F.col("batch_cluster_title")))
    parts = written(parts.select("_of", F.col("id").alias("_text"), whole.alias("_id"), F.col("batch_cluster_title").alias("_title")), "parts")
    out = clustered.join(parts, (F.col("batch_cluster_id") == F.col("_of")) & (F.col("initial_summary_text") == F.col("_text")), "left").withColumn("batch_cluster_success", F.col("_id").isNotNull())
    out = out.withColumn("batch_cluster_id", F.coalesce("_id", "batch_cluster_id")).withColumn("batch_cluster_title", F.coalesce("_title", "batch_cluster_title"))
    return written(out.drop("_of", "_text", "_id", "_title"), "clusters")


def reranked_candidates(query: DataFrame, known: DataFrame, reranker, s: Settings = DEFAULTS) -> DataFrame:
    """cluster_id, risk_event_id, risk_event_title, score, rank: ``retrieval_top_k`` by vector, reranked by title, the ``rerank_top_k`` best.

    ``query``: cluster_id, gm_code, title, embedding; ``known``: risk_event_id, gm_code, risk_event_title, embedding. Where reranking fails,
    or without a reranker, the vectors' similarity is the score.
    """
    hits = vector_search.knn(query.withColumnRenamed("cluster_id", "vec_id"), known.withColumnRenamed("risk_event_id", "vec_id"), s.retrieval_top_k, "gm_code", keep=["risk_event_title"])
    named = hits.join(query.select(F.col("cluster_id").alias("query_id"), "title"), "query_id")
    if reranker is not None:
        named = models.reranked(named, "title", "hit_risk_event_title", reranker)
    else:
        named = named.withColumn("score", F.lit(None).cast("double"))
    score = F.round(F.coalesce("score", 1 - F.col("distance")), 4)
    scored = named.select(F.col("query_id").alias("cluster_id"), F.col("hit_id").alias("risk_event_id"), F.col("hit_risk_event_title").alias("risk_event_title"), score.alias("score"), F.col("rank").alias("_near"))
    return top_k(scored, ["cluster_id"], [F.col("score").desc(), F.col("_near").asc()], s.rerank_top_k, "rank").drop("_near")


def decider(model) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A function of asked clusters (cluster_id, title, context) and their candidates that gives the model's answers: cluster_id, answer."""

    def ask(asked: DataFrame, candidates: DataFrame) -> DataFrame:
        listed = candidates.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("decision_rank", "risk_event_id", "risk_event_title"))).alias("c"))
        few = F.transform("c", lambda x: F.struct(x["risk_event_id"].alias("risk_event_id"), x["risk_event_title"].alias("risk_event_title")))  # rerank_top_k at most
        task = F.to_json(F.struct("title", F.col("context").alias("summaries"), few.alias("candidates")))
        prompts = asked.join(listed, "cluster_id").select("cluster_id", text.prompt(models.DECIDE, task=task).alias("prompt"))
        return models.answered(prompts, "cluster_id", "prompt", model).select("cluster_id", models.without_thoughts(F.col("answer")).alias("answer"))

    return ask


def match_and_decide(
    clustered: DataFrame, kb: DataFrame, false_positives: DataFrame, activity: DataFrame, as_of: Column, embedder,
    answers: Callable[[DataFrame, DataFrame], DataFrame] | None = None, s: Settings = DEFAULTS, reranker=None,
) -> DataFrame:
    """Voices with decision and risk_event_id. ``kb`` and ``false_positives``: risk_event_id, gm_code, risk_event_title, embedding; ``answers``:
    asked clusters and their candidates -> cluster_id, answer (see ``decider``). Voices that aren't searched for are new events of their cluster."""
    tasks, _ = matching.search_tasks(clustered, s)
    summaries = clusters.context_summaries(clustered.withColumnRenamed("batch_cluster_id", "cluster_id"), ["cluster_id"], "initial_summary_text", s.summary_batch_context)
    found = tasks.drop("voices").join(summaries, "cluster_id", "left").withColumn("context", F.coalesce("context_summaries", F.array().cast("array<string>")))
    found = written(models.embedded(found.withColumn("contexts", F.size("context")), "cluster_id", "title", embedder), "tasks")
    query = found.where(F.col("embedding").isNotNull()).select("cluster_id", "gm_code", "title", "embedding")
    kb, false_positives = written(kb.select("risk_event_id", "gm_code", "risk_event_title", "embedding"), "known"), written(false_positives.select("risk_event_id", "gm_code", "embedding"), "wrong")
    scored = written(matching.decision_scores(reranked_candidates(query, kb, reranker, s), activity, as_of, s), "candidates")
    wrong = vector_search.knn(query.withColumnRenamed("cluster_id", "vec_id"), false_positives.withColumnRenamed("risk_event_id", "vec_id"), 1, "gm_code")
    decided = matching.decisions(found, scored, wrong.select(F.col("query_id").alias("cluster_id"), F.col("distance").alias("fp_distance")), s)
    decided = written(decided, "decisions")
    final = written(matching.resolve(decided, written(answers(decided.where("outcome = 'ask'"), scored), "answers") if answers else None, scored, s), "final")
    out = clustered.join(final.withColumnRenamed("cluster_id", "batch_cluster_id"), "batch_cluster_id", "left")
    decision = F.coalesce("decision", F.lit("create_new"))
    return out.withColumn("decision", decision).withColumn("risk_event_id", F.coalesce("final_event_id", "batch_cluster_id")).drop("final_event_id")


@dataclass
class Managed:
    """What a batch writes. ``knowledge``: the new events as the matching will find them, their vectors still to be made."""

    mapping: DataFrame
    events: DataFrame
    alerts: DataFrame
    knowledge: DataFrame
    stats: DataFrame


def manage_events(decided: DataFrame, events: DataFrame, mapping: DataFrame, timeline: DataFrame, as_of: Column, s: Settings = DEFAULTS) -> Managed:
    """Account for a batch: ``decided`` (id, voice_id, title, gm_code, gmt_create, risk_event_id, decision; goc_product_line, batch_cluster_title
    and initial_summary_text if known) against the state so far.

    The incremental count of known events includes this batch; a new event's is its whole delta.
    """
    voices = written(keep_last(decided, "voice_id", "id"), "voices")
    rows = voices.where(F.col("risk_event_id").isNotNull()).select("voice_id", "risk_event_id", F.col("gmt_create").alias("voice_date"))
    named = [c for c in ("batch_cluster_title", "initial_summary_text", "title") if c in voices.columns]
    line = F.col("goc_product_line") if "goc_product_line" in voices.columns else F.lit(None).cast("string")
    counted = accounting.countable(voices, as_of, s).withColumn("_name", text.or_default(*[F.col(c) for c in named], "Unknown Title")).withColumn("_line", line)
    sample = [F.min_by("gm_code", "id").alias("_code"), F.min_by("_line", "id").alias("_line")]
    deltas = written(accounting.rollup(counted, title_col="_name", also=sample), "deltas")
    merged = accounting.merge_volumes(events, deltas, as_of)
    unknown = F.lit(s.unknown_code)
    fresh = deltas.select("risk_event_id", F.col("risk_event_title").alias("_title"), F.coalesce("_code", unknown).alias("_code"), F.coalesce("_line", unknown).alias("_line"))
    filled = {"risk_event_title": F.col("_title"), "gm_code": F.col("_code"), "goc_product_line": F.col("_line"), "data_source": F.when(F.col("_title").isNotNull(), F.lit(s.data_source))}
    merged = merged.join(fresh, "risk_event_id", "left")
    merged = merged.withColumns({c: F.coalesce(F.col(c), new) for c, new in filled.items() if c in events.columns}).select(*events.columns)
    known = events.select("risk_event_id", F.lit(True).alias("known"))
    counts = accounting.incremental_volume(mapping.unionByName(rows), as_of, s, deltas.select("risk_event_id"))
    checks = deltas.select("risk_event_id", "delta", "first_time").join(merged, "risk_event_id").join(known, "risk_event_id", "left").join(counts, "risk_event_id", "left")
    checks = checks.withColumn("known", F.coalesce("known", F.lit(False))).withColumn("as_of", as_of)
    current = F.when(F.col("known"), F.coalesce("incremental_volume", F.lit(0))).otherwise(F.col("delta"))
    judged = written(baseline.judged(baseline.history(checks, timeline, s).withColumn("volume", current), s), "judged")
    due = accounting.alerts(judged.where(F.col("verdict").isin("alert", "alert_without_baseline")), as_of, s)
    digits = [F.round(c, 2).alias(n) for c, n in (("historical_mean", "historical_mean"), ("historical_std", "historical_std_dev"), ("threshold", "final_decision_threshold"))]
    context = F.to_json(F.struct("gm_code", F.col("volume").alias("current_incremental_volume"), "static_threshold", F.col("history").alias("historical_incremental_volumes"), *digits, "verdict"))
    alerts = due.where(F.col("alert_type").isNotNull()).select("risk_event_id", as_of.alias("alert_timestamp"), F.col("risk_event_volume").alias("volume_at_alert"), "alert_type", context.alias("alert_context"))
    stamps = due.select("risk_event_id", F.col("new_breach").alias("_b"), F.col("new_alerted").alias("_a"))
    state = merged.join(stamps, "risk_event_id", "left").withColumn("threshold_breach_timestamp", F.coalesce("_b", "threshold_breach_timestamp"))
    state = state.withColumn("last_alerted_timestamp", F.coalesce("_a", "last_alerted_timestamp")).select(*events.columns)
    new, old = accounting.split_known(deltas, events)
    listed = ["risk_event_id", "risk_event_title", "status", "gm_code", "goc_product_line", "data_source", "initial_timestamp"]
    knowledge = state.join(new.select("risk_event_id"), "risk_event_id", "left_semi").select(*[c for c in listed if c in events.columns])
    stats = rows.agg(F.count("*").alias("mappings")).join(new.agg(F.count("*").alias("new_events"))).join(old.agg(F.count("*").alias("updated_events")))
    stats = stats.join(alerts.agg(F.count("*").alias("alerts_triggered"))).join(voices.agg(F.count_if(F.col("decision") == "suppress_as_false_positive").alias("suppressed_voices")))
    return Managed(rows, state, alerts, knowledge, stats)
