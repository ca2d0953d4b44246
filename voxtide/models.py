"""Model services behind small protocols, applied to columns by id; deterministic offline implementations.

A call that fails gives null and its reason in an error column, never a text in place of a result; retries happen
within the call. Clients are made once a worker.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtide.functions.text import prompt
from voxtide.sources.embedding_cache import EmbeddingCache
from voxtide.sources.shared import written


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    def scores(self, query: str, texts: list[str]) -> list[float]: ...


class LanguageModel(Protocol):
    def answer(self, prompt: str) -> str: ...


class HashEmbedder:
    """Unit vectors of hashed character trigrams."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v, padded = np.zeros(self.dim), f"  {text.lower()} "
            for i in range(len(padded) - 2):
                h = int.from_bytes(hashlib.blake2b(padded[i : i + 3].encode(), digest_size=8).digest(), "little")
                v[h % self.dim] += 1 if h >> 63 else -1
            length = float(np.linalg.norm(v))
            out.append((v / length if length else v).tolist())
        return out


class CosineReranker:
    """1 - cosine distance of the offline embeddings, within [0, 1]."""

    def __init__(self, embedder: Embedder | None = None) -> None:
        self.embedder = embedder or HashEmbedder()

    def scores(self, query: str, texts: list[str]) -> list[float]:
        q, *rest = (np.array(v) for v in self.embedder.embed([query, *texts]))
        return [float(min(1.0, max(0.0, q @ r))) for r in rest]


class EchoModel:
    """Answers with the last line of its prompt: the masked title of a summary prompt."""

    def answer(self, prompt: str) -> str:
        return prompt.rsplit("\n", 1)[-1]


class OfflineModel(EchoModel):
    """Echoes summaries; puts a cluster's messages under their shortest; merges a cluster with the candidate of the same title, if any."""

    def answer(self, prompt: str) -> str:
        last = super().answer(prompt)
        if prompt.startswith(SPLIT.split("\n", 1)[0]):
            messages = json.loads(last)
            return json.dumps({"summaries": [{"text": min(messages, key=lambda m: (len(m), m)), "original_indices": list(range(len(messages)))}]})
        if prompt.startswith(DECIDE.split("\n", 1)[0]):
            task = json.loads(last)
            same = [c for c in task["candidates"] if c["risk_event_title"] == task["title"]]
            return json.dumps({"decision": "merge", "matched_risk_event_id": same[0]["risk_event_id"]} if same else {"decision": "create_new"})
        return last


#: Prompts; ``$name`` is filled from a column.
SUMMARIZE = "Summarize the message in one sentence.\n$title"
SPLIT = (
    "Group the numbered messages of this cluster by the problem that they report.\n"
    'Answer with JSON alone: {"summaries": [{"text": "the problem in one sentence", "original_indices": [0, 1]}]}, each message in one group, counted from 0.\n$messages'
)
DECIDE = (
    "Decide whether a new cluster of messages belongs to a known event.\n"
    'Answer with JSON alone: {"decision": "merge" or "create_new", "matched_risk_event_id": "the candidate\'s id or null", "reason": "why"}.\n$task'
)


class HttpClient:
    """POSTs JSON to a service, within a time limit; made in the worker that uses it."""

    def __init__(self, url: str, model: str = "", timeout: float = 180.0, headers: dict[str, str] | None = None) -> None:
        self.url, self.model, self.timeout, self.headers = url, model, timeout, headers or {}

    def post(self, **body: object) -> dict:
        data = json.dumps({"model": self.model} | body).encode()
        request = urllib.request.Request(self.url, data, {"Content-Type": "application/json"} | self.headers)
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.loads(answer.read())


class HttpEmbedder(HttpClient):
    """``{"input": [...]}`` -> ``{"data": [{"index": i, "embedding": [...]}]}``."""

    def embed(self, texts: list[str]) -> list[list[float]]:
        rows = sorted(self.post(input=texts)["data"], key=lambda r: r["index"])
        if [r["index"] for r in rows] != list(range(len(texts))):
            raise ValueError("the service left out a text")
        return [r["embedding"] for r in rows]


class HttpReranker(HttpClient):
    """``{"query": q, "documents": [...]}`` -> ``{"results": [{"index": i, "relevance_score": x}]}``, in any order."""

    def scores(self, query: str, texts: list[str]) -> list[float]:
        rows = sorted(self.post(query=query, documents=texts)["results"], key=lambda r: r["index"])
        if [r["index"] for r in rows] != list(range(len(texts))):
            raise ValueError("the service left out a text")
        return [float(r["relevance_score"]) for r in rows]


class HttpModel(HttpClient):
    """``{"messages": [...]}`` -> ``{"choices": [{"message": {"content": "..."}}]}``."""

    def __init__(self, url: str, model: str = "", timeout: float = 600.0, headers: dict[str, str] | None = None) -> None:
        super().__init__(url, model, timeout, headers)

    def answer(self, prompt: str) -> str:
        return self.post(messages=[{"role": "user", "content": prompt}])["choices"][0]["message"]["content"]


def attempt(call: Callable[[], object], times: int = 2, pause: float = 0.5) -> tuple[object, str | None]:
    error = None
    for i in range(times):
        if i:
            time.sleep(pause)
        try:
            return call(), None
        except Exception as e:  # noqa: BLE001  a service may fail in any way; the row carries the reason
            error = f"{type(e).__name__}: {e}"
    return None, error


@dataclass(frozen=True)
class Cached:
    """An embedder that asks only for texts that ``cache`` doesn't have; ``embedded`` takes it in place of ``make``."""

    make: Callable[[], Embedder]
    cache: EmbeddingCache


def embedded(df: DataFrame, id_col: str, text_col: str, make: Callable[[], Embedder] | Cached, batch: int = 64, column: str = "embedding") -> DataFrame:
    """``df`` with the vector of a text and an error; each distinct text is embedded once, failed batches are null. The result is written:
    however often it is read, nothing is asked again (``df`` itself is read twice, so it asks nothing, or is written)."""

    cache, make = (make.cache, make.make) if isinstance(make, Cached) else (None, make)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service = make()
        for frame in frames:
            vectors, errors = [], []
            for at in range(0, len(frame), batch):
                texts = frame["_text"].iloc[at : at + batch].tolist()
                got, error = attempt(lambda texts=texts: service.embed(texts))
                vectors += got if got is not None else [None] * len(texts)
                errors += [error] * len(texts)
            yield pd.DataFrame({"_text": frame["_text"], column: vectors, f"{column}_error": errors})

    texts = df.select(F.col(text_col).alias("_text")).where("_text IS NOT NULL").distinct()
    schema = f"_text string, {column} array<double>, {column}_error string"
    if cache is None:
        vectors = texts.mapInPandas(run, schema)
    else:
        texts = written(texts, "texts")
        known = written(cache.found(texts, "_text"), "known-texts")
        asked = written(texts.join(known, "_text", "left_anti").mapInPandas(run, schema), "asked-texts")
        cache.add(asked, "_text", column)
        vectors = asked.unionByName(known.select("_text", F.col("_vector").alias(column), F.lit(None).cast("string").alias(f"{column}_error")))
    return written(df.join(vectors, df[text_col] == F.col("_text"), "left").drop("_text"), "embedded")


def answered(df: DataFrame, id_col: str, prompt_col: str, make: Callable[[], LanguageModel], workers: int = 8) -> DataFrame:
    """id, answer, error of every prompt: calls run side by side, results are tied to ids and not to positions."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service = make()
        with ThreadPoolExecutor(workers) as pool:
            for frame in frames:
                got = list(pool.map(lambda p: attempt(lambda: service.answer(p)), frame[prompt_col]))
                yield pd.DataFrame({id_col: frame[id_col], "answer": [a for a, _ in got], "error": [e for _, e in got]})

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, prompt_col).mapInPandas(run, f"`{id_col}` {kind}, answer string, error string")


def without_thoughts(answer: Column) -> Column:
    """An answer without the model's thoughts; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(answer, r"(?s)<think>.*?</think>", "")), F.lit(""))


def summary_id(key: Column, summary: Column) -> Column:
    return F.concat(F.lit("sum"), F.substring(F.sha2(F.concat_ws("|", key.cast("string"), summary), 256), 1, 24))


def summarized(voices: DataFrame, id_col: str, title_col: str, make: Callable[[], LanguageModel], template: str = SUMMARIZE) -> DataFrame:
    """``voices`` with initial_summary_text (the masked title where the model fails), initial_summary_id and summary_error; written, as ``embedded``."""
    titles = voices.select(F.col(title_col).alias("_asked")).where("_asked IS NOT NULL").distinct()  # each once
    got = answered(titles.withColumn("prompt", prompt(template, title=F.col("_asked"))), "_asked", "prompt", make).withColumnRenamed("error", "summary_error")
    clean = without_thoughts(F.col("answer"))
    joined = voices.join(got, voices[title_col] == got["_asked"], "left").withColumn("initial_summary_text", F.coalesce(clean, F.col(title_col)))
    return written(joined.withColumn("initial_summary_id", summary_id(F.col(id_col), F.col("initial_summary_text"))).drop("_asked", "answer"), "summarized")


def reranked(hits: DataFrame, query_col: str, text_col: str, make: Callable[[], Reranker], digits: int = 4) -> DataFrame:
    """``hits`` with ``score``: rows of one query in a batch go to the service together; a failed call gives null. Written, as ``embedded``."""
    columns = hits.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service = make()
        for frame in frames:
            score = pd.Series(index=frame.index, dtype="float64")
            for query, rows in frame.groupby(query_col, sort=False):
                got, _ = attempt(lambda query=query, rows=rows: service.scores(query, rows[text_col].tolist()))
                if got is not None:
                    score[rows.index] = got
            yield frame.assign(score=score.round(digits))[[*columns, "score"]]

    schema = ", ".join(f"`{n}` {t}" for n, t in hits.dtypes if n != "score") + ", score double"
    return written(hits.mapInPandas(run, schema), "reranked")
