"""Language identification by nearest centroids of hashed n-gram TF-IDF vectors.

A text's vector holds, for every bucket of its hashed 2- to 4-grams (of lower-cased bytes, other than
letters as one space), (1 + ln count) * idf, scaled to unit length. Each language has several
unit centroids, found by spherical k-means; the language of the centroid with the largest cosine is the
prediction, and that cosine its score. A text too far from every centroid is rejected: its cosine is for each language under
the language's bound, growing with the text's number of n-grams, or it has no letter at all. The bound is learned from what
cosines labelled texts have with centroids fitted on others: a share ``MARGIN`` of their ``LOW`` quantile, so that one odd text
doesn't set it. A text of few n-grams, which cosines can't tell, is rejected too if most of its letters are in no fitted text.

The document frequencies cover every labelled text (partial sums in each task, ``BUCKETS`` numbers in all);
the centroids are fitted on a bounded sample of distinct texts: ``PER_LANGUAGE`` of a language and ``SAMPLE``
over all languages (one text of each, if there are more languages), drawn by a hash of the text at a share of the language's distinct texts with a letter, so copies take no place. Prediction is one narrow pass without a shuffle.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and rejected; with no labelled
text everything is ``und``; an empty table gives an empty result; repeated rows get equal results; a very long text is counted as a
whole; of centroids with equal cosine the first counts, by language; only the text is read for a prediction, and columns other than
those named are not touched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxtide.llm.common import gives_back, stored
from voxtide.llm.shingles import column_blocks

BUCKETS = 1 << 14
#: Bounds of the fitting sample.
PER_LANGUAGE, SAMPLE = 200, 2000
#: Texts drawn beyond twice the quota, so that small quotas are met as well.
SPARE = 30
CENTROIDS = 4
UNKNOWN = "und"
#: A text is rejected under this share of the low quantile of the cosines, by their reach, of a language's labelled texts. Short and
#: odd texts of a language come down to 0.4 of the quantile, other Latin-script languages and random letters up to 0.25.
LOW, MARGIN = 0.05, 0.32
#: Under so many distinct n-grams (about 100 letters) the bound shrinks with them: a name or a key in a short text outweighs its words.
SURE = 256
#: With fewer texts a language has no quantile of its own; the least bound of the others holds.
FEW = 20

_CLEAN = np.full(256, 0x20, np.uint8)
_CLEAN[0x61:0x7B] = np.arange(0x61, 0x7B)
_CLEAN[0x41:0x5B] = np.arange(0x61, 0x7B)
_CLEAN[0x80:] = np.arange(0x80, 0x100)


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8", "replace"))) if text else False


def vectors(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, counts) of each text's n-grams."""
    bounds = np.cumsum([0, *(len(t) + 2 for t in texts)])
    raw = _CLEAN[np.frombuffer(b" " + b"  ".join(texts) + b"   ", np.uint8)]
    raw = raw.astype(np.uint32)
    grams, code = [], raw[:-1] << np.uint32(8) | raw[1:]
    for n in (2, 3, 4):
        if n > 2:
            code = code[: len(raw) - n + 1] << np.uint32(8) | raw[n - 1 :]
        grams.append(((code * np.uint32(0x9E3779B1)) ^ np.uint32(n * 0x2545F491)) * np.uint32(0x85EBCA77) >> np.uint32(18))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        count = np.bincount(np.concatenate([g[a : b - n] for g, n in zip(grams, (0, 1, 2), strict=True)]), minlength=BUCKETS) if b - a > 4 else np.bincount(grams[0][a:b], minlength=BUCKETS)
        at = np.flatnonzero(count)
        yield at, count[at]


@dataclass
class Model:
    idf: np.ndarray
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    bounds: np.ndarray  # of each centroid: least cosine of a text by its reach
    letters: frozenset[str] = frozenset()  # of the fitted texts

    @staticmethod
    def reach(grams: int) -> float:
        """How the cosine that can be expected grows with the number of distinct n-grams."""
        return float(np.sqrt(min(grams, 1024)))

    def weigh(self, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        w = (1 + np.log(count)) * self.idf[at]
        norm = np.sqrt((w * w).sum())
        return (w / norm if norm else w).astype(np.float32)

    def nearest(self, at: np.ndarray, count: np.ndarray) -> tuple[int, float, bool]:
        """(centroid, cosine, whether the text is too far from all centroids)."""
        cosine = self.centroids[:, at] @ self.weigh(at, count)
        best = int(cosine.argmax())
        return best, float(min(max(cosine[best], 0.0), 1.0)), bool((cosine < self.bounds * self.reach(len(at)) * min(1.0, len(at) / SURE)).all())

    def strange(self, text: bytes) -> bool:
        """Whether most of a text's letters are in no fitted text."""
        known = [c in self.letters for c in text.decode("utf-8", "replace").lower() if c.isalpha()]
        return 2 * sum(known) < len(known)

    def label(self, texts: list[bytes]) -> Iterator[tuple[str, float, bool]]:
        """(language, score, rejected) of each text."""
        for text, (at, count) in zip(texts, vectors(texts), strict=True):
            if not self.languages or not has_letter(text):
                yield UNKNOWN, 0.0, True
            else:
                best, score, far = self.nearest(at, count)
                yield self.languages[best], score, far or len(at) < SURE and self.strange(text)


def _kmeans(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Spherical k-means from a farthest-first start at the first row."""
    start = [0]
    while len(start) < min(k, len(x)):
        start.append(int((x @ x[start].T).max(axis=1).argmin()))
    centre = x[start]
    for _ in range(rounds):
        own = (x @ centre.T).argmax(axis=1)
        new = np.array([x[own == i].sum(axis=0) if (own == i).any() else centre[i] for i in range(len(centre))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, centre, atol=1e-5):
            break
        centre = new
    return centre


def _bound(x: np.ndarray, reach: np.ndarray, clusters: int) -> float | None:
    """Least cosine, by reach, of a language's texts: each half of them is held against centroids of the other."""
    if len(x) < FEW:
        return None
    far = [((x[i::2] @ _kmeans(x[1 - i :: 2], clusters).T).max(axis=1) / reach[i::2]) for i in (0, 1)]
    return MARGIN * float(np.quantile(np.concatenate(far), LOW))


def fit(docs: DataFrame, learn: Column, lang_col: str = "lang", text_col: str = "text", per_language: int = PER_LANGUAGE, sample: int = SAMPLE, clusters: int = CENTROIDS) -> Model:
    """Learn from the text and language of the rows where ``learn`` holds and the language isn't null."""
    spark = docs.sparkSession
    rows = docs.where(learn & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    key = F.xxhash64("text")
    distinct = F.approx_count_distinct(F.when(F.col("text").rlike(r"\p{L}"), key)).alias("n")  # texts, not rows: copies are drawn once
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(distinct).collect() if r["n"]}
    if not sizes:
        return Model(np.zeros(BUCKETS), [], np.zeros((0, BUCKETS)), np.zeros(0))
    quota = max(1, min(per_language, sample // len(sizes)))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, (2 * quota + SPARE) / n))])
    drawn = (F.pmod(key, F.lit(1 << 30)) <= share[F.col("lang")] * (1 << 30)).alias("drawn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The drawn texts' counts, and at the end one row without a language: the task's document frequencies."""
        df, total, seen = np.zeros(BUCKETS, np.int64), 0, set()

        def row(lang, h, at, count, letters=""):
            return pa.RecordBatch.from_pydict({"lang": pa.array([lang], pa.string()), "h": pa.array([h], pa.int64()), "at": pa.array([at], pa.list_(pa.int32())), "n": pa.array([count], pa.list_(pa.int64())), "letters": pa.array([letters], pa.string())})

        for batch in batches:
            lang, h, take = (batch.column(i).to_pylist() for i in (0, 2, 3))
            for first, part in column_blocks(batch.column(1)):
                for i, (at, count) in enumerate(vectors(part), first):
                    df[at] += 1
                    total += 1
                    if take[i] and (lang[i], h[i]) not in seen and has_letter(part[i - first]):
                        seen.add((lang[i], h[i]))
                        yield row(lang[i], h[i], at, count, "".join(sorted({c for c in part[i - first].decode("utf-8", "replace").lower() if c.isalpha()})))
        at = np.flatnonzero(df)
        yield row(None, total, at, df[at])

    facts = stored(rows.where("text IS NOT NULL").select("lang", "text", key.alias("h"), drawn).mapInArrow(gives_back(run), "lang string, h long, at array<int>, n array<long>, letters string"), "langid")
    partial = facts.where("lang IS NULL")
    total = partial.agg(F.sum("h")).first()[0]
    df = np.zeros(BUCKETS)
    each = partial.select(F.explode(F.arrays_zip("at", "n")).alias("x")).groupBy("x.at").agg(F.sum("x.n").alias("n"))
    for r in each.collect():  # BUCKETS rows
        df[r["at"]] = r["n"]
    model = Model(np.log((1 + total) / (1 + df)) + 0.05, [], np.zeros((0, BUCKETS)), np.zeros(0))
    first = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    few = facts.where("lang IS NOT NULL").dropDuplicates(["lang", "h"]).withColumn("i", first).where(F.col("i") <= quota).orderBy("lang", "h").select("lang", "at", "n", "letters").toArrow()
    found, bounds = [], []
    by_lang: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for i, lang in enumerate(few["lang"].to_pylist()):
        by_lang.setdefault(lang, []).append((few["at"][i].values.to_numpy(), few["n"][i].values.to_numpy()))
    for lang, own in by_lang.items():
        x = np.zeros((len(own), BUCKETS), np.float32)
        for i, (at, count) in enumerate(own):
            x[i, at] = model.weigh(at, count)
        found.append(_kmeans(x, clusters))
        bounds += [_bound(x, np.array([model.reach(len(at)) for at, _ in own]), clusters)] * len(found[-1])
        model.languages += [lang] * len(found[-1])
    if not found:  # letters that only one of Java and Python knows
        return model
    model.centroids = np.vstack(found).astype(np.float32)
    model.letters = frozenset("".join(few["letters"].to_pylist()))
    least = min((b for b in bounds if b is not None), default=0.0)
    model.bounds = np.array([least if b is None else b for b in bounds])
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected."""

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            out = [x for _, part in column_blocks(batch.column(1)) for x in model.label(part)]
            lang, score, rejected = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(gives_back(run), "doc_id long, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that aren't rejected, with all their columns, in one narrow pass."""
    place, shared = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            out = [not rejected for _, part in column_blocks(batch.column(place)) for _, _, rejected in model.label(part)]
            yield batch.filter(pa.array(out, pa.bool_()))

    return docs.mapInArrow(gives_back(run), docs.schema)


def learnable(id_col: str = "doc_id") -> Column:
    """Rows to learn from: all but a quarter, held out by a checksum of the id."""
    return ~held_out(id_col)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
