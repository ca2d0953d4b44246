"""Language-model scores of whole texts by a subword lattice: the probability of a text is the sum over all ways to segment it.

The pieces are those of an existing vocabulary (a SentencePiece file; nothing is added to it or trained of it), with its byte pieces for
whatever it lacks. Text is lower-cased in A-Z and cut at ASCII white space; a word is a space and its bytes, and no piece runs over a
space, so a text is a chain of lattices, one a word, and an end. A forward recursion in log space sums over all paths of a lattice:
``P(w) = sum over segmentations of the product of their pieces' probabilities``. Every lattice has one edge more, over the whole word,
whose weight is the word's training count: a token is w with ``(count(w) + V * P(w)) / (words + V)``, V the distinct training words.
A text's probability is that of a mixture over the training languages, each with weights of its own; summed over all texts it is at most 1.

The file's scores are ranks of merges; as weights they start as 1 / (rank + 1). ``ROUNDS`` rounds of expectation (forward and backward
over a language's distinct training words, each once, as what is left to the pieces are words that were not met) re-estimate them; each
round is one pass over the table of words, and gives the driver one number a piece and language.

Scale: counts of words are summed in each task and shuffled by word. A word's lattice is worked through once for the whole corpus. The
``OFTEN`` most frequent words of at most ``SHORT`` bytes (some 10 MB at most with their scores) go to all tasks; the others are looked up by
a shuffle of (row, word, n), without texts. Languages beyond the ``LANGUAGES`` with most training rows are one component together.

Defined cases: a null or empty text has its end alone; a null language is one of its own; without training rows all pieces are alike,
N = V = 0 and the base score is 0; repeated rows are rows of their own; a word of any length is scored as a whole (its lattice reaches
back one piece's length at a time); an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtide.llm.common import discard, gives_back, stored
from voxtide.llm.slices import grouped, lookup, padded, runs, strings, summed, text_blocks

#: Bytes of a word: not ASCII white space.
WORD = lookup(0x20, range(0x09, 0x0E))
ROUNDS = 3
#: Languages with weights of their own; the last component is all others together.
LANGUAGES = 8
#: Added to each piece's expected count.
SMOOTH = 0.1
#: Words whose counts go to all tasks, and the bytes that such a word has at most.
OFTEN, SHORT = 1 << 16, 64
#: Words over this length are scored one by one; words of one lattice batch.
LONG_WORD, BATCH_WORDS = 48, 1 << 14
SPACE, PAD = 0x20, 256


@dataclass
class Vocabulary:
    """The pieces of a file as a trie over bytes, a word's leading space as byte 32."""

    ranks: np.ndarray  # of each piece
    child: np.ndarray  # nodes x 257: the next node, 0 if none
    piece: np.ndarray  # of each node, -1 if none
    byte: np.ndarray  # 256 byte pieces
    depth: int

    def __len__(self) -> int:
        return len(self.ranks)


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """Load the file; control, unknown and unused pieces, and those with A-Z or a space inside, can't occur in a lattice."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts, byte, ranks = [], np.full(256, -1), []
    for i in range(model.get_piece_size()):
        text, score = model.id_to_piece(i), model.get_score(i)
        if model.is_byte(i):
            byte[int(text[3:5], 16)] = len(ranks)
            ranks.append(None)
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            raw = text.replace("▁", " ").encode()
            if SPACE not in raw[1:] and WORD[list(raw.lstrip(b" "))].all() and not any(0x41 <= b <= 0x5A for b in raw):
                texts.append((raw, len(ranks)))
                ranks.append(-score)
    for b in range(256):  # a file without byte pieces
        if byte[b] < 0:
            byte[b] = len(ranks)
            ranks.append(None)
    last = 1 + max((r for r in ranks if r is not None), default=0)
    nodes: dict[bytes, int] = {b"": 0}
    for raw, _ in texts:
        for n in range(1, len(raw) + 1):
            nodes.setdefault(raw[:n], len(nodes))
    child, piece = np.zeros((len(nodes), 257), np.int32), np.full(len(nodes), -1, np.int32)
    for prefix, node in nodes.items():
        if prefix:
            child[nodes[prefix[:-1]], prefix[-1]] = node
    for raw, i in texts:
        piece[nodes[raw]] = i
    return Vocabulary(np.array([last if r is None else r for r in ranks], np.float64), child, piece, byte, max((len(r) for r, _ in texts), default=1))


def normalised(weights: np.ndarray) -> np.ndarray:
    """Log probabilities of the pieces."""
    return np.log(weights) - np.log(weights.sum())


def _edges(letters: np.ndarray, v: Vocabulary) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, words, pieces): the pieces of a batch of words (rows of bytes, padded with PAD), from left to right."""
    n, width = letters.shape
    everyone = np.arange(n)
    for i in range(width):
        words = everyone if i == 0 else np.flatnonzero(letters[:, i] != PAD)
        yield i, i + 1, words, v.byte[letters[words, i]]
        node = np.zeros(len(words), np.int32)
        for j in range(i, min(width, i + v.depth)):
            node = v.child[node, letters[words, j]]
            alive = node > 0
            words, node = words[alive], node[alive]
            if not len(words):
                break
            found = v.piece[node]
            whole = found >= 0
            if whole.any():
                yield i, j + 1, words[whole], found[whole]


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log(exp(a) + exp(b)); b is finite."""
    return np.maximum(a, b) + np.log(1 + np.exp(-np.abs(a - b)))


def _forward(letters: np.ndarray, v: Vocabulary, log_p: np.ndarray, keep: list | None = None) -> np.ndarray:
    """alpha (places x words x columns of ``log_p``): the log of the summed weight of all paths to a place."""
    alpha = np.full((letters.shape[1] + 1, len(letters), log_p.shape[1]), -np.inf)
    alpha[0] = 0.0
    for i, j, words, pieces in _edges(letters, v):
        alpha[j, words] = _add(alpha[j, words], alpha[i, words] + log_p[pieces])
        if keep is not None:
            keep.append((i, j, words, pieces))
    return alpha


def _long(word: bytes, v: Vocabulary, log_p: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """alpha and, for each place, the (from, piece) that end there, of one long word."""
    n, into = len(word), [[] for _ in range(len(word) + 1)]
    alpha = np.full(n + 1, -np.inf)
    alpha[0] = 0.0
    child, piece = v.child, v.piece
    for i in range(n):
        if into[i]:
            alpha[i] = np.logaddexp.reduce([alpha[a] + log_p[p] for a, p in into[i]])
        into[i + 1].append((i, int(v.byte[word[i]])))
        node = 0
        for j in range(i, min(n, i + v.depth)):
            node = child[node, word[j]]
            if not node:
                break
            if piece[node] >= 0:
                into[j + 1].append((i, int(piece[node])))
    alpha[n] = np.logaddexp.reduce([alpha[a] + log_p[p] for a, p in into[n]])
    return alpha, into


def _batches(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, letters) of words of about one length: a space, the bytes, PAD."""
    lengths = ends - starts
    short = np.flatnonzero(lengths <= LONG_WORD)
    short = short[np.argsort(lengths[short], kind="stable")]
    for at in range(0, len(short), BATCH_WORDS):
        places = short[at : at + BATCH_WORDS]
        width = int(lengths[places[-1]])
        steps = np.arange(width)
        letters = np.full((len(places), width + 1), PAD, np.int32)
        letters[:, 0] = SPACE
        inside = steps < lengths[places][:, None]
        letters[:, 1:][inside] = raw[(starts[places][:, None] + steps)[inside]]
        yield places, letters


def word_scores(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, v: Vocabulary, log_p: np.ndarray) -> np.ndarray:
    """Natural log of the marginal probability of each word (rows) under each component (rows of ``log_p``)."""
    out, columns = np.zeros((len(starts), len(log_p))), np.ascontiguousarray(log_p.T)
    for places, letters in _batches(raw, starts, ends):
        alpha = _forward(letters, v, columns)
        out[places] = alpha[1 + (ends - starts)[places], np.arange(len(places))]
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        word = b" " + raw[starts[i] : ends[i]].tobytes()
        out[i] = [_long(word, v, lp)[0][-1] for lp in log_p]
    return out


def expected(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray, v: Vocabulary, log_p: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece over weighted words: forward, then backward."""
    total = np.zeros(len(v))
    for places, letters in _batches(raw, starts, ends):
        edges: list = []
        alpha = _forward(letters, v, log_p[:, None], edges)[:, :, 0]
        last, each = 1 + (ends - starts)[places], np.arange(len(places))
        beta = np.full_like(alpha, -np.inf)
        beta[last, each] = np.log(weights[places]) - alpha[last, each]
        for i, j, words, pieces in reversed(edges):
            after = log_p[pieces] + beta[j, words]
            beta[i, words] = _add(beta[i, words], after)
            total += np.bincount(pieces, np.exp(alpha[i, words] + after), len(v))
    for w in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        alpha, into = _long(b" " + raw[starts[w] : ends[w]].tobytes(), v, log_p)
        beta = np.full(len(alpha), -np.inf)
        beta[-1] = np.log(weights[w]) - alpha[-1]
        for j in range(len(into) - 1, 0, -1):
            for i, p in into[j]:
                after = log_p[p] + beta[j]
                beta[i] = np.logaddexp(beta[i], after)
                total[p] += np.exp(alpha[i] + after)
    return total


def _words(block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(raw, starts, ends, group) of a block's words: the slices of its distinct words, and which one each word is."""
    starts, ends = runs(WORD[block.raw], block.bounds)
    raw = padded(block.raw)
    heads, group = grouped(raw, starts, ends)
    doc = np.searchsorted(block.bounds, starts, "right") - 1
    return raw, starts[heads], ends[heads], group * len(block) + doc  # group and document in one key


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(component, text) -> occurrences of each word of a block in each component; a text without a component gives its words without a count."""
    for batch in batches:
        own = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        kinds = int(own.max(initial=0)) + 1
        for block in text_blocks(batch.column(1)):
            raw, starts, ends, key = _words(block)
            key, n = summed(key // len(block) * kinds + own[block.first + key % len(block)], np.ones(len(key), np.int64))
            word, component = key // kinds, key % kinds - 1
            yield pa.RecordBatch.from_arrays([strings(raw, starts[word], ends[word]), pa.array(component.astype(np.int32)), pa.array(np.where(component < 0, 0, n))], names=["word", "component", "n"])


def _counts(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def expect(path: str, log_p: np.ndarray):
    """Over (word, c): the expected number of uses of each piece in each component, over the component's distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, total = vocabulary(path), np.zeros(log_p.shape)
        for batch in batches:
            met = _counts(batch.column(1)) > 0
            for block in text_blocks(batch.column(0)):
                raw = padded(block.raw)
                for k in range(len(log_p)):
                    at = np.flatnonzero(met[block.first : block.first + len(block), k])
                    total[k] += expected(raw, block.bounds[at], block.bounds[at + 1], np.ones(len(at)), v, log_p[k])
        component, piece = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(component.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[component, piece])], names=["component", "piece", "uses"])

    return run


@dataclass
class Model:
    """What is learned: numbers of the components (one a language), the pieces' weights, and the table of words with their scores."""

    path: str
    log_p: np.ndarray  # components x pieces, natural logs
    tokens: np.ndarray  # of each component: training words and ends
    ends: np.ndarray  # training rows
    kinds: np.ndarray  # distinct training words
    all_kinds: int  # V: distinct training tokens of all components
    words: DataFrame | None = None  # word, c (its count), p (log10 of its probability in each component)
    often: tuple[dict[bytes, int], np.ndarray, np.ndarray] = ({}, np.zeros(0), np.zeros(0))  # places of frequent words; their c and p

    @property
    def train_tokens(self) -> int:
        return int(self.tokens.sum())

    def base(self, count):
        """log10 of the base model's probability of a token; ``count`` is a column or an array."""
        whole = float(self.train_tokens + self.all_kinds + 1)
        return F.log10((count + 1) / F.lit(whole)) if isinstance(count, Column) else np.log10((np.asarray(count) + 1.0) / whole)

    @property
    def stop(self) -> np.ndarray:
        """The probability that a token is an end, in each component."""
        return (self.ends + 1) / (self.tokens + 2)

    def word_log10(self, counts: np.ndarray, lattice: np.ndarray) -> np.ndarray:
        """log10 of the probability of words (rows) in each component (columns), from their counts and their lattices' natural logs."""
        spare = np.maximum(self.kinds, 1)
        with np.errstate(divide="ignore"):
            known = np.log(counts) - np.log(self.tokens - self.ends + spare)
        return (np.logaddexp(known, np.log(spare) - np.log(self.tokens - self.ends + spare) + lattice) + np.log1p(-self.stop)) / np.log(10)


def score_words(model: Model):
    """Over (word, c): word, its count in all components, and its log10 probability in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model.path)
        for batch in batches:
            counts = _counts(batch.column(1))
            for block in text_blocks(batch.column(0)):
                raw, here = padded(block.raw), counts[block.first : block.first + len(block)]
                lattice = word_scores(raw, block.bounds[:-1], block.bounds[1:], v, model.log_p)
                p = pa.FixedSizeListArray.from_arrays(pa.array(model.word_log10(here, lattice).ravel()), here.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, len(block)), pa.array(here.sum(axis=1)), p], names=["word", "c", "p"])

    return run


def fit(docs: DataFrame, learn: Column, path: str, text_col: str = "text", lang_col: str = "lang", rounds: int = ROUNDS, often: int = OFTEN, languages: int = LANGUAGES) -> Model:
    """Learn from the rows where ``learn`` holds; the words of all rows are scored with the vocabulary at ``path``."""
    v = vocabulary(path)
    lang, training = F.coalesce(F.col(lang_col).cast("string"), F.lit("")), F.coalesce(learn, F.lit(False))
    sizes = docs.where(training).groupBy(lang.alias("lang")).agg(F.count("*").alias("n"))
    largest = [r["lang"] for r in sizes.orderBy(F.col("n").desc(), "lang").limit(languages).collect()]
    number = F.coalesce(F.create_map(*[F.lit(x) for k, name in enumerate(largest) for x in (name, k)])[lang], F.lit(len(largest))) if largest else F.lit(0)
    component = F.when(training, number).otherwise(-1).cast("int")
    rows = docs.select(component.alias("component"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ends = {r["component"]: r["n"] for r in rows.where("component >= 0").groupBy("component").agg(F.count("*").alias("n")).collect()}
    size = max(ends, default=0) + 1
    each = F.array(*[F.sum(F.when(F.col("component") == k, F.col("n")).otherwise(0)) for k in range(size)])
    words = stored(rows.mapInArrow(gives_back(count_words), "word string, component int, n long").groupBy("word").agg(each.alias("c")), "words")
    sums = [x for k in range(size) for x in (F.coalesce(F.sum(F.col("c")[k]), F.lit(0)), F.count_if(F.col("c")[k] > 0))]
    found = words.agg(*sums, F.count_if(F.exists("c", lambda x: x > 0))).first()
    rest = np.array([ends.get(k, 0) for k in range(size)], np.int64)
    model = Model(path, np.tile(normalised(1 / (v.ranks + 1)), (size, 1)), np.array(found[0:-1:2], np.int64) + rest, rest, np.array(found[1:-1:2], np.int64), found[-1] + bool(rest.any()))
    for _ in range(rounds if model.kinds.any() else 0):
        uses = np.full(model.log_p.shape, SMOOTH)
        got = words.mapInArrow(gives_back(expect(path, model.log_p)), "component int, piece int, uses double").groupBy("component", "piece").agg(F.sum("uses").alias("uses")).toArrow()
        uses[got["component"].to_numpy(), got["piece"].to_numpy()] += got["uses"].to_numpy()
        model.log_p = np.stack([normalised(u) for u in uses])
    scored = stored(words.mapInArrow(gives_back(score_words(model)), "word string, c long, p array<double>"), "word-scores")
    discard(words)
    top = scored.where(F.octet_length("word") <= SHORT).orderBy(F.col("c").desc(), F.col("word")).limit(often).toArrow().combine_chunks()
    places = {w.encode(): i for i, w in enumerate(top["word"].to_pylist())}
    p = top["p"].combine_chunks()
    model.often = (places, top["c"].to_numpy(), p.flatten().to_numpy().reshape(-1, size))
    model.words = scored
    return model


def _score(model: Model):
    """Over (doc_id, text): a row of each text, and rows of its words that aren't at hand."""
    (places, often_c, often_p), width = model.often, len(model.log_p)
    base_of, ends = replace(model, words=None, log_p=model.log_p[:, :0], often=({}, None, None)), int(model.ends.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for block in text_blocks(batch.column(1)):
                raw, starts, stops, key = _words(block)
                key, n = summed(key, np.ones(len(key), np.int64))
                word, doc, size = key // len(block), key % len(block), len(block)
                place = np.array([places.get(raw[a:b].tobytes(), -1) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)], np.int64)[word]
                near, far = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
                c, at, many = often_c[place[near]], doc[near], n[near]
                tokens = np.bincount(doc, n, size).astype(np.int64) + 1
                known = np.bincount(at, many * (c > 0), size).astype(np.int64) + (1 if ends else 0)
                base = np.bincount(at, many * base_of.base(c), size) + float(base_of.base(ends))
                p = np.stack([np.bincount(at, many * often_p[place[near], k], size) for k in range(width)], axis=1)
                ids = batch.column(0).slice(block.first, size)
                yield _rows(ids, np.arange(row, row + size), None, tokens, known, base, p)
                if len(far):
                    yield _rows(pa.nulls(len(far), ids.type), row + doc[far], strings(raw, starts[word[far]], stops[word[far]]), n[far], None, None, None)
                row += size

    return run


def _rows(ids: pa.Array, row: np.ndarray, word: pa.Array | None, n: np.ndarray, known, base, p) -> pa.RecordBatch:
    size, lists = len(ids), pa.list_(pa.float64())
    columns = [ids, pa.array(row), pa.nulls(size, pa.string()) if word is None else word, pa.array(n)]
    columns += [pa.nulls(size, kind) if c is None else pa.array(c, kind) for c, kind in ((known, pa.int64()), (base, pa.float64()))]
    columns.append(pa.nulls(size, lists) if p is None else pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), p.shape[1]).cast(lists))
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "word", "n", "known", "base", "p"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score: log10 probabilities of whole texts. ``docs``: the rows that ``fit`` was given."""
    kind, width = docs.select(id_col).schema[0].dataType.simpleString(), len(model.log_p)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    facts = stored(rows.mapInArrow(gives_back(_score(model)), f"doc_id {kind}, row long, word string, n long, known long, base double, p array<double>"), "scores")
    far = facts.where("word IS NOT NULL").select("row", "word", "n").join(model.words.select("word", "c", F.col("p").alias("q")), "word")
    more = [F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("_known"), F.sum(F.col("n") * model.base(F.col("c"))).alias("_base")]
    looked = far.groupBy("row").agg(*more, F.array(*[F.sum(F.col("n") * F.col("q")[k]) for k in range(width)]).alias("_p"))
    joined = facts.where("word IS NULL").drop("word").join(looked, "row", "left")
    prior = np.log10((model.ends + 1) / (model.ends + 1).sum()) + np.log10(model.stop)
    each = F.array(*[F.col("p")[k] + F.coalesce(F.col("_p")[k], F.lit(0.0)) + F.lit(float(prior[k])) for k in range(width)])
    best = F.array_max("_each")
    total = best + F.log10(F.aggregate("_each", F.lit(0.0), lambda s, x: s + F.pow(F.lit(10.0), x - best)))
    return joined.withColumn("_each", each).select(
        "doc_id", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("_known", F.lit(0))).alias("n_known"), F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", F.lit(0.0))).alias("base_score"), total.alias("score"),
    )
