"""Collocations of two to five words, by language: phrases that occur more often than their parts explain.

Texts are cut into pieces at punctuation and line breaks. Identical pieces of a language become one with a multiplicity, so copies are
counted once and weighed. Phrases are counted level by level: a phrase of k words is only counted where both of its parts of k - 1 words
are frequent (all others can't be), which a Bloom filter of the frequent ones tells before anything is shuffled. A task groups the
phrases of its pieces (XXH64, bytes verified) and deals them by hash over buckets, as compressed Arrow blocks; one task counts a bucket
in DuckDB, within ``MEMORY`` and beyond it on disk. Parts of a phrase lie in other buckets: requests for their counts are
shuffled to them by joins, and the answers back to the phrase.

A phrase of frequency a, cut into parts of frequencies l and r among n words of its language, scores floor(1000 a n / (l r)); its
lowest-scoring cut counts. Products are decimals of 38 digits, so they are exact up to n of 9e15.

Scale: what is shuffled is each distinct piece once a task, and phrases behind the filter; a phrase that all texts share is one row a
block. No group is gathered: buckets are counted out of core, and of a language only the first ``top`` leave a task. DuckDB's spill is a scratch
folder of the task, deleted with it, as Spark's own spill; nothing is read from it by another task. The filter has at most 4 MB; beyond
some two million frequent phrases of a level it lets more through, which costs a larger shuffle and never a count.

Defined cases: a null text is empty, a null language ``und``; a piece without words is none; ties of cuts go to the smallest k, ties of rank to the
greater frequency, then to the phrase in UTF-8 order; repeated rows count as often as they are there; an empty table, or one without
frequent words, gives no rows; long texts, pieces and words are taken as a whole; other columns are not read, whatever their names.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxtide.llm.common import discard, filter_words, gives_back, stored
from voxtide.llm.slices import Block, grouped, lookup, padded, runs, strings, summed, text_blocks, xxh64

LEAST, TOP, WORDS = 100, 2000, 5
UNKNOWN = "und"
#: Bytes that end a piece, and those that part words within one.
STOPS, BLANKS = [*b".,;:!?", *range(0x0A, 0x0E)], [0x20, 0x09]
IN_PIECE, IN_WORD = lookup(*STOPS), lookup(*STOPS, *BLANKS)
#: What DuckDB may hold of a bucket in memory, and the bytes of phrases that a task gathers before it deals them out.
MEMORY, GATHERED = "192MB", 1 << 23
#: Bytes of pieces that are cut into phrases together.
TOGETHER = 1 << 20
#: Exact: of 36 and 38 digits.
SCORE = "(1000BD * CAST(a AS DECIMAL(16,0)) * CAST(n AS DECIMAL(16,0))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))"
COUNTED = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("m", pa.int64())])


def cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> lang, piece (its words, one space apart), m: the distinct pieces of a block and how often they occur."""
    for batch in batches:
        names: dict[str, int] = {}
        lang = np.array([names.setdefault(x, len(names)) for x in batch.column(0).to_pylist()], np.int64)
        langs = pa.array(list(names), pa.string())
        for block in text_blocks(batch.column(1)):
            raw, starts, ends, doc = _pieces(block)
            heads, group = grouped(raw, starts, ends)
            key, m = summed(group * len(names) + lang[block.first + doc], np.ones(len(group), np.int64))
            piece = heads[key // len(names)]
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(key % len(names))), strings(raw, starts[piece], ends[piece]), pa.array(m)], names=["lang", "piece", "m"])


def _pieces(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(raw, starts, ends, document) of a block's pieces; of the blanks between two words only one is left, as a space."""
    word = IN_WORD[block.raw]
    begin, stop = runs(word, block.bounds)
    piece_starts, _ = runs(IN_PIECE[block.raw], block.bounds)
    piece = np.searchsorted(piece_starts, begin, "right") - 1  # of each word
    keep = word.copy()
    same = np.flatnonzero(piece[1:] == piece[:-1])
    keep[stop[same]] = True  # the first blank after a word that has a next one
    raw = padded(np.where(word, block.raw, np.uint8(0x20))[keep])
    place = np.concatenate([[0], np.cumsum(keep)])
    first = np.flatnonzero(np.diff(piece, prepend=-1))
    last = np.append(first[1:], len(piece)) - 1 if len(first) else first
    starts, ends = place[begin[first]], place[stop[last] - 1] + 1 if len(first) else first
    return raw, starts, ends, np.searchsorted(block.bounds, begin[first], "right") - 1


def lang_seeds(names: list[str]) -> np.ndarray:
    """What Spark's ``xxhash64(lang, gram)`` hashes the gram with."""
    bounds = np.cumsum([0, *(len(x.encode()) for x in names)])
    return xxh64(padded(np.frombuffer("".join(names).encode(), np.uint8)), bounds[:-1], bounds[1:])


class Gathered:
    """Weighted slices of several blocks, by language, summed whenever they pass ``GATHERED`` bytes, and dealt over hash buckets."""

    def __init__(self, buckets: int) -> None:
        self.buckets, self.size, self.parts = buckets, 0, []

    def add(self, lang: pa.Array, gram: pa.Array, m: pa.Array) -> None:
        self.parts.append(pa.record_batch([lang, gram, m], schema=COUNTED))
        self.size += self.parts[-1].nbytes

    def dealt(self) -> Iterator[pa.RecordBatch]:
        """bucket, block: what was gathered, sorted within a bucket so that it compresses well."""
        if not self.parts:
            return
        table = pa.Table.from_batches(self.parts).group_by(["lang", "gram"]).aggregate([("m", "sum")]).rename_columns(COUNTED.names)
        self.parts, self.size = [], 0
        names = table["gram"].combine_chunks().cast(pa.large_string())
        bounds, data = np.frombuffer(names.buffers()[1], np.int64)[: len(names) + 1], names.buffers()[2]
        raw = padded(np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))
        bucket = (xxh64(raw, bounds[:-1], bounds[1:]) % np.uint64(self.buckets)).astype(np.int32)
        table = table.append_column("bucket", pa.array(bucket)).sort_by([("bucket", "ascending"), ("lang", "ascending"), ("gram", "ascending")])
        bucket = table["bucket"].to_numpy()
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
        blocks = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, COUNTED, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(table.select(COUNTED.names).slice(a, b - a).combine_chunks())
            blocks.append(out.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), pa.array(blocks, pa.binary())], names=["bucket", "block"])


def _frequent(seen: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether a filter of ``filter_words`` holds a hash; never false for one that was put in."""
    signed = hashes.view(np.int64)
    one = np.int64(1)
    bits = np.left_shift(one, (hashes >> np.uint64(40) & np.uint64(63)).astype(np.int64)) | np.left_shift(one, (hashes >> np.uint64(48) & np.uint64(63)).astype(np.int64))
    return seen[np.mod(signed, len(seen))] & bits == bits


def joined(batches: Iterator[pa.RecordBatch], size: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least ``size`` bytes but for the last: pieces are short, and a batch of few of them costs more in calls than in work."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n >= size:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def phrase_blocks(k: int, seen: np.ndarray | None, buckets: int):
    """Over (lang, piece, m): phrases of ``k`` words whose two parts of k - 1 are ``seen``, dealt over buckets. For single words also '', the number of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = Gathered(buckets)
        for batch in joined(batches):
            encoded = batch.column(0).dictionary_encode()
            lang, names = encoded.indices.to_numpy().astype(np.int64), encoded.dictionary.to_pylist()
            langs, seeds, many = encoded.dictionary, lang_seeds(names), batch.column(2).to_numpy()
            for block in text_blocks(batch.column(1)):
                starts, ends = runs(IN_WORD[block.raw], block.bounds)
                raw = padded(block.raw)
                piece = np.repeat(np.arange(len(block)), np.diff(np.searchsorted(starts, block.bounds)))
                of = lang[block.first + piece]
                if k == 1:
                    begin, stop = starts, ends
                    total = np.bincount(of, many[block.first + piece], len(names)).astype(np.int64)
                    gathered.add(langs, pa.array([""] * len(names), pa.string()), pa.array(total))
                else:
                    head = np.flatnonzero(piece[: len(piece) - k + 2] == piece[k - 2 :]) if k > 2 else np.arange(len(piece))
                    good = np.zeros(len(piece) + 1, bool)  # a frequent part begins here
                    good[head] = _frequent(seen, xxh64(raw, starts[head], ends[head + k - 2], seeds[of[head]]))
                    head = np.flatnonzero(good[:-1] & good[1:])
                    head = head[head + k - 1 < len(piece)]
                    head = head[piece[head] == piece[head + k - 1]]
                    begin, stop, piece, of = starts[head], ends[head + k - 1], piece[head], of[head]
                heads, group = grouped(raw, begin, stop)
                key, m = summed(group * len(names) + of, many[block.first + piece])
                at = heads[key // len(names)]
                gathered.add(langs.take(pa.array(key % len(names))), strings(raw, begin[at], stop[at]), pa.array(m))
                if gathered.size > GATHERED:
                    yield from gathered.dealt()
        yield from gathered.dealt()

    return run


def count_bucket(least: int):
    """Over (bucket, block): lang, gram, f of the bucket's phrases that occur at least ``least`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        def blocks() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in batch.column(1):
                    yield from pa.ipc.open_stream(block.as_buffer())

        with tempfile.TemporaryDirectory(prefix="phrases-") as scratch:
            con = duckdb.connect(config={"memory_limit": MEMORY, "threads": 1, "temp_directory": os.path.join(scratch, "spill"), "preserve_insertion_order": False})
            try:
                con.execute("CREATE TEMP TABLE counted (lang VARCHAR, gram VARCHAR, m BIGINT)")
                held, size = [], 0

                def put() -> None:
                    part = pa.Table.from_batches(held, COUNTED)  # noqa: F841  DuckDB finds it by its name
                    con.execute("INSERT INTO counted SELECT * FROM part")
                    held.clear()

                for block in blocks():
                    held.append(block)
                    size += block.nbytes
                    if size > GATHERED:
                        put()
                        size = 0
                put()
                found = con.sql(f"SELECT lang, gram, CAST(sum(m) AS BIGINT) AS f FROM counted GROUP BY lang, gram HAVING sum(m) >= {least}")
                for batch in found.to_arrow_reader(1 << 14):
                    yield batch.cast(pa.schema([("lang", pa.string()), ("gram", pa.string()), ("f", pa.int64())]))
            finally:
                con.close()

    return run


def frequent(pieces: DataFrame, words: int = WORDS, least: int = LEAST) -> list[DataFrame]:
    """lang, gram, f of the phrases of 1, 2, ... ``words`` words that occur at least ``least`` times; the first also has each language's number of words, as ''."""
    spark, levels, seen = pieces.sparkSession, [], None
    buckets = 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    for k in range(1, words + 1):
        dealt = pieces.mapInArrow(gives_back(phrase_blocks(k, seen, buckets)), "bucket int, block binary").repartition("bucket")
        levels.append(stored(dealt.mapInArrow(gives_back(count_bucket(least)), "lang string, gram string, f long"), f"phrases-{k}"))
        known = levels[-1].where("gram != ''").select("lang", "gram")
        if k < words:
            seen = filter_words(known)
            if not seen.any():
                break
    return levels


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", words: int = WORDS, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases by score."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    once = rows.mapInArrow(gives_back(cut_pieces), "lang string, piece string, m long").groupBy("lang", "piece").agg(F.sum("m").alias("m"))
    pieces = stored(once, "pieces", "zstd")
    levels = frequent(pieces, words, least)
    discard(pieces)
    counts = levels[0]
    for level in levels[1:]:
        counts = counts.unionByName(level)
    counts = stored(counts, "phrases")
    discard(*levels)
    total = counts.where("gram = ''").select("lang", F.col("f").alias("n"))
    split = counts.where("gram != ''").withColumn("words", F.split("gram", " "))
    longer = split.where(F.size("words") > 1).select("lang", F.col("gram").alias("phrase"), F.col("f").alias("a"), "words")

    # phrases inside a longer one that is as frequent
    place = F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("size")
    inner = longer.where(F.size("words") > 2).select("lang", "a", "words", place)
    inner = inner.select("lang", "a", "words", "size", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)).alias("at"))
    inner = inner.groupBy("lang", F.array_join(F.slice("words", F.col("at"), F.col("size")), " ").alias("phrase")).agg(F.max("a").alias("within"))
    kept = longer.join(inner, ["lang", "phrase"], "left").where(F.col("within").isNull() | (F.lit(100).cast("decimal(20,0)") * F.col("within") < F.lit(100).cast("decimal(20,0)") * F.col("a")))

    # requests for the counts of both parts of each cut
    cuts = kept.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    left, right = F.array_join(F.slice("words", F.lit(1), F.col("k")), " "), F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " ")
    cuts = cuts.select("lang", "phrase", "a", "k", left.alias("left"), right.alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("gram").alias(side), F.col("f").alias(name)), ["lang", side])
    cuts = cuts.join(total, "lang").withColumn("score", F.expr(SCORE))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x")).select("lang", "phrase", "x.*")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()))
    return best.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
