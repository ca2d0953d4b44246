"""Packing documents into fixed-length training sequences: dominance reduction, then best fit.

1. ``tokenize`` turns every whole text into ids of a public tokenizer plus an end id, cut into
   pieces of at most ``capacity`` tokens.
2. The instance is the histogram of piece lengths (at most ``capacity`` rows, whatever the corpus).
   ``reduce_dominated`` fixes the sets that Martello and Toth's criterion proves to be in some best
   packing: a set of at most three pieces that dominates every other set holding the same piece.
3. Best-fit-decreasing packs what remains; pieces find their place by their rank within their length.

Scale: no text is shuffled; ranks are salted, so that one length shared by a third of all pieces is
spread; the driver sees one row per length.

Defined cases: a null text is empty and gives one piece holding the end id alone; an empty table
gives an empty result; repeated rows are packed as separate documents; a null doc_id is kept as such; a very long text is cut into
pieces and nothing of it is left out; pieces of equal length go by doc_id, number and checksum; columns other than the two named are
not read, whatever their names.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtide.llm.binpack import PLAN_SCHEMA, Plan, best_fit_decreasing
from voxtide.llm.common import give_back, gives_back, local_table, salted_rank, stored

#: Distinct pieces that a worker remembers the ids of (some 230 bytes each), in each of two generations.
MEMO = 100_000
#: Longest piece that is remembered, and bytes of text that are cut together; a longer text is cut alone.
SHORT, TOGETHER = 64, 2 << 20


class ChunkTokenizer(dict):
    """Ids of whole texts by their distinct white-space-separated chunks: piece -> little-endian 32-bit ids.

    Right for tokenizers whose white space is a boundary that no token crosses and that yields no
    id. A chunk of printable Latin-1 characters is normalised by lower-casing alone, so that its
    pre-tokens go to the library's model directly; any other chunk goes through the whole library. That holds for files whose
    normalizer, pre-tokenizer and kind of model are those below, which is checked at load; texts for any other file go through the library as they are.
    """

    #: The pre-tokenizer's pattern, and the code points that byte-level models write as themselves.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    SELF = (*range(33, 127), *range(161, 173), *range(174, 256))
    #: The steps before the model, as the file states them.
    NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
    SPLIT = {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}
    BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    #: What keeps a chunk from the short way: a character that isn't printable Latin-1, or the mark of a special token.
    ODD = re.compile(r"[^\x20-\x7e\xa1-\xac\xae-\xff]|<\|")
    #: Stands behind each chunk among its ids; no id is as large.
    MARK = b"\xff\xff\xff\xff"

    def __init__(self, path: str, memo: int | None = None) -> None:
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.memo = memo or MEMO
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.by_chunks = by_chunks(path)
        self.split = regex.compile(self.PATTERN + "| ").findall
        others = [b for b in range(256) if b not in self.SELF]
        self.letters = {b: chr(b) for b in self.SELF} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.old: dict[str, bytes] = {}  # the generation before: what is met again moves over
        self[" "] = self.MARK

    def _library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.memo:
            self.old = dict(self)
            self.clear()
            self[" "] = self.MARK
        if (ids := self.old.get(piece)) is None:
            if self.ODD.search(piece):
                ids = self._library(piece)
            else:
                word = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
                ids = struct.pack(f"<{len(t := self.model.tokenize(word))}I", *[x.id for x in t])
        if len(piece) <= SHORT:
            self[piece] = ids
        return ids

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct chunks, and where each chunk's begin and end among them."""
        whole = pa.ListArray.from_arrays(pa.array([0, len(chunks)], pa.int32()), chunks)
        text = pc.binary_join(whole, pa.scalar(" ", chunks.type))[0].as_buffer().to_pybytes().decode("utf-8", "replace")
        lone: dict[int, bytes] = {}
        if self.ODD.search(text):
            parts = text.split(" ")
            lone = {i: self[x] for i, x in enumerate(parts) if self.ODD.search(x)}
            for i in lone:
                parts[i] = ""
            text = " ".join(parts)
        found = b"".join(map(self.__getitem__, self.split(f"{text} ".lower())))
        ids = np.frombuffer(b"".join([found, *lone.values()]), "<u4")
        ends = np.flatnonzero(ids[: len(found) // 4] == 0xFFFFFFFF)
        begins = np.concatenate([[0], ends[:-1] + 1])
        if lone:
            at = np.fromiter(lone, np.int64)
            ends[at] = len(found) // 4 + np.cumsum([len(x) // 4 for x in lone.values()])
            begins[at] = ends[at] - [len(x) // 4 for x in lone.values()]
        return ids, begins, ends

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (strings, none null) one after the other, and where each text's begin, with their end."""
        if not self.by_chunks:
            each = [self._library(x.decode("utf-8", "replace")) for x in texts.view(pa.binary()).to_pylist()]
            return np.frombuffer(b"".join(each), "<u4"), np.cumsum([0, *[len(x) // 4 for x in each]])
        parts = pc.ascii_split_whitespace(texts)
        coded = parts.flatten().dictionary_encode()
        if not len(coded):
            return np.zeros(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        ids, begins, ends = self._chunks(coded.dictionary)
        which = coded.indices.to_numpy()
        sizes = (ends - begins)[which]
        until = np.cumsum(sizes)
        at = np.repeat(begins[which] - (until - sizes), sizes)
        at += np.arange(len(at))
        offsets = parts.offsets.to_numpy()
        return ids[at], np.concatenate([[0], until])[offsets - offsets[0]]

    def ids(self, text: bytes) -> bytes:
        return self.flat(pa.array([text], pa.binary()).view(pa.string()))[0].tobytes()


@functools.cache
def by_chunks(path: str) -> bool:
    """Whether a tokenizer file states the steps that a ``ChunkTokenizer`` takes; read once a worker."""
    with open(path, encoding="utf-8") as file:
        stated = json.load(file)
    before = {"type": "Sequence", "pretokenizers": [ChunkTokenizer.SPLIT, ChunkTokenizer.BYTES]}
    return (stated["normalizer"], stated["pre_tokenizer"], stated["model"]["type"]) == (ChunkTokenizer.NORMALIZER, before, "BPE")


def tokenize(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1, with_ids: bool = False, together: int | None = None) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32 [, ids]. ``path``: the tokenizer's file, on every machine; ``together``: less than ``TOGETHER`` takes less memory, of remembered pieces too, and more time."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        encoder = ChunkTokenizer(path, together and max(1, MEMO * together // TOGETHER))  # for one task: some 50 MB that an idle worker would keep
        for whole in batches:
            texts = pc.fill_null(whole.column(1), "")
            ends = np.cumsum(pc.binary_length(texts).to_numpy()) // (together or TOGETHER)
            cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), whole.num_rows] if whole.num_rows else []
            for at, until in itertools.pairwise(cuts):
                ids, begins = encoder.flat(texts.slice(at, until - at))
                ids = np.insert(ids, begins[1:], end_id)
                begins = (begins + np.arange(len(begins))).tolist()
                rows: list[list] = [[] for _ in schema]
                for doc, (begin, end) in zip(whole.column(0).slice(at, until - at).to_pylist(), itertools.pairwise(begins), strict=True):
                    for piece, start in enumerate(range(0, end - begin, capacity)):
                        own = ids[begin + start : min(begin + start + capacity, end)]
                        values = [doc, piece, start, len(own), zlib.crc32(own)] + [own.astype("i8")] * with_ids
                        for column, value in zip(rows, values, strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, schema, strict=True)], schema=schema)
            if together:
                give_back()

    out = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(gives_back(pieces), out)


def reduce_dominated(classes: dict[int, int], capacity: int) -> tuple[Plan, dict[int, int], dict[int, int]]:
    """Fix every bin that the dominance criterion settles, over and over until it settles none.

    For a piece j, let x be the largest other piece that fits beside it. {j} dominates if nothing
    fits; {j, x} if it fills the bin, or no two pieces fit beside j, or no three do and x is at least
    as large as the best two; {j, a, b} if no three fit, a = x and no pair from between a and b fits.
    Returns the fixed bins, the ranks used of each size, and the classes left.
    """
    left = {s: n for s, n in classes.items() if n}
    sizes = sorted(left)
    plan, used = Plan(), {}

    def take(kinds: tuple[int, ...], bins: int) -> None:
        base = 0
        for size in kinds:
            used[size] = plan.put(size, used.get(size, 0), bins, plan.bins, 1, base)
            base += size
            left[size] -= bins
            if not left[size]:
                del left[size]
                sizes.pop(bisect.bisect_left(sizes, size))
        plan.bins += bins

    def smallest(without: int) -> list[int]:
        """Up to three smallest pieces other than one of size ``without``."""
        out: list[int] = []
        for s in sizes[:4]:
            out += [s] * min(3, left[s] - (s == without))
        return out[:3]

    def best_pair(room: int, without: int) -> tuple[int, int] | None:
        low, high, best = 0, bisect.bisect_right(sizes, room) - 1, None
        while low <= high:
            a, b = sizes[high], sizes[low]
            enough = left[a] - (a == without) >= 1 and left[b] - (b == without) >= 1 if a != b else left[a] - (a == without) >= 2
            if a + b > room:
                high -= 1
                continue
            if enough and (best is None or a + b > sum(best)):
                best = (a, b)
            low += 1
        return best

    changed = True
    while changed:
        changed = False
        for size in sorted(left, reverse=True):
            while left.get(size):
                few, room = smallest(size), capacity - size
                if not few or few[0] > room:
                    take((size,), 1 if size in few[:1] else left[size])
                    changed = True
                    continue
                at = bisect.bisect_right(sizes, room) - 1
                while sizes[at] == size and left[size] == 1:
                    at -= 1
                partner = sizes[at]
                most = left[size] // 2 if partner == size else min(left[size], left[partner])
                one_more = len(few) < 2 or few[0] + few[1] > room
                two_more = len(few) < 3 or sum(few) > room
                #: While pieces above the three smallest are used up, what was proven stays proven.
                safe = most if partner > few[-1] and size > few[-1] else 1
                if size + partner == capacity:
                    take((size, partner) if partner != size else (size, size), most)
                elif one_more:
                    take((size, partner), safe)
                elif two_more and (pair := best_pair(room, size)):
                    a, b = pair
                    between = sizes[bisect.bisect_right(sizes, b) : bisect.bisect_left(sizes, a)]
                    if partner >= a + b:
                        take((size, partner), safe)
                    elif partner == a and len({size, a, b}) == 3 and (not between or (sum(left[x] for x in between) <= 1) or 2 * between[0] > room):
                        take((size, a, b), 1)
                    else:
                        break
                else:
                    break
                changed = True
    return plan, used, left


def plan_sequences(classes: dict[int, int], capacity: int) -> Plan:
    plan, used, left = reduce_dominated(classes, capacity)
    return best_fit_decreasing(left, capacity, plan, used)


def place(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with sequence_id and offset, gapless from 0 in each sequence."""
    spark = pieces.sparkSession
    histogram = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``capacity`` rows
    plan = plan_sequences({r["length"]: r["n"] for r in histogram}, capacity)
    ranges = local_table(spark, PLAN_SCHEMA, **plan.columns())
    sizes = local_table(spark, "length long, _rows long", length=[r["length"] for r in histogram], _rows=[r["n"] for r in histogram])
    ranked = salted_rank(pieces, "length", ["doc_id", "piece", "ids_crc32"], "_rank", sizes)
    rank = (F.col("length") == F.col("p_size")) & (F.col("_rank") >= F.col("p_lo")) & (F.col("_rank") < F.col("p_hi"))
    nth = F.col("_rank") - F.col("p_lo")
    return ranked.join(ranges, rank).select(
        *pieces.columns, (F.col("p_first") + F.expr("(_rank - p_lo) DIV p_each")).alias("sequence_id"), (F.col("p_base") + nth % F.col("p_each") * F.col("length")).alias("offset")
    )


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1, together: int | None = None) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return place(stored(tokenize(docs, path, id_col, text_col, capacity, end_id, together=together), "pieces"), capacity)
