"""How the sources of a language differ in their terms: a triangular divergence of every pair, and each source's most telling terms.

Tokens are cut from concatenated UTF-8 buffers by a lookup table of bytes; slices are grouped by XXH64 with their bytes verified
(``slices.grouped``), counted per (language, source) in blocks, and summed by Spark. Terms in at least ``min_docs`` documents of a
language are kept. They are dealt over blocks by a hash; a block is a CSR matrix of sources by terms, and each row is held against
all others by one gather and one ``reduceat``. With smoothed shares p and q, in units of 1e-9, the divergence is the sum of
floor((p - q)^2 / (p + q)).

All arithmetic is exact: counts up to 9e15, shares by long division in three steps of a thousand, sums in 64 bits.

Scale: one task's tokens are summed before they are shuffled, first by (language, source, term), so that a term of every document or a
source with a third of all rows is no hot key; then by (language, term), at most one row a source. A language's terms are spread over as many
tasks as ``block_terms`` asks for. The result has one row for each pair of sources of a language; a block holds rows of sources by sources for one source at a time.

Defined cases: a null text, language or source is ''; a group without terms, and a language that keeps none, has its pairs (with 0, if none
is kept) and no terms; an empty table gives no rows; repeated rows count as often as they are there, each as a document of its own; long texts are
cut as a whole; ties are ranked by the item's UTF-8 bytes; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxtide.llm.common import discard, gives_back, stored
from voxtide.llm.slices import grouped, lookup, padded, runs, strings, summed, text_blocks

#: Bytes of a term: letters, and what is not ASCII.
TERM = lookup(range(0x00, 0x41), range(0x5B, 0x61), range(0x7B, 0x80))
UNIT = 1_000_000_000
MIN_DOCS, TOP = 10, 10
#: Terms of a block, on average.
BLOCK_TERMS = 8192

COUNTS = "lang string, source string, term string, n long, docs long"
PARTS = "lang string, source string, part string, item string, value long"


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> occurrences and documents of each (lang, source, term) of a block."""
    for batch in batches:
        pairs = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], ["lang", "source"])
        names: dict[tuple, int] = {}
        owner = np.array([names.setdefault((r["lang"], r["source"]), len(names)) for r in pairs.to_pylist()], np.int64)
        langs, sources = (pa.array([k[i] for k in names], pa.string()) for i in (0, 1))
        for block in text_blocks(batch.column(2)):
            starts, ends = runs(TERM[block.raw], block.bounds)
            raw = padded(block.raw)
            heads, group = grouped(raw, starts, ends)
            doc = np.searchsorted(block.bounds, starts, "right") - 1
            seen, n = summed(group * len(block) + doc, np.ones(len(group), np.int64))
            keys = seen // len(block) * len(names) + owner[block.first + seen % len(block)]
            keys, n, docs = summed(keys, n, np.ones(len(seen), np.int64))
            term, pair = heads[keys // len(names)], pa.array(keys % len(names))
            yield pa.RecordBatch.from_arrays([langs.take(pair), sources.take(pair), strings(raw, starts[term], ends[term]), pa.array(n), pa.array(docs)], names=["lang", "source", "term", "n", "docs"])


def share(count: np.ndarray, total: np.ndarray | int, kinds: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 2) / (total + 2 * kinds)), exact: three digits of the quotient at a time."""
    whole = np.asarray(total, np.int64) + 2 * kinds
    quotient, rest = np.divmod(np.asarray(count, np.int64) + 2, whole)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, whole)
        quotient = quotient * 1000 + digit
    return 1 + quotient


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _row_sums(values: np.ndarray, rows: np.ndarray, pointer: np.ndarray) -> np.ndarray:
    """The sum of each CSR row; ``rows``: those with entries."""
    out = np.zeros(len(pointer) - 1, np.int64)
    if len(rows):
        out[rows] = np.add.reduceat(values, pointer[rows])
    return out


def compare(top: int):
    """A function of one block of a language's terms (and its header row of all sources with their totals) that gives PARTS."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        head = pc.is_null(table["term"])
        header, terms = table.filter(head), table.filter(pc.invert(head))
        lang, kinds, all_n = header["lang"][0].as_py(), header["kinds"][0].as_py(), header["total"][0].as_py()
        names = header["sources"][0].values.field("source")
        totals = header["sources"][0].values.field("n").to_numpy()
        lists = terms["sources"].combine_chunks()
        entry = lists.flatten()
        column = np.repeat(np.arange(len(terms)), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
        row = pc.index_in(entry.field("source"), names).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(row, kind="stable")
        row, column, count = row[order], column[order], entry.field("n").to_numpy()[order]
        pointer = np.searchsorted(row, np.arange(len(names) + 1))
        filled = np.flatnonzero(np.diff(pointer))
        found = {"source": [], "part": [], "item": [], "value": []}

        def add(source: int, part: str, items: pa.Array, values: np.ndarray) -> None:
            found["source"].append(pa.array([names[source].as_py()] * len(items), pa.string()))
            found["part"].append(pa.array([part] * len(items), pa.string()))
            found["item"].append(items)
            found["value"].append(pa.array(values, pa.int64()))

        p = share(count, totals[row], kinds) if kinds else count
        none = share(np.zeros(len(names), np.int64), totals, kinds) if kinds else np.ones(len(names), np.int64)
        mean = share(terms["total"].to_numpy(), all_n, kinds) if kinds else np.zeros(0, np.int64)
        for i in range(len(names)):
            own, mine = column[pointer[i] : pointer[i + 1]], p[pointer[i] : pointer[i + 1]]
            dense = np.full(len(terms), none[i])
            dense[own] = mine
            here = dense[column]  # this source's share of the term of every entry of the matrix
            both = _row_sums(divergence(here, p), filled, pointer)
            shares, often = np.unique(dense, return_counts=True)
            alone = sum((divergence(s, none) * k for s, k in zip(shares, often, strict=True)), np.zeros(len(names), np.int64))  # as if the others had no entries
            value = alone - _row_sums(divergence(here, none[row]), filled, pointer) + both
            others = np.delete(np.arange(len(names)), i)
            add(i, "pair", names.take(pa.array(others)), value[others])
            more = np.flatnonzero(mine > mean[own])
            told = divergence(mine[more], mean[own[more]])
            if len(more) > top:
                more, told = (x[told >= np.partition(told, -top)[-top]] for x in (more, told))  # ties of the last are ranked later
            add(i, "term", terms["term"].combine_chunks().take(pa.array(own[more])), told)
        size = sum(map(len, found["item"]))
        return pa.table({"lang": pa.array([lang] * size, pa.string())} | {k: pa.chunked_array(v) if v else pa.array([], pa.int64() if k == "value" else pa.string()) for k, v in found.items()})

    return run


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank. Part ``pair``: every other source of the language; ``term``: the ``top`` terms that a source has more of than its language."""
    named = {"lang": lang_col, "source": source_col, "text": text_col}
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in named.items()])
    counts = rows.mapInArrow(gives_back(count_terms), COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    each = F.collect_list(F.struct("source", "n")).alias("sources")  # as many as the language has sources
    kept = stored(counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), each).where(F.col("docs") >= min_docs).drop("docs"), "terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("total").alias("total"))
    own = kept.select("lang", F.inline("sources")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = rows.select("lang", "source").distinct().join(own, ["lang", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    sized = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("sources")).join(langs, "lang", "left")
    sized = stored(sized.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("kinds", "total")}).withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("kinds") / block_terms)).cast("int")), "languages")
    headers = sized.select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("string").alias("term"), "total", "sources", "kinds")
    dealt = kept.join(sized.select("lang", "kinds", "blocks"), "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    blocks = headers.unionByName(dealt.select(*headers.columns)).groupBy("lang", "block")
    parts = stored(blocks.applyInArrow(compare(top), PARTS), "divergences")
    discard(kept, sized)
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), F.col("item").asc()))
    best = parts.where("part = 'term'").select(*pairs.columns).withColumn("rank", rank).where(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(best)
