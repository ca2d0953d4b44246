"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups (rows of equal text) are sorted by size and each enters the shard with the tightest
remaining capacity, found in a balanced tree. The capacity is the smallest for which the given
number of fixed-capacity shards suffices, so shard sizes come out near equal.

Scale: the packing is planned from the histogram of group sizes. Sizes up to 4096 are exact
classes, larger ones are rounded up to 13 significant bits, so at most 2**12 classes exist per power
of two (some 10**5 in all, whatever the number of groups) and a shard is overestimated by under 1/4096.
Groups find their place by their rank within their class. Only (digest, sizes) are shuffled,
never texts; groups holding over 1/HEAVY of all bytes or of all rows are joined by a broadcast of at most 2 * HEAVY
rows, so a copy group of a third of all rows does not meet in one task.

Defined cases: a null text is an empty one (size: the overhead alone, crc32 0) and grouped with it; a
group larger than a fair share gets a shard of its own; with fewer groups than shards some stay
empty; an empty table gives an empty result; repeated rows are separate rows of one group; a null doc_id is kept as such and
ranked first; a very long text counts with its whole size; equal sizes go by digest; columns other than the two named are not
read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtide.llm.binpack import PLAN_SCHEMA, Plan, best_fit_decreasing
from voxtide.llm.common import local_table, salted_rank, stored, unhex_sha256

#: Groups with more than 1/HEAVY of all bytes or of all rows are joined by broadcast (so at most twice HEAVY of them).
HEAVY = 4096
#: Significant bits of a size class.
BITS = 13


def plan_shards(classes: dict[int, int], shards: int) -> Plan:
    """The packing with (nearly) the least capacity that needs no more than ``shards`` bins."""
    left, giants = dict(classes), Plan()
    total, used = sum(s * n for s, n in classes.items()), {}
    while left and giants.bins < shards - 1 and (top := max(left)) * (shards - giants.bins) > total:
        used[top] = giants.put(top, used.get(top, 0), 1, giants.bins, 1, 0)
        giants.bins, total = giants.bins + 1, total - top
        left[top] -= 1
        if not left[top]:
            del left[top]
    if not left:
        return giants
    bins = shards - giants.bins

    def packed(capacity: int) -> Plan | None:
        return best_fit_decreasing(left, capacity, None, used, bins)

    low = max(max(left), -(-total // bins))
    step, best = max(1, low >> 14), packed(low)
    tight, high = low, low
    while best is None:  # widen, then bisect to the step
        tight, high = high, high + step
        step, best = 2 * step, packed(high)
    while high - tight > max(1, low >> 14):
        middle = (tight + high) // 2
        if (plan := packed(middle)) is None:
            tight = middle
        else:
            best, high = plan, middle
    for column in ("size", "lo", "hi", "each", "base"):
        getattr(giants, column).extend(getattr(best, column))
    giants.first.extend(x + giants.bins for x in best.first)
    giants.bins += best.bins
    return giants


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, digest (of the group), shard, slot (gapless from 0)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stored(
        docs.select(
            F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), unhex_sha256(text).alias("digest")
        ),
        "shard-rows",
    )
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    width = f"CAST(POWER(2, GREATEST(0, LENGTH(BIN(bytes)) - {BITS})) AS BIGINT)"
    groups = stored(groups.withColumn("class", F.expr(f"(bytes + {width} - 1) DIV {width} * {width}")), "shard-groups")
    counts = groups.groupBy("class").agg(F.count("*").alias("_rows"), F.sum("bytes").alias("_bytes"), F.sum("n").alias("_n"))
    histogram = counts.collect()  # bounded: one row per class
    plan = plan_shards({r["class"]: r["_rows"] for r in histogram}, shards)
    ranges = local_table(spark, PLAN_SCHEMA, **plan.columns())
    sizes = local_table(spark, "class long, _rows long", **{"class": [r["class"] for r in histogram], "_rows": [r["_rows"] for r in histogram]})
    ranked = salted_rank(groups, "class", ["digest"], "rank", sizes)
    placed = ranked.join(ranges, (F.col("class") == F.col("p_size")) & (F.col("rank") >= F.col("p_lo")) & (F.col("rank") < F.col("p_hi")))
    placed = stored(placed.select("digest", "bytes", "n", F.expr("CAST(p_first + (rank - p_lo) DIV p_each AS INT)").alias("shard")), "shard-plan")
    heavy = (F.col("bytes") * HEAVY > sum(r["_bytes"] for r in histogram)) | (F.col("n") * HEAVY > sum(r["_n"] for r in histogram))
    big = F.broadcast(placed.where(heavy).select("digest", "shard"))
    hot = rows.join(big, "digest")
    cold = rows.join(big.select("digest"), "digest", "left_anti").join(placed.where(~heavy).select("digest", "shard"), "digest")
    out = stored(hot.unionByName(cold), "shard-dealt")
    return salted_rank(out, "shard", ["doc_id", "digest"], "slot").select("doc_id", "size", "text_crc32", "digest", "shard", "slot")
