import random
import zlib
from itertools import combinations

import numpy as np
import pytest
from helpers import TEXTS, documents

from voxtide.llm import packing, sharding
from voxtide.llm.binpack import CapacityTree, best_fit_decreasing
from voxtide.llm.queries import tokenizer_path


def bins_of(plan):
    out = {}
    for size, lo, hi, first, each, base in zip(plan.size, plan.lo, plan.hi, plan.first, plan.each, plan.base, strict=True):
        for r in range(hi - lo):
            out.setdefault(first + r // each, []).append((base + r % each * size, size))
    return out


def check(plan, classes, capacity):
    got = bins_of(plan)
    assert len(got) == plan.bins
    for items in got.values():
        end = 0
        for offset, size in sorted(items):
            assert offset == end
            end += size
        assert end <= capacity
    counts = {}
    for items in got.values():
        for _, size in items:
            counts[size] = counts.get(size, 0) + 1
    assert counts == {s: n for s, n in classes.items() if n}


def least_bins(items, capacity):
    """By trying all fillings of the bin of the largest item."""
    if not items:
        return 0
    first, rest = items[-1], items[:-1]
    best = len(items)
    for k in range(len(rest) + 1):
        for idx in combinations(range(len(rest)), k):
            if first + sum(rest[i] for i in idx) <= capacity:
                best = min(best, 1 + least_bins([x for i, x in enumerate(rest) if i not in idx], capacity))
    return best


def test_tree_ceiling():
    tree, held, rng = CapacityTree(), [], random.Random(1)
    for i in range(500):
        tree.add(rem := rng.randint(0, 50), i, 1)
        held.append((rem, i))
        if i % 3 == 0:
            want = min((h for h in held if h[0] >= 25), default=None)
            got = tree.pop_tightest(25)
            assert (got and got[:2]) == want
            if want:
                held.remove(want)


@pytest.mark.parametrize("seed", range(30))
def test_plans(seed):
    rng = random.Random(seed)
    capacity = rng.choice([20, 100, 4096])
    classes = {rng.randint(1, capacity): rng.randint(1, 40) for _ in range(rng.randint(0, 60))}
    check(packing.plan_sequences(classes, capacity), classes, capacity)
    check(best_fit_decreasing(classes, capacity), classes, capacity)


@pytest.mark.parametrize("seed", range(60))
def test_dominance_keeps_a_best_packing(seed):
    """Fixed bins plus a best packing of the rest use no more bins than a best packing of all."""
    rng = random.Random(seed)
    items = sorted(rng.randint(2, 20) for _ in range(7))
    classes = {x: items.count(x) for x in items}
    plan, _, left = packing.reduce_dominated(classes, 20)
    rest = sorted(s for s, n in left.items() for _ in range(n))
    assert plan.bins + least_bins(rest, 20) == least_bins(items, 20)


def test_tokens_are_the_librarys():
    from tokenizers import Tokenizer

    own, library = packing.ChunkTokenizer(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    odd = ["a<|endoftext|>b it's We'LL 12.5 Ünïcödé,. ﬁ İ ΣΑΣ á b\x1cc d e​f\x85g\xadh", "Hello, world...!? foo.bar, (x). <|EndOfText|> ḰÅ µ ª ²", *[t or "" for t in TEXTS]]
    for text in odd:
        assert own.ids(text.encode()) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_pack(spark):
    docs = documents(spark)
    got = packing.pack(docs, tokenizer_path()).toPandas()
    assert got.groupby("sequence_id").length.sum().max() <= 4096
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    whole = got[got.doc_id == 8].sort_values("piece")
    assert len(whole) > 2 and (whole.length[:-1] == 4096).all() and list(whole.start) == [4096 * i for i in range(len(whole))]
    empty = got[got.doc_id == 4].iloc[0]
    assert (empty.length, empty.ids_crc32) == (1, zlib.crc32(np.array([1], "<u4").tobytes()))
    assert len(got) - len(whole) + 1 == len(TEXTS) + 3
    assert packing.pack(docs.limit(0), tokenizer_path()).count() == 0


def test_shards(spark):
    docs = documents(spark)
    got = sharding.shard(docs, 4).toPandas()
    assert len(got) == len(TEXTS) + 3
    assert (got.groupby("digest").shard.nunique() == 1).all()
    for _, rows in got.groupby("shard"):
        assert sorted(rows.slot) == list(range(len(rows)))
    by_id = got.drop_duplicates("doc_id").set_index("doc_id")
    assert by_id.loc[4, "size"] == 16 and by_id.loc[4, "text_crc32"] == 0
    assert by_id.loc[6, "size"] == len(TEXTS[6].encode()) + 16 and by_id.loc[6, "text_crc32"] == zlib.crc32(TEXTS[6].encode())
    assert sharding.shard(docs.limit(0), 4).count() == 0


def test_shards_are_near_equal_beside_a_giant(spark):
    rows = [(i, "giant" if i % 3 == 0 else f"text {i} " * (i % 40 + 1)) for i in range(6000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 10).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 10 and sizes.max() <= 1.01 * sizes.min()
    hot = sharding.shard(spark.createDataFrame([(i, "giant" * 50 if i % 2 else f"t{i}") for i in range(4000)], "doc_id long, text string"), 10).toPandas()
    sizes = sorted(hot.groupby("shard")["size"].sum())
    assert len(sizes) == 10 and sizes[-2] - sizes[0] <= 9 * 21  # each shard may fall short by less than a row


@pytest.mark.parametrize("seed", range(20))
def test_best_fit_is_that_of_single_items(seed):
    rng = random.Random(seed)
    capacity = rng.choice([30, 200, 4096])
    classes = {rng.randint(1, capacity): rng.randint(1, 30) for _ in range(rng.randint(1, 40))}
    rooms: list[int] = []
    for size in sorted(classes, reverse=True):
        for _ in range(classes[size]):
            fits = [i for i, room in enumerate(rooms) if room >= size]
            if fits:
                rooms[min(fits, key=lambda i: rooms[i])] -= size
            else:
                rooms.append(capacity - size)
    got = bins_of(best_fit_decreasing(classes, capacity))
    assert sorted(capacity - sum(s for _, s in x) for x in got.values()) == sorted(rooms)


def test_hot_rows_of_little_size(spark, monkeypatch):
    """A third of the rows are empty texts beside long ones: few bytes, many rows; they are joined by broadcast."""
    monkeypatch.setattr(sharding, "HEAVY", 16)
    rows = [(i, "" if i % 3 == 0 else f"{i} " * 2000) for i in range(900)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard(frame, 5).toPandas()
    assert len(got) == 900 and got[got["size"] == 16].shard.nunique() == 1
    assert all(sorted(x.slot) == list(range(len(x))) for _, x in got.groupby("shard"))
    assert got.groupby("shard")["size"].sum().max() <= 1.05 * got["size"].sum() / 5


def test_another_tokenizer_file_goes_through_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, mine = Tokenizer.from_file(path), packing.ChunkTokenizer(path)
    assert not mine.by_chunks and packing.ChunkTokenizer(public_tokenizers.path("word_bpe_49k.json")).by_chunks
    for text in ("Two  Words\n\nand more", "", "Straße 日本 ABC", " x"):
        assert np.frombuffer(mine.ids(text.encode()), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_what_a_worker_remembers_is_bounded_and_asked_once(monkeypatch):
    """Chunks of any kind, met again and again: at most two generations of pieces are held, and what stands in texts that are cut together is asked once."""
    monkeypatch.setattr(packing, "MEMO", 100)
    own, asked = packing.ChunkTokenizer(tokenizer_path()), []
    words = ["".join(random.Random(i).choices("abcdefgh", k=9)) for i in range(700)]
    for _ in range(3):
        own.ids(" ".join(words).encode())
    held = len(own) + sum(len(x) for x in vars(own).values() if isinstance(x, dict) and any(isinstance(y, bytes) for y in x.values()))
    assert held <= 200
    library = own._library
    monkeypatch.setattr(own, "_library", lambda text: asked.append(text) or library(text))
    long = "日本語" * 40
    assert own.ids(f"{long} a {long}\t{long}".encode()) == library(f"{long} a {long} {long}")
    assert len(asked) == 1


def test_texts_that_are_cut_together(spark, monkeypatch):
    """Where texts are cut from one another changes nothing: empty ones, blanks, several in a slice, odd chunks between others."""
    rng = random.Random(3)
    texts = ["", None, " \t", "x", *[" ".join(rng.choices(["one", "Two,", "3.14", "über", "日本", "<|endoftext|>", "it's", "", "\x1c", "end.\n"], k=rng.randint(0, 40))) for _ in range(300)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    library = packing.ChunkTokenizer(tokenizer_path()).library
    for together in (1, 700, 1 << 20):
        monkeypatch.setattr(packing, "TOGETHER", together)
        got = {r["doc_id"]: r["ids"] for r in packing.tokenize(docs, tokenizer_path(), with_ids=True).collect()}
        assert got == {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}


def test_an_idle_worker_holds_no_tokenizer(spark):
    """The tokenizer goes with its task: workers are used again by stages that need the memory."""

    def left(batches):
        import gc

        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": [sum(type(x).__name__ == "ChunkTokenizer" for x in gc.get_objects())]})

    packing.tokenize(documents(spark).repartition(8), tokenizer_path()).collect()
    assert {r["n"] for r in spark.range(1000).repartition(8).mapInArrow(left, "n long").collect()} == {0}


def test_less_text_together_remembers_fewer_pieces():
    half, whole = packing.ChunkTokenizer(tokenizer_path(), 50), packing.ChunkTokenizer(tokenizer_path())
    text = " ".join("ab" + chr(97 + i % 26) + chr(97 + i // 26) + " other" for i in range(300)).encode()  # digits would be pieces of their own
    assert half.ids(text) == whole.ids(text) and len(half) + len(half.old) <= 101 < len(whole)
