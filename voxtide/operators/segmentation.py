"""Words of Chinese text by the cheapest path through a lattice of all dictionary words and single letters.

A run of letters is a lattice: an edge for each place where a word of the dictionary stands, and one for each letter. A word costs
``round(1000 * ln(total / uses))``; the cheapest path is found by dynamic programming, and letters that it takes one by one, next to each
other, are one unknown word. Uses are learned from the titles: first every edge counts, then rounds of expectation (forward and
backward over a run's paths) count an edge by the share of the paths' weight that takes it.

Runs are taken once each, with the number of titles that have them; a pass gives the driver one number a word of the dictionary and letter
of the alphabet. The dictionary is a hand-kept list, and goes to all tasks.

Defined cases: a null or empty title has no words; letters that no title had when costs were learned cost as much as half a use; of
equally cheap paths the one whose words come first in code point order is taken; repeated rows are cut alike; an empty table learns nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtide.functions.text import NOT_WORD

CHINESE = "[一-龥]"


@dataclass(frozen=True)
class Costs:
    """Costs of words and letters; ``unseen`` is a letter's that has none."""

    words: dict[str, int]
    unseen: int
    lengths: tuple[int, ...]

    def edges(self, run: str, end: int) -> Iterator[tuple[int, str, int]]:
        """(from, word, cost) of the edges into a place."""
        for n in self.lengths:
            if n <= end:
                word = run[end - n : end]
                cost = self.words.get(word, self.unseen if n == 1 else None)
                if cost is not None:
                    yield end - n, word, cost


def dictionary(words: Sequence[str]) -> list[str]:
    """Upper-case words of two letters or more, at least one of them Chinese."""
    return sorted({w.upper() for w in words if re.fullmatch(r"[0-9A-Za-z一-龥]{2,}", w) and re.search(CHINESE, w)})


def cheapest(run: str, costs: Costs) -> tuple[int, list[str]]:
    """The cost of the cheapest path and its words, letters next to each other as one."""
    best: list[tuple[int, str, bool]] = [(0, "", False)]
    for end in range(1, len(run) + 1):
        ways = []
        for begin, word, cost in costs.edges(run, end):
            before, path, letter = best[begin]
            single = len(word) == 1
            ways.append((before + cost, path + ("" if single and letter else " ") + word, single))
        best.append(min(ways))
    return best[-1][0], best[-1][1].split()


def expected(run: str, costs: Costs, uses: Counter, weight: float) -> None:
    """Add to ``uses`` what each edge of a run's lattice is expected to be used, by the paths' weights exp(-cost / 1000)."""
    n = len(run)
    alpha, into = [0.0] + [-math.inf] * n, [[] for _ in range(n + 1)]
    for end in range(1, n + 1):
        into[end] = [(begin, word, -cost / 1000) for begin, word, cost in costs.edges(run, end)]
        ways = [alpha[b] + x for b, _, x in into[end]]
        top = max(ways)
        alpha[end] = top + math.log(sum(math.exp(w - top) for w in ways))
    share = [0.0] * n + [1.0]  # of the paths' weight that passes a place
    for end in range(n, 0, -1):
        for begin, word, x in into[end]:
            taken = share[end] * math.exp(alpha[begin] + x - alpha[end])
            share[begin] += taken
            uses[word] += weight * taken


def runs(titles: DataFrame, id_col: str = "id", title_col: str = "title") -> DataFrame:
    """id, pos, run: runs of Chinese letters (other signs between them don't count) and other words of a title, upper-case."""
    flat = F.regexp_replace(F.upper(F.col(title_col)), f"(?<={CHINESE}){NOT_WORD}+(?={CHINESE})", "")
    return titles.select(F.col(id_col).alias("id"), F.posexplode(F.regexp_extract_all(flat, F.lit(f"[0-9A-Z]+|{CHINESE}+"), F.lit(0))).alias("pos", "run"))


def learn(titles: DataFrame, words: Sequence[str], rounds: int = 2, id_col: str = "id", title_col: str = "title") -> Costs:
    """Costs from the titles: of each edge in any lattice, and then ``rounds`` rounds of expectation."""
    own = dictionary(words)
    lengths = tuple(sorted({1, *map(len, own)}))
    met = runs(titles, id_col, title_col).where(F.col("run").rlike(CHINESE)).groupBy("run").agg(F.count("*").alias("n"))
    costs = Costs({w: 0 for w in own}, 0, lengths)
    for i in range(rounds + 1):

        def count(frames: Iterator[pd.DataFrame], costs: Costs = costs, first: bool = i == 0) -> Iterator[pd.DataFrame]:
            uses: Counter = Counter()
            for frame in frames:
                for run, n in zip(frame["run"], frame["n"], strict=True):
                    if first:
                        for end in range(1, len(run) + 1):
                            for _, word, _ in costs.edges(run, end):
                                uses[word] += n
                    else:
                        expected(run, costs, uses, n)
            yield pd.DataFrame({"word": list(uses), "uses": [float(x) for x in uses.values()]})

        found = {r["word"]: r["uses"] for r in met.mapInPandas(count, "word string, uses double").groupBy("word").agg(F.sum("uses").alias("uses")).collect()}
        total = sum(found.values())
        if not total:
            break
        costs = Costs({w: round(1000 * math.log(total / n)) for w, n in found.items() if n > 1e-9}, round(1000 * math.log(total / 0.5)), lengths)
    return costs


def tokens(titles: DataFrame, costs: Costs, stopwords: Column | None = None, most: int = 10, id_col: str = "id", title_col: str = "title") -> DataFrame:
    """id, tokens: the first ``most`` words of more than one letter, without stopwords; each distinct run is cut once."""
    parts = runs(titles, id_col, title_col)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"cut": frame["cut"], "words": [cheapest(run, costs)[1] for run in frame["cut"]]})

    whole = parts.where(F.col("run").rlike(CHINESE)).select(F.col("run").alias("cut")).distinct().mapInPandas(cut, "cut string, words array<string>")
    found = parts.join(whole, F.col("run") == F.col("cut"), "left").select("id", "pos", F.coalesce("words", F.array("run")).alias("words"))
    listed = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "words"))).alias("all"))  # of one title
    kept = F.filter(F.flatten(F.col("all.words")), lambda w: F.length(w) > 1)
    kept = F.filter(kept, lambda w: ~F.array_contains(stopwords, w)) if stopwords is not None else kept
    return titles.select(F.col(id_col).alias("id")).distinct().join(listed.select("id", F.slice(kept, 1, most).alias("tokens")), "id", "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))
