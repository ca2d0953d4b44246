"""All keyword rules in one pass over a title: an Aho-Corasick automaton finds every word of every rule, overlapping ones too.

Rules are tests on the words found: a group of words is met when as many of its distinct words were found as it has, which only touches
the groups of found words. So a title costs its length and its hits, however many rules there are. The automaton is built once a worker
from the rules, which are data of a checked size (they travel with the task).

Defined cases: a null title meets no rule (every column is null); an empty word is in every title, a group without words is always met; a word in several rules is found once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a title is dropped for.
KINDS = ("prefix", "any", "all", "within", "include")


class Automaton:
    """Rules compiled to words, and to the groups that a word counts for."""

    def __init__(self, prefixes: Sequence = (), any_of: Sequence = (), all_of: Sequence = (), all_within: Sequence = (), include_exclude: Sequence = ()) -> None:
        import ahocorasick

        self.number: dict[str, int] = {}
        self.groups: list[tuple[str, int, int | None, frozenset[int]]] = []  # kind, words needed, greatest length, words that forbid it
        self.of_word: dict[int, list[int]] = {}
        self.prefix: dict[int, int] = {}  # word -> greatest length of the title
        self.free: list[int] = []  # groups that need no word
        for word, most in prefixes:
            n = self._word(word)
            self.prefix[n] = max(most, self.prefix.get(n, most))
        for word in any_of:
            self._group("any", [word])
        for words in all_of:
            self._group("all", words)
        for words, most in all_within:
            self._group("within", words, most)
        for yes, no in include_exclude:
            self._group("include", yes, None, no)
        self.machine = ahocorasick.Automaton()
        for word, n in self.number.items():
            if word:
                self.machine.add_word(word, (n, len(word)))
        self.always = {self.number[""]} if "" in self.number else set()
        self.some = len(self.machine) > 0
        if self.some:
            self.machine.make_automaton()

    def _word(self, word: str) -> int:
        return self.number.setdefault(word, len(self.number))

    def _group(self, kind: str, words: Sequence[str], most: int | None = None, no: Sequence[str] = ()) -> None:
        numbers = {self._word(w) for w in words}
        self.groups.append((kind, len(numbers), most, frozenset(self._word(w) for w in no)))
        for n in numbers:
            self.of_word.setdefault(n, []).append(len(self.groups) - 1)
        if not numbers:
            self.free.append(len(self.groups) - 1)

    def met(self, title: str) -> set[str]:
        """The kinds of rules that a title meets."""
        found, begins = set(self.always), set(self.always)
        if self.some:
            for end, (n, size) in self.machine.iter(title):
                found.add(n)
                if end + 1 == size:
                    begins.add(n)
        out = {"prefix"} if any(len(title) <= self.prefix[n] for n in begins if n in self.prefix) else set()
        need: dict[int, int] = {}
        for n in found:
            for g in self.of_word.get(n, ()):
                need[g] = need.get(g, 0) + 1
        for g in [*(g for g, k in need.items() if k == self.groups[g][1]), *self.free]:
            kind, _, most, no = self.groups[g]
            if (most is None or len(title) <= most) and not no & found:
                out.add(kind)
        return out


def tested(df: DataFrame, rules, title: str = "title") -> DataFrame:
    """``df`` with ``drops``: an array of the kinds of ``rules`` (fields as ``stages.Rules``) that its title meets."""
    parts = (rules.prefixes, rules.any_of, rules.all_of, rules.all_within, rules.include_exclude)

    @F.pandas_udf("array<string>")
    def drops(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = Automaton(*parts)
        for frame in frames:
            yield frame.map(lambda t: None if t is None else sorted(automaton.met(t)))

    return df.withColumn("drops", drops(F.col(title)))


def meets(kind: str) -> Column:
    return F.array_contains("drops", kind)
