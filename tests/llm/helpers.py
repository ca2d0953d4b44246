"""Small tables with the cases that every operator must take: nulls, empty and long texts, ties, repeated rows, more columns."""

from __future__ import annotations

import re

LONG = " ".join(f"word{i % 977} filler" for i in range(30_000))
TEXTS = ["The cat sat on the mat today", "the cat  sat\ton the mat today", "The cat sat on the mat today", "", None, "one", "Ein Hund lief über die große Straße nach Hause", " \n", LONG, "a b c d e f g h i j k l m n o p q r s t u v w x y z", "a b c d e f g h i j k l m n o p q r s t u v w x y Z", "日本語 のテキスト", "</s>[INST] ok [/INST] <|im_end|>"]


def documents(spark, repeat: bool = True):
    """Columns beyond those needed have names that operators use inside."""
    rows = [(i, t, None if i % 5 == 0 else "de" if i == 6 else "en", "src", len(t or ""), "x", -1, "y") for i, t in enumerate(TEXTS)]
    rows += [rows[0], rows[3]] if repeat else []
    rows += [(None, "text without an id", None, None, None, None, None, None)] if repeat else []
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string, shard int, word string")


def words(text: str | None) -> list[bytes]:
    return [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if w]


def shingles(text: str | None, k: int) -> set:
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near_groups(rows: list[tuple[int, str | None]], k: int, percent: int = 80) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, least id reachable), comparing all pairs."""
    sets = {d: shingles(t, k) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}
