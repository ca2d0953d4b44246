"""Text expressions: masking, filter rules as data, tokens, keyword cells, fallback titles. Columns only, no Python per row."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Masking patterns. (?U) gives digits and white space their Unicode meaning.
IDENTIFIER = r"(?iU)((?:支付宝|对方|个人|实名)?(?:账号|手机号|手机号码|身份证号|身份证号码)(?:\s*(?:是|为))?)\s*([0-9A-Za-z\*\-@\.]+)"
LONG_NUMBER = r"(?U)(?<!\d)\d{5,}(?!\d)"
AMOUNT = r"(?U)\d+(\.\d+)?元"
#: Openings and punctuation that a fallback title is rid of.
OPENING = r"^用户(?:表示|遇到|咨询|反映|说|称|需要|想|希望|尝试)?"
PUNCTUATION = r"(?U)[，,。!！？?；;\s]+"
#: What a keyword cell is split at, what a title keeps for word search.
CELL = r"[^,^{^}]+"
NOT_WORD = r"[^0-9A-Za-z一-龥]"


def mask(title: Column) -> Column:
    """Identifiers after their keyword, runs of five and more digits, then amounts become ``*`` (in this order)."""
    masked = F.regexp_replace(title, IDENTIFIER, "$1*")
    masked = F.regexp_replace(masked, LONG_NUMBER, "*")
    return F.regexp_replace(masked, AMOUNT, "*元")


def _any(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _all(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def length_band(title: Column, over: int = 12, under: int = 80) -> Column:
    return (F.length(title) > over) & (F.length(title) < under)


def prefix_rule(title: Column, rules: Sequence[tuple[str, int]]) -> Column:
    """True to drop: it begins with a prefix and is at most so long."""
    return _any([title.startswith(p) & (F.length(title) <= n) for p, n in rules])


def any_keyword(title: Column, keywords: Sequence[str]) -> Column:
    """One alternation, so that a title is scanned once for all keywords."""
    return title.rlike("|".join(re.escape(k) for k in keywords)) if keywords else F.lit(False)


def all_keywords(title: Column, rules: Sequence[Sequence[str]]) -> Column:
    return _any([_all([title.contains(k) for k in rule]) for rule in rules])


def keywords_within(title: Column, rules: Sequence[tuple[Sequence[str], int]]) -> Column:
    return _any([_all([title.contains(k) for k in rule]) & (F.length(title) <= n) for rule, n in rules])


def include_exclude(title: Column, rules: Sequence[tuple[Sequence[str], Sequence[str]]]) -> Column:
    return _any([_all([title.contains(k) for k in yes]) & ~_any([title.contains(k) for k in no]) for yes, no in rules])


def one_of(words: Iterable[str]) -> str:
    """A pattern of any of some words, the longest first: a tree of their letters, so that a text is compared with those that begin alike."""
    tree: dict = {}
    for word in words:
        node = tree
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        ends = "" in node
        ways = [re.escape(letter) + pattern(below) for letter, below in sorted(node.items()) if letter]
        if not ways:
            return ""
        joined = ways[0] if len(ways) == 1 and not ends else f"(?:{'|'.join(ways)})"
        return joined + "?" * ends

    return pattern(tree)


def tokens(title: Column, stopwords: Column | None = None, most: int = 10, words: Sequence[str] = ()) -> Column:
    """Upper-case words of more than one letter or digit, without stopwords; the first ``most``.

    ``words``: the user dictionary. With it, runs of Chinese letters, in which other signs don't count, are cut by the
    longest word of the dictionary that begins at each place; letters of no word are left out. Without it a run is one word.
    """
    own = sorted({w.upper() for w in words if re.fullmatch(r"[0-9A-Za-z一-龥]{2,}", w) and re.search("[一-龥]", w)})
    if own:
        flat = F.regexp_replace(F.upper(title), f"(?<=[一-龥]){NOT_WORD}+(?=[一-龥])", "")
        found = F.regexp_extract_all(flat, F.lit(f"{one_of(own)}|[0-9A-Z]+|[一-龥]"), F.lit(0))
    else:
        found = F.regexp_extract_all(F.upper(title), F.lit(r"[0-9A-Z一-龥]+"), F.lit(0))
    kept = F.filter(found, lambda w: F.length(w) > 1)
    return F.slice(F.filter(kept, lambda w: ~F.array_contains(stopwords, w)) if stopwords is not None else kept, 1, most)


def all_words(*rules: Sequence) -> list[str]:
    """The distinct keywords of rules, however nested their lists are (prefix lengths and the like are no keywords)."""

    def flat(x: object) -> Iterable[str]:
        return [x] if isinstance(x, str) else [w for y in x for w in flat(y)] if isinstance(x, (list, tuple, set, frozenset)) else []

    return sorted(set(flat(rules)))


def prompt(template: str, **values: Column) -> Column:
    """A template with its ``$name`` places filled by columns; a null fills nothing."""
    parts = re.split(r"\$([a-z_]+)", template)
    return F.concat(*[F.coalesce(values[x].cast("string"), F.lit("")) if i % 2 else F.lit(x) for i, x in enumerate(parts)])


def keyword_cell(cell: Column) -> Column:
    """The set of upper-case keywords of a cell; null and empty cells have none."""
    parts = F.transform(F.regexp_extract_all(F.coalesce(cell, F.lit("")), F.lit(CELL), F.lit(0)), lambda k: F.upper(F.trim(k)))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda k: k != "")))


def fallback_title(feedback: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(feedback, OPENING, ""), PUNCTUATION, "")
    return F.coalesce(F.nullif(clean, F.lit("")), feedback)


def or_default(*options: Column | str) -> Column:
    """The first option that is neither null nor empty."""
    columns = [F.lit(x) if isinstance(x, str) else F.nullif(x, F.lit("")) for x in options]
    return F.coalesce(*columns)


def stable_id(kind: str, *parts: Column) -> Column:
    return F.concat(F.lit(kind), F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 24))
