"""Chat formatting: records of many layouts become canonical turns by their schema's fingerprint, and turns become one text
with reversible escapes and a loss mask.

* ``field_paths`` lists the nested field paths of a schema or of a JSON record; ``fingerprint`` hashes the sorted list of those that any
  layout names. A fingerprint is looked up in a table of the declarative mappings ``LAYOUTS``: where the turns are and which fields hold the
  role and the text. The table has the fingerprints of records of one layout and of two at once; another is resolved once and remembered, 4096 at most.
* ``canonical`` applies the mapping of a table's schema; ``canonical_json`` that of every JSON record by itself.
* ``format_turns`` writes each turn as ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside a text or role
  get a backslash after their first character (one more if it has some already), which ``unescape`` takes off; line breaks and
  backslashes of a role are written as ``\\n``, ``\\r`` and two backslashes.
* ``read_back`` finds the turns in the text of a conversation by their marks alone, whatever pieces it comes in, and digests
  them, streaming.

Scale: formatting is per turn, as DataFrame expressions. Only reading back needs a conversation's turns in order: rows
are dealt by conversation and sorted, and a task streams over them with constant state, so even a
conversation of a third of all rows is never held as a whole.

Defined cases: a null text or role is empty; turns of equal number are ordered by role and text; repeated rows are repeated
turns; an empty table gives an empty result; an empty list of turns is a conversation without any, which leaves no row; a JSON
record that is broken, of no known layout, or whose id is no 64-bit whole number goes out with ``error`` set and no turns; a null
conversation id is a conversation of its own; a very long text is one turn, held once by its task; fields that no layout names are
left out; where several layouts fit, that with most fields present counts, and of those the first listed.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtide.llm.common import gives_back

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of common templates (fixed values); none has its own first character's match inside another.
CONTROLS = ["<|im_start|>", "<|im_end|>", "<|system|>", "<|user|>", "<|assistant|>", "<|endoftext|>", "<|startoftext|>", "<|eot_id|>", "<|begin_of_text|>", "<|end_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<s>", "</s>", "<pad>", "<unk>", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>", "<bos>", "<eos>", "[INST]", "[/INST]"]
_REST = {first: "|".join(re.escape(c[1:]) for c in CONTROLS if c[0] == first) for first in "<["}
_ESCAPE = "|".join(rf"{re.escape(first)}(?=\\*(?:{rest}))" for first, rest in _REST.items())
_UNESCAPE = "|".join(rf"(?<={re.escape(first)})\\(?=\\*(?:{rest}))" for first, rest in _REST.items())


def escape(text: Column) -> Column:
    return F.regexp_replace(text, f"({_ESCAPE})", r"$1\\")


def unescape(text: str) -> str:
    return re.sub(_UNESCAPE, "", text)


def escape_role(role: Column) -> Column:
    """``escape``, and on one line."""
    line = F.replace(escape(role), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(line, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: {"n": "\n", "r": "\r"}.get(m[1], m[1]), role))


def field_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths; ``[]`` for an array's elements."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, f"{prefix}[]")
    return [prefix]


def json_paths(value: object, prefix: str = "") -> set[str]:
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in json_paths(v, f"{prefix}.{k}" if prefix else k)}
    if isinstance(value, list):
        return {p for v in value for p in json_paths(v, f"{prefix}[]")} or {f"{prefix}[]"}
    return {prefix}


def fingerprint(paths: list[str] | set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Layout:
    """How a record's turns are found. ``turns``: an array of turns with ``role`` and ``text`` fields; or ``parts``: (role, fields), whose
    non-empty texts joined by a blank line make one turn each. ``number``: the field that orders records that are turns themselves."""

    id: str
    turns: str | None = None
    role: str | None = None
    text: str | None = None
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    number: str | None = None

    def paths(self) -> list[str]:
        if self.number:
            return [self.id, self.number, self.role, self.text]
        if self.turns:
            return [self.id, f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}"]
        return [self.id, *(f for _, fields in self.parts for f in fields)]


def _layouts() -> Iterator[Layout]:
    for name in ("conv_id", "id"):
        yield Layout(name, role="role", text="text", number="turn")
        for turns, role, text in (("messages", "role", "content"), ("conversations", "from", "value"), ("conversation", "role", "content"), ("turns", "speaker", "text")):
            yield Layout(name, turns, role, text)
        for user in (("prompt",), ("instruction",), ("instruction", "input"), ("question",)):
            for assistant in ("response", "output", "completion", "answer"):
                yield Layout(name, parts=(("user", user), ("assistant", (assistant,))))
                yield Layout(name, parts=(("system", ("system",)), ("user", user), ("assistant", (assistant,))))


LAYOUTS = list(_layouts())


def _forms(x: Layout) -> Iterator[frozenset[str]]:
    """The sets of field paths that a record of a layout may have: messages may lack their texts, or there may be none."""
    yield frozenset(x.paths())
    if x.turns:
        yield frozenset({x.id, f"{x.turns}[].{x.role}"})
        yield frozenset({x.id, f"{x.turns}[]"})


FORMS = list(dict.fromkeys((form, x) for x in LAYOUTS for form in _forms(x)))
#: The field paths that any layout names; others aren't fingerprinted.
NAMED = frozenset(p for form, _ in FORMS for p in form)


def _fitting(paths: frozenset[str]) -> Layout | None:
    """Of the layouts whose fields are there, the one with most fields present; of equals the first listed."""
    fitting = dict.fromkeys(x for form, x in FORMS if form <= paths)
    return max(fitting, key=lambda x: (len(paths & set(x.paths())), -LAYOUTS.index(x)), default=None)


@functools.cache
def mappings() -> dict[str, Layout]:
    """Fingerprint -> layout, for records of one layout and for those that have the fields of two."""
    both = {a | b for a, _ in FORMS for b, _ in FORMS}
    return {fingerprint(paths): _fitting(paths) for paths in both}


@functools.lru_cache(4096)
def _unlisted(mark: str, paths: frozenset[str]) -> Layout | None:
    """The layout of a fingerprint that the table lacks: fields of three layouts and more, or of none."""
    return _fitting(paths)


def mark_of(paths: list[str] | set[str] | frozenset[str]) -> tuple[str, frozenset[str]]:
    """The fingerprint of the field paths that layouts name, and those paths."""
    named = NAMED & set(paths)
    return fingerprint(named), named


def layout_of(mark: str, named: frozenset[str]) -> Layout | None:
    """The layout that a fingerprint selects from the table; ``named``: what was fingerprinted."""
    return mappings().get(mark) or _unlisted(mark, named)


#: Names that mean a canonical role.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _mapped(layout: Layout, record: dict) -> list[tuple[str, str]]:
    if layout.turns:
        pairs = [(str(t.get(layout.role) or ""), str(t.get(layout.text) or "")) for t in record.get(layout.turns) or []]
        return [(ROLES.get(r, r), t) for r, t in pairs]
    if layout.number:
        return [(str(record.get(layout.role) or ""), str(record.get(layout.text) or ""))]
    joined = [(role, "\n\n".join(str(record[f]) for f in fields if record.get(f))) for role, fields in layout.parts]
    return [(role, text) for role, text in joined if text or role != "system"]


def canonical(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of a table whose schema has a known layout; columns that the layout doesn't name are left out."""
    paths = frozenset(field_paths(df.schema))
    layout = layout_of(*mark_of(paths))
    if layout is None:
        raise ValueError(f"no layout has the field paths {sorted(paths)}")
    conv, empty = F.col(layout.id).cast("long").alias("conv_id"), F.lit("")
    if layout.number:
        return df.select(conv, F.col(layout.number).cast("long").alias("turn"), F.coalesce(layout.role, empty).alias("role"), F.coalesce(layout.text, empty).alias("text"))
    if layout.turns:
        rows = df.select(conv, F.posexplode(layout.turns).alias("turn", "t"))
        role = F.coalesce(F.col(f"t.{layout.role}"), empty)
        named = F.coalesce(F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])[role], role)
        return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), named.alias("role"), (F.coalesce(F.col(f"t.{layout.text}"), empty) if f"{layout.turns}[].{layout.text}" in paths else empty).alias("text"))
    parts = [F.struct(F.lit(r).alias("role"), F.array_join(F.filter(F.array(*fields), lambda x: x != ""), "\n\n").alias("text")) for r, fields in layout.parts]
    rows = df.select(conv, F.posexplode(F.filter(F.array(*parts), lambda p: (p.role != "system") | (p.text != ""))).alias("turn", "t"))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


def canonical_json(df: DataFrame, json_col: str) -> DataFrame:
    """conv_id, turn, role, text, fingerprint, error: each JSON record by the layout of its own field paths."""
    schema = "conv_id long, turn long, role string, text string, fingerprint string, error string"

    def turns(record: object, layout: Layout) -> list[tuple]:
        conv = record[layout.id]
        first = record[layout.number] if layout.number else 0
        for number in (conv, first):
            if isinstance(number, bool) or int(number) != (number if isinstance(number, float) else int(number)) or not -(1 << 63) <= int(number) < 1 << 63:
                raise ValueError("an id or a turn that is no 64-bit whole number")
        found = [(int(conv), i, role, text) for i, (role, text) in enumerate(_mapped(layout, record), int(first))]
        for *_, role, text in found:
            role.encode(), text.encode()  # lone surrogates are no text
        return found

    def rows(raw: str | None) -> Iterator[tuple]:
        mark = None
        try:
            record = json.loads(raw or "")
            mark, named = mark_of(json_paths(record))
            layout = layout_of(mark, named)
            if layout is None:
                raise ValueError("no layout has this fingerprint")
            yield from [(*turn, mark, None) for turn in turns(record, layout)]
        except (ValueError, TypeError, AttributeError, KeyError, OverflowError, RecursionError) as broken:
            yield None, None, None, None, mark, f"{type(broken).__name__}: {broken}"[:200].encode("utf-8", "replace").decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            out = [r for raw in batch.column(0).to_pylist() for r in rows(raw)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=[f.split()[0] for f in schema.split(", ")])

    return df.select(F.col(json_col).cast("string")).mapInArrow(gives_back(run), schema)


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and the turn's formatted text, with the span of its text that the loss covers (code points; null: none)."""
    role, text = escape_role(F.col("role")), escape(F.col("text"))
    out = turns.withColumn("formatted", F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n")))
    trained = F.col("role") == "assistant"
    begin = F.length(role) + (len(START) + 1)
    return out.withColumn("loss_from", F.when(trained, begin)).withColumn("loss_to", F.when(trained, begin + F.length(text)))


class _Conversation:
    """What is known of a conversation from its formatted text so far; it comes in pieces of any size."""

    def __init__(self, conv: int | None) -> None:
        self.conv, self.turns, self.loss_chars, self.chars = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()
        self.held, self.at, self.seen = "", 0, 0  # text not yet parsed, its place in the conversation, how far it was searched
        self.spans: list[tuple[int, int]] = []  # under the loss mask, by place in the conversation

    def add(self, formatted: str, loss_from: int | None, loss_to: int | None) -> None:
        if loss_from is not None:
            self.spans.append((self.chars + loss_from, self.chars + loss_to))
        self.chars += len(formatted)
        self.held = self.held + formatted if self.held else formatted
        done, mark = 0, END + "\n"
        while (end := self.held.find(mark, max(done, self.seen))) >= 0:
            if not self.held.startswith(START, done):
                raise ValueError("a formatted turn without its marks")
            self._turn(done, end)
            done = self.seen = end + len(mark)
        self.seen = max(0, len(self.held) - done - len(mark) + 1)
        self.held, self.at = self.held[done:], self.at + done

    def _turn(self, begin: int, end: int) -> None:
        role, _, text = self.held[begin + len(START) : end].partition("\n")
        self.turns += 1
        self.all.update(f"{unescape_role(role)}\n{unescape(text)}\n".encode())
        while self.spans and self.spans[0][1] <= self.at + end:
            a, b = self.spans.pop(0)
            under = unescape(self.held[a - self.at : b - self.at])
            self.loss_chars += len(under)
            self.loss.update(under.encode())

    def row(self) -> tuple:
        if self.held or self.spans:
            raise ValueError("the text of a conversation ends within a turn")
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns in a conversation's text."""
    found = re.findall(rf"{re.escape(START)}([^\n]*)\n(.*?){re.escape(END)}\n", formatted, re.S)
    return [(unescape_role(role), unescape(text)) for role, text in found]


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the formatted text and its loss spans alone."""
    rows = formatted.select("conv_id", "formatted", "loss_from", "loss_to", "turn", "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "formatted", "loss_from", "loss_to")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Conversation | None = None
        for batch in batches:
            done = []
            for conv, *turn in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Conversation(conv)
                now.add(*turn)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(now.row(), kinds, strict=True)], names=names)

    return rows.mapInArrow(gives_back(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
