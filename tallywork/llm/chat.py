"""Chat formatting by schema fingerprints: records of many layouts become canonical turns, turns become marked text.

A record is a JSON object. The paths of its nested fields, with the kind of each value, are hashed; the hash selects a
declared Mapping, which says where roles and texts lie. Nothing else about a record is looked at, so a new layout is one
more declaration. Records whose fingerprint nobody declared, or that aren't JSON, give one row with an error and no text.

Turns are written as <|im_start|>role, line feed, text, <|im_end|>, line feed. In texts and roles each "<" that is followed
by backslashes (or none) and "|" gets one backslash more, so no text holds "<|", and taking one away gives the text again.
A conversation is a run of segments, one a turn, each with the part of it under the loss mask: no task holds more than a turn
of a conversation, however long it is.

Null texts and roles are empty; a null record is no JSON; an empty list of turns gives no rows; repeated records give
repeated turns; a null conversation id is a conversation of its own.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
MARK = re.compile(r"<(\\*)\|")
MARKED = re.compile(r"<\\(\\*)\|")

LONE = re.compile("[\ud800-\udfff]")

#: Fields of a record that say nothing about its layout.
IGNORED = ("id", "source", "metadata")


def kind_of(value: object) -> str:
    return "flag" if isinstance(value, bool) else "number" if isinstance(value, int | float) else "string"


def named(field: str) -> str:
    """A field's name as a step of a path; one that holds marks of paths is quoted."""
    return json.dumps(field) if re.search(r"[.:\[\]{}\"]", field) else field


def field_paths(record: object, ignored: tuple[str, ...] = IGNORED) -> frozenset[str]:
    """The paths of all leaves with their kinds, list places as []; nulls count as absent, empty lists and objects as leaves."""
    found, todo = set(), [("", record)]
    while todo:
        at, value = todo.pop()
        if isinstance(value, dict):
            inner = [(f"{at}.{named(k)}" if at else named(k), v) for k, v in value.items() if at or k not in ignored]
            todo += inner
            if at and not inner:
                found.add(f"{at}{{}}")
        elif isinstance(value, list):
            todo += [(f"{at}[]", v) for v in value]
            if not value:
                found.add(f"{at}[]")
        elif value is not None:
            found.add(f"{at}:{kind_of(value)}")
    return frozenset(found)


@lru_cache(maxsize=4096)
def fingerprint(paths: frozenset[str]) -> str:
    """64 bits of a hash of the sorted paths, as 16 hex digits."""
    return hashlib.blake2b("\n".join(sorted(paths)).encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


@dataclass(frozen=True)
class Turn:
    """Where a turn's role and text lie; a role that begins with = is itself the role. Texts that are there are joined by blank lines."""

    role: str
    texts: tuple[str, ...]
    needed: bool = True


@dataclass(frozen=True)
class Mapping:
    """A layout: the list that holds the turns (or none, if fields are turns), its turns, the paths it must and may have."""

    name: str
    turns: tuple[Turn, ...]
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    each: str = ""
    roles: tuple[tuple[str, str], ...] = ()

    def fingerprints(self) -> Iterator[str]:
        for chosen in chain.from_iterable(combinations(self.optional, k) for k in range(len(self.optional) + 1)):
            yield fingerprint(frozenset(self.required + chosen))
        if self.each:
            yield fingerprint(frozenset([f"{self.each}[]"]))

    def read(self, record: dict) -> list[tuple[str, str]]:
        renamed, out = dict(self.roles), []
        for item in found(record, f"{self.each}[]") if self.each else [record]:
            for t in self.turns:
                there = [strings(item, p) for p in t.texts]
                if any(there) or t.needed:
                    role = t.role[1:] if t.role.startswith("=") else "".join(strings(item, t.role))
                    out.append((renamed.get(role, role), "\n\n".join("".join(x) for x in there if any(x))))
        return out


def found(value: object, path: str) -> list:
    """What lies at a path, nulls left out."""
    values = [value]
    for step in path.split("."):
        name, listed = step.removesuffix("[]"), step.endswith("[]")
        values = [v[name] for v in values if isinstance(v, dict) and v.get(name) is not None]
        values = [x for v in values for x in v] if listed else values
    return [v for v in values if v is not None]


def strings(value: object, path: str) -> list[str]:
    """The strings at a path; halves of surrogate pairs, which JSON can escape but no text holds, become U+FFFD."""
    return [v.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if LONE.search(v) else v for v in found(value, path) if isinstance(v, str)]


PARTS = ("content[].type:string", "content[].text:string")
MAPPINGS = (
    Mapping("messages", (Turn("role", ("content", "content[].text")),), ("messages[].role:string",), ("messages[].content:string", "messages[].content[]", *[f"messages[].{p}" for p in PARTS], "messages[].name:string"), "messages"),
    Mapping("speakers", (Turn("from", ("value",)),), ("conversations[].from:string", "conversations[].value:string"), (), "conversations", (("human", "user"), ("gpt", "assistant"))),
    Mapping("pair", (Turn("=user", ("prompt",)), Turn("=assistant", ("completion",))), ("prompt:string", "completion:string")),
    Mapping("answer", (Turn("=system", ("system",), False), Turn("=user", ("question",)), Turn("=assistant", ("response",))), ("question:string", "response:string"), ("system:string",)),
    Mapping("instruction", (Turn("=system", ("system",), False), Turn("=user", ("instruction", "input")), Turn("=assistant", ("output",))), ("instruction:string", "output:string"), ("input:string", "system:string")),
    Mapping("turn", (Turn("role", ("text",)),), ("role:string",), ("text:string", "turn:number")),
)


def dispatch(mappings: Iterable[Mapping]) -> dict[str, Mapping]:
    """Fingerprint to mapping; raises where two mappings claim the same one."""
    out: dict[str, Mapping] = {}
    for m in mappings:
        for f in m.fingerprints():
            if out.setdefault(f, m) is not m:
                raise ValueError(f"{m.name} and {out[f].name} declare the same fields")
    return out


TURNS = "conv_id long, part long, position long, role string, text string, layout string, fingerprint string, error string"


def canonical(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """Turns (conv_id, part, position, role, text, layout, fingerprint, error) of records (conv_id, part, record).

    part orders the records of a conversation, position the turns of a record. Rows come in the order of the records.
    """
    by_fingerprint = dispatch(mappings)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for conv, part, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                try:
                    record = json.loads(text)
                except (TypeError, ValueError, RecursionError):
                    rows.append((conv, part, 0, None, None, None, None, "no JSON"))
                    continue
                print_ = fingerprint(field_paths(record, ignored))
                m = by_fingerprint.get(print_) if isinstance(record, dict) else None
                if m is None:
                    rows.append((conv, part, 0, None, None, None, print_, "no mapping"))
                else:
                    rows += [(conv, part, k, role, said, m.name, print_, None) for k, (role, said) in enumerate(m.read(record))]
            columns = list(zip(*rows, strict=True)) or [[]] * len(KINDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, KINDS.values(), strict=True)], list(KINDS))

    return records.select(F.col("conv_id").cast("long"), F.col("part").cast("long"), F.col("record").cast("string")).mapInArrow(read, TURNS)


KINDS = dict(zip([c.split()[0] for c in TURNS.split(", ")], [pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * 5], strict=True))


def layouts(turns: DataFrame) -> DataFrame:
    """fingerprint, layout, error, n_turns: what a corpus holds, so that missing layouts can be declared."""
    return turns.groupBy("fingerprint", "layout", "error").agg(F.count("*").alias("n_turns"))


def escaped(text: str) -> str:
    return MARK.sub(r"<\\\1|", text)


def unescaped(text: str) -> str:
    return MARKED.sub(r"<\1|", text)


def role_line(role: str) -> str:
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def role_of(line: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(line), flags=re.S)


SEGMENTS = "conv_id long, part long, position long, segment string, loss_start int, loss_length int"


def rendered(turns: DataFrame) -> DataFrame:
    """Segments (conv_id, part, position, segment, loss_start, loss_length), one a turn, in the order of the turns.

    Concatenated by part and position they are the conversation. The mask, in code points of the segment, covers the escaped
    text of an assistant; it is empty (length 0) in other turns. Rows with an error have no turn and are left to layouts().
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, starts, lengths = [], [], []
            for role, text in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                head, body = f"{START}{role_line(role or '')}\n", escaped(text or "")
                out.append(f"{head}{body}{END}\n")
                starts.append(len(head))
                lengths.append(len(body) if role == "assistant" else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.string()), pa.array(starts, pa.int32()), pa.array(lengths, pa.int32())], ["conv_id", "part", "position", "segment", "loss_start", "loss_length"])

    return turns.where("error is null").select("conv_id", "part", "position", "role", "text").mapInArrow(write, SEGMENTS)


class Reader:
    """Turns from text that comes in pieces of any size; holds no more than the turn it is in."""

    def __init__(self) -> None:
        self.held = ""

    def feed(self, text: str) -> list[tuple[str, str]]:
        self.held += text
        out, at = [], 0
        while (end := self.held.find(f"{END}\n", at)) >= 0:
            head = self.held.find("\n", at)
            if not self.held.startswith(START, at) or not at < head < end:
                raise ValueError("a turn has no head")
            out.append((role_of(self.held[at + len(START) : head]), unescaped(self.held[head + 1 : end])))
            at = end + len(END) + 1
        self.held = self.held[at:]
        return out


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digested(segments: DataFrame, in_order: bool = False) -> DataFrame:
    """What is read back from the segments of each conversation: its turns, the text under the mask, the length of all.

    SHA-256 goes through a conversation in order, so one task reads it, turn by turn, in memory of one turn. in_order says
    that the segments of a conversation already lie together and in order.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, current, state = [], object(), None

        def closed() -> None:
            if state is not None:
                if state[0].held:
                    raise ValueError("a conversation ends within a turn")
                done.append((current, state[3], state[1].hexdigest(), state[4], state[2].hexdigest(), state[5]))

        for b in batches:
            for conv, segment, start, length in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if state is None or conv != current:
                    closed()
                    current, state = conv, [Reader(), hashlib.sha256(), hashlib.sha256(), 0, 0, 0]
                for role, text in state[0].feed(segment):
                    state[1].update(f"{role}\n{text}\n".encode())
                    state[3] += 1
                under = unescaped(segment[start : start + length])
                state[2].update(under.encode())
                state[4] += len(under)
                state[5] += len(segment)
            if done:
                yield batch(done)
                done = []
        closed()
        if done:
            yield batch(done)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    rows = segments if in_order else segments.repartition("conv_id").sortWithinPartitions("conv_id", "part", "position")
    return rows.select("conv_id", "segment", "loss_start", "loss_length").mapInArrow(read, DIGESTS)
