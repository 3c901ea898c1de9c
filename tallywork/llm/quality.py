"""Quality rules as a short-circuit cascade.

Every rule looks at one whole text and may reject it. A sample of some SAMPLE_ROWS texts tells what each rule costs and
how much it rejects; rules then run by rejection per cost, ties in their listed order, and the first that rejects ends the
work on a text. The order changes the time only, never a verdict.

Nulls and empty texts have no words and are rejected by too_few_words. Repeated rows are judged one by one; an empty
table gives an empty result. A very long text is judged whole, in memory that grows with its length; all rules take time in
proportion to the length but the one that sorts its windows. Columns other than the text are carried along untouched by accepted(), whatever their names.
"""

from __future__ import annotations

import operator
import re
import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywork.llm.common import BLANKS

#: Rows, on average, on which costs and selectivities are estimated.
SAMPLE_ROWS = 2000
MIN_WORDS = 20
#: Most words in repeated windows, in per cent.
MAX_REPEATED = 30
WINDOW = 8
#: Most symbols for each word, words like the one before, exclamation marks for each word, capital share of cased letters, share of repeated lines.
MAX_SYMBOLS, MAX_STUTTER, MAX_SHOUTS, MAX_CAPITALS, MAX_DUP_LINES = 0.1, 0.2, 0.25, 0.7, 0.3
#: Mean characters in a word.
WORD_CHARS = (2.0, 20.0)
#: Least share of words with a letter.
MIN_LETTERS = 0.6
SYMBOLS = "#*$%&|<>"
#: A word without a letter; every byte beyond ASCII counts as one.
NO_LETTER = re.compile(rb"(?<!\S)[^A-Za-z\x80-\xff\s]+(?!\S)")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of so many words found twice or more in this text."""
    n, m = len(words), len(words) - window + 1
    if m < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    if len(numbers) == n:
        return 0
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    sums = np.zeros(m, np.uint64)
    for k in range(window):
        sums = sums * np.uint64(0x100000001B3) + mixed[k : k + m]
    order = np.argsort(sums, kind="stable")
    ordered = sums[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    views = np.lib.stride_tricks.sliding_window_view(ids, window)
    at = np.flatnonzero(same)
    if (views[order[at]] == views[order[at + 1]]).all():
        found = order[np.append(same, False) | np.insert(same, 0, False)]
    else:  # two different windows share a hash
        where: dict[tuple, list[int]] = {}
        for i, v in enumerate(map(tuple, views)):
            where.setdefault(v, []).append(i)
        found = np.array([i for x in where.values() if len(x) > 1 for i in x], np.int64)
    edge = np.zeros(n + 1, np.int64)
    edge[found] += 1
    edge[found + window] -= 1
    return int((np.cumsum(edge[:n]) > 0).sum())


class Text:
    """One text; what several rules need is worked out once, when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode().split()

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, BLANKS))

    @cached_property
    def symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(BLANKS)]

    @cached_property
    def dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def repeated(self) -> int:
        return repeated_words(self.words)


def too_few_words(t: Text) -> bool:
    return len(t.words) < MIN_WORDS


def repeats_itself(t: Text) -> bool:
    return 100 * t.repeated > MAX_REPEATED * len(t.words)


def stutters(t: Text) -> bool:
    return sum(map(operator.eq, t.words, t.words[1:])) > MAX_STUTTER * len(t.words)


def too_many_symbols(t: Text) -> bool:
    return t.symbols > MAX_SYMBOLS * len(t.words)


def shouts(t: Text) -> bool:
    return t.text.count("!") > MAX_SHOUTS * len(t.words)


def differing(a: str, b: str) -> int:
    x, y = (np.frombuffer(t.encode("utf-32-le"), "<u4") for t in (a, b))
    return int(np.count_nonzero(x != y)) if len(x) == len(y) else abs(len(x) - len(y)) + sum(c != d for c, d in zip(a, b, strict=False))


def mostly_capitals(t: Text) -> bool:
    capitals, small = differing(t.text, t.text.lower()), differing(t.text, t.text.upper())
    return capitals > MAX_CAPITALS * (capitals + small)


def odd_word_length(t: Text) -> bool:
    return not WORD_CHARS[0] * len(t.words) <= t.word_chars <= WORD_CHARS[1] * len(t.words)


def repeated_lines(t: Text) -> bool:
    return len(t.lines) > 3 and t.dup_lines > MAX_DUP_LINES * len(t.lines)


def few_letters(t: Text) -> bool:
    return len(NO_LETTER.findall(t.text.encode())) > (1 - MIN_LETTERS) * len(t.words)


Rule = Callable[[Text], bool]
BASE: tuple[Rule, ...] = (too_few_words, repeats_itself)
RULES: tuple[Rule, ...] = (*BASE, stutters, too_many_symbols, shouts, mostly_capitals, odd_word_length, repeated_lines, few_letters)


def measured(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, text: str = "text") -> list[dict]:
    """For each rule, seconds a text and share rejected, each rule run alone on the sample; one summed row a rule.

    Rows are drawn one by one, sample_rows of them on average, and judged where they lie, so no task gets the whole sample.
    """
    total = docs.count()
    sample = docs.select(F.col(text).alias("t")).sample(min(1.0, sample_rows / max(total, 1)), seed=7)

    def timed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cost, out, texts = np.zeros(len(rules)), np.zeros(len(rules), np.int64), b.column(0).to_pylist()
            for x in texts:
                for k, rule in enumerate(rules):
                    one, began = Text(x), time.perf_counter()
                    out[k] += rule(one)
                    cost[k] += time.perf_counter() - began
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rules)), pa.int32()), pa.array(cost), pa.array(out), pa.array([len(texts)] * len(rules), pa.int64())], ["rule", "cost", "rejected", "n"])

    by_rule = sample.mapInArrow(timed, "rule int, cost double, rejected long, n long").groupBy("rule")
    return [r.asDict() for r in by_rule.agg(F.sum("cost").alias("cost"), F.sum("rejected").alias("rejected"), F.sum("n").alias("n")).collect()]


def ordered(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, text: str = "text") -> tuple[Rule, ...]:
    """The rules by rejections per second on the sample; a rule that rejected nothing there still runs, after the others."""
    gain = {r["rule"]: (r["rejected"] + 0.5) / (r["cost"] + 1e-9) for r in measured(docs, rules, sample_rows, text)}
    return tuple(rules[k] for k in sorted(range(len(rules)), key=lambda k: (-gain.get(k, 0.0), k)))


def passes(t: Text, rules: tuple[Rule, ...]) -> bool:
    return not any(rule(t) for rule in rules)


def scored(docs: DataFrame, rules: tuple[Rule, ...] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document with its counts and verdict."""
    cascade = rules or ordered(docs, text=text)
    later = tuple(r for r in cascade if r not in BASE)
    kinds = {c: pa.int64() for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")} | {"base_failed": pa.bool_(), "kept": pa.bool_()}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.column(1).to_pylist():
                t = Text(x)
                failed = too_few_words(t) or repeats_itself(t)
                rows.append((len(t.words), t.word_chars, t.symbols, t.dup_lines, t.repeated, failed, not failed and passes(t, later)))
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, kind) for c, kind in zip(columns, kinds.values(), strict=True))], [key, *kinds])

    known = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))
    return known.mapInArrow(score, f"{key} long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")


def accepted(docs: DataFrame, rules: tuple[Rule, ...] | None = None, text: str = "text") -> DataFrame:
    """The documents that no rule rejects, with all their columns."""
    cascade, at = rules or ordered(docs, text=text), docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([passes(Text(x), cascade) for x in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
