"""Concatenate and cut: all documents' tokens in one stream, cut into windows of a fixed length.

First pass: each partition tokenizes its documents and keeps running totals. The partitions' totals, one small row
each, give every partition its place in the stream, and a second pass cuts documents at multiples of the window. A
document that crosses a cut gives one boundary piece on either side; nothing is lost or padded but the very last window.

A null text counts as empty and gives the end mark alone. Repeated rows are packed as often as they occur. Of equal
rows and of documents in one partition the order read is the order packed. A very long text is tokenized whole, in memory
that grows with its length, and cut into as many pieces as it needs. An empty table gives no piece. Other columns are
ignored.
"""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywork.llm.common import stored

WINDOW = 2048
END = 1
#: Bytes of words and ids, with OVERHEAD for each, that a worker remembers as new and again as old; when the new ones are full
#: they become the old ones, which are forgotten but for those that occur again. This bounds memory and alters no result.
REMEMBERED, OVERHEAD = 48 << 20, 150
#: Texts given to the tokenizer at once.
AT_ONCE = 2000
#: Characters of texts that are tokenized together.
TOGETHER = 1 << 20
#: How a byte-level vocabulary writes a space and a line end.
BLANKS = {" ": "\u0120", "\n": "\u010a"}
#: Not letters, digits, blanks or apostrophes, which can start a contraction.
PUNCTUATION = ",.;:!?%*#&$|()[]{}\"-"

_tokenizers: dict[str, "Words"] = {}


class Words:
    """Ids of texts by a byte-level tokenizer, put together from the ids of their words.

    Such a tokenizer never joins what a single blank between two non-blanks separates: the blank goes with what follows.
    So a text may be cut there, if the blank is a space or a line end, and each distinct word needs to be tokenized once only. Neither does it join letters to
    punctuation after them, so letters with punctuation follow from the two parts.
    """

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(file)
        vocabulary = self.inner.get_vocab()
        self.begin = {blank: np.zeros(max(vocabulary.values()) + 1, bool) for blank in BLANKS}
        for blank, sign in BLANKS.items():
            self.begin[blank][[i for t, i in vocabulary.items() if t.startswith(sign)]] = True
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0
        self.tails: dict[str, bytes] = {}
        self.double = re.compile(r"\s\s")
        self.cut = re.compile(r"(?<=\S) (?=\S)")

    def raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for k in range(0, len(texts), AT_ONCE) for x in self.inner.encode_batch_fast(texts[k : k + AT_ONCE], add_special_tokens=False)]

    def raw_words(self, words: list[str], blank: str) -> list[bytes]:
        """What a blank and each word of letters give: one text of all, cut where tokens begin with the blank."""
        if not words:
            return []
        ids = np.array(self.inner.encode_batch_fast(["".join(blank + w for w in words)], add_special_tokens=False)[0].ids, "<u4")
        begins = (np.flatnonzero(self.begin[blank][ids]) * 4).tolist()
        if len(begins) != len(words):
            return self.raw([blank + w for w in words])
        data = ids.tobytes()
        return [data[s:e] for s, e in zip(begins, [*begins[1:], len(data)], strict=True)]

    def learn(self, words: set[str]) -> None:
        """Makes known what each of the words gives, after a space unless it begins with a line end."""
        if self.held > REMEMBERED:
            self.old, self.known, self.held = self.known, {}, 0
        known, old, tails = self.known, self.old, self.tails
        again = words & old.keys() if old else set()
        known.update((w, old[w]) for w in again)
        composed, spaced, lined, odd = [], set(), set(), []
        for w in words - again if again else words:
            core = w.rstrip(PUNCTUATION)
            if core.isalpha():
                spaced.add(core)
            elif core[:1] == "\n" and core[1:].isalpha():
                lined.add(core)
            else:
                odd.append(w)
                continue
            if core != w:
                composed.append((w, core, w[len(core) :]))
        for blank, cores in ((" ", spaced), ("\n", lined)):
            new = [c for c in cores if c not in known]
            for k in range(0, len(new), 1000):
                known.update(zip(new[k : k + 1000], self.raw_words([c.removeprefix("\n") for c in new[k : k + 1000]], blank), strict=True))
        known.update(zip(odd, self.raw([w if w[:1] == "\n" else " " + w for w in odd]), strict=True))
        rest = list({t for _, _, t in composed if t not in tails})
        tails.update(zip(rest, self.raw(rest), strict=True))
        for w, core, tail in composed:
            known[w] = known[core] + tails[tail]
        # A word has no more ids than bytes; most have one for some letters.
        self.held += 2 * sum(map(len, words)) + OVERHEAD * len(words)
        if len(tails) > AT_ONCE:
            tails.clear()

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text. Millions of lists and tuples come and go here, none in a cycle, so the collector of cycles rests."""
        collects = gc.isenabled()
        gc.disable()
        try:
            return self.ids_of(texts)
        finally:
            if collects:
                gc.enable()

    def ids_of(self, texts: list[str]) -> list[bytes]:
        odd = lambda t: t[:1].isspace() or t[-1:].isspace() or self.double.search(t)
        split = [self.cut.split(t) if odd(t) else t.replace("\n", " \n").split(" ") for t in texts]
        out = [[x, *map(self.known.get, s[1:])] for x, s in zip(self.raw([s[0] for s in split]), split, strict=True)]
        open_ = [(x, s, [k for k, ids in enumerate(x) if ids is None]) for x, s in zip(out, split, strict=True) if None in x]
        if open_:
            self.learn({s[k] for _, s, at in open_ for k in at})
            for x, s, at in open_:
                for k in at:
                    x[k] = self.known[s[k]]
        return list(map(b"".join, out))


def tokenizer(file: str) -> Words:
    """One for each Python worker, which keeps it from task to task."""
    if file not in _tokenizers:
        _tokenizers[file] = Words(file)
    return _tokenizers[file]


def cuts(texts: pa.Array) -> list[int]:
    """Where to end groups of texts of about TOGETHER bytes, one text at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // TOGETHER
    return [*(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(sizes)] if len(sizes) else []


def tokenized(docs: DataFrame, file: str, end: int = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a document: key, part (the task that made it), before (ids of that part before it), n, ids (packed, with the end mark)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, part, before, mark = tokenizer(file), TaskContext.get().partitionId(), 0, np.array([end], "<u4").tobytes()
        for b in batches:
            begin, n = 0, b.column(1)
            for end_ in cuts(n):
                packed = [x + mark for x in words.ids([t.as_py() or "" for t in n[begin:end_]])]
                sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
                upto = before + np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays([b.column(0)[begin:end_], pa.array(np.full(len(packed), part, np.int32)), pa.array(upto - sizes), pa.array(sizes), pa.array(packed, pa.binary())], [key, "part", "before", "n", "ids"])
                begin, before = end_, int(upto[-1])

    known = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))
    return known.mapInArrow(encode, f"{key} long, part int, before long, n long, ids binary")


def packed(docs: DataFrame, file: str, window: int = WINDOW, end: int = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a piece: key, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset."""
    tokens = stored(tokenized(docs, file, end, key, text), "tokens")
    # One row for each partition, two numbers wide: small at any size, so it is broadcast and the tokens are not shuffled.
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    placed = tokens.join(F.broadcast(bases), "part").withColumn("at", F.col("base") + F.col("before"))
    first, last = F.floor(F.col("at") / window), F.floor((F.col("at") + F.col("n") - 1) / window)

    def piece(w):
        begin = F.greatest(w * window, F.col("at"))
        length = F.least((w + 1) * window, F.col("at") + F.col("n")) - begin
        start = begin - F.col("at")
        return F.struct(
            start.alias("start"), length.alias("length"), F.substring(F.col("ids"), (start * 4 + 1).cast("int"), (length * 4).cast("int")).alias("ids"),
            w.alias("sequence_id"), (begin - w * window).alias("offset"),
        )

    pieces = placed.select(key, F.col("n").alias("doc_tokens"), F.explode(F.transform(F.sequence(first, last), piece)).alias("p"))
    return pieces.select(key, "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id", "p.offset")
