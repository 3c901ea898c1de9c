"""Near-duplicates by SimHash fingerprints, compared at the anchors of a covering code.

A fingerprint's 64 bits fall into three parts of 22, 21 and 21 bits, each filled up with zeros to 23. The anchors of a
part are the 4096 words of the binary Golay code, whose covering radius is 3: each part lies within 3 of exactly one
anchor, its home. Two fingerprints that differ in at most t = 4 bits differ in at most t // 3 = 1 bit in some part.
There the one's home is within 3 + 1 of the other, so sending every part to all anchors within 4 of it (5.3 of them on
average) brings each such pair together. At an anchor, those at home are compared with all.

Equal fingerprints are one row from the start. An anchor reports no pairs but a spanning forest of what it finds
connected, so a dense group of thousands costs one edge a member. At an anchor of more than CHUNK rows, chunks of those at
home meet chunks of all, each pair of chunks a task of its own. Components then come from min-label rounds with pointer jumping over the edges.

Nulls and texts without a word have fingerprint zero and are linked like any other; a null doc_id counts only where a
component has no other, and rows of one doc_id or of none are in one component only if their texts are. Repeated rows come
back as often as they occur; a very long text takes memory for its words' hashes, some tens of its bytes a word; an empty
table gives no row; other columns are ignored by components() and carried along by representatives().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywork.llm.common import stored, unused

SHINGLE = 4
SEED = 42
THRESHOLD = 4
#: First bit and number of bits of each part.
PARTS = ((0, 22), (22, 21), (43, 21))
#: Length of the binary Golay code, its check bits, generator polynomial and covering radius.
LENGTH, CHECKS, GENERATOR, RADIUS = 23, 11, 0xC75, 3
CHUNK = 4096

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    w = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(begins[: len(words) - w + 1].tolist(), ends[w - 1 :].tolist(), strict=True)], np.uint64)
    by_byte = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(by_byte[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(sum(1 << k for k in np.flatnonzero(2 * ones > len(hashes)).tolist()))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, digest: bool = False) -> DataFrame:
    """key and fp, the fingerprint as a signed long; on request digest, of the text, where a null counts as empty."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, size) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), *b.columns[2:]], [key, "fp", *b.schema.names[2:]])

    known = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))
    if digest:
        known = known.withColumn("digest", F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return known.mapInArrow(mark, f"{key} long, fp long" + ", digest string" * digest)


def syndromes(words: np.ndarray) -> np.ndarray:
    rest = words.astype(np.int64)
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        rest = np.where((rest >> bit) & 1, rest ^ (GENERATOR << (bit - CHECKS)), rest)
    return rest


def coset_patterns(radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome, the bit patterns of at most radius ones that lead to an anchor, lightest first; and how many."""
    patterns = [0]
    layer = {0}
    for _ in range(radius):
        layer = {p | (1 << k) for p in layer for k in range(LENGTH) if not p >> k & 1}
        patterns += sorted(layer)
    at = syndromes(np.array(patterns))
    counts = np.bincount(at, minlength=1 << CHECKS)
    table = np.zeros((1 << CHECKS, counts.max()), np.int64)
    filled = [0] * (1 << CHECKS)
    for p, s in zip(patterns, at.tolist(), strict=True):
        table[s, filled[s]] = p
        filled[s] += 1
    return table, counts


def anchored(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """A row for each fingerprint and anchor that it goes to: anchor (with its part), fp, home."""
    reach = RADIUS + threshold // len(PARTS)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, counts = coset_patterns(reach)
        for b in batches:
            all_fp = b.column(0).to_numpy(zero_copy_only=False)
            for k in range(0, len(all_fp), 8192):
                fp = all_fp[k : k + 8192].view(np.uint64)
                for part, (first, bits) in enumerate(PARTS):
                    word = ((fp >> np.uint64(first)) & np.uint64((1 << bits) - 1)).astype(np.int64)
                    s = syndromes(word)
                    slot = np.arange(table.shape[1])[None, :]
                    row, col = np.nonzero(slot < counts[s][:, None])
                    anchor = (word[row] ^ table[s[row], col]) + (part << LENGTH)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[row].view(np.int64)), pa.array(col == 0)], ["anchor", "fp", "home"])

    return fps.select("fp").mapInArrow(send, "anchor long, fp long, home boolean")


#: What a row is at an anchor: compared by others, comparing with others, or both.
OTHER, ASKING, BOTH = 0, 1, 2


def forest(fp: np.ndarray, role: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Edges that connect what is within threshold at an anchor: each row that asks with all that don't merely ask."""
    label = np.arange(len(fp))
    answers = role != ASKING
    for i in np.flatnonzero(role != OTHER).tolist():
        near = (np.bitwise_count(fp ^ fp[i]) <= threshold) & answers
        near[i] = True
        found = np.unique(label[near])
        if len(found) > 1:
            label[np.isin(label, found[1:])] = found[0]
    at = np.flatnonzero(fp != fp[label])
    return list(zip(fp[at].view(np.int64).tolist(), fp[label[at]].view(np.int64).tolist(), strict=True))


def links(fps: DataFrame, threshold: int = THRESHOLD, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) whose connected components are those of all pairs of distinct fingerprints within threshold."""
    at = stored(anchored(fps, threshold), "anchors")
    sizes = at.groupBy("anchor").agg(F.count("*").alias("n"), F.count_if("home").alias("homes")).where(F.col("n") > chunk)
    parts = lambda n: F.ceil(F.col(n) / chunk).cast("int")
    big = stored(sizes.select("anchor", parts("n").alias("parts"), parts("homes").alias("home_parts")), "big")
    dealt = at.join(big, "anchor", "left")
    task = lambda i, j, role: F.struct(i.alias("lo"), j.alias("hi"), F.lit(role).alias("role"))
    each = lambda n, make: F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col(n) - 1, F.lit(0))), make))
    mine, home_mine = (F.pmod(F.xxhash64("fp", F.lit(n)), F.greatest(F.col(n_parts), F.lit(1))).cast("int") for n, n_parts in ((1, "parts"), (2, "home_parts")))
    none = F.array().cast("array<struct<lo:int,hi:int,role:int>>")
    asking = F.when(F.col("home"), each("parts", lambda j: task(home_mine, j, ASKING))).otherwise(none)
    asked = F.coalesce(each("home_parts", lambda i: task(i, mine, OTHER)), none)
    small = F.when(F.col("home"), F.array(task(F.lit(0), F.lit(0), BOTH))).otherwise(F.array(task(F.lit(0), F.lit(0), OTHER)))
    tasks = dealt.select("anchor", "fp", F.explode(F.when(F.col("parts").isNull(), small).otherwise(F.concat(asking, asked))).alias("p")).select("anchor", "p.lo", "p.hi", "fp", "p.role")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted, so an anchor's are together; only the last group of a batch waits for the next one."""
        held: list[np.ndarray] = []

        def cut(rows: np.ndarray, last: bool) -> tuple[list[tuple[int, int]], np.ndarray]:
            change = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
            edges = [0, *change.tolist(), len(rows)]
            out: list[tuple[int, int]] = []
            for s, e in zip(edges[: None if last else -2], edges[1 : None if last else -1], strict=False):
                if e - s > 1:
                    g = rows[s:e]
                    out += forest(g[:, 3].copy().view(np.uint64), g[:, 4], threshold)
            return out, rows[len(rows) if last else edges[-2] :]

        def batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
            a, b = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for b in batches:
            if b.num_rows:
                held.append(np.stack([c.cast(pa.int64()).to_numpy(zero_copy_only=False) for c in b.columns], axis=1))
                found, rest = cut(np.concatenate(held), False)
                held = [rest]
                yield batch(found)
        if held:
            yield batch(cut(np.concatenate(held), True)[0])

    groups = ["anchor", "lo", "hi"]
    return tasks.repartition(*groups).sortWithinPartitions(*groups).mapInArrow(compare, "a long, b long").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """node and label, the smallest node of its component, for each node of the edges (a, b)."""
    sides = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(sides.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        seen = sides.join(labels, sides.b == labels.node).groupBy(F.col("a").alias("at")).agg(F.min("label").alias("near"))
        nearer = labels.join(seen, labels.node == seen["at"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("further"))
        new = stored(nearer.join(jump, nearer.label == jump["to"]).select("node", "old", F.least("label", "further").alias("label")), "labels")
        labels = new.select("node", "label")
        if not new.where("label < old").limit(1).count():
            return labels


def labelled(marked: DataFrame, key: str, threshold: int) -> DataFrame:
    """fp, label of its component (unlike component_id, never that of another) and component_id, of fingerprints (key, fp)."""
    distinct = stored(marked.groupBy("fp").agg(F.min(key).alias("first")), "distinct")
    labels = connected(links(distinct, threshold)).withColumnRenamed("node", "fp")
    known = stored(distinct.join(labels, "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label")), "labelled")
    smallest = stored(known.groupBy("label").agg(F.min("first").alias("component_id")), "smallest")
    return stored(known.join(smallest, "label").select("fp", "label", "component_id"), "members")


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """A row a document: key, fingerprint (16 hex digits), component_id (the smallest key reachable)."""
    marked = stored(fingerprints(docs, key, text, size), "fingerprints")
    member = labelled(marked, key, threshold).select("fp", "component_id")
    return marked.join(member, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each component, that of the smallest key and, of its texts, the smallest digest; a null key comes last."""
    same, null, digest = (unused(docs, n) for n in ("same", "null", "digest"))
    number = F.col(key).cast("long")
    by_text = F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))
    by_key = [F.coalesce(number, F.lit(0)).alias(same), number.isNull().alias(null), by_text.alias(digest)]
    marked = stored(fingerprints(docs, key, text, digest=True), "fingerprints")
    member = labelled(marked, key, THRESHOLD).select("fp", "label")
    first = F.min(F.struct(F.col(key).isNull().alias("null"), F.coalesce(key, F.lit(0)).alias("same"), "digest")).alias("first")
    found = marked.join(member, "fp").groupBy("label").agg(first).select(*[F.col(f"first.{c}").alias(n) for c, n in (("same", same), ("null", null), ("digest", digest))])
    # The list of those kept grows with the documents, so it is never broadcast; one shuffle serves both steps.
    kept = docs.select("*", *by_key).join(stored(found, "kept").hint("merge"), [same, null, digest], "left_semi")
    return kept.dropDuplicates([same, null, digest]).select(*docs.columns)
