"""Chroma fingerprints of recordings, and their alignment.

Sound becomes frames of energy by pitch class. Sixteen filters, each a difference of sums over rectangles of a window of
frames, read an integral image; each answer becomes two bits, so a window is one packed 32-bit integer. Recordings vote
for an offset by integers that agree in all bytes but one (24 bits); offsets with MIN_VOTES are candidates, and the share
of differing bits over the overlap decides. Of several offsets that of the smallest share is kept, then that of the longest
overlap, then the nearest to zero.

What occurs more than HOT times (silence, held notes) votes as well, but as runs: positions in a row that share a key are
one row, and two runs give each offset at which they overlap once, with as many votes as places overlap. So HOT decides how
votes are counted and never which count: alignments are the same at any HOT. Recordings that share a common sound all meet
there, so these rows grow with the square of their number, in bounded memory; nothing in the tables at hand is that common.
The recall against all offsets without votes, as tests/llm measure it at five levels of noise up to the loudness of the
sound, is 0.95 or more of the alignments within MAX_ERROR.

Recordings of equal fingerprints are one class, whose smallest id stands for it; alignments are between queries' classes
and all classes, and membership says who is in each. Null, empty or very short sound has no integers, belongs to the
class of empty fingerprints and aligns with nothing. Very long sound is transformed in runs of FRAMES frames. Repeated
rows share their class. An empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywork.llm.common import stored

RATE = 2000
FRAME, HOP = 512, 128
#: Frames that a packed integer looks at, and pitch classes.
SPAN, CLASSES = 16, 12
LOWEST, HIGHEST = 55.0, 900.0
#: Cuts of a filter's answer into four levels; none at 0, the answer of silence, where noise would decide.
CUTS = (-0.3, 0.1, 0.5)
MAX_ERROR = 0.2
MIN_OVERLAP = 16
#: Integers that agree in three bytes at one offset that make a candidate, and the most occurrences of one that votes place by place.
MIN_VOTES = 2
HOT = 2000
#: Frames that are transformed together.
FRAMES = 4096
#: Rectangles by kind, as fractions (top, bottom, left, right) of a filter's area that count as positive.
HALVES = {"top": [(0, 0.5, 0, 1)], "left": [(0, 1, 0, 0.5)], "cross": [(0, 0.5, 0, 0.5), (0.5, 1, 0.5, 1)], "middle": [(0.25, 0.75, 0, 1)]}
#: kind, first pitch class, pitch classes, frames.
FILTERS = [(kind, 3 * k, 4 + 2 * (k % 2), SPAN >> (k % 2)) for kind in HALVES for k in range(4)]


def pitch_classes() -> np.ndarray:
    """Which bin of the spectrum belongs to which pitch class."""
    f = np.arange(FRAME // 2 + 1) * RATE / FRAME
    out = np.zeros((len(f), CLASSES))
    for k in np.flatnonzero((f >= LOWEST) & (f <= HIGHEST)):
        out[k, int(np.rint(12 * np.log2(f[k] / 440.0))) % CLASSES] = 1
    return out


def chroma(pcm: np.ndarray, classes: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Frames by pitch class, each frame scaled to length one."""
    if len(pcm) < FRAME:
        return np.zeros((0, CLASSES))
    frames = np.lib.stride_tricks.sliding_window_view(pcm.astype(np.float64), FRAME)[::HOP]
    energy = np.concatenate([(np.abs(np.fft.rfft(frames[k : k + FRAMES] * window, axis=1)) ** 2) @ classes for k in range(0, len(frames), FRAMES)])
    return energy / np.maximum(np.linalg.norm(energy, axis=1, keepdims=True), 1e-9)


def packed(frames: np.ndarray) -> np.ndarray:
    """One integer for each window of SPAN frames."""
    n = len(frames) - SPAN + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    tiled = np.concatenate([frames, frames], axis=1)  # a filter may go round past the last pitch class
    image = np.zeros((len(frames) + 1, 2 * CLASSES + 1))
    image[1:, 1:] = tiled.cumsum(0).cumsum(1)
    t = np.arange(n)

    def area(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        return image[t + t1, c1] - image[t + t0, c1] - image[t + t1, c0] + image[t + t0, c0]

    out = np.zeros(n, np.uint32)
    for kind, c, height, width in FILTERS:
        total = area(0, width, c, c + height)
        part = sum(area(int(width * left), int(width * right), c + int(height * top), c + int(height * bottom)) for top, bottom, left, right in HALVES[kind])
        answer = np.log((part + 0.01) / (np.maximum(total - part, 0) + 0.01))
        level = np.digitize(answer, CUTS).astype(np.uint32)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1)))  # neighbouring levels differ in one bit
    return out


def fingerprints(recordings: DataFrame) -> DataFrame:
    """id and fp (array of packed integers as longs) of recordings (id, pcm: 16-bit little-endian samples at RATE)."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, window = pitch_classes(), np.hanning(FRAME)
        for b in batches:
            out = [packed(chroma(np.frombuffer(x, "<i2", len(x) // 2), classes, window)).astype(np.int64) for x in (v.as_py() or b"" for v in b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64()))], ["id", "fp"])

    return recordings.select(F.col("id").cast("long").alias("id"), "pcm").mapInArrow(mark, "id long, fp array<long>")


def keyed(classes: DataFrame, hot: int = HOT) -> list[DataFrame]:
    """Three bytes of integers as keys: places (class_id, asks, at, key) of those that occur hot times at most, runs (class_id, asks, key, at, n) of the others."""
    but_one = [F.col("x").bitwiseAND(F.lit(0xFFFFFFFF & ~(0xFF << 8 * k)).cast("long")) + F.lit(k << 33) for k in range(4)]
    known = classes.select("class_id", "asks", F.posexplode("fp").alias("at", "x")).select("class_id", "asks", "at", F.explode(F.array(*but_one)).alias("key"))
    # One row for each key of more than hot rows: a small part of the rows.
    common = stored(known.groupBy(F.col("key").alias("of")).count().where(F.col("count") > hot).select("of"), "common")
    rare = known.join(common, F.col("key") == F.col("of"), "left_anti")
    rest = known.join(common, F.col("key") == F.col("of"), "left_semi")
    run = F.col("at") - F.row_number().over(Window.partitionBy("class_id", "key").orderBy("at"))
    runs = rest.withColumn("run", run).groupBy("class_id", "asks", "key", "run").agg(F.min("at").alias("at"), F.count("*").cast("int").alias("n"))
    return [rare, stored(runs.drop("run").select("class_id", "asks", "key", "at", "n"), "runs")]


def aligned(marked: DataFrame, is_query: str, max_error: float = MAX_ERROR, min_overlap: int = MIN_OVERLAP, min_votes: int = MIN_VOTES, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Alignments (query_class, class_id, offset, overlap, errors) and membership (id, class_id) of fingerprints (id, fp).

    is_query is a condition on id; a class is a query if any member is.
    """
    digested = stored(marked.withColumn("digest", F.md5(F.to_json("fp"))), "sound")
    classes = stored(digested.groupBy("digest").agg(F.min("id").alias("class_id"), F.max(F.expr(is_query)).alias("asks"), F.first("fp").alias("fp")), "classes")
    members = digested.select("id", F.col("digest").alias("d")).join(classes.select("digest", "class_id"), F.col("d") == F.col("digest")).select("id", "class_id")
    asking = lambda table, *more: table.where("asks").select(F.col("class_id").alias("query_class"), F.col("at").alias("from"), F.col("key").alias("asked"), *more)
    others = (F.col("asked") == F.col("key")) & (F.col("query_class") != F.col("class_id"))
    rare, common = keyed(classes, hot)
    met = asking(rare).join(rare, others).select("query_class", "class_id", (F.col("at") - F.col("from")).alias("offset"), F.lit(1).cast("long").alias("votes"))
    long_ = asking(common, F.col("n").alias("m")).join(common, others)
    overlapping = long_.withColumn("offset", F.explode(F.sequence(F.col("at") - F.col("from") - F.col("m") + 1, F.col("at") - F.col("from") + F.col("n") - 1)))
    shared = F.least(F.col("from") + F.col("offset") + F.col("m"), F.col("at") + F.col("n")) - F.greatest(F.col("from") + F.col("offset"), F.col("at"))
    met = met.union(overlapping.select("query_class", "class_id", "offset", shared.cast("long")))
    votes = met.groupBy("query_class", "class_id", "offset").agg(F.sum("votes").alias("votes")).where(F.col("votes") >= min_votes)
    sound = classes.select(F.col("class_id").alias("c"), "fp")
    both = votes.join(sound.select(F.col("c").alias("q"), F.col("fp").alias("a")), F.col("query_class") == F.col("q")).join(sound.select("c", F.col("fp").alias("b")), F.col("class_id") == F.col("c"))
    begin = F.greatest(F.lit(0), -F.col("offset"))
    n = F.least(F.size("a") - begin, F.size("b") - begin - F.col("offset"))
    wrong = F.aggregate(F.zip_with(F.slice("a", begin + 1, F.greatest(n, F.lit(0))), F.slice("b", begin + F.col("offset") + 1, F.greatest(n, F.lit(0))), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    scored = both.select("query_class", "class_id", "offset", n.alias("overlap"), wrong.alias("errors"))
    good = scored.where((F.col("overlap") >= min_overlap) & (F.col("errors") <= 32 * max_error * F.col("overlap")))
    best = F.min(F.struct(F.col("errors") / F.col("overlap"), -F.col("overlap"), F.abs("offset"), "offset", "overlap", "errors"))
    return good.groupBy("query_class", "class_id").agg(best.alias("m")).select("query_class", "class_id", "m.offset", "m.overlap", "m.errors"), members


NOTES = 24
NOTE_SAMPLES = 128


def played(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Recordings (id, pcm) made of vectors: each number is a note, the pitch by its size."""

    def play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pitch = 110.0 * 2.0 ** (np.arange(NOTES)[:, None] / 12)
        sound = (8000 * np.sin(2 * np.pi * pitch * np.arange(NOTE_SAMPLES)[None, :] / RATE)).astype("<i2")
        for b in batches:
            pcm = []
            for v in b.column(1).to_pylist():
                x = np.nan_to_num(np.array([0.0 if e is None else e for e in v or ()], np.float64))
                scale = np.sqrt(np.mean(x * x)) if len(x) else 1.0
                steps = np.clip(np.rint((x / (scale or 1.0) + 3) / 6 * (NOTES - 1)), 0, NOTES - 1).astype(int)
                pcm.append(sound[steps].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pcm, pa.binary())], ["id", "pcm"])

    return vectors.select(F.col(key).cast("long").alias(key), vector).mapInArrow(play, "id long, pcm binary")
