"""Mixing sources to target weights, in DataFrame operations only.

Each source's words form one stream, cut into blocks of BLOCK words. The mix has as many blocks as the input, dealt over
output shards of SHARD slots. The number of a shard's slots that each source gets is a multinomial draw: each slot has a
uniform number of its own from a hash and falls to the source in whose share of the target weights it lies; a shard's
slots are counted by source. A source's slots are numbered through all shards; number j takes the block at place j mod n,
in pass j div n, of a pseudorandom permutation of the source's n blocks (swap-or-not rounds over a keyed hash). Documents
meet the blocks taken by block index. A slot beyond the third pass stays empty, so no document exceeds 3 times its size.

mixed() gives the words that the mix takes from each document; resampled() the mix itself, a row for each document and
pass, whose text is that of the document's words in the blocks that the pass takes.

Nulls have no words. A null source is a source of its own, sorted last. Documents of no words take none and aren't in the
mix. Documents are in the order of a hash of doc_id and text, ties by doc_id, text hash and size; what is equal in all of
these, repeated rows included, may trade places, which changes no result. Very long documents are more blocks, nothing
else. An empty table, or one without a word, gives no slot. Other columns are ignored by mixed() and carried along by
resampled().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywork.llm.common import BLANKS, WORD, starts, stored, unused

WEIGHTS = (5, 2, 1)
#: Most times that a source is used, and so each of its documents.
PASSES = 3
#: Words of a block: the draws' standard error is the square root of BLOCK times a source's target.
BLOCK = 16
#: The same where the mix is written out, so that most texts stay whole or are cut into long runs.
TEXT_BLOCK = 256
#: Slots of a shard.
SHARD = 4096
ROUNDS = 16
#: Blocks that travel together: a row for each group of so many neighbours, not for each block.
GROUP = 64
#: Equal parts of [0, 1) in which a slot's number is looked up.
CELLS = 4096
SEED = 1
#: Documents of a source in one chunk of the prefix sums, about; shards in one chunk.
CHUNK_ROWS, CHUNK_SHARDS = 2_000, 4096


def uniform(*of: Column | str) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11) * F.lit(2.0**-53)


def sized(docs: DataFrame, *carried: Column) -> DataFrame:
    """doc_id, mark (a hash of the text), source and size, after the columns to be carried."""
    text = F.col("text").cast("string")
    return docs.select(*carried, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """A row a source: source, source_no, source_size, n_docs, total, target, and its interval [lo, hi) of the target shares.

    Targets share the total by weight, but none is above its limit of passes times the source's size. Sorted by limit
    over weight, those at their limit come first; the level that the others share follows from the sums up to there. The
    windows see one row a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    w = F.array(*[F.lit(float(x)) for x in weights])
    numbered = per.withColumn("source_no", F.row_number().over(by_name) - 1)
    known = numbered.withColumn("weight", F.element_at(w, (F.col("source_no") % len(weights) + 1).cast("int"))).withColumn("total", F.sum("source_size").over(every)).withColumn("limit", F.col("source_size") * float(passes))
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), "source_no")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    limits = F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = known.withColumn("level", (F.col("total") - limits) / left).withColumn("k", F.row_number().over(by_limit))
    free = F.min(F.when(F.col("limit") >= F.col("level") * F.col("weight"), F.struct("k", "level"))).over(every)
    shared = levels.withColumn("free", free).withColumn("target", F.when(F.col("k") < F.col("free.k"), F.col("limit")).otherwise(F.col("free.level") * F.col("weight")))
    upto = F.sum("target").over(Window.orderBy("source_no")) / F.sum("target").over(every)
    hi = F.when(F.col("source_no") == F.max("source_no").over(every), 1.0).otherwise(F.least(upto, F.lit(1.0)))
    ranged = shared.withColumn("hi", hi).withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("source_no")), F.lit(0.0)))
    return ranged.select("source", "source_no", "source_size", "n_docs", "total", "target", "lo", "hi")


def drawn(sources: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED, cells: int = CELLS) -> DataFrame:
    """A row for each source and shard with slots: source_no, shard, draws, n_blocks.

    Slots are made in as many tasks as there are partitions and looked up by the cell in which their number lies, so the
    work is even however large a source is, and however many there are.
    """
    spark = sources.sparkSession
    total = sources.agg(F.max("total")).first()[0] or 0
    slots = max(1, round(total / block)) if total else 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), slots >> 22)
    numbers = spark.range(0, slots, 1, tasks).select(F.floor(F.col("id") / shard).alias("shard"), uniform(F.lit(seed), "id").alias("u"))
    known = sources.where("source_size > 0").withColumn("n_blocks", F.ceil(F.col("source_size") / block))
    cell = lambda x: F.least(F.floor(x * cells), F.lit(cells - 1))
    ranges = known.select("source_no", "n_blocks", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("of"))
    met = numbers.join(ranges, (cell(F.col("u")) == F.col("of")) & (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    return met.groupBy("source_no", "shard", "n_blocks").agg(F.count("*").alias("draws")).select("source_no", "shard", "draws", "n_blocks")


def permuted(x: Column, n: Column, *key: Column, rounds: int = ROUNDS) -> Column:
    """The place of x under a keyed pseudorandom permutation of 0 .. n - 1.

    In each round, x and its mirror image about a keyed point either swap or stay, as a hash of the larger of them says;
    each round undoes itself, so all of them together are one to one for any n.
    """

    def one(at: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(*key, r), n) - at, n)
        return F.when(F.xxhash64(*key, r, F.greatest(at, mirror)).bitwiseAND(F.lit(1)) == 1, mirror).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x, one)


def taken_blocks(draws: DataFrame, passes: int = PASSES, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """source_no, group and blocks: those of a group of neighbouring blocks that the mix takes, by number in the group, each as often as taken."""
    numbered = starts(draws.withColumn("part", F.floor(F.col("shard") / CHUNK_SHARDS)), "source_no", "part", ["shard"], "draws", "first", "row")
    # Few rows become many slots: spread them by number, or they would all be coalesced into one task.
    spread = numbered.repartition(int(draws.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source_no", "shard")
    slots = spread.select("source_no", "n_blocks", F.explode(F.sequence("first", F.col("first") + F.col("draws") - 1)).alias("slot")).where(F.col("slot") < passes * F.col("n_blocks"))
    turn = F.floor(F.col("slot") / F.col("n_blocks"))
    place = permuted(F.col("slot") % F.col("n_blocks"), F.col("n_blocks"), F.lit(seed), F.col("source_no"), turn)
    placed = slots.select("source_no", place.alias("block")).select("source_no", F.floor(F.col("block") / group).alias("group"), (F.col("block") % group).cast("byte").alias("block"))
    return placed.groupBy("source_no", "group").agg(F.collect_list("block").alias("blocks"))  # at most passes * group of them


def overlaps(sizes: DataFrame, own: list[str], weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The documents with their source's figures, and a row for each one's part in a group of blocks.

    The first has source_no, source_size, target and part added; the second own, source_no, part, row (which together
    tell a document), first and upto (its words in its source's stream), begin (the group's first word) and blocks.
    """
    sources = stored(targets(sizes, weights, passes), "sources")
    taken = stored(taken_blocks(drawn(sources, block, shard, seed), passes, seed), "blocks").withColumnRenamed("group", "_group").withColumnRenamed("source_no", "_no")
    dealt = sizes.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    dealt = stored(dealt.withColumn("part", F.pmod(F.xxhash64("doc_id", "mark"), F.ceil(F.col("n_docs") / CHUNK_ROWS))), "dealt")
    placed = starts(dealt.where("size > 0"), "source_no", "part", ["doc_id", "mark", "size"], "size", "first", "row").withColumn("upto", F.col("first") + F.col("size"))
    words = block * GROUP
    groups = F.sequence(F.floor(F.col("first") / words), F.floor((F.col("upto") - 1) / words))
    keys = ["source_no", "part", "row"]
    pieces = placed.select(*own, *keys, "first", "upto", F.explode(groups).alias("group"))
    met = pieces.join(taken, (F.col("source_no") == F.col("_no")) & (F.col("group") == F.col("_group")), "left")
    return dealt, met.select(*own, *keys, "first", "upto", (F.col("group") * words).alias("begin"), "blocks")


def span(number: Column, block: int) -> tuple[Column, Column]:
    """Where the document's words in a block begin and end in its source's stream; the block counts from begin."""
    at = F.col("begin") + number * block
    return F.greatest(at, F.col("first")), F.least(at + block, F.col("upto"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """A row a document: doc_id, size, source_size, target, taken."""
    own = ["doc_id", "size", "source_size", "target"]
    dealt, met = overlaps(stored(sized(docs), "sizes"), own, weights, passes, block, shard, seed)

    def words(x: Column) -> Column:
        begin, end = span(x, block)
        return F.greatest(end - begin, F.lit(0))

    part = F.aggregate("blocks", F.lit(0).cast("long"), lambda n, x: n + words(x))
    taken = met.groupBy(*own, "source_no", "part", "row").agg(F.sum(F.coalesce(part, F.lit(0))).cast("long").alias("taken"))
    none = dealt.where("size = 0").select(*own, F.lit(0).cast("long").alias("taken"))
    return taken.select(*own, "taken").union(none).withColumn("target", F.col("target").cast("double"))


def resampled(docs: DataFrame, chars: str | None = None, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES, block: int = TEXT_BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """The mix as documents: for each of docs and each pass that takes words of it, a row with the text of those words.

    Rows keep their other columns; chars names one that holds the length of the text. Between words stands what stood
    after the first of them; a text of which all words are taken is left as it is. The words of a document's rows are in
    number what mixed() says that the mix takes of it.
    """
    row, size, spans, turn = (unused(docs, n) for n in ("of_row", "of_size", "spans", "turn"))
    known = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    _, met = overlaps(stored(sized(known, F.col(row).alias("_row")), "sizes"), ["_row", "size"], weights, passes, block, shard, seed)

    def piece(x: Column) -> Column:
        begin, end = span(x, block)
        return F.struct((begin - F.col("first")).alias("begin"), (end - begin).alias("words"), F.size(F.filter("blocks", lambda b: b == x)).alias("copies"))

    parts = F.filter(F.transform(F.array_sort(F.array_distinct("blocks")), piece), lambda x: x.words > 0)
    per = met.where("blocks is not null").select("_row", "size", F.explode(parts).alias("p")).groupBy(F.col("_row").alias("_of"), F.col("size").alias(size)).agg(F.sort_array(F.collect_list("p")).alias(spans))
    # One row a document: it grows with the documents, so it is never broadcast.
    found = known.join(stored(per, "spans").hint("merge"), F.col(row) == F.col("_of"))
    each = found.withColumn(turn, F.explode(F.sequence(F.lit(1), F.array_max(F.transform(spans, lambda x: x.copies)).cast("int"))))
    mine = F.filter(spans, lambda x: x.copies >= F.col(turn))
    whole = F.aggregate(mine, F.lit(0).cast("long"), lambda n, x: n + x.words) == F.col(size)
    text = F.col("text").cast("string")
    signs = F.regexp_extract_all(text, F.lit(rf"{WORD}[\x20\x09-\x0D]*"), F.lit(0))
    cut = lambda words: F.array_join(F.flatten(F.transform(mine, lambda x: F.slice(words, (x.begin + 1).cast("int"), x.words.cast("int")))), "")
    # An array of one, so that the words are found once and not for each span.
    part = F.rtrim(F.get(F.transform(F.array(signs), cut), F.lit(0)), F.lit(BLANKS))
    new = F.when(whole, text).otherwise(part)
    kinds = dict(docs.dtypes)
    return each.select(*[new.cast(kinds[c]).alias(c) if c == "text" else F.char_length(new).cast(kinds[c]).alias(c) if c == chars else F.col(c) for c in docs.columns])
