"""Column expressions: counter-based random numbers, thresholds, guarded ratios."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Key = Column | str | int


def _col(key: Key) -> Column:
    return F.lit(str(key)) if isinstance(key, int) else F.lit(key) if isinstance(key, str) and key.startswith("'") else F.col(key).cast("string") if isinstance(key, str) else key.cast("string")


def uniform(seed: str, *keys: Key) -> Column:
    """A number in [0, 1) from md5 of the seed and keys; any engine with md5 draws the same."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), *map(_col, keys)).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform_sql(seed: str, *keys: str) -> str:
    """uniform() in DuckDB's SQL."""
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(keys)})), 1, 8))::bigint / 4294967296.0::double)"


def sign(seed: str, *keys: Key) -> Column:
    return F.when(uniform(seed, *keys) < 0.5, -1.0).otherwise(1.0)


#: Bits of one md5, and how many of them make a word.
DIGEST_BITS, LANE = 128, 32


def lane_bits_sql(seed: str, lane: str, *keys: str) -> str:
    """The word that signs() takes for a lane in DuckDB's SQL."""
    per = DIGEST_BITS // LANE
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', {lane} // {per}, {', '.join(keys)})), ({lane} % {per} * {LANE // 4} + 1)::int, {LANE // 4}))::bigint"


#: A Poisson number of mean 1 from 16 bits: it is as many as there are limits not above them.
POISSON_BITS = 16
POISSON = tuple(t for k in range(12) if (t := int(2**POISSON_BITS * sum(math.exp(-1.0) / math.factorial(j) for j in range(k + 1)))) < 2**POISSON_BITS)
#: Weights that one md5 gives.
WEIGHTS = DIGEST_BITS // POISSON_BITS


def digests(seed: str, first: Column, n: int, *keys: Key) -> Column:
    """The md5 of seed, number and keys for n numbers from first on, one after the other as bytes."""
    return F.unhex(F.concat(*[F.md5(F.concat_ws("|", F.lit(seed), (first + j).cast("string"), *map(_col, keys)).cast("binary")) for j in range(n)]))


def signs(digest: np.ndarray) -> np.ndarray:
    """Rows of digests (bytes) as 1 and -1, DIGEST_BITS a digest; number LANE * lane + k has bit k of the lane's 32-bit word."""
    words = digest.reshape(len(digest), -1, LANE // 8)[:, :, ::-1]
    return 1.0 - 2.0 * np.unpackbits(words.reshape(len(digest), -1), axis=1, bitorder="little")


def weights(digest: np.ndarray) -> np.ndarray:
    """Rows of digests (bytes) as Poisson numbers of mean 1, WEIGHTS a digest."""
    return np.searchsorted(POISSON, np.arange(2**POISSON_BITS), "right").astype(np.float64)[digest.view(">u2")]


def poisson_sql(seed: str, number: str, *keys: str) -> str:
    """The number-th of weights() in DuckDB's SQL."""
    word = f"('0x' || substr(md5(concat_ws('|', '{seed}', {number} // {WEIGHTS}, {', '.join(keys)})), ({number} % {WEIGHTS} * 4 + 1)::int, 4))::int"
    return f"len(list_filter({list(POISSON)}, lambda t: t <= {word}))"


def index(n: Key, seed: str, *keys: Key) -> Column:
    """A place in 0 .. n - 1."""
    return F.floor(uniform(seed, *keys) * (F.lit(n) if isinstance(n, int) else F.col(n) if isinstance(n, str) else n)).cast("long")


def normal(seed: str, *keys: Key) -> Column:
    """Standard normal, from two uniforms."""
    a = F.greatest(uniform(f"{seed}/a", *keys), F.lit(1e-12))
    return F.sqrt(-2.0 * F.log(a)) * F.cos(2.0 * F.pi() * uniform(f"{seed}/b", *keys))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a / F.nullif(b, F.lit(0.0))


def beats(score: Column, higher_is_better: Column, threshold: Column) -> Column:
    """Reached the threshold; equal counts."""
    return F.when(higher_is_better, score >= threshold).otherwise(score <= threshold)


def medal_ranks(n: Column) -> Column:
    """struct(gold, silver, bronze): how many of n teams get a medal or better, by size of the field."""
    whole = lambda x: F.floor(x).cast("long")
    share = lambda f: whole(n * F.lit(f))
    tiers = [(n < 100, (share(0.1), share(0.2), share(0.4))), (n < 250, (F.lit(10), F.lit(20), share(0.4))), (n < 1000, (10 + share(0.002), F.lit(50), F.lit(100)))]
    large = (10 + share(0.002), share(0.05), share(0.1))
    raw = [reduce(lambda rest, t, k=k: F.when(t[0], t[1][k]).otherwise(rest), reversed(tiers), large[k]) for k in range(3)]
    gold = F.greatest(raw[0].cast("long"), F.lit(1).cast("long"))
    silver = F.least(F.greatest(raw[1].cast("long"), gold), n.cast("long"))
    bronze = F.least(F.greatest(raw[2].cast("long"), silver), n.cast("long"))
    return F.struct(gold.alias("gold"), silver.alias("silver"), bronze.alias("bronze"))


def medal_label(gold: Column, silver: Column, bronze: Column, above: Column) -> Column:
    return F.when(gold, "gold").when(silver, "silver").when(bronze, "bronze").when(above, "above median").otherwise("-")


#: What reads as a number: sign, digits with single underscores between them, fraction, exponent; or nan and inf.
NUMBER = r"^\s*[+-]?(?:(?:[0-9](?:_?[0-9])*)(?:\.(?:[0-9](?:_?[0-9])*)?)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?\s*$"
SPECIAL = r"(?i)^\s*([+-]?)(nan|inf|infinity)\s*$"


def parsed_number(raw: Column) -> Column:
    """raw as a double, null where it isn't a number; nan and infinities as such."""
    special = F.lower(F.regexp_extract(raw, SPECIAL, 2))
    value = F.when(special == "nan", F.lit(float("nan"))).when(special != "", F.when(F.regexp_extract(raw, SPECIAL, 1) == "-", F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
    return F.when(raw.rlike(SPECIAL), value).when(raw.rlike(NUMBER), F.regexp_replace(F.trim(raw), "_", "").try_cast("double"))


def sigmoid(z: Column) -> Column:
    return F.when(z >= 0, 1.0 / (1.0 + F.exp(-F.abs(z)))).otherwise(F.exp(-F.abs(z)) / (1.0 + F.exp(-F.abs(z))))


def log_sigmoid(z: Column) -> Column:
    """log of the logistic function, without overflow."""
    return F.least(z, F.lit(0.0)) - F.log1p(F.exp(-F.abs(z)))


def before_last(key: Column, delimiter: str) -> Column:
    """What precedes the last delimiter."""
    return F.regexp_extract(key, f"^(.*){delimiter}", 1)


def percentile_of(score: Column, leaderboard: Column, higher_is_better: Column) -> Column:
    """Share of a leaderboard (an array) that score strictly beats; null for an empty one."""
    beaten = F.size(F.filter(leaderboard, lambda x: F.when(higher_is_better, score > x).otherwise(score < x)))
    return ratio(beaten.cast("double"), F.size(leaderboard).cast("double"))


def pvalue_floor(n_units: Column, n_permutations: int = 9999, exact_up_to: int = 15) -> Column:
    """The smallest p-value that n paired units can give."""
    return F.when(n_units <= exact_up_to, 3.0 / (F.pow(F.lit(2.0), n_units) + 1.0)).otherwise(1.0 / (n_permutations + 1.0))
