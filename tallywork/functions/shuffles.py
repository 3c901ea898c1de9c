"""Keyed permutations of 0 .. n - 1 as columns: each number finds its place by itself, so nothing is sorted or exchanged."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallywork.functions import expr


def rounds(n: int) -> int:
    """Rounds after which a number may be anywhere: some for each bit of n."""
    return 8 + 4 * max(n - 1, 1).bit_length()


def permuted(number: Column, n: int, seed: str, *keys: expr.Key) -> Column:
    """Where number goes in the keys' permutation of 0 .. n - 1, one at random for each seed and keys.

    In each round every number has a partner, the two adding up to the round's key modulo n; a coin thrown for the pair, by
    the larger of them, says whether they change places.
    """

    def swapped(x: Column, r: Column) -> Column:
        partner = F.pmod(expr.index(n, f"{seed}/key", *keys, r) - x, F.lit(n).cast("long"))
        return F.when(expr.uniform(f"{seed}/coin", *keys, r, F.greatest(x, partner)) < 0.5, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds(n) - 1)), number.cast("long"), swapped)


def permuted_sql(number: str, n: int, seed: str, *keys: str) -> str:
    """permuted() in DuckDB's SQL."""
    partner = f"((floor({expr.uniform_sql(f'{seed}/key', *keys, 'r')} * {n})::bigint - x + {n}) % {n})"
    return f"list_reduce(range({rounds(n)}), lambda x, r: case when {expr.uniform_sql(f'{seed}/coin', *keys, 'r', f'greatest(x, {partner})')} < 0.5 then {partner} else x end, ({number})::bigint)"
