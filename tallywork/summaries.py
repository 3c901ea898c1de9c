"""Results as lines of text: each takes the rows of an operator and gives a column line, so that lists of any length can be written out by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def percent(x: Column | str, places: int = 1) -> Column:
    """A share as a percentage, a dash where it is unknown."""
    c = F.col(x) if isinstance(x, str) else x
    return F.when(c.isNull(), "-").otherwise(F.format_string(f"%.{places}f%%", 100.0 * c))


def signed(x: str, places: int = 3) -> Column:
    return F.when(F.col(x).isNull(), "-").otherwise(F.format_string(f"%+.{places}f", F.col(x)))


def lines(rows: DataFrame, *parts: Column | str, keep: tuple[str, ...] = ()) -> DataFrame:
    return rows.select(*keep, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("line"))


def text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("-"))


def compared(rows: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Of inference.compared: the difference, its interval at 1 - alpha, p-value, verdict and warnings."""
    verdict = F.when(F.col("regression"), "a regression").when(F.col("significant"), "significant").when(F.col("underpowered"), "no verdict possible with so few units").otherwise("not significant")
    warned = F.when(F.col("warnings") != "", F.concat(F.lit(" ("), F.col("warnings"), F.lit(")"))).otherwise("")
    return lines(rows, signed("difference"), f" [{100 * (1 - alpha):g}% interval ", signed("ci_low"), " to ", signed("ci_high"), "], p = ", F.format_string("%.4f", "p_value"), " over ", text("n_units"), " units: ", verdict, warned)


def powered(rows: DataFrame) -> DataFrame:
    """Of inference.power: the power at each effect."""
    return lines(rows, "effect ", signed("effect"), ": found in ", percent("power"), " of experiments", keep=("effect",))


def outcomes(rows: DataFrame) -> DataFrame:
    """Of triage.counts: how often each outcome occurred."""
    return lines(rows, text("outcome"), ": ", text("n"), keep=("ord",))


def suites(rows: DataFrame) -> DataFrame:
    """Of ctt.report: size, reliability against chance, strata, flagged items and notes."""
    flagged = [x for k in ("dead", "weak", "trap") for x in (f", {k}: ", F.size(f"{k}_items").cast("string"))]
    noted = F.when(F.col("notes") != "", F.concat(F.lit("; "), F.col("notes"))).otherwise("")
    return lines(rows, text("n_items"), " items, ", text("n_subjects"), " subjects: reliability ", F.format_string("%.3f", "alpha"), " (by chance up to ", F.format_string("%.3f", "null_p95"), "), ", F.format_string("%.1f", "strata"), " strata", *flagged, noted)


def skills(rows: DataFrame) -> DataFrame:
    """Of skills.cells: what each challenge costs each agent, and whether it stands out of the noise."""
    lost = F.when(F.col("broke"), "broken in all pairs").otherwise(F.concat(signed("delta"), F.when(F.col("partially_broke"), F.concat(F.lit(", "), text("n_broken"), F.lit(" of "), text("n_pairs"), F.lit(" pairs broken"))).otherwise(""), F.when(F.col("p_value") < 0.05, " *").otherwise("")))
    return lines(rows, text("agent"), " under ", text("challenge"), ": ", lost, keep=("agent", "challenge"))


def estimates(rows: DataFrame) -> DataFrame:
    """Of subset.summary: how far each selector and estimator are off."""
    return lines(rows, text("selector"), " of ", text("k"), ", ", text("estimator"), ": off by ", percent("mae", 2), " on average, ", percent("max_error", 2), " at worst, bias ", F.format_string("%+.2f%%", 100.0 * F.col("bias")), keep=("selector", "estimator", "k"))


def attenuations(rows: DataFrame) -> DataFrame:
    """Of irt.attenuated: how much slopes shrink, and what is recovered."""
    return lines(rows, "slopes come back at ", F.format_string("%.3f", "slope"), " of their size (sd ", F.format_string("%.3f", "slope_sd"), "), abilities at r = ", F.format_string("%.3f", "ability_recovery"), ", difficulties at r = ", F.format_string("%.3f", "difficulty_recovery"), ", over ", text("n_draws"), " draws")
