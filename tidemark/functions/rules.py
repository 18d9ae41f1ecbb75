"""Column expressions for lag, split and scaling rules, and for small scalar formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def lags_for_period(m) -> Column:
    """Number of lags for a seasonal period: at least 5, at most 12."""
    return F.least(F.lit(12), F.greatest(F.lit(5), F.lit(m) if isinstance(m, int) else m))


def effective_lags(n: Column, lags: Column) -> Column:
    """Very short series (fewer than 25 values) use two lags at most."""
    return F.when(n < 25, F.least(lags, F.lit(2))).otherwise(lags)


def round_half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("int")


def supervised_split(n_rows: Column, fraction: float = 0.85) -> Column:
    """Training rows among n supervised rows, halves rounded up."""
    return round_half_up(n_rows * F.lit(fraction))


def initial_train_size(n: Column, fraction: float = 0.85) -> Column:
    """Training values among n raw values, halves rounded to even; null unless it is 10 at least and less than n."""
    size = F.bround(n * F.lit(fraction), 0).cast("int")
    return F.when((size >= 10) & (size < n), size)


def floor_split(n: Column, fraction: float = 0.8) -> Column:
    return F.floor(n * F.lit(fraction)).cast("int")


def truncated_split(n: Column, fraction: float = 0.8) -> Column:
    return (n * F.lit(fraction)).cast("int")


def tail_size(n: Column, lags: Column) -> Column:
    """Validation rows at the end of n pre-test values: a fifth of the supervised rows, 8 at least; null if under 11 stay."""
    rows = n - lags
    size = F.greatest(F.lit(8), F.floor(rows * F.lit(0.2))).cast("int")
    return F.when(rows - size >= 11, size)


def inner_validation_size(n: Column, lags: Column) -> Column:
    """Inner validation values: a fifth rounded up, 5 at least, leaving ten supervised rows; null if that isn't possible."""
    size = F.least(F.greatest(F.lit(5), F.ceil(n * F.lit(0.2))), n - lags - 10).cast("int")
    return F.when(size >= 5, size)


def period_of_frequency(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.contains("month"), 12).when(low.contains("quarter"), 4).otherwise(1)


def safe_divide(a: Column, b: Column) -> Column:
    """a / b; null where b is 0 or either isn't finite."""
    finite = ~F.isnan(a) & ~F.isnan(b) & (F.abs(a) < float("inf")) & (F.abs(b) < float("inf"))
    return F.when(finite & (b != 0), a / F.nullif(b, F.lit(0.0)))


def constriction(phi: Column) -> Column:
    """2 / (phi - 2 + sqrt(phi^2 - 4 phi)) for phi over 4, else null."""
    return F.when(phi > 4, F.lit(2.0) / (phi - 2 + F.sqrt(phi * phi - 4 * phi)))


def clip(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def resolved(requested: Column, configured: Column, default, quick: Column | None = None, cap: int = 5) -> Column:
    """A parameter as requested, else as configured, else the default; quick runs hold it to ``cap``."""
    value = F.coalesce(requested, configured, F.lit(default))
    return value if quick is None else F.when(quick, F.least(value, F.lit(cap))).otherwise(value)


def method_list(names: Column, known: list[str], aliases: dict[str, str], period: Column) -> Column:
    """Known methods of a text of names with commas between, in order, each once; a seasonal one needs a season."""

    def plain(s: Column) -> Column:
        out = F.lower(F.trim(s))
        for alias, name in aliases.items():
            out = F.when(out == alias, name).otherwise(out)
        return out

    wanted = F.transform(F.split(names, ","), plain)
    return F.array_distinct(F.filter(wanted, lambda s: s.isin(known) & ((s != "seasonal_naive") | (period > 1))))


def key_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def row_key(*parts: Column) -> Column:
    return F.concat_ws(" | ", *(p.cast("string") for p in parts))


def format_p(p: Column) -> Column:
    """'--' where missing; scientific below 0.001, else four decimals."""
    return F.when(p.isNull() | F.isnan(p), "--").when(p < 1e-3, F.format_string("%.2e", p)).otherwise(F.format_string("%.4f", p))


def latex_escape(s: Column) -> Column:
    """Escapes & % _ #, unless the text already has a backslash or a dollar sign."""
    out = s
    for c in "&%_#":
        out = F.replace(out, F.lit(c), F.lit("\\" + c))
    return F.when(s.contains("\\") | s.contains("$"), s).otherwise(out)


def safe_name(s: Column) -> Column:
    return F.regexp_replace(s, "[^A-Za-z0-9_-]", "_")
