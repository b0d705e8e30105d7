"""Scalar columns: bounded curves, gates and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(float(high))), F.lit(float(low))))


def scaled_sigmoid(x: Column, scale: float = 1.5) -> Column:
    """From -1 to 1, with slope 1 / (2 scale) at 0."""
    return 2 / (1 + F.exp(-x / scale)) - 1


def soft_bound(x: Column, bound: float = 100.0) -> Column:
    return bound * F.tanh(x / bound)


def gate(x: Column, low: float, high: float, floor: float = 0.02, missing: float = 0.5) -> Column:
    """0 at low to 1 at high, in a straight line, never under floor; `missing` for null."""
    return F.coalesce(F.greatest(F.least((x - low) / (high - low), F.lit(1.0)), F.lit(floor)), F.lit(missing))


def normal_cdf(x: Column) -> Column:
    """The normal distribution function, by a rational approximation with an error under 7.5e-8."""
    # Coefficients of Abramowitz and Stegun 26.2.17.
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-x * x / 2) / 2.5066282746310002 * poly
    return F.when(x >= 0, 1 - upper).otherwise(upper)


def probit(p: Column) -> Column:
    """The normal quantile of p, by a rational approximation with an error under 4.5e-4; null outside (0, 1)."""
    # Coefficients of Abramowitz and Stegun 26.2.23.
    t = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    x = t - (2.515517 + t * (0.802853 + t * 0.010328)) / (1 + t * (1.432788 + t * (0.189269 + t * 0.001308)))
    return F.when((p > 0) & (p < 1), F.when(p < 0.5, -x).otherwise(x))


def tape_symbol(text: Column, names: dict[str, str]) -> Column:
    """A ticker without its mark and end, or its short name."""
    symbol = F.regexp_replace(F.regexp_replace(F.upper(F.trim(text)), r"^\^", ""), r"(\.[A-Z]{1,3}|=[FX])$", "")
    out = symbol
    for name, short in names.items():
        out = F.when(symbol == name, short).otherwise(out)
    return out


def one_hot(value: Column, classes: list[str]) -> Column:
    """An array with true at the place of value in classes."""
    return F.array(*[F.coalesce(value == c, F.lit(False)) for c in classes])


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-clip(x, -30, 30)))


def decay(half_life: Column | float) -> Column:
    """The factor for each step that halves a weight in half_life steps."""
    return F.exp(-F.log(F.lit(2.0)) / half_life)


def with_default(m: Column, key: str, default) -> Column:
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(default))


#: The ends of a ticker that name its exchange, in order; futures stand under one, currencies under weekdays.
EXCHANGES = ((".NS", "XNSE"), (".BO", "XNSE"), ("=F", "CMES"), ("=X", "WEEK"), (".L", "XLON"), (".T", "XTKS"), (".HK", "XHKG"), (".DE", "XETR"), (".PA", "XPAR"))
#: Indices by name.
INDICES = {"^NSEI": "XNSE", "^BSESN": "XNSE", "^FTSE": "XLON", "^N225": "XTKS", "^HSI": "XHKG", "^GDAXI": "XETR", "^FCHI": "XPAR"}


def exchange_of(ticker: Column, other: str = "XNYS") -> Column:
    """The exchange of a ticker by its end, or by name for an index."""
    out = F.lit(other)
    for end, exchange in reversed(EXCHANGES):
        out = F.when(ticker.endswith(end), exchange).otherwise(out)
    for name, exchange in INDICES.items():
        out = F.when(ticker == name, exchange).otherwise(out)
    return out


def clean_symbol(text: Column) -> Column:
    """Upper case, trimmed, with - for a dot; null unless 1 to 6 characters long."""
    symbol = F.replace(F.upper(F.trim(text)), F.lit("."), F.lit("-"))
    return F.when(F.length(symbol).between(1, 6), symbol)


def zone(z: Column) -> Column:
    """Bands of a z-score at 1 and 2."""
    return (
        F.when(z.isNull(), "N/A").when(z > 2, "Extreme Over").when(z > 1, "Overvalued").when(z > -1, "Fair Value").when(z > -2, "Undervalued").otherwise("Extreme Under")
    )


def fixed(x: Column, digits: int = 6) -> Column:
    """x to so many digits; values a hair under a half go up, so that sums in another order give the same."""
    return F.floor(x * 10**digits + 0.501) / 10**digits


#: Name patterns of asset classes, in order; the first that is found holds.
CLASSES = (
    ("(?i)treasury|bond|yield|gilt", "Rates"),
    ("(?i)gold|silver|copper|platinum|steel|brass|tin|nickel", "Metals"),
    ("(?i)oil|gas|brent|fuel", "Energy"),
    ("(?i)wheat|corn|soy|sugar|coffee", "Softs"),
    ("(?i)usd|eur|jpy|fx", "FX"),
)


def asset_class(name: Column) -> Column:
    out = F.lit("Other")
    for pattern, label in reversed(CLASSES):
        out = F.when(F.coalesce(name.rlike(pattern), F.lit(False)), label).otherwise(out)
    return out
