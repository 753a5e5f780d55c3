"""Vector expressions over ARRAY<FLOAT>/ARRAY<DOUBLE> columns, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision; null if the lengths differ."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x))


METRICS = {"cosine": cosine, "dot": dot, "ip": dot, "euclid": lambda a, b: -l2(a, b), "l2": lambda a, b: -l2(a, b)}


def similarity(metric: str, a: Column, b: Column) -> Column:
    """Greater is nearer, by the engine's metric name in any case."""
    try:
        return METRICS[metric.lower()](a, b)
    except KeyError:
        raise ValueError(f"metric {metric!r} is none of {sorted(METRICS)}") from None


def bbox_centre_distance(a: Column, b: Column) -> Column:
    """Distance between the centres of two boxes [x0, y0, x1, y1]."""
    centre = lambda box, i: (F.get(box, i) + F.get(box, i + 2)) / 2
    return F.sqrt(F.pow(centre(a, 0) - centre(b, 0), 2) + F.pow(centre(a, 1) - centre(b, 1), 2))


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_vector(text: Column) -> Column:
    """A deterministic embedding inside the JVM: how often each Latin letter occurs; null for a null text or one without letters."""
    low = F.lower(text)
    counts = F.array(*((F.length(low) - F.length(F.replace(low, F.lit(x), F.lit("")))).cast("double") for x in LETTERS))
    return F.when(low.rlike("[a-z]"), counts)


def letters_of(text: str) -> list[float]:
    """The same of a question, on the driver."""
    return [float(text.lower().count(x)) for x in LETTERS]
