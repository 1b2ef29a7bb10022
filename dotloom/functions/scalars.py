"""Scalar and array functions that the operators share, as column expressions."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(a, b) -> Column:
    """a / b, and 0 where b is 0 or missing."""
    return F.coalesce(F.try_divide(_column(a), _column(b)), F.lit(0.0))


def clamp(x: Column, low: float, high: float) -> Column:
    """The value within [low, high]."""
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def sigmoid(x: Column) -> Column:
    """1 / (1 + exp(-x))."""
    return 1 / (1 + F.exp(-x))


def log_odds(p: Column, eps: float = 1e-6) -> Column:
    """The logit of a probability, kept off 0 and 1."""
    return bound(clamp(p, eps, 1 - eps), lambda q: F.log(q / (1 - q)))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, also where ``f`` uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), f), 1)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """L2 norm of an array of doubles, at least 1e-12."""
    return F.greatest(F.sqrt(dot(a, a)), F.lit(1e-12))


def normalised(a: Column) -> Column:
    """The array divided by its L2 norm."""
    return bound(norm(a), lambda n: F.transform(a, lambda x: x / n))


def round_half_even(x: Column, digits: int = 4) -> Column:
    """The decimal of so many digits that is closest to the exact value of the double, the even one of two; as Python rounds.

    The product with 2 * 10**digits is split into two exact parts, so that its place against a tie is known.
    """
    scale = float(10**digits)
    k = F.floor(x * scale + 0.5).cast("double")
    high = x * 134_217_729.0 - (x * 134_217_729.0 - x)
    low = x - high

    def beyond(tie):
        return (high * (2 * scale) - tie) + low * (2 * scale)

    below, above = beyond(2 * k - 1), beyond(2 * k + 1)
    odd = k % 2 != 0
    got = F.when((below < 0) | ((below == 0) & odd), k - 1).when((above > 0) | ((above == 0) & odd), k + 1).otherwise(k)
    return got / scale


def stem(name: str) -> Column:
    """A file name without its last extension; a leading dot is none."""
    return F.regexp_replace(F.col(name), r"(?<=[^/.])\.[^./]*$", "")


def image_file(file: str = "file_name", image_id: str = "image_id") -> Column:
    """The file name, or the image id with .jpg where it is null or empty."""
    return F.coalesce(F.nullif(F.col(file), F.lit("")), F.concat(F.col(image_id).cast("string"), F.lit(".jpg")))


def cache_name(image_id: str = "image_id") -> Column:
    """File name of an image's cache entry: the id with twelve digits."""
    return F.lpad(F.col(image_id).cast("string"), 12, "0")
