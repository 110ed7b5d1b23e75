"""Scalar expressions: scale repair of model numbers, names and paths, number text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def coordinate(value: Column) -> Column:
    """Model coordinate to 0..1; anything above 1 is read on the 0..1000 scale."""
    return _unit(value, 1000.0)


def confidence(value: Column) -> Column:
    """Model confidence to 0..1; anything above 1 is read as a percentage."""
    return _unit(value, 100.0)


def _unit(value: Column, scale: float) -> Column:
    scaled = F.when(value > 1.0, value / F.lit(scale)).otherwise(value)
    # greatest and least skip nulls, so a missing value has to be kept apart
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)))


def strip(text: Column) -> Column:
    """Trim white space of any kind, not only blanks."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_name(path: Column) -> Column:
    """Name of the folder that holds the file, empty when the path has none."""
    return F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)


def stem(name: Column) -> Column:
    """File name without its last extension; a leading dot does not start one."""
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")


def join_path(folder: str | Column, name: Column) -> Column:
    if isinstance(folder, str):
        folder = F.lit(folder.rstrip("/"))
    return F.concat(folder, F.lit("/"), name)


# Media types by file extension, anything else counts as JPEG.
MEDIA_TYPES = {
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "png": "image/png",
    "webp": "image/webp",
}
IMAGE_NAME_PATTERN = r"(?i)\.(png|jpe?g)$"


def media_type(path: Column) -> Column:
    extension = F.lower(F.substring_index(path, ".", -1))
    chosen = F.lit("image/jpeg")
    for suffix, media in MEDIA_TYPES.items():
        chosen = F.when(extension == suffix, media).otherwise(chosen)
    return chosen


def is_image_name(name: Column) -> Column:
    return name.rlike(IMAGE_NAME_PATTERN)


def base64_text(content: Column) -> Column:
    """Base64 in one line; the built-in breaks its output every 76 characters."""
    return F.translate(F.base64(content), "\r\n", "")


def fixed(value: Column, decimals: int) -> Column:
    """Text with so many decimals of the exact binary value, halves to the even one.

    The built-in rounds the shortest text of the number instead; that differs only next to the middle of two steps, so only
    there the product with the scale is worked out exactly, as a sum of two doubles. Elsewhere the nearest step is that of the
    rounded product; zero, which may be negative, and large numbers are left to the built-in.
    """
    scale = float(10**decimals)
    if scale > 2**26:
        raise ValueError("at most 7 decimals")

    def exact(v: Column) -> Column:
        size = F.abs(v)
        split = size * F.lit(134217729.0)  # 2^27 + 1 parts the digits into halves whose products with the scale are exact
        high = split - (split - size)
        product, rest = high * F.lit(scale), (size - high) * F.lit(scale)
        below = F.floor(product + rest)
        beyond = product - below.cast("double") - F.lit(0.5)
        up = (beyond > -rest) | ((beyond == -rest) & (below % 2 == 1))
        return written(v, below + up.cast("bigint"))

    def written(v: Column, steps: Column) -> Column:
        whole, part = F.floor(steps / F.lit(scale)).cast("string"), F.lpad((steps % F.lit(10**decimals)).cast("string"), decimals, "0")
        return F.concat(F.when(v < 0, "-").otherwise(""), whole, F.lit("."), part)

    def text(v: Column) -> Column:
        size = F.abs(v) * F.lit(scale)
        small = size < 2.0**40
        near = (F.abs(size - F.floor(size) - 0.5) < 1e-3) & small
        rounded = F.when(small & (v != 0), written(v, F.floor(size + 0.5))).otherwise(F.format_string(f"%.{decimals}f", v))
        return F.when(near, F.get(F.transform(F.array(v), exact), 0)).otherwise(rounded)

    return text(value.cast("double"))


def plain_number(value: Column) -> Column:
    """Text of a double as most languages print it: ``0.00012`` and ``1.2e-05``, not ``1.2E-4``."""
    text = value.cast("string")
    mantissa = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
    digits = F.translate(mantissa, ".-", "")
    sign = F.when(value < 0, "-").otherwise("")
    exponent = F.substring_index(text, "E", -1)
    return (
        F.when(~text.contains("E"), text)
        .when(exponent == "-4", F.concat(sign, F.lit("0.000"), digits))
        .when(exponent.startswith("-"), F.concat(mantissa, F.lit("e-"), _two_digits(F.ltrim(F.translate(exponent, "-", "")))))
        .otherwise(text)
    )


def _two_digits(number: Column) -> Column:
    return F.when(F.length(number) < 2, F.concat(F.lit("0"), number)).otherwise(number)


def uncertainty(consistency: Column, mean_confidence: Column) -> Column:
    return F.lit(1.0) - (consistency + mean_confidence) / 2


def reliability(uncertainty_score: Column) -> Column:
    return F.coalesce(F.lit(1.0) - uncertainty_score, F.lit(1.0))
