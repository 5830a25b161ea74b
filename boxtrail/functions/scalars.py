"""Scalar functions: names, phrases, ratios, scores, vectors. All are Columns unless said otherwise."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Weights of event reasons; others count DEFAULT_PRIORITY.
PRIORITIES = {"new_track": 3.0, "unknown_track": 3.0, "low_confidence": 2.5, "periodic_refresh": 1.0}
DEFAULT_PRIORITY = 2.0
SEVERITIES = ("info", "warning", "high", "critical")


def class_name(name: Column) -> Column:
    """Trimmed, lower case, white space and hyphens as single underscores."""
    joined = F.regexp_replace(F.lower(F.trim(name)), r"[\s\-]+", "_")
    return F.regexp_replace(F.regexp_replace(joined, "_+", "_"), "^_|_$", "")


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def phrase(text: Column, normalize: bool = True) -> Column:
    """Lower case letters a-z and digits with single spaces; normalize: bring compatibility characters to their plain forms first."""
    plain = nfkc(text) if normalize else text
    spaced = F.regexp_replace(F.lower(plain), r"[_\-]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(spaced, r"[^a-z0-9 ]+", " "), " +", " "))


def ratio_or_null(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def ratio_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(ratio_or_null(a, b), F.lit(0.0))


def f1(precision: Column, recall: Column, empty: Column | None = None) -> Column:
    """Harmonic mean; a zero sum gives empty, 0 by default."""
    return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0) if empty is None else empty)


def json_safe(value: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def or_default(value: Column, default) -> Column:
    """A missing or zero value as the default."""
    return F.coalesce(F.nullif(value, F.lit(0)), F.lit(default))


def stable_id(prefix: str, *columns: str, digits: int = 16) -> Column:
    text = F.to_json(F.struct(*sorted(columns)))
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(text, 256), 1, digits))


def event_priority(reason: Column, quality: Column, confidence: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in PRIORITIES.items() for x in pair])
    return F.round(F.coalesce(table[reason], F.lit(DEFAULT_PRIORITY)) + quality + 0.25 * F.coalesce(confidence, F.lit(0.0)), 6)


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)


def refresh_multiplier(label: Column, specific: Column) -> Column:
    """1 without a label, 20 for a specific one, else 4."""
    return F.when(label.isNull(), 1).when(specific, 20).otherwise(4)


def crop_score(area: Column, visible: Column, confidence: Column) -> Column:
    return F.log1p(area) * visible * (0.5 + 0.5 * F.coalesce(confidence, F.lit(0.5)))


def crop_reasons(width: Column, height: Column, area: Column, visible: Column, sharpness: Column, least: dict[str, float]) -> Column:
    """Names of the quality gates that a crop fails, in order."""
    tests = [
        (F.coalesce((width <= 0) | (height <= 0), F.lit(True)), "invalid"),
        (width < least["width"], "narrow"),
        (height < least["height"], "short"),
        (area < least["area"], "small"),
        (visible < least["visible"], "clipped"),
        (sharpness < least["sharpness"], "blurry"),
    ]
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in tests]))


def crop_quality(area: Column, visible: Column, reasons: Column, least_area: float) -> Column:
    score = visible * F.least(F.lit(1.0), area / F.lit(4 * least_area))
    return F.when(F.size(reasons) > 0, F.least(score, F.lit(0.25))).otherwise(score)


def queue_quality(sharp: Column, bright: Column, size: Column, confidence: Column, visible: Column) -> Column:
    return 0.30 * sharp + 0.20 * bright + 0.20 * size + 0.20 * confidence + 0.10 * visible


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def is_embedding(a: Column, size: int | None = None) -> Column:
    """Not empty, all finite, not all zero and, where size is given, so long."""
    fine = F.coalesce((F.size(a) > 0) & F.forall(a, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    return fine & (norm(a) > 0) & (F.lit(True) if size is None else F.size(a) == size)


def l2_normalized(a: Column) -> Column:
    return F.transform(a, lambda v: v.cast("double") / norm(a))


def cosine(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot(a, b), norm(a) * norm(b))))


def cosine01(a: Column, b: Column) -> Column:
    return (cosine(a, b) + 1) / 2


def nearest_rank(values: Column, q: float) -> Column:
    """Of a sorted array the element at min(round half even(q * (n - 1)), n - 1); null if empty."""
    n = F.size(values)
    return F.when(n > 0, F.element_at(values, F.least(F.bround(F.lit(q) * (n - 1)).cast("int"), n - 1) + 1))


def exclusive_quantile(values: Column, q: float) -> Column:
    """Of a sorted array by h = q * (n + 1), between neighbours; at least two values, else the only one."""
    n, h = F.size(values), F.lit(q) * (F.size(values) + 1)
    low = F.greatest(F.lit(1), F.least(n - 1, F.floor(h).cast("int")))
    between = F.element_at(values, low) + (h - low) * (F.element_at(values, low + 1) - F.element_at(values, low))
    return F.when(n > 1, between).when(n == 1, F.element_at(values, 1))


def parse_boxes(text: Column) -> Column:
    """Boxes of `<box>x1,y1,x2,y2</box>` tags as an array of structs with the values, null where they are no four numbers."""
    found = F.regexp_extract_all(text, F.lit(r"<box>([^<]*)</box>"), F.lit(1))
    values = lambda t: F.transform(F.split(F.regexp_replace(t, r"[\s()\[\]]", ""), ","), lambda v: v.try_cast("double"))
    return F.transform(found, lambda t: F.when(F.size(F.array_compact(values(t))) == 4, values(t)))


def redact_credentials(url: Column) -> Column:
    return F.regexp_replace(url, r"://[^/@\s]+@", "://***@")
