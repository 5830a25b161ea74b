"""Recovery of JSON objects from free text, as model output comes."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys of a list of predictions, and the names of each field in order of precedence.
LIST_KEYS = ("track_predictions", "p", "predictions")
FIELDS = {
    "track_id": ("id", "track_id"),
    "label": ("class", "l", "label", "class_label"),
    "fine_label": ("subtype", "f", "fine", "fine_label"),
    "confidence": ("q", "conf", "confidence"),
    "fine_confidence": ("sq", "fq", "fine_conf", "fine_confidence"),
    "color": ("color", "c"),
}
ROW = "track_id long, label string, fine_label string, confidence double, fine_confidence double, color string"


def balanced(text: str) -> list[str]:
    """Substrings from each `{` to its closing bracket, outermost first, in order; strings are skipped over."""
    out, start, depth, quoted, escaped = [], 0, 0, False, False
    for i, ch in enumerate(text):
        if quoted:
            quoted, escaped = not (ch == '"' and not escaped), ch == "\\" and not escaped
        elif ch == '"' and depth:
            quoted = True
        elif ch == "{":
            start = i if depth == 0 else start
            depth += 1
        elif ch == "}" and depth:
            depth -= 1
            if depth == 0:
                out.append(text[start : i + 1])
    return out


def first_object(text: str | None, keys: tuple[str, ...]) -> dict | None:
    """The first object of the text that has any of the keys, by itself or one level down."""
    for part in balanced(text or ""):
        try:
            found = json.loads(part)
        except ValueError:
            continue
        for candidate in [found, *[v for v in found.values() if isinstance(v, dict)]]:
            if any(k in candidate for k in keys):
                return candidate
    return None


def prediction_rows(text: str | None) -> list[dict]:
    """Predictions of the first object that lists any. A row's observations stand for it, each over the row's own fields; rows without a track, or not
    accepted for fusion, are dropped; bad numbers are 0."""

    def number(v) -> float:
        try:
            return min(1.0, max(0.0, float(v)))
        except (TypeError, ValueError):
            return 0.0

    found = first_object(text, LIST_KEYS) or {}
    listed = next((found[k] for k in LIST_KEYS if isinstance(found.get(k), list)), [])
    out = []
    for row in (r for r in listed if isinstance(r, dict) and r.get("accepted_for_fusion") is not False):
        seen = [o for o in row.get("observations") or [] if isinstance(o, dict) and o.get("accepted_for_fusion") is not False]
        for source in [row | o for o in seen] or [row]:
            got = {f: next((source[n] for n in names if source.get(n) is not None), None) for f, names in FIELDS.items()}
            if isinstance(got["track_id"], int):
                words = {f: str(got[f]) if got[f] is not None else "unknown" for f in ("label", "fine_label")}
                out.append({"track_id": got["track_id"], **words, "confidence": number(got["confidence"]), "fine_confidence": number(got["fine_confidence"]), "color": None if got["color"] is None else str(got["color"]).strip().lower()})
    return out


def predictions(text: Column) -> Column:
    """prediction_rows() as an array of structs."""
    kinds = {"long": T.LongType(), "string": T.StringType(), "double": T.DoubleType()}
    row = T.StructType([T.StructField(name, kinds[kind]) for name, kind in (f.split() for f in ROW.split(", "))])

    def run(column: pd.Series) -> pd.Series:
        return pd.Series([prediction_rows(t) for t in column], dtype=object)

    return F.pandas_udf(run, T.ArrayType(row))(text)
