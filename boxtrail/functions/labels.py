"""Labels as they are shown, hinted at and taken from models: Columns of Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of actions and states, and words that may stand between them.
ACTIONS = ("driving", "gesturing", "holding", "looking", "moving", "parked", "playing", "reading", "riding", "running", "sitting", "standing", "talking", "teaching", "walking", "wearing", "working", "writing")
CONNECTORS = ("a", "an", "at", "in", "of", "on", "the", "to", "with")
#: Colours that may precede a label.
SHOWN_COLOURS = ("black", "white", "gray", "grey", "silver", "red", "blue", "green", "yellow", "orange", "brown", "beige", "maroon", "purple", "pink", "gold")
NOTHING = ("", "unknown")


def is_action(text: Column) -> Column:
    """Whether a text names an action, not a thing: it has a word of one, and a comma or no word but those and connectors."""
    plain = F.regexp_replace(F.lower(F.trim(text)), "_", " ")
    words = F.array_distinct(F.regexp_extract_all(plain, F.lit("[a-z]+"), F.lit(0)))
    some = F.size(F.array_intersect(words, F.lit(list(ACTIONS)))) > 0
    only = F.size(F.array_except(words, F.lit([*ACTIONS, *CONNECTORS]))) == 0
    return F.coalesce(~plain.isin(*NOTHING) & some & (text.contains(",") | only), F.lit(False))


def display_label(base: Column, label: Column, fine: Column, fine_accepted: Column, fast: Column, colour: Column) -> Column:
    """The most specific label that says more than those before it: an accepted fine label, the class, the fast label, else the base; with a known colour
    before it, unless it has that word. Nulls count as unknown, a null base as object."""
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    base = F.coalesce(F.nullif(text(base), F.lit("")), F.lit("object"))
    new = lambda c, *old: ~F.lower(text(c)).isin(*NOTHING) & ~F.array_contains(F.array(*[F.lower(text(o)) for o in old]), F.lower(text(c)))
    detail = F.when(F.coalesce(fine_accepted, F.lit(False)) & new(fine, base, label), text(fine)).when(new(label, base), text(label)).when(new(fast, base), text(fast)).otherwise(base)
    shade = F.lower(text(colour))
    shown = shade.isin(*SHOWN_COLOURS) & ~F.array_contains(F.split(F.lower(detail), r"\s+"), shade)
    return F.when(shown, F.concat(shade, F.lit(" "), detail)).otherwise(detail)


def hint(value: Column, confidence: Column, least: float) -> Column:
    """A value that is known and sure enough to be hinted at, else null: labels from 0.65, colours from 0.55."""
    return F.when(~value.isin(*NOTHING) & (F.coalesce(confidence, F.lit(0.0)) >= least), value)


def needs_focus(label: Column, confidence: Column, least: float = 0.65) -> Column:
    """Whether a known label is too unsure to be a hint and so is looked at more closely."""
    return F.coalesce(~label.isin(*NOTHING) & (confidence > 0) & (confidence < least), F.lit(False))


#: The kinds of a fine label that an answer may name.
FINE_TYPES = ("role", "subtype", "species", "breed", "make", "model", "make_model", "medical", "diagnosis", "identity", "unknown")


def sanitized(confidence: Column, fine_label: Column, fine_type: Column, fine_confidence: Column, frames: Column, allowed: Column) -> dict[str, Column]:
    """What a model says, held to what it may say; warnings name what was changed.

    Confidences (text) become numbers in 0 to 1; one that is no finite number or lies outside is warned of, a missing one is 0. Fine types are compared in lower case with _ for
    spaces and hyphens; with another type the fine label is unknown. frames (an array of text): whole numbers over 0, each once, in rising order, of those that are allowed
    (null: all).
    """
    number = lambda c: F.coalesce(c.try_cast("double"), F.lit(float("nan")))
    finite = lambda c: ~F.isnan(number(c)) & (F.abs(number(c)) < float("inf"))
    bounded = lambda c: F.when(finite(c), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number(c)))).otherwise(0.0)
    changed = lambda c: c.isNotNull() & (~finite(c) | (bounded(c) != number(c)))
    kind = F.regexp_replace(F.lower(F.trim(F.coalesce(fine_type, F.lit("unknown")))), "[- ]", "_")
    known = kind.isin(*FINE_TYPES)
    said = F.trim(F.coalesce(fine_label, F.lit("unknown")))
    numbers = F.array_sort(F.array_distinct(F.filter(F.transform(frames, lambda v: v.try_cast("long")), lambda v: v > 0)))
    kept = F.when(allowed.isNull(), numbers).otherwise(F.array_sort(F.array_intersect(numbers, allowed.cast("array<bigint>"))))
    warnings = [
        F.when(changed(confidence), "invalid_confidence_bounded:confidence"),
        F.when(changed(fine_confidence), "invalid_confidence_bounded:fine_confidence"),
        F.when(~known, "unsupported_fine_label_type"),
        F.when(F.size(kept) < F.size(numbers), "unsupported_evidence_frames_removed"),
    ]
    return {
        "confidence": bounded(confidence),
        "fine_label": F.when(known & (said != ""), said).otherwise("unknown"),
        "fine_type": F.when(known, kind).otherwise("unknown"),
        "fine_confidence": F.when(known, bounded(fine_confidence)).otherwise(0.0),
        "frames": kept,
        "warnings": F.array_compact(F.array(*warnings)),
    }


def wants_contrast(mode: Column, luminance: Column, dark: float = 70.0) -> Column:
    """Whether a frame's contrast is to be raised: always in mode clahe, in mode auto when it is dark."""
    return F.coalesce((mode == "clahe") | ((mode == "auto") & (luminance < dark)), F.lit(False))


def ordered_union(*lists: Column) -> Column:
    """Distinct values of arrays in the order of their first occurrence."""
    return F.array_distinct(F.concat(*lists))
