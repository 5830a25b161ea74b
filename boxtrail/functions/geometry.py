"""Box geometry as Column expressions. A box is four columns: corners (x1, y1, x2, y2) or corner and size (x, y, w, h)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


class Box(NamedTuple):
    """Corner columns of a box."""

    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @property
    def width(self) -> Column:
        return self.x2 - self.x1

    @property
    def height(self) -> Column:
        return self.y2 - self.y1


def corners(x, y, w, h) -> Box:
    x, y, w, h = (F.col(c) if isinstance(c, str) else c for c in (x, y, w, h))
    return Box(x, y, x + w, y + h)


def size_form(b: Box) -> tuple[Column, Column, Column, Column]:
    return b.x1, b.y1, b.width, b.height


def finite(*columns: Column) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(INF))
    return out


def is_valid(b: Box) -> Column:
    """All four finite and a positive width and height; never null."""
    return finite(*b) & F.coalesce((b.x2 > b.x1) & (b.y2 > b.y1), F.lit(False))


def clip(b: Box, width, height) -> Box:
    hold = lambda v, top: F.greatest(F.lit(0.0), F.least(F.lit(top) if not isinstance(top, Column) else top, v))
    return Box(hold(b.x1, width), hold(b.y1, height), hold(b.x2, width), hold(b.y2, height))


def area(b: Box) -> Column:
    """Zero for an invalid box."""
    return F.when(is_valid(b), b.width * b.height).otherwise(F.lit(0.0))


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    h = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: Box, b: Box) -> Column:
    """Zero when disjoint or degenerate; negative sides count as none."""
    side = lambda v: F.greatest(F.lit(0.0), v)
    common = intersection(a, b)
    union = side(a.width) * side(a.height) + side(b.width) * side(b.height) - common
    return F.when(union > 0, common / union).otherwise(F.lit(0.0))


def strict_iou(a: Box, b: Box) -> Column:
    """As iou, but an invalid box raises."""
    fine = is_valid(a) & is_valid(b)
    return F.when(fine, iou(a, b)).otherwise(F.raise_error(F.lit("invalid box")).cast("double"))


def coverage(inner: Box, outer: Box) -> Column:
    """Share of the first box that lies in the second."""
    return F.coalesce(F.try_divide(intersection(inner, outer), area(inner)), F.lit(0.0))


def containment(a: Box, b: Box) -> Column:
    """The greater of IoU and the intersection's share of the smaller box, within 0 and 1."""
    share = F.coalesce(F.try_divide(intersection(a, b), F.least(area(a), area(b))), F.lit(0.0))
    return F.least(F.lit(1.0), F.greatest(iou(a, b), share))


def partial_overlap(a: Box, b: Box) -> Column:
    return F.greatest(iou(a, b), F.sqrt(coverage(a, b) * coverage(b, a)))


def centre(b: Box) -> tuple[Column, Column]:
    return (b.x1 + b.x2) / 2, (b.y1 + b.y2) / 2


def centre_distance(a: Box, b: Box) -> Column:
    (ax, ay), (bx, by) = centre(a), centre(b)
    return F.hypot(ax - bx, ay - by)


def centre_inside(a: Box, b: Box) -> Column:
    """Whether the centre of the first lies in the second, edges included."""
    x, y = centre(a)
    return (x >= b.x1) & (x <= b.x2) & (y >= b.y1) & (y <= b.y2)


def association_metrics(a: Box, b: Box, width: float, height: float) -> dict[str, Column]:
    """Everything that relates two boxes of a frame of the given size."""
    distance = centre_distance(a, b)
    share = F.least(F.lit(1.0), distance / F.lit((width**2 + height**2) ** 0.5))
    return {
        "intersection": intersection(a, b),
        "iou": iou(a, b),
        "a_coverage": coverage(a, b),
        "b_coverage": coverage(b, a),
        "centre_distance": distance,
        "normalized_distance": share,
        "centre_similarity": 1 - share,
        "a_centre_inside": centre_inside(a, b),
        "b_centre_inside": centre_inside(b, a),
    }


def yolo_normalize(b: Box, width: float, height: float) -> dict[str, Column]:
    """Centre and size as shares of the image; up to 1e-9 beyond 0 and 1 is held to them, more raises."""

    def share(v: Column, whole: float) -> Column:
        r = v / F.lit(whole)
        return F.when((r < -1e-9) | (r > 1 + 1e-9), F.raise_error(F.lit("box outside the image")).cast("double")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), r)))

    x, y = centre(b)
    return {"cx": share(x, width), "cy": share(y, height), "nw": share(b.width, width), "nh": share(b.height, height)}


def yolo_denormalize(cx: Column, cy: Column, w: Column, h: Column, width: float, height: float) -> Box:
    return Box((cx - w / 2) * width, (cy - h / 2) * height, (cx + w / 2) * width, (cy + h / 2) * height)


def grid_to_pixels(v: Column, size: float, grid: float = 1000.0) -> Column:
    """A coordinate on a 0 to grid scale in pixels, rounded half to even; others raise."""
    return F.when(v.between(0, grid), F.bround(v / grid * size)).otherwise(F.raise_error(F.lit("coordinate off the grid")).cast("double"))


def scaled(b: Box, sx: float, sy: float) -> Box:
    return Box(b.x1 * sx, b.y1 * sy, b.x2 * sx, b.y2 * sy)


def crop_to_source(b: Box, left: Column, top: Column, scale_x: Column, scale_y: Column) -> Box:
    """A box found in a resized crop, in the coordinates of the source image."""
    return Box(b.x1 / scale_x + left, b.y1 / scale_y + top, b.x2 / scale_x + left, b.y2 / scale_y + top)


def size_bin(area_ratio: Column, small: float = 0.01, medium: float = 0.05) -> Column:
    return F.when(area_ratio <= small, "small").when(area_ratio <= medium, "medium").otherwise("large")
