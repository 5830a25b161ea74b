import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from boxtrail.functions import geometry as g
from boxtrail.functions import scalars as s


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def box(*v):
    return g.Box(*[F.lit(float(x)) for x in v])


@pytest.mark.parametrize(("a", "b", "want"), [((0, 0, 10, 10), (5, 5, 15, 15), 25 / 175), ((0, 0, 10, 10), (5, 0, 15, 10), 1 / 3), ((0, 0, 10, 10), (10, 0, 20, 10), 0.0), ((0, 0, 0, 0), (0, 0, 0, 0), 0.0)])
def test_iou(spark, a, b, want):
    assert math.isclose(value(spark, g.iou(box(*a), box(*b))), want)


def test_coverage_both_ways(spark):
    inner, outer = box(2, 2, 7, 7), box(0, 0, 10, 10)
    assert value(spark, g.coverage(inner, outer)) == 1.0 and value(spark, g.coverage(outer, inner)) == 0.25


def test_strict_iou_raises(spark):
    with pytest.raises(Exception, match="invalid box"):
        value(spark, g.strict_iou(box(5, 5, 1, 1), box(0, 0, 1, 1)))


def test_clip_scale_and_grid(spark):
    c = g.clip(box(-5, 3, 500, 50), 100.0, 40.0)
    assert [value(spark, v) for v in c] == [0.0, 3.0, 100.0, 40.0]
    scaled = g.scaled(box(100, 100, 140, 130), 0.5, 0.5)
    assert [value(spark, v) for v in g.size_form(scaled)] == [50.0, 50.0, 20.0, 15.0]
    assert value(spark, g.grid_to_pixels(F.lit(500.0), 5.0)) == 2.0  # half to even


def test_yolo_round_trip(spark):
    n = g.yolo_normalize(box(10, 20, 50, 60), 100.0, 80.0)
    back = g.yolo_denormalize(n["cx"], n["cy"], n["nw"], n["nh"], 100.0, 80.0)
    assert [round(value(spark, v), 9) for v in back] == [10.0, 20.0, 50.0, 60.0]


def test_nulls_and_nan_are_invalid(spark):
    rows = spark.createDataFrame([(1.0, 1.0, 2.0, 2.0), (None, 1.0, 2.0, 2.0), (1.0, float("nan"), 2.0, 2.0), (1.0, 1.0, float("inf"), 2.0), (1.0, 1.0, 0.0, 2.0)], "x double, y double, w double, h double")
    assert [r.v for r in rows.select(g.is_valid(g.corners("x", "y", "w", "h")).alias("v")).collect()] == [True, False, False, False, False]


def test_names_and_phrases(spark):
    assert value(spark, s.class_name(F.lit("  Traffic-Light  A__b_ "))) == "traffic_light_a_b"
    assert value(spark, s.phrase(F.lit("Ｔhe  red-car_№1!"))) == "the red car no1"


def test_ratios_and_defaults(spark):
    assert value(spark, s.ratio_or_null(F.lit(1), F.lit(0))) is None and value(spark, s.ratio_or_zero(F.lit(1), F.lit(0))) == 0.0
    assert value(spark, s.or_default(F.lit(0.0), 0.5)) == 0.5 and value(spark, s.json_safe(F.lit(float("nan")))) is None


def test_quantiles(spark):
    v = F.array(*[F.lit(float(x)) for x in (1, 2, 3, 4)])
    assert value(spark, s.nearest_rank(v, 0.5)) == 3.0  # 1.5 rounds to the even 2
    assert value(spark, s.exclusive_quantile(v, 0.25)) == 1.25


def test_priority_and_redaction(spark):
    assert value(spark, s.event_priority(F.lit("new_track"), F.lit(0.5), F.lit(None).cast("double"))) == 3.5
    assert value(spark, s.redact_credentials(F.lit("rtsp://user:secret@cam/1"))) == "rtsp://***@cam/1"


def test_parse_boxes(spark):
    got = value(spark, s.parse_boxes(F.lit("<ref>a</ref><box>(1, 2, 3,4)</box> none <box>1,x,3,4</box>")))
    assert got == [[1.0, 2.0, 3.0, 4.0], None]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(0, 100, allow_nan=False), min_size=8, max_size=8))
def test_iou_is_symmetric_and_bounded(spark, v):
    a, b = box(v[0], v[1], v[0] + v[2], v[1] + v[3]), box(v[4], v[5], v[4] + v[6], v[5] + v[7])
    r = spark.range(1).select(g.iou(a, b).alias("x"), g.iou(b, a).alias("y"), g.containment(a, b).alias("c")).first()
    assert math.isclose(r.x, r.y, abs_tol=1e-12) and -1e-12 <= r.x <= 1 + 1e-9 and r.c >= r.x - 1e-9
