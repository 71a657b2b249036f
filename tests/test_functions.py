import math

import pytest
from pyspark.sql import functions as F

from seriesloom.functions import clean, domain, timeaxis
from seriesloom.operators import clean as rows
from tests.helpers import at, values


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "text, wanted",
    [("1.5", 1.5), (" 2 ", 2.0), ("abc", None), ("", None), ("NaN", None), (None, None), ("1e3", 1000.0)],
)
def test_to_number(spark, text, wanted):
    assert one(spark, clean.to_number(F.lit(text).cast("string"))) == wanted


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("2024-01-01 03:00:00", at(3)),
        ("2024-01-01T03:00:00", at(3)),
        ("2024-01-01T03:00:00Z", at(3)),
        ("2024-01-01T03:00:00+02:00", at(1)),
        ("2024-01-01", at(0)),
        ("soon", None),
    ],
)
def test_to_time(spark, text, wanted):
    assert one(spark, clean.to_time(F.lit(text))) == wanted


def test_strict_time_fails(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast"):
        one(spark, clean.to_time(F.lit("soon"), strict=True))


@pytest.mark.parametrize(
    "value, missing",
    [(999.9, True), (999.905, True), (999.95, False), (9999.0, False), (0.0, False), (None, True)],
)
def test_sentinel(spark, value, missing):
    out = one(spark, clean.sentinel_to_null(F.lit(value).cast("double"), (999.9,)))
    assert (out is None) == missing


def test_null_sentinels_names_missing_columns(spark):
    with pytest.raises(ValueError, match="speed"):
        rows.null_sentinels(spark.range(1), {"speed": (1.0,)})


def test_clip_keeps_null(spark):
    assert one(spark, clean.clip(F.lit(None).cast("double"), 0, 9)) is None
    assert one(spark, clean.clip(F.lit(12.0), 0, 9)) == 9.0
    assert one(spark, clean.clip(F.lit(-1.0), low=0)) == 0.0


@pytest.mark.parametrize("value", [float("nan"), float("inf"), float("-inf"), None])
def test_unusable_becomes_zero(spark, value):
    assert one(spark, clean.finite_or_zero(F.lit(value).cast("double"))) == 0.0


def test_coupling(spark):
    lit = [F.lit(x) for x in (400.0, 5.0, 3.0, -4.0)]
    angle = math.atan2(3.0, -4.0)
    wanted = 400 ** (4 / 3) * 5 ** (2 / 3) * math.sin(angle / 2) ** (8 / 3)
    assert one(spark, domain.coupling(*lit)) == pytest.approx(wanted)
    assert one(spark, domain.coupling(F.lit(400.0), F.lit(-5.0), F.lit(1.0), F.lit(1.0))) is None
    assert one(spark, domain.coupling(F.lit(400.0), F.lit(5.0), F.lit(0.0), F.lit(2.0))) == 0.0


@pytest.mark.parametrize(
    "kp, label",
    [
        (3.99, "Quiet"),
        (4.0, "Unsettled / Active"),
        (5.0, "G1 - Minor storm"),
        (6.0, "G2 - Moderate storm"),
        (7.0, "G3 - Strong storm"),
        (8.0, "G4 - Severe storm"),
        (9.0, "G5 - Extreme storm"),
        (None, None),
    ],
)
def test_kp_label(spark, kp, label):
    assert one(spark, domain.kp_label(F.lit(kp).cast("double"))) == label


@pytest.mark.parametrize("modifier, wanted", [(0.4, (0.251, 0.629, 0.12)), (1.0, (0.2, 0.5, 0.3)), (1.6, (0.149, 0.371, 0.48))])
def test_adjusted_weights(spark, modifier, wanted):
    base = {"Quiet": 0.2, "Moderate": 0.5, "Active": 0.3}
    w = domain.adjusted_weights(F.lit(modifier), base)
    got = spark.range(1).select(*[c.alias(k) for k, c in w.items()]).first()
    assert (got.Quiet, got.Moderate, got.Active) == wanted
    assert sum(got) == pytest.approx(1.0, abs=0.002)


def test_cycle_position_of_flat_cycle(spark):
    assert one(spark, domain.cycle_position(F.lit(5.2), F.lit(5.0), F.lit(5.0))) == pytest.approx(0.2)
    assert one(spark, domain.storm_rate_modifier(F.lit(1.0))) == pytest.approx(1.6)


def test_time_axes(spark):
    t = F.lit(at(0)).cast("timestamp_ntz")
    assert one(spark, timeaxis.time_axis(t, "3 hours", 3)) == [at(3), at(6), at(9)]
    late = F.lit(at(0, days=30)).cast("timestamp_ntz")
    months = one(spark, timeaxis.mid_month_axis(late, 13))
    assert (months[0].month, months[0].day, months[11].year, months[12].month) == (2, 15, 2025, 2)


def test_day_of_year(spark):
    assert one(spark, timeaxis.day_of_year_time(F.lit(2024), F.lit(60), F.lit(5))).isoformat() == "2024-02-29T05:00:00"
    assert one(spark, timeaxis.day_of_year_time(F.lit(-1), F.lit(60), F.lit(5))) is None


def test_month_index_and_age(spark):
    t = F.lit(at(0)).cast("timestamp_ntz")
    assert one(spark, timeaxis.month_index(t)) == 275 * 12
    assert one(spark, timeaxis.age_hours(t, F.lit(at(7.5)).cast("timestamp_ntz"))) == 7.5


def test_dedupe_rules(spark):
    df = spark.createDataFrame(
        [(at(0), 1.0, 1), (at(0), 1.0, 1), (at(0), 2.0, 2), (at(3), 5.0, 1)], "t timestamp_ntz, kp double, pos int"
    )
    assert len(values(rows.dedupe_exact(df, ["t", "kp"]), "t", "kp")) == 3
    assert values(rows.dedupe(df, "t", ["pos"], "first"), "t", "kp") == [(at(0), 1.0), (at(3), 5.0)]
    assert values(rows.dedupe(df, "t", ["pos"], "last"), "t", "kp") == [(at(0), 2.0), (at(3), 5.0)]
    with pytest.raises(ValueError):
        rows.dedupe(df, "t", ["pos"], "any")
