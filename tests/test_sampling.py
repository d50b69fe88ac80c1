"""Constraints that draw their points anew: counts, repeats, focused draws, fits."""

import math

import pytest
from pyspark.sql import functions as F

from axisfield.functions.expressions import Label, sin
from axisfield.plans import sampling as P
from axisfield.sources import components as D
from axisfield.sources import shapes as S

X, T, A = Label("x"), Label("t"), Label("a")


@pytest.fixture(scope="module")
def domain():
    return D.Domain((D.ShapeFactor(S.rectangle([0.5, 0.5], 1.0, 1.0)), D.TimeInterval(0.0, 2.0)))


def test_counts(domain):
    c = domain.component()
    assert P.parse_counts(c, 7) == {"x": 7, "t": 7} and P.parse_counts(c, {"y": 5, "t": 3}) == {"x": 5, "t": 3} and P.parse_counts(c, (9, {"t": 2})) == {"x": 9, "t": 2}
    for wrong, message in (({"x": 5}, "no number"), ({"x": 5, "y": 6, "t": 1}, "together"), ((5, {"z": 1}), "no labels"), (-1, "whole"), (1.5, "whole")):
        with pytest.raises(ValueError, match=message):
            P.parse_counts(c, wrong)
    with pytest.raises(ValueError, match="reduction"):
        P.SamplingConstraint(c, lambda f: [X], 3, reduction="max")


def test_steps_draw_anew_and_repeat(spark, domain):
    made = P.SamplingConstraint.from_operator(domain.component(), lambda u: u - X, "u", (50, {"t": 4}), seed=3)
    rows = lambda k: sorted(tuple(r) for r in made.points(spark, k).collect())
    assert rows(1) == rows(1) != rows(2) and len(rows(0)) == 200
    fixed = P.SamplingConstraint(domain.component(), made.residual, 20, mode="fixed")
    assert sorted(map(tuple, fixed.points(spark, 5).collect())) == sorted(map(tuple, fixed.points(spark, 9).collect()))
    union = P.SamplingConstraint(domain.boundary(), made.residual, (40, {"t": 5}))
    counts = {r.term: (r["count"], r.q) for r in union.points(spark).groupBy("term").agg(F.count("q").alias("count"), F.sum("q").alias("q")).collect()}
    # edges at all times; the inside at both ends
    assert counts[0] == (200, pytest.approx(8.0)) and counts[1] == (80, pytest.approx(2.0))


def test_losses_and_focus(spark, domain):
    peak = P.SamplingConstraint.from_operator(domain.component(), lambda u: u * X**8, "u", (3000, {"t": 2}), reduction="integral", seed=1)
    fields, want = {"u": A * 1.0}, 2 * 4.0 / 17
    value, slope = peak.loss(peak.points(spark), fields, {"a": 2.0}, ["a"])
    assert value == pytest.approx(want, rel=0.1) and slope[0] == pytest.approx(value)
    near = peak.focused(spark, fields, {"a": 2.0})
    assert near.count() == 6000 and peak.loss(near, fields, {"a": 2.0})[0] == pytest.approx(want, rel=0.06)
    assert near.agg(F.avg("x")).first()[0] > 0.65 and near.agg(F.sum("q")).first()[0] == pytest.approx(2.0, rel=0.1)


def test_a_fit_repeats(spark, domain):
    made = P.SamplingConstraint.from_operator(domain.component(), lambda u: u - 3.0 * sin(X), "u", (60, {"t": 1}), seed=8)
    a, b = (P.fit(spark, {"u": A * sin(X)}, [made], {"a": 2.5}, steps=12, rate=0.1) for _ in range(2))
    assert a == b and a["a"] == pytest.approx(3.0, abs=0.15) and math.isfinite(a["a"])
