"""Series in blocks of time give what one window over each series gives."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from axisfield.operators import histories as H
from axisfield.operators import nonlocal_ops as N
from axisfield.operators import series as S


@pytest.fixture
def many_blocks(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def rows(spark):
    """One series with most rows, short ones, a null name, null values."""
    draw = random.Random(4)
    out = [("hot", k, draw.random()) for k in range(600)] + [(f"s{k % 9}", k, draw.random()) for k in range(60)] + [(None, k, float(k)) for k in range(40)] + [("lone", 5, 1.5), ("gaps", 1, None), ("gaps", 2, 7.0), ("gaps", 3, None)]
    out += [("quiet", k, None if 10 < k < 190 else float(k)) for k in range(200)]
    return spark.createDataFrame(out, "s string, t long, v double").repartition(5)


def same(got, want):
    key = lambda r: tuple((x is None, x) for x in r)
    a, b = (sorted((tuple(r) for r in x.collect()), key=key) for x in (got, want))
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x[:-1] == y[:-1] and (x[-1] == pytest.approx(y[-1]) if y[-1] is not None else x[-1] is None), (x, y)


def test_a_long_series_has_several_blocks(spark, many_blocks):
    b = S.blocked(rows(spark), ["s"], ["t"])
    assert b.where("s = 'hot'").select(S.BLOCK).distinct().count() > 4
    assert b.groupBy(S.BLOCK).count().agg(F.max("count")).first()[0] < 200


def test_stencil(spark, many_blocks):
    df, line = rows(spark), Window.partitionBy("s").orderBy("t")
    back, ahead = F.lag("v").over(line), F.lead("v").over(line)
    d = F.when(back.isNull() & ahead.isNull(), 0.0).when(back.isNull(), ahead - F.col("v")).when(ahead.isNull(), F.col("v") - back).otherwise((ahead - back) / 2)
    same(N.stencil(df, ["s"], "t", "v", F.lit(1.0)), df.withColumn("d", d))
    whole = df.where("s in ('hot', 's1', 'lone')")
    all_ = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    around = (F.coalesce(ahead, F.first("v").over(all_)) - F.coalesce(back, F.last("v").over(all_))) / 2
    same(N.stencil(whole, ["s"], "t", "v", F.lit(1.0), periodic=True), whole.withColumn("d", around))


def test_delay(spark, many_blocks):
    df = rows(spark)
    seen = {}
    for r in df.where("v is not null").orderBy("t").collect():
        seen.setdefault(r.s, []).append((r.t, r.v))
    got = N.delay(df, "s", "t", "v", 3).collect()
    assert len(got) == df.count()
    for r in got:
        want = [v for t, v in seen.get(r.s, []) if t <= r.t - 3]
        assert r.delayed == (want[-1] if want else None)


def test_track(spark, many_blocks):
    seen = rows(spark).where("v is not null").withColumn("t", F.col("t").cast("double"))
    asked = seen.select("s", (F.col("t") + 0.25).alias("t")).union(seen.select("s", "t")).union(spark.createDataFrame([("hot", -3.0), ("hot", 1e4), ("none", 1.0)], "s string, t double"))
    got = {(r.s, r.t): r.tracked for r in H.track(seen, asked, ["s"], "t", "v").collect()}
    by = {}
    for r in seen.collect():
        by.setdefault(r.s, []).append((r.t, r.v))
    for name, o in by.items():
        o.sort()
        slope = []
        for k in range(len(o)):
            near = [(o[j + 1][1] - o[j][1]) / (o[j + 1][0] - o[j][0]) for j in (k - 1, k) if 0 <= j < len(o) - 1]
            slope.append(sum(near) / len(near) if near else 0.0)
        for k, (t, v) in enumerate(o):
            assert got[name, t] == pytest.approx(v)
            if k + 1 == len(o):
                assert got[name, t + 0.25] == v
                continue
            h, s = o[k + 1][0] - t, 0.25 / (o[k + 1][0] - t)
            want = v * (1 + 2 * s) * (1 - s) ** 2 + h * slope[k] * s * (1 - s) ** 2 + o[k + 1][1] * s * s * (3 - 2 * s) - h * slope[k + 1] * s * s * (1 - s)
            assert got[name, t + 0.25] == pytest.approx(want)
    assert got["none", 1.0] is None and got["hot", 1e4] == by["hot"][-1][1] and got["hot", -3.0] == by["hot"][0][1]
