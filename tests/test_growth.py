"""Queries on tables that broke them when they were larger: results, and plans that hold no side whole."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from axisfield import catalog
from axisfield.operators import nearby

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def duck():
    return duckdb.connect()


def test_nearest_mean_on_and_beside_an_anchor(spark, duck, tmp_path):
    """on a supplier the SQL's quotient is NaN; a cent beside it (d2 about 1e-12) all three count."""
    pd.DataFrame({"s_suppkey": [1, 102, 203, 4], "s_acctbal": [500.0, 9000.0, 100.0, 70.01], "s_nationkey": [7, 20, 3, 9]}).to_parquet(tmp_path / "supplier.parquet")
    pd.DataFrame({"c_custkey": np.array([1, 102, 4, 105, 50]), "c_acctbal": [500.0, 9000.01, 70.0, 70.02, 3000.0]}).to_parquet(tmp_path / "customer.parquet")
    for t in ("supplier", "customer"):
        duck.execute(f"create view {t} as from '{tmp_path}/{t}.parquet'")
    got = catalog.queries()["nearest_inverse_distance"](spark, str(tmp_path)).toPandas().set_index("c_custkey").sort_index()
    want = duck.sql(catalog.oracle_sql()["nearest_inverse_distance"]).df().set_index("c_custkey").sort_index()
    assert want["idw"].isna().tolist() == [True, False, False, False, False]
    np.testing.assert_allclose(got["idw"], want["idw"], atol=1.1e-6)


def test_cosine_lines_join_nothing(spark):
    """both derivatives come from one look at a line; their join was broadcast by a guess of its size."""
    assert "Join" not in plan(catalog.queries()["cosine_lines"](spark, SF))


def test_mesh_sides_are_not_broadcast(spark):
    """faces make six rows each before the join, which the guessed size does not know."""
    from axisfield.more_queries import lattice_boxes
    from axisfield.plans.tables import written
    from axisfield.sources import meshes as M

    faces = written(lattice_boxes(spark, SF).withColumn("__face", F.monotonically_increasing_id()))
    assert "Broadcast" not in plan(M.feature_normals(faces))


def test_groups_rule_out_most_boxes():
    """rows that lie together look at few boxes, whatever their number."""
    draw = np.random.default_rng(4)
    low = draw.random((2000, 2)) * 100
    rows = draw.random((5000, 2)) * 100
    groups = nearby.halved(rows, nearby.GROUP)
    assert sorted(np.concatenate(groups).tolist()) == list(range(5000)) and max(map(len, groups)) <= nearby.GROUP
    for g in groups:
        near = nearby._candidates(rows[g], low, low + 0.5, np.full(2000, 24), 1)
        best = nearby.box_distance(rows[g], low, low + 0.5).argmin(axis=1)
        assert len(near) < 600 and np.isin(best, near).all()


def test_edges_are_counted_by_hash(spark):
    """F8, F9: no sort of arrays in the task that reads the parts, and the parts' rows are dealt evenly."""
    from axisfield.planar_queries import frames
    from axisfield.sources import planar as P

    text = plan(P.boundary_edges(frames(spark, SF)))
    assert "SortAggregate" not in text and "HashAggregate" in text and "REPARTITION_BY_NUM" in text


def test_windows_only_grow(spark):
    """a window from a row to the end of its block is gone through anew for each row."""
    from axisfield.operators import series

    rows = series.blocked(spark.createDataFrame([(1, k, float(k) if k % 5 == 0 else None) for k in range(23)], "s int, t int, v double"), ["s"], ["t"])
    out = series.nearest_known(rows, ["s"], ["t"], "v", last="l", first="f")
    assert "unboundedfollowing" not in plan(out).lower()
    assert {r.t: (r.l, r.f) for r in out.collect()} == {k: (float(k // 5 * 5), float(-(-k // 5) * 5) if k <= 20 else None) for k in range(23)}


def test_long_rules_are_summed_once_a_place(spark):
    """one sum for each distinct place that the term reads, nulls alike; one number where it reads none."""
    from axisfield.operators import nonlocal_ops as N

    rows = spark.createDataFrame([(k, float(k % 3) if k % 4 else None) for k in range(20)], "id int, x double")
    rule = [{"xi": 0.5 * j, "w": 0.25} for j in range(4)]
    term = lambda e: (F.col("x") + e["xi"]) * e["w"]
    out = N.local_integral(N.local_integral(rows, rule, lambda e: e["xi"] * e["w"], into="b", reads=[]), rule, term, into="a", reads=["x"])
    want = N.local_integral(rows, rule, term, into="a")
    assert {r.id: r.a for r in out.collect()} == {r.id: r.a for r in want.collect()} and {r.b for r in out.collect()} == {0.75}


def test_contractions_are_compiled(spark):
    """a small product is written out; functions over arrays are evaluated node by node."""
    assert "aggregate(" not in plan(catalog.queries()["latent_grid"](spark, SF))


def test_means_in_little_memory():
    """pairs are looked at in pieces that caches hold, with ties to the least value."""
    import tracemalloc

    from axisfield.operators import nonlocal_ops as N

    draw = np.random.default_rng(2)
    places, spots, values = draw.random((300, 2)), draw.random((9000, 2)), draw.integers(0, 9, 9000).astype(float)
    spots[5], spots[8000], values[5], values[8000] = places[3], places[3], 4.0, 2.0
    tracemalloc.start()
    top, low, least, near = N._means(places, spots, values, 2.0)
    assert tracemalloc.get_traced_memory()[1] < 4e6
    tracemalloc.stop()
    d2 = ((places[:, None] - spots) ** 2).sum(axis=2)
    w = 1 / np.maximum(d2, 1e-300)
    np.testing.assert_allclose(top / low, (w @ values) / w.sum(axis=1), rtol=1e-12)
    assert (least == d2.min(axis=1)).all() and near[3] == 2.0


def test_points_of_a_cloud_are_looked_at_together():
    """points with as many neighbours in one step, with the triangles that each has by itself."""
    from axisfield.sources import clouds

    draw = np.random.default_rng(3)
    here, near = draw.random((50, 2)), draw.random((50, 9, 2))
    zero, zeros = np.zeros(50), np.zeros((50, 9))
    got = set(zip(*(x.tolist() for x in clouds._stars(here, zero, near, zeros, 0.5)), strict=True))
    want = {(p, *map(int, pair)) for p in range(50) for pair in clouds._star(here[p], 0.0, near[p], zeros[p], 0.5)}
    assert got == want and len({p for p, _, _ in got}) > 25
