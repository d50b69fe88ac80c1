"""Mixing where the cut lies inside a group of equal rows."""

from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from axisfield.llm import mixing, queries


@pytest.mark.parametrize("hot", [3, None])
def test_equal_rows_are_taken_one_by_one(spark, hot):
    rows = [(hot, "a", "four words are here") for _ in range(3000)] + [(100 + i, "a", f"word{i} and more") for i in range(40)] + [(1000 + i, s, "some words " * (i % 5 + 1)) for i in range(60) for s in ("b", None)]
    rows += [(hot, "b", f"three words {i}") for i in range(500)]  # alike in id and size only
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.source, r.text) for r in out) == Counter(rows)
    got, taken, goal, most = Counter((r.doc_id, r.size, r.taken) for r in out), Counter(), {}, Counter()
    for r in out:
        taken[r.source] += r.taken
        goal[r.source] = r.target
        most[r.source] = max(most[r.source], r.size)
    assert all(abs(taken[s] - goal[s]) <= most[s] for s in goal)
    c = duckdb.connect()
    c.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "source": [r[1] for r in rows], "text": [r[2] for r in rows]}))
    assert got == Counter((d, n, t) for d, n, _, _, t in c.execute(queries.OP9_SQL).fetchall())
    again = mixing.mix(docs.repartition(7)).collect()
    assert Counter((r.doc_id, r.source, r.text, r.taken) for r in again) == Counter((r.doc_id, r.source, r.text, r.taken) for r in out)
