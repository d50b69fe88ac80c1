"""Sums over a declared rule inside a row: no join, no shuffle, all columns of the row kept."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def rule_sum(rule: Sequence[dict[str, float]], term: Callable[[Column], Column]) -> Column:
    """The sum of term(entry) over the entries of a rule, which is a parameter and becomes one literal array."""
    if not rule:
        return F.lit(0.0)
    # one literal, whatever the length of the rule: the optimizer parses it once
    fields = ", ".join(f"{k}: double" for k in rule[0])
    table = F.from_json(F.lit(json.dumps([{k: float(v) for k, v in entry.items()} for entry in rule])), f"array<struct<{fields}>>")
    return F.aggregate(table, F.lit(0.0), lambda total, entry: total + term(entry))
