import random

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import sequence


@pytest.mark.parametrize("backward", [False, True])
@pytest.mark.parametrize("current", [False, True])
@pytest.mark.parametrize("kind", ["sum", "max"])
def test_running_values_are_those_of_one_walk(spark, kind, current, backward):
    random.seed(7)
    places = random.sample(range(-200, 400), 300)
    rows = [(random.choice(["a", "a", "a", "b", None]), o, random.choice([None, *range(9)])) for o in places]
    made = spark.createDataFrame(rows, "k string, ord bigint, v bigint")
    got = {r["ord"]: r["x"] for r in sequence.running(made, ["k"], "ord", "x", F.col("v"), kind, current=current, backward=backward, stretch=50).collect()}
    want, state = {}, {}
    for k, o, v in sorted(rows, key=lambda r: r[1], reverse=backward):
        before = state.get(k, [])
        state[k] = after = before + [v] * (v is not None)
        seen = after if current else before
        want[o] = sum(seen) if kind == "sum" else max(seen, default=None)
    assert got == want


def test_running_keeps_repeated_rows_and_empty_tables(spark):
    made = spark.createDataFrame([("a", 1, 5), ("a", 1, 5), ("a", 70_000, 1)], "k string, ord bigint, v bigint")
    rows = sequence.running(made, ["k"], "ord", "x", F.lit(1), current=False).orderBy("x").collect()
    assert [(r["ord"], r["x"]) for r in rows] == [(1, 0), (1, 1), (70_000, 2)]
    none = sequence.running(made.limit(0), ["k"], "ord", "x", F.lit(1))
    assert none.count() == 0 and none.columns == ["k", "ord", "v", "x"]
