"""Places and percentile ranks over many parts, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from skerry.operators.places import By, few_numbered, numbered, percentile_ranks, running
from skerry.sources.staged import staged


def frame(spark, n, seed):
    rng = random.Random(seed)
    # a third of all rows share one score; some have none
    rows = [(i, None if i % 11 == 0 else 50.0 if i % 3 == 0 else round(rng.uniform(-20, 100), 1), rng.choice(["a", "b", None])) for i in range(n)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "code long, score double, kind string").repartition(5)


@pytest.mark.parametrize("part_rows", [3, 17, 1000])
def test_places_over_parts(spark, part_rows):
    rows, df = frame(spark, 200, part_rows)
    got = {r.code: r["rank"] for r in numbered(df, [By("score", descending=True), By("kind", nulls_last=False), By("code")], part_rows=part_rows).collect()}
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2] is not None, r[2] or "", r[0]))
    assert got == {r[0]: i + 1 for i, r in enumerate(order)}
    again = numbered(df.withColumn("rank", F.col("code") * 2), [By("rank", descending=True)], part_rows=part_rows)
    assert {r.code: r["rank"] for r in again.collect()} == {i: 200 - i for i in range(200)}
    first = few_numbered(df, [By("score", descending=True), By("kind", nulls_last=False), By("code")], 7).collect()
    assert [(r.code, r["rank"]) for r in sorted(first, key=lambda r: r["rank"])] == [(r[0], i + 1) for i, r in enumerate(order[:7])]
    assert numbered(df.limit(0), [By("code")]).count() == 0


@pytest.mark.parametrize("part_rows", [4, 1000])
def test_percentile_ranks_over_parts(spark, part_rows):
    rows, df = frame(spark, 150, 3)
    ranked = {"up": (F.col("score"), False, 20.0), "down": (F.col("score"), True, 25.0), "codes": (F.col("code"), False, 0.0)}
    got = {r.code: r for r in percentile_ranks(staged(df, "t"), ranked, part_rows).collect()}
    known = [r[1] for r in rows if r[1] is not None]
    for code, score, _ in rows:
        if score is None:
            assert (got[code].up, got[code].down) == (20.0, 25.0)
        else:
            ties = known.count(score)
            assert got[code].up == pytest.approx((sum(k < score for k in known) + (ties + 1) / 2) / len(known) * 100)
            assert got[code].down == pytest.approx((sum(k > score for k in known) + (ties + 1) / 2) / len(known) * 100)
        assert got[code].codes == pytest.approx((code + 1) / len(rows) * 100)


def test_no_task_orders_all_rows(spark):
    """The plan cuts rows into parts by the key; nothing goes to a single partition."""
    _, df = frame(spark, 200, 1)
    plan = running(staged(df, "t"), [By("score"), By("code")], F.lit(1), "before", 10)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "hashpartitioning(_part" in plan
