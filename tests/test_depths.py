"""Depth segments from a few marks of each sequence against the rule over all its depths."""

import numpy as np
import pandas as pd
import pytest

from quakespark.operators import segments

SHAPES = {
    "spread": lambda r: r.uniform(0, 60, 400),
    "ties": lambda r: np.where(r.random(500) < 0.8, 10.0, np.round(r.uniform(0, 40, 500), 1)),
    "all one": lambda r: np.full(200, 10.0),
    "two": lambda r: np.repeat([5.0, 12.0], [180, 90]),
    "low heap": lambda r: np.concatenate((np.full(300, 0.0), r.uniform(5, 9, 160))),
    "three heaps": lambda r: np.repeat([1.0, 2.0, 3.0, 33.0], [200, 60, 70, 40]),
    "few": lambda r: r.uniform(0, 60, 30),
    "steps": lambda r: np.round(r.exponential(10, 700)),
}


@pytest.mark.parametrize("bins", [None, [0.0, 10.0, 20.0, 40.0], [5.0, 12.0]])
@pytest.mark.parametrize("least", [25, 60])
def test_marks_give_the_rule_over_all_depths(spark, bins, least):
    rng = np.random.default_rng(12)
    made = {name: make(rng) for name, make in SHAPES.items()}
    events = pd.concat([pd.DataFrame({"mainshock_id": name, "depth_km": [*d, np.nan]}) for name, d in made.items()])
    rows = spark.createDataFrame(events).selectExpr("mainshock_id", "nullif(depth_km, double('NaN')) AS depth_km").repartition(6)
    got = {}
    for r in segments.depth_segments(rows, least, bins=bins).collect():
        got.setdefault(r.mainshock_id, []).append((r.lo, r.hi, r.first))
    for name, d in made.items():
        values, counts = np.unique(d, return_counts=True)
        depths = segments.Depths(values.tolist(), counts.tolist())
        want = segments.depth_segments_of(depths, least) if bins is None else segments.binned_depth_segments(depths, bins, least)
        assert sorted(got.get(name, [])) == [(lo, hi, k == 0) for k, (lo, hi) in enumerate(want)], name
    assert got


def test_a_sequence_of_many_depths_has_few_marks(spark):
    rows = spark.range(200_000).selectExpr("'one' AS mainshock_id", "cast(id * 7919 % 200003 AS double) / 1000 AS depth_km")
    marks = segments.depth_marks(rows, 25, 3, [])
    assert "FlatMapGroupsInPandas" not in marks._jdf.queryExecution().toString()
    found = marks.collect()
    assert len(found) == 1 and len(found[0].marks) <= 12
    got = [(r.lo, r.hi) for r in segments.depth_segments(rows, 25).collect()]
    d = np.sort(np.arange(200_000) * 7919 % 200003 / 1000)
    assert [x[0] for x in sorted(got)[1:]] == pytest.approx(np.percentile(d, [100 / 3, 200 / 3]).tolist())
