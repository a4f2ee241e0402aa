from __future__ import annotations

import random

from quillspark.operators import segments as E


def test_nearest_by_word_and_time(spark):
    r = random.Random(3)
    rows = [(k, r.choice("ab"), r.choice([float(r.randrange(60)), r.random() * 60 - 20])) for k in range(300)] + [(300, None, 1.0), (301, "a", None), (302, "c", 5.0), (0, "b", 7.0)]
    e = spark.createDataFrame(rows, "id long, w string, t double")
    found = sorted(map(tuple, E.proximity_join(e.filter("id % 2 = 0"), e.filter("id % 2 = 1"), "w", "t", "id", 0.7).collect()))
    best = {}
    for i, w, t in rows:
        for j, v, u in rows:
            if i % 2 == 0 and j % 2 and w is not None and w == v and None not in (t, u) and abs(u - t) <= 0.7:
                best[i] = min(best.get(i, (9, 0, 0)), (abs(u - t), j, u - t))
    assert found == sorted((i, j, d) for i, (_, j, d) in best.items()) and len(found) > 60


def test_dense_rows_are_not_paired(spark):
    e = spark.range(60_000).selectExpr("id", "'a' AS w", "(id DIV 2) / 1000D AS t")  # in one bucket: 900 million pairs
    found = E.proximity_join(e.filter("id % 2 = 0"), e.filter("id % 2 = 1"), "w", "t", "id", 600.0)
    assert found.filter("other = id + 1 AND delta = 0").count() == 30_000
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
