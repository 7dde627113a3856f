"""Nearest vectors by blocks against all pairs, and how many rows meet."""

import numpy as np
import pytest

from raterline.operators import nearest as ne

KIND = "id long, cluster int, v array<float>"


def direct(rows):
    out = {}
    for i, c, v in rows:
        if i is None or c is None or i % 3:
            continue
        for j, d, w in rows:
            if j is None or c != d or i == j:
                continue
            terms = [(a - b) ** 2 for a, b in zip(v or [], w or []) if a is not None and b is not None]
            gap = float(np.sqrt(sum(terms))) if terms else None
            key = (gap is None, np.isnan(gap) if terms else False, gap if terms and not np.isnan(gap) else 0.0, j)
            if i not in out or key < out[i][0]:
                out[i] = (key, j, gap)
    return {i: v[1:] for i, v in out.items()}


@pytest.mark.parametrize("size", [1024, 7])
def test_equals_all_pairs(spark, size):
    """Copies, near copies far from the origin, one large cluster, and vectors that are not whole."""
    rng = np.random.default_rng(4)
    rows = [(i, 0 if i % 4 else i % 5, np.round(rng.normal(size=6) + 1000 * (i % 2), 3).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, 0, rows[i][2]) for i in range(20)] + [(2000 + i, 0, rows[1][2]) for i in range(60)]
    rows += [(3000, 9, [1.0] * 6), (3003, 8, [2.0] * 6), (3004, 8, None), (3006, 0, None), (3009, 0, [1.0, None, 3.0, 4.0, 5.0, 6.0]), (3012, 0, [float("nan")] * 6), (3015, 0, [1.0, 2.0]), (3018, None, [1.0] * 6), (None, 0, [1.0] * 6)]
    got = {r.id: (r.nearest, r.distance) for r in ne.nearest(spark.createDataFrame(rows, KIND), "id % 3 = 0", size=size, asked=5).collect()}
    want = direct(rows)
    assert got.keys() == want.keys()
    for i, (j, gap) in want.items():
        assert got[i][0] == j and (got[i][1] is None if gap is None else got[i][1] == pytest.approx(gap, nan_ok=True)), (i, got[i], want[i])


def test_pairs_of_vectors_are_never_rows(spark):
    """2,000 queries and 2,000 vectors of one cluster meet as blocks, not as four million rows."""
    rng = np.random.default_rng(5)
    d = spark.createDataFrame([(i, 1, rng.normal(size=4).tolist()) for i in range(2000)], KIND)
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = lambda: (lambda s: [s.apply(i) for i in range(s.size())])(store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None))
    before = {s.stageId() for s in stages()}
    assert ne.nearest(d, "true").count() == 2000
    assert max(s.shuffleWriteRecords() for s in stages() if s.stageId() not in before) <= 20_000


def test_no_vectors(spark):
    assert ne.nearest(spark.createDataFrame([], KIND), "true").count() == 0
