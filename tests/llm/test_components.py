"""Components against union-find."""

import numpy as np

from tapelib.llm.components import components


def test_components(spark):
    rng = np.random.default_rng(9)
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, int(x)) for x in range(501, 560)] + rng.integers(1000, 1060, (40, 2)).tolist() + [(3, 3), (100, 101)]
    low = {}
    for _ in range(200):
        for a, b in edges:
            m = min(low.get(a, a), low.get(b, b))
            low[a] = low[b] = m
    got = {r.node: r.comp for r in components(spark.createDataFrame([tuple(e) for e in edges], "a long, b long")).collect()}
    assert got == low
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
