import random

import pytest

from tensorloom.llm.components import components


def plain(edges):
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root if find(i) != i}


@pytest.mark.parametrize("kind", ["random", "path", "star", "none", "loops"])
def test_components(spark, kind):
    rng = random.Random(3)
    edges = {
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(220)],
        "path": [(i, i + 1) for i in rng.sample(range(60), 60)],
        "star": [(7, i) for i in range(8, 40)] + [(3, 7), (3, 7)],
        "none": [],
        "loops": [(1, 1), (2, 2), (5, 4)],
    }[kind]
    df = spark.createDataFrame(edges, "a long, b long")
    got = components(df).collect()
    assert {r["node"]: r["root"] for r in got} == plain(edges) and len(got) == len(plain(edges))
