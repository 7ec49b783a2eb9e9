import random

import pytest

from quern.llm.components import connected_components

LINKS = "u bigint, v bigint"


def union_find(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    # a component's least node stands for it and is not listed itself
    return {x: find(x) for x in root if find(x) != x}


def check(spark, links):
    got = connected_components(spark.createDataFrame(links, LINKS))
    rows = got.collect()
    assert len(rows) == len({r.node for r in rows})
    assert {r.node: r.component for r in rows} == union_find(links)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    check(spark, [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(220)])


def test_paths_stars_and_odd_links(spark):
    path = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, 1000 + i) for i in range(1, 80)] + [(2000, 1040)]
    odd = [(5000, 5000), (None, 7), (8, None), (None, None), (6000, 6001), (6001, 6000), (6000, 6001)]
    check(spark, path + star + odd)
    assert connected_components(spark.createDataFrame([], LINKS)).count() == 0
    assert connected_components(spark.createDataFrame([(3, 3)], LINKS)).count() == 0
