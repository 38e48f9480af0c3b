import random

from tessera.llm.components import connected_components


def brute(edges):
    of = {}

    def find(x):
        of.setdefault(x, x)
        while of[x] != x:
            x = of[x]
        return x

    for u, v in edges:
        if None not in (u, v) and u != v:
            a, b = find(u), find(v)
            of[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in of)


def test_chains_stars_and_odd_pairs(spark):
    rnd = random.Random(6)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(i, 200) for i in range(201, 230)]
    edges += [(rnd.randint(300, 400), rnd.randint(300, 400)) for _ in range(60)] + [(500, 500), (7, 6), (7, 6), (None, 3), (9, None), (-5, 12)]
    rnd.shuffle(edges)
    got = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted((r.node, r.component) for r in got) == brute(edges)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
