import random

from polyglint.llm.graphs import components


def test_components(spark):
    rng = random.Random(1)
    for edges in ([], [(1, 1)], [(k, k + 1) for k in range(40)], [(rng.randrange(80), rng.randrange(80)) for _ in range(50)], [(9, k) for k in range(9)] + [(1, 2), (2, 1), (None, 3)]):
        parent = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for a, b in edges:
            if a is not None:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
        want = {(x, root(x)) for x in parent if root(x) != x}
        got = components(spark.createDataFrame(edges, "a long, b long"))
        assert {tuple(r) for r in got.collect()} == want and got.columns == ["node", "label"]
