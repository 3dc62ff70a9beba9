import random

from twinfold.llm.common import components, running_totals


def _check(spark, edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        up[max(p, q)] = min(p, q)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_chain_star_and_random(spark):
    rng = random.Random(4)
    chain = list(range(40))
    rng.shuffle(chain)
    _check(spark, list(zip(chain, chain[1:])))
    _check(spark, [(1000, k) for k in range(50)] + [(7, 7), (2000, 1000), (2000, -5)])
    _check(spark, [(rng.randrange(120), rng.randrange(120)) for _ in range(90)])


def test_empty(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_running_totals(spark):
    rows = [(k, k % 7) for k in range(300)]
    got = running_totals(spark.createDataFrame(rows, "k long, n long"), "k", "n", "before", block=16)
    want, total = {}, 0
    for k, n in rows:
        want[k] = total
        total += n
    assert {r.k: r.before for r in got.collect()} == want
