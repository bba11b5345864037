import random

import pytest

from ledgerloom.llm import ngram_join


def roots(links):
    root = {x: x for ab in links for x in ab}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    return sorted((x, find(x)) for x in root)


def shuffled_paths(seed, n, size):
    ids = random.Random(seed).sample(range(10 * n * size), n * size)
    return [(ids[k + j], ids[k + j + 1]) for k in range(0, len(ids), size) for j in range(size - 1)]


@pytest.mark.parametrize("links", [[(4, 3), (4, 1), (5, 3), (5, 2)], shuffled_paths(1, 60, 4), shuffled_paths(2, 30, 6), shuffled_paths(3, 15, 9)])
def test_one_root_a_component(spark, links):
    got = ngram_join.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert sorted(map(tuple, got)) == roots(links)
