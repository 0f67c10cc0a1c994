import random

import pytest

from lexiloom.llm.components import components


def brute(links):
    root = {x: x for link in links for x in link}
    for a, b in links:
        low, high = sorted((root[a], root[b]))
        root = {k: low if r == high else r for k, r in root.items()}
    return root


def cases():
    r = random.Random(4)
    ids = [r.randrange(-(1 << 62), 1 << 62) for _ in range(80)]
    return {
        "none": [],
        "loops only": [(1, 1), (2, 2)],
        "chain": list(zip(ids, ids[1:])),
        "ascending chain": [(k, k + 1) for k in range(120)],
        "star": [(ids[0], x) for x in ids[1:]],
        "sparse": [(r.choice(ids), r.choice(ids)) for _ in range(45)],
        "repeated": [(1, 2), (2, 1), (1, 2), (3, 2), (5, 4), (4, 4)],
    }


@pytest.mark.parametrize("name", list(cases()))
def test_components_against_merging_one_link_after_another(spark, name):
    links = cases()[name]
    got = [tuple(x) for x in components(spark.createDataFrame(links, "a long, b long")).collect()]
    linked = [x for x in links if x[0] != x[1]]
    assert len(got) == len(dict(got)) and dict(got) == brute(linked)
