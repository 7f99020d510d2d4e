"""Families of near copies that no first head has joined."""

from __future__ import annotations

import numpy as np

from gridmosaic.llm import ngrams
from gridmosaic.llm.components import components

SCHEMA = "n long, a long, hashes array<long>, keys array<long>, image array<long>"


def as_set(a, members):
    hashes = np.sort(np.array(members, dtype=np.uint64))
    return len(members), a, [int(x) for x in hashes.view(np.int64)], [0, 0, 0], [int(x) for x in ngrams.bit_image(hashes)]


def test_a_family_is_compared_by_heads_not_by_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    draw = lambda n: [int(x) for x in rng.integers(1, 1 << 62, n)]
    common, apart = draw(95), draw(100)
    size = 60
    sets = [as_set(k, common + draw(5)) for k in range(size)]  # any two: 95 of 105
    sets += [as_set(size, apart), as_set(size + 1, apart[:85] + draw(15))]  # 85 of 115: not similar
    frame = spark.createDataFrame(sets, SCHEMA)
    compared = []
    real = ngrams._similar_pairs
    monkeypatch.setattr(ngrams, "_similar_pairs", lambda pairs, all_sets: compared.append(pairs.count()) or real(pairs, all_sets))
    links = ngrams.links_between_groups(frame, spark.createDataFrame([], "u long, root long"))
    roots = {r.u: r.root for r in components(links).collect()}
    assert len({roots.get(k, k) for k in range(size)}) == 1
    assert size not in roots and size + 1 not in roots
    assert sum(compared) <= 3 * size  # 1,770 pairs are similar


def test_join_groups_goes_to_the_hub(spark):
    groups = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, 40), (5, 50), (6, 60), (7, 10)], "a long, grp long")
    links = spark.createDataFrame([(1, 2), (3, 7), (1, 4), (5, 6), (1, 7)], "u long, v long")
    hubs = {r.g: r.hub for r in ngrams.join_groups(links, groups).collect()}
    assert hubs == {10: 10, 20: 10, 30: 10, 40: 10, 50: 60, 60: 60}
