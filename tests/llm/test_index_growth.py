"""What the Jaccard join's index, its buckets and its groups cost as tables grow."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from foreband.llm import common, jaccard_join, words


def tokens(r, n):
    return np.unique(words.mix(r.integers(0, 1 << 62, n, dtype=np.uint64)))


@pytest.mark.parametrize(("num", "den"), [(80, 100), (85, 100)])
def test_sets_of_strangers_hardly_meet(num, den):
    """Sets that share nothing, or one passage, don't gather in a bucket that grows with their number."""
    r = np.random.default_rng(11)
    passage = tokens(r, 9)
    sets = [np.unique(np.concatenate((tokens(r, int(n)), passage))) for n in r.integers(180, 420, 500)]
    met = Counter(k for s in sets for k in np.unique(jaccard_join.signatures(s, num, den)).tolist())
    assert max(met.values()) <= 25


@pytest.mark.parametrize("seed", range(4))
def test_linked_sets_of_any_size_in_a_band_share_a_key(seed):
    """Pigeonhole, also where the sizes are the farthest apart, and where many segments are small."""
    r, linked = np.random.default_rng(seed), 0
    for _ in range(200):
        n = int(r.choice([2, 4, 8, 14, 30, 60, 150, 500, 1500]))
        a = tokens(r, n)
        drop = int(r.integers(0, n // 5 + 1))
        b = np.unique(np.concatenate((r.permutation(a)[drop:], tokens(r, int(r.choice([0, n // 5 - drop, n // 4])) if n // 5 > drop else 0))))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 80 * (len(a) + len(b) - both):
            linked += 1
            assert len(np.intersect1d(jaccard_join.signatures(a, 80, 100), jaccard_join.signatures(b, 80, 100)))
    assert linked > 60


@pytest.mark.parametrize(("skip", "rows"), [(0, 7), (5, 7), (512, 333), (100, 2000)])
def test_bucket_rows_meet_every_pivot_before_them(skip, rows):
    """Pairs found in stretches are those of comparing all members, however the rows are cut to batches."""
    r = np.random.default_rng(12)
    table = []
    for key in range(25):
        base = tokens(r, int(r.choice([10, 60, 300])))
        for c in np.sort(r.integers(-(1 << 62), 1 << 62, 620 if key == 7 else int(r.choice([2, 6, 30])))).tolist():
            s = np.unique(np.concatenate((r.permutation(base)[int(r.integers(0, len(base) // 3 + 1)) :], tokens(r, int(r.integers(0, len(base) // 3 + 1))))))
            table.append((key, c, len(s), jaccard_join.parity(s), int(r.integers(0, 4))))
    names, types = ["key", "cls", "n", "fine", "g"], [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
    batches = pa.table([pa.array(c, t) for c, t in zip(zip(*table, strict=True), types, strict=True)], names).to_batches(rows)
    got = [tuple(x.values()) for b in jaccard_join._meet(80, 100, skip, True)(batches) for x in b.to_pylist()]
    pairs, members = set(), set()
    for key in range(25):
        own = [x for x in table if x[0] == key][skip:]
        for j, (_, b, m, q, h) in enumerate(own):
            for _, a, n, p, g in own[: min(j, jaccard_join.PIVOTS)]:
                if g != h and 180 * jaccard_join.least_difference(p, q) <= 20 * (n + m):
                    pairs.add((None, a, b))
                    members |= {(key, a, None), (key, b, None)}
    assert set(got) == pairs | members and len(got) == len(set(got)) and (pairs or skip == 512)


def test_a_large_group_of_many_links_is_contracted(spark, monkeypatch):
    """Of a group with forty links a member only the links between the first labels go through the rounds."""
    left, spread = [], common._spread
    monkeypatch.setattr(common, "_spread", lambda pairs, rows: left.append(rows) or spread(pairs, rows))
    r = random.Random(13)
    pivots = r.sample(range(600), 40)
    links = [(p, i) for i in range(600) for p in pivots] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7), (2000, 2000)]
    got = {x.id: x.component for x in common.grouped(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(600)} | {1000 + i: 1000 for i in range(41)}
    assert sum(left) < len(links) // 20
