import random
from collections import Counter

import pytest

from memloom.llm import packing


def exact(items, cap):
    """Least number of containers by search over small instances."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for r in sorted({b for b in bins if b >= items[i]}):
            j = bins.index(r)
            go(i + 1, bins[:j] + [r - items[i]] + bins[j + 1 :])
        go(i + 1, [*bins, cap - items[i]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(6))
def test_patterns_hold_all_items(seed):
    rng = random.Random(seed)
    for _ in range(40):
        cap = rng.choice([10, 30, 100])
        h = Counter(rng.randint(1, cap) for _ in range(rng.randrange(80)))
        got = Counter()
        for pattern, n in packing.pack_histogram(h, cap):
            assert n > 0 and sum(s * k for s, k in pattern) <= cap
            for s, k in pattern:
                got[s] += k * n
        assert got == h


@pytest.mark.parametrize("seed", range(4))
def test_reduction_keeps_the_optimum(seed):
    rng = random.Random(seed)
    for _ in range(25):
        cap = rng.choice([10, 20, 50])
        items = [rng.randint(max(1, cap // 5), cap) for _ in range(9)]
        fixed, rest = packing.reduce_instance(Counter(items), cap)
        assert sum(n for _, n in fixed) + exact(list(Counter(rest).elements()), cap) == exact(items, cap)


def test_assignment(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([0, 1, 50, 50, 50, 333, 600, 1400, rng.randrange(700)])) for i in range(900)] + [(7, 50), (None, 20)]
    sizes = spark.createDataFrame(rows, "doc_id BIGINT, n_tokens BIGINT")
    packs = spark.createDataFrame([("a", 512), ("b", 2048), ("none", 0), (None, 5)], "pack_name STRING, capacity_tokens INT")
    got = packing.assign(sizes, packs, block=100).collect()
    for name, cap in (("a", 512), ("b", 2048)):
        own = [r for r in got if r.pack_name == name]
        assert sum(r.n_tokens for r in own) == sum(n for _, n in rows)
        assert len({(r.doc_id, r.piece_no, r.container_id, r.n_tokens) for r in own if r.doc_id not in (7, None)}) == len([r for r in own if r.doc_id not in (7, None)])
        room = Counter()
        for r in own:
            room[r.container_id] += r.n_tokens
        assert max(room.values()) <= cap
        pieces = Counter(r.doc_id for r in own if r.n_tokens or r.doc_id is not None)
        for d, n in rows:
            if d is not None and d != 7:
                assert pieces[d] == max(1, -(-n // cap))
        full = {c for c, t in room.items() if t}
        assert full == set(range(max(full) + 1))
    assert packing.assign(sizes.limit(0), packs).collect() == []


def test_whole_way(spark):
    docs = spark.createDataFrame([(1, "hello world " * 400, "x"), (2, None, "x"), (3, "", "x"), (4, "a" * 50_000, "x"), (5, "short", "x")], "doc_id BIGINT, text STRING, size STRING")
    packs = spark.createDataFrame([("short", 512)], "pack_name STRING, capacity_tokens INT")
    got = packing.pack(docs, packs).collect()
    assert {r.doc_id for r in got} == {1, 2, 3, 4, 5}
    report = packing.fill_report(packing.pack(docs, packs)).first()
    assert report.fullest <= 512 and report.n_containers >= report.least_containers
