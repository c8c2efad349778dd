import random
import re

import pytest

from memloom.llm import neardup, queries


def brute(rows):
    """Pairs of row_ids of similarity >= 0.6 over all pairs of (row_id, payload)."""
    sets = [(i, set(re.findall(r"[^\W_]+", p.lower()))) for i, p in rows if p]
    return {(min(i, j), max(i, j)) for k, (i, a) in enumerate(sets) for j, b in sets[:k] if a and b and 5 * len(a & b) >= 3 * len(a | b)}


def texts(seed, n=260):
    """Templates with edits: shared frames, rare and common words, insertions, reorderings, copies."""
    rng = random.Random(seed)
    rare = [f"w{i}" for i in range(900)]
    common = [f"c{i}" for i in range(30)]
    frames = [["the", "limit", "of", "must", "stay", "under"], ["use", "library", "with", "adapter", "pool"], []]
    out = []
    for i in range(n):
        if out and rng.random() < 0.45:
            ws = out[rng.randrange(len(out))][1].split()
            for _ in range(rng.choice([0, 1, 2, 4, 6])):
                what = rng.random()
                if what < 0.4 and ws:
                    ws[rng.randrange(len(ws))] = rng.choice(rare)
                elif what < 0.7:
                    ws.insert(rng.randrange(len(ws) + 1), rng.choice(rare + common))
                elif ws:
                    ws.pop(rng.randrange(len(ws)))
            rng.shuffle(ws)
        else:
            ws = rng.choice(frames) + rng.choices(common, k=rng.randrange(6)) + rng.choices(rare, k=rng.choice([0, 1, 3, 7]))
        out.append((i, " ".join(ws)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_all_pairs_found(patches_of, seed):
    rows = texts(seed)
    df = patches_of([{"row_id": i, "patch_id": f"p{i}", "payload": p} for i, p in rows], extra=True)
    got = [tuple(r) for r in neardup.found(df).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


@pytest.mark.parametrize("first", [(1, 1), (2, 3), (5, 2), (3, 3, 2)])
def test_any_thresholds_are_exact(spark, patches_of, first, monkeypatch):
    """Whatever plan is made, and with hardly any subsets allowed, no pair is lost."""
    rows = texts(7, 160)

    def plan(sample, counts, n, num, den):
        mid = len(first) - 1
        words = {w: (0 if w in ("the", "limit", "of") else 1 + i % mid) for i, w in enumerate(sorted(counts))}
        return neardup.Plan(words, counts, mid, 1, first, num, den)

    monkeypatch.setattr(neardup, "make_plan", plan)
    monkeypatch.setattr(neardup, "FREQUENT", 0.03)
    monkeypatch.setattr(neardup, "MAX_SUBSETS", 6)
    df = patches_of([{"row_id": i, "patch_id": f"p{i}", "payload": p} for i, p in rows])
    assert {tuple(r) for r in neardup.found(df).collect()} == brute(rows)


def test_odd_rows(patches_of):
    long = " ".join(f"k{i}" for i in range(3000))
    rows = [
        {"payload": None}, {"payload": ""}, {"payload": " .,; "}, {"payload": "Same text here"}, {"payload": "same TEXT, here!"}, {"payload": "same text here", "patch_type": "Slots "},
        {"payload": "same text here", "patch_type": None}, {"payload": long}, {"payload": long + " more"}, {"payload": "x"}, {"payload": "X."}, {"payload": "same text here", "conv_id": None}, {"payload": "same text here", "patch_id": None},
    ]
    got = {tuple(r) for r in neardup.found(patches_of(rows, extra=True)).collect()}
    assert got == {(3, 4), (3, 6), (4, 6), (7, 8), (9, 10)}
    assert neardup.found(patches_of([])).collect() == []


def test_large_classes_stay_linked(patches_of):
    rows = [{"payload": "one two three four five six"} for _ in range(70)] + [{"payload": "one two three four five seven"}]
    got = {tuple(r) for r in neardup.found(patches_of(rows)).collect()}
    assert got == {(0, i) for i in range(1, 70)} | {(0, 70)}


def test_counted_rows_only(patches_of):
    rows = [{"patch_id": "a", "payload": "one two three"}, {"patch_id": "a", "payload": "four five six"}, {"patch_id": "b", "payload": "one two three"}, {"patch_id": "c", "payload": "five four six"}]
    assert {tuple(r) for r in neardup.found(patches_of(rows)).collect()} == {(1, 3)}


def test_groups_are_components(patches_of):
    rows = texts(4, 150)
    df = patches_of([{"row_id": i, "patch_id": f"p{i}", "payload": p} for i, p in rows])
    root = {i: i for i, p in rows if p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in brute(rows):
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.row_id: r.group_id for r in neardup.groups(df).collect()}
    assert got == {i: find(i) for i in root}


@pytest.mark.parametrize("block", [1_000, 4])
def test_query_lists_all_pairs_of_large_classes(spark, patches_of, tmp_path, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    a, b = ["one two three four five six", "Six FIVE four three two one one"], ["one two three four five seven", "seven one two three four five"]
    rows = list(enumerate([a[i % 2] for i in range(61)] + [b[i % 2] for i in range(55)] + ["one two three four five six eight", "quite another text"]))
    patches_of([{"row_id": i, "patch_id": f"p{i}", "payload": p} for i, p in rows]).write.parquet(f"{tmp_path}/patches.parquet")
    got = [tuple(r) for r in queries.p3_found(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)
