import random

import pytest

from memloom.operators import hierarchy


def brute(rows):
    """(conv, patch) -> root by walking, of rows (conv, patch, deps) that are counted."""
    by = {}
    for conv, pid, deps in rows:
        by.setdefault(conv, {})[pid] = deps
    out = {}
    for conv, nodes in by.items():
        def parent(p):
            return next((d.strip().lower() for d in nodes[p] or () if d is not None and d.strip().lower() in nodes), None)

        for p in nodes:
            if parent(p) is None:
                continue
            seen, x = [p], parent(p)
            while x is not None and x not in seen:
                seen.append(x)
                x = parent(x)
            out[conv, p] = seen[-1] if x is None else "cycle:" + min(seen[seen.index(x) :])
    return out


def random_rows(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        conv = rng.choice([1, 1, 1, 2, 3])
        deps = rng.choice([None, [], [rng.choice([f"p0_{rng.randrange(n)}", f" P0_{rng.randrange(n)}", None, "", "gone"]) for _ in range(3)], [f"p0_{i}"] if rng.random() < 0.2 else [f"p0_{max(0, i - 1)}"]])
        rows.append((conv, f"p0_{i}", deps))
    return rows


@pytest.mark.parametrize("block", [200_000, 5])
def test_roots_equal_walking(patches_of, block):
    rows = random_rows(3)
    df = patches_of([{"conv_id": c, "patch_id": p, "dependencies": d} for c, p, d in rows], extra=True)
    want = brute(rows)
    got = {(r.conv_id, r.patch_id): r.root_id for r in hierarchy.found(df, block).collect()}
    assert got == want
    tree = {(r.conv_id, r.patch_id): r for r in hierarchy.hierarchy(df, block).collect()}
    assert len(tree) == len(rows)
    for key, r in tree.items():
        assert r.path[-1] == key[1] and len(r.path) == r.depth + 1
        assert r.root_id == want.get(key, key[1])
        assert r.n_descendants == sum(key[1] in x.path[:-1] for k, x in tree.items() if k[0] == key[0])
    pairs = hierarchy.descendants(hierarchy.hierarchy(df, block)).count()
    assert pairs == sum(r.depth for r in tree.values())


def test_repeats_nulls_and_empty(patches_of):
    rows = [
        {"patch_id": "p0_0", "dependencies": ["p0_1"]},
        {"patch_id": "p0_0", "dependencies": None},  # delivered again, counts
        {"patch_id": "p0_1", "dependencies": ["P0_0 "]},
        {"patch_id": None, "dependencies": ["p0_0"]},
        {"conv_id": None, "patch_id": "p0_2", "dependencies": ["p0_0"]},
    ]
    assert [tuple(r) for r in hierarchy.found(patches_of(rows)).collect()] == [(1, "p0_1", "p0_0")]
    assert hierarchy.found(patches_of([])).collect() == []
    assert hierarchy.hierarchy(patches_of([])).collect() == []


def test_long_chain_and_cycle_on_the_spread_way(patches_of):
    rows = [{"patch_id": f"p{i}_0", "dependencies": [f"p{i - 1}_0"] if i else []} for i in range(70)]
    rows += [{"conv_id": 2, "patch_id": f"p{i}_0", "dependencies": [f"p{(i + 1) % 9}_0"]} for i in range(9)]
    rows += [{"conv_id": 2, "patch_id": f"q{i}_0", "dependencies": [f"q{i - 1}_0" if i else "p4_0"]} for i in range(20)]
    got = {(r.conv_id, r.root_id) for r in hierarchy.found(patches_of(rows), 3).collect()}
    assert got == {(1, "p0_0"), (2, "cycle:p0_0")}


@pytest.mark.parametrize("block", [200_000, 15, 3])
def test_dependents_include_the_circle(patches_of, block):
    deps = {f"p{i}": f"p{(i + 1) % 4}" for i in range(4)} | {"a": "p1", "b": "a", "c": "b", "d": "p3", "x": "y", "y": "x", "s": "s", "t": "s", "r": None, "q": "r"}
    rows = [{"conv_id": c, "patch_id": p, "dependencies": [d]} for c in (1, 2) for p, d in deps.items()]
    want = {}
    for p in deps:
        x, n = deps[p], 1
        while x is not None and x != p and (x, p) not in want:
            want[x, p] = n
            x, n = deps[x], n + 1
    tree = hierarchy.hierarchy(patches_of(rows), block)
    assert {(r.conv_id, r.patch_id): r.n_descendants for r in tree.collect()} == {(c, p): sum(a == p for a, _ in want) for c in (1, 2) for p in deps}
    got = [tuple(r) for r in hierarchy.descendants(tree).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(c, a, p, n) for c in (1, 2) for (a, p), n in want.items()}


@pytest.mark.parametrize("block", [200_000, 3])
def test_odd_spelling_of_patch_ids(patches_of, block):
    rows = [{"patch_id": p, "dependencies": d} for p, d in ((" P1", None), ("p2", ["p1"]), ("P3 ", ["P2"]), ("p4", ["p3"]), ("p5", ["p4"]))]
    df = patches_of(rows)
    assert {tuple(r) for r in hierarchy.found(df, block).collect()} == {(1, p, " P1") for p in ("p2", "P3 ", "p4", "p5")}
    assert {(r.patch_id, r.depth) for r in hierarchy.hierarchy(df, block).collect()} == {(" P1", 0), ("p2", 1), ("P3 ", 2), ("p4", 3), ("p5", 4)}
