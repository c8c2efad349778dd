import datetime
import random

import pytest

from memloom.operators import history

SCHEMA = "row_id BIGINT, conv_id BIGINT, turn_index INT, slot_key STRING, payload STRING, arrived_at TIMESTAMP_NTZ, version_no STRING, run STRING"
T = datetime.datetime(2031, 1, 1)


def brute(rows):
    out, convs = set(), {}
    for r in rows:
        if r[1] is not None and r[2] is not None:
            convs.setdefault(r[1], []).append(r)
    for conv, rs in convs.items():
        turns = sorted({r[2] for r in rs})
        for key in {r[3].strip().lower() for r in rs if r[3] is not None}:
            held, start = None, None
            for i, t in enumerate([*turns, None]):
                own = [r for r in rs if t is not None and r[2] == t and r[3] is not None and r[3].strip().lower() == key]
                best = max(own, key=lambda r: (r[5], r[0]), default=None)
                now = None if best is None or best[4] is None else " ".join(best[4].split()).lower()
                if now != held:
                    if held is not None:
                        out.add((conv, key, start, -1 if t is None else t))
                    held, start = now, t
    return out


@pytest.mark.parametrize("block", [128, 3, 1])
def test_versions_equal_walking(spark, block):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        rows.append((i, rng.choice([1, 1, 2]), rng.randrange(40), rng.choice(["A::x", " a::X", "b", None]), rng.choice(["one", "ONE", "one ", "two", None, ""]), T + datetime.timedelta(hours=rng.randrange(5)), "v", "r"))
    rows += [(900, None, 1, "b", "x", T, "v", "r"), (901, 1, None, "b", "x", T, "v", "r")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in history.history(df, block).select("conv_id", "slot_key", "valid_from", "valid_to").collect()]
    assert set(got) == brute(rows) and len(got) == len(set(got))


def test_long_run_over_blocks_and_empty(spark):
    rows = [(i, 1, i, "k", "same" if i < 30 else "x" * 10_000, T, "v", "r") for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in history.history(df, 4).orderBy("version_no").select("version_no", "valid_from", "valid_to", "n_saves").collect()]
    assert got == [(1, 0, 30, 30), (2, 30, -1, 10)]
    assert history.found(df.limit(0)).collect() == []
