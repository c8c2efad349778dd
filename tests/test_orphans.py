import datetime

from memloom.operators import orphans

T = datetime.datetime(2031, 3, 1)


def hours(n):
    return T + datetime.timedelta(hours=n)


def tables(spark, patches_of):
    patches = patches_of(
        [
            {"row_id": 1, "patch_id": "p0_0", "dependencies": ["p9_9", " P9_9 ", "", None, "p1_0"], "ingested_at": hours(1)},
            {"row_id": 2, "patch_id": "p1_0", "dependencies": ["p0_0", "x"], "ingested_at": hours(2)},
            {"row_id": 3, "patch_id": "p1_0", "dependencies": ["p0_0", "x"], "ingested_at": hours(3)},
            {"row_id": 4, "patch_id": "p2_0", "dependencies": None, "ingested_at": None},
        ],
        extra=True,
    )
    items = spark.createDataFrame([(10, 1, "P0_0", hours(0)), (11, 1, " p0_0", hours(1)), (12, 1, None, hours(1)), (13, 2, "p0_0", hours(5)), (14, 1, "p9_9", None)], "row_id BIGINT, conv_id BIGINT, patch_id STRING, selected_at TIMESTAMP_NTZ")
    deleted = spark.createDataFrame([(1, "X ", None, hours(9)), (1, "x", "merge", hours(9)), (1, None, None, None)], "conv_id BIGINT, patch_id STRING, reason STRING, deleted_at TIMESTAMP_NTZ")
    return patches, items, deleted


WANT = {
    ("patches", 1, "p9_9", "missing"),
    ("patches", 1, "p1_0", "late"),
    ("patches", 3, "x", "deleted"),
    ("context_items", 10, "p0_0", "late"),
    ("context_items", 13, "p0_0", "missing"),
}


def test_states(spark, patches_of):
    got = orphans.found(*tables(spark, patches_of))
    rows = [(r.src_table, r.row_id, r.ref_id, r.ref_state) for r in got.collect()]
    assert set(rows) == WANT and len(rows) == len(WANT)
    assert {r.src_month for r in got.collect()} == {"2031-02" if T.day > 1 else "2031-03"}


def test_steps_equal_one_load(spark, patches_of):
    patches, items, deleted = tables(spark, patches_of)
    state, last = None, None
    refs = orphans.patch_refs(patches).unionByName(orphans.item_refs(items)).where("made_at IS NOT NULL")
    for lo, hi in ((-1, 1), (1, 2), (2, 99)):
        new_refs = refs.where(f"made_at > TIMESTAMP_NTZ'{hours(lo)}' AND made_at <= TIMESTAMP_NTZ'{hours(hi)}'")
        new_parents = orphans.parent_rows(patches.where(f"ingested_at > TIMESTAMP_NTZ'{hours(lo)}' AND ingested_at <= TIMESTAMP_NTZ'{hours(hi)}'"))
        new_gone = orphans.deletion_rows(deleted.where(f"deleted_at > TIMESTAMP_NTZ'{hours(lo)}' AND deleted_at <= TIMESTAMP_NTZ'{hours(hi)}'"))
        state, last = orphans.orphan_step(state, new_refs, new_parents, new_gone)
        state = state.save()
    assert {(r.src_table, r.row_id, r.ref_id, r.ref_state) for r in last.collect()} == WANT


def test_reopened_by_deletion(spark, patches_of):
    patches, items, _ = tables(spark, patches_of)
    gone = spark.createDataFrame([(1, "p0_0", None, hours(9))], "conv_id BIGINT, patch_id STRING, reason STRING, deleted_at TIMESTAMP_NTZ")
    _, found = orphans.orphan_step(None, orphans.item_refs(items).where("row_id = 11"), orphans.parent_rows(patches), orphans.deletion_rows(gone), reopen=True)
    assert [r.ref_state for r in found.collect()] == ["reopened"]


def test_empty(spark, patches_of):
    patches, items, deleted = (t.limit(0) for t in tables(spark, patches_of))
    assert orphans.found(patches, items, deleted).collect() == []
