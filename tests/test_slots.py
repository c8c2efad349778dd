import datetime

import pytest

from memloom.operators import slots

CASES = [
    ("7", "int", "7"), ("007", "int", "7"), ("37 units", "int", "37"), ("twelve", "int", "12"), ("a few", "int", None), ("1-2", "int", None), ("3 or 4", "int", None), ("4.5", "int", None), ("9.0", "int", "9"),
    ("€996.22", "double", "996.22"), ("EUR 640.30", "double", "640.30"), ("349,5 EUR", "double", "349.50"), ("$ 7", "double", "7.00"), ("1.2.3", "double", None), ("low", "double", None),
    ("Yes", "boolean", "true"), ("OFF", "boolean", "false"), ("0", "boolean", "false"), ("maybe", "boolean", None),
    ("2031-06-25", "date", "2031-06-25"), ("2031/06/05", "date", "2031-06-05"), ("26.11.2031", "date", "2031-11-26"), ("5 June 2032", "date", "2032-06-05"), ("Oct 7, 2032", "date", "2032-10-07"), ("2032-13-01", "date", None), ("soon", "date", None),
    ("4:00 am", "time", "04:00"), ("12:05 a.m.", "time", "00:05"), ("11:30PM", "time", "23:30"), ("0725", "time", "07:25"), ("14:20 hrs", "time", "14:20"), ("14:20:59", "time", "14:20"), ("25:00", "time", None), ("later", "time", None),
    ('"River  Side"', "string", "river side"), ("n/a", "string", None), ("-", "string", None), ("", "string", None), ("x" * 5000, "string", "x" * 5000),
]


@pytest.mark.parametrize(("raw", "kind", "want"), CASES)
def test_cells(raw, kind, want):
    assert slots.read_cell(raw, kind) == want


def test_notes():
    assert slots.read_notes("[SLOT] Dining.book date -> 2031/09/02 | cab.shared=yes;rail.seats : 4") == [("dining", "bookdate", "2031/09/02"), ("cab", "shared", "yes"), ("rail", "seats", "4")]
    assert slots.read_notes("no note") == [] and slots.read_notes("") == []


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame([("dining", "book_people", "int"), ("dining", "book_date", "date"), ("dining", "budget", "double"), ("cab", "shared", "boolean"), ("cab", "leave_at", "time"), ("rail", "leave_at", "time"), (None, "x", "int")], "service STRING, attr_name STRING, value_type STRING")


def test_last_note_decides(patches_of, catalog):
    df = patches_of(
        [
            {"patch_type": "Slots", "turn_index": 1, "payload": "dining.book_people = 2"},
            {"patch_type": " SLOT", "turn_index": 5, "payload": "DINING.Book-People: 4; dining.budget = 7,5"},
            {"patch_type": "slot", "turn_index": 3, "payload": "dining.book_people = 3 | cab.leave_at = 9:05 pm"},
            {"patch_type": "slot", "turn_index": 9, "payload": "dining.budget = tbd"},
            {"patch_type": "entity", "turn_index": 9, "payload": "cab.shared = yes"},
            {"patch_type": "slot", "turn_index": 9, "payload": None},
            {"patch_type": "slot", "turn_index": None, "payload": "rail.leave_at = 0700"},
        ],
        extra=True,
    )
    for block in (1, 2, 16):
        wide = {r.service: r for r in slots.wide_slots(df, catalog, block).collect()}
        assert wide["dining"].book_people == 4 and wide["dining"].budget is None
        assert wide["cab"].leave_at == "21:05" and wide["cab"].shared is None and wide["rail"].leave_at == "07:00"
    assert {tuple(r) for r in slots.found(df, catalog).collect()} == {(1, "dining", "book_people", "4"), (1, "cab", "leave_at", "21:05"), (1, "rail", "leave_at", "07:00")}


def test_types_and_empty(patches_of, catalog):
    df = patches_of([{"patch_type": "slot", "payload": "dining.book_date = 2.3.2031"}])
    assert slots.wide_slots(df, catalog).first().book_date == datetime.date(2031, 3, 2)
    assert slots.found(patches_of([]), catalog).collect() == []
    assert "book_date" in slots.wide_slots(patches_of([]), catalog).columns
