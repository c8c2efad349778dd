"""Attribute-value notes into wide, typed tables (problem 4).

Patches of type slot carry notes ``service.attribute = value``.  They are read once (Arrow batches, since reading dates,
times and amounts in many spellings is beyond built-in expressions), reduced per cell to the deciding note before the
shuffle, and pivoted in blocks of columns: all blocks group the same entity-partitioned table, so the pivots and the joins
of the blocks need no further exchange.  Entities are (conv_id, service); after the reduction an entity has at most one row
per catalogued attribute, however often a conversation repeats a note.

Null payloads, notes without separator, names that the catalogue lacks and unreadable values leave a cell empty (a later
unreadable value empties it).  Of notes of the same turn the one with the greatest row_id, then the last in the payload,
decides.  A null turn counts as before all turns.  An empty table gives an empty result with all columns.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from memloom.sources.tables import counted, norm_type

#: The catalogue is sent to all tasks; beyond this many rows it is refused rather than broadcast.
MAX_CATALOG = 100_000
BLOCK_COLUMNS = 16

# Spellings that a cell may have.
NO_VALUE = {"", "-", "--", "?", "tbd", "n/a", "na", "none", "null", "dontcare", "don't care", "not mentioned", "unknown"}
TRUE = {"true", "yes", "y", "on", "1"}
FALSE = {"false", "no", "n", "off", "0"}
NUMBERS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve"]
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]

_NOTE = re.compile(r"\s*(?:\[\s*slots?\s*\]\s*)?([^\W_][\w -]*?)\s*\.\s*([\w -]+?)\s*(?:->|=>|:=|→|=|:)\s*(.*?)\s*", re.I | re.S)
_UNIT = r"(?:[a-z%€$£]+\.?(?:\s+[a-z]+\.?)*)"
_INT = re.compile(rf"(?:[€$£]|[a-z]+\s)?\s*([+-]?\d{{1,18}})(?:[.,]0*)?\s*{_UNIT}?")
_DOUBLE = re.compile(rf"(?:[€$£]|[a-z]+\s)?\s*([+-]?\d{{1,15}}(?:[.,]\d*)?)\s*{_UNIT}?")
_TIME = re.compile(r"(\d{1,2}):(\d{2})(?::\d{2})?\s*(a\.?m\.?|p\.?m\.?|h|hrs?|uhr)?")
_CLOCK = re.compile(r"(\d{2})(\d{2})(?:\s*(?:h|hrs?|uhr))?")
_YMD = re.compile(r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})")
_DMY = re.compile(r"(\d{1,2})\.(\d{1,2})\.(\d{4})")
_DAY_MONTH = re.compile(r"(\d{1,2})\.?\s+([a-z]+)\.?,?\s+(\d{4})")
_MONTH_DAY = re.compile(r"([a-z]+)\.?\s+(\d{1,2}),?\s+(\d{4})")


def _date(y: str, m: str, d: str) -> str | None:
    try:
        return datetime.date(int(y), int(m), int(d)).isoformat()
    except ValueError:
        return None


def _month(name: str) -> str | None:
    hits = [i for i, m in enumerate(MONTHS, 1) if m == name or len(name) >= 3 and m.startswith(name)]
    return str(hits[0]) if hits else None


def read_cell(raw: str, kind: str) -> str | None:
    """The value in the form of its catalogued type, or None if it can't be read or stands for no value."""
    v = " ".join(raw.split()).strip().lower()
    bare = v.strip("\"'").strip()
    if bare in NO_VALUE:
        return None
    if kind == "string":
        return bare
    v = bare
    if kind == "boolean":
        return "true" if v in TRUE else "false" if v in FALSE else None
    if kind == "int":
        if m := _INT.fullmatch(v):
            return str(int(m[1]))
        first = v.split(" ", 1)
        if first[0] in NUMBERS and (len(first) == 1 or re.fullmatch(_UNIT, first[1]) and not {*first[1].split()} & {"or", "to", *NUMBERS}):
            return str(NUMBERS.index(first[0]))
        return None
    if kind == "double":
        m = _DOUBLE.fullmatch(v)
        return f"{float(m[1].replace(',', '.')):.2f}" if m else None
    if kind == "time":
        if m := _TIME.fullmatch(v):
            h, minute, tail = int(m[1]), int(m[2]), (m[3] or "").replace(".", "")
            if tail in ("am", "pm"):
                if not 1 <= h <= 12:
                    return None
                h = h % 12 + 12 * (tail == "pm")
        elif m := _CLOCK.fullmatch(v):
            h, minute = int(m[1]), int(m[2])
        else:
            return None
        return f"{h:02d}:{minute:02d}" if h < 24 and minute < 60 else None
    if kind == "date":
        if m := _YMD.fullmatch(v):
            return _date(m[1], m[2], m[3])
        if m := _DMY.fullmatch(v):
            return _date(m[3], m[2], m[1])
        if (m := _DAY_MONTH.fullmatch(v)) and (month := _month(m[2])):
            return _date(m[3], month, m[1])
        if (m := _MONTH_DAY.fullmatch(v)) and (month := _month(m[1])):
            return _date(m[3], month, m[2])
        return None
    return None


def _plain(name: str) -> str:
    return re.sub(r"[\W_]+", "", name.lower())


def read_notes(payload: str) -> list[tuple[str, str, str]]:
    """(service, attribute, raw value) of each note, names without separators in lower case."""
    out = []
    for part in re.split(r"[;|\n]", payload):
        if m := _NOTE.fullmatch(part):
            out.append((_plain(m[1]), _plain(m[2]), m[3]))
    return out


def _catalog(catalog: DataFrame) -> list[Row]:
    rows = catalog.select("service", "attr_name", "value_type").where("service IS NOT NULL AND attr_name IS NOT NULL AND value_type IS NOT NULL").distinct().limit(MAX_CATALOG + 1).collect()
    if len(rows) > MAX_CATALOG:
        raise ValueError(f"the catalogue has more than {MAX_CATALOG} rows")
    return sorted(rows)


def slot_cells(patches: DataFrame, catalog: DataFrame) -> DataFrame:
    """(conv_id, service, attr_name, cell) as the deciding notes have it; cell null if unreadable."""
    known = {(_plain(r.service), _plain(r.attr_name)): (r.service, r.attr_name, r.value_type.strip().lower()) for r in _catalog(catalog)}
    schema = pa.schema([("conv_id", pa.int64()), ("service", pa.string()), ("attr_name", pa.string()), ("cell", pa.string()), ("turn_index", pa.int32()), ("row_id", pa.int64()), ("pos", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in schema]
            for conv, turn, row, payload in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn_index", "row_id", "payload")), strict=True):
                for pos, (service, attr, raw) in enumerate(read_notes(payload)):
                    if (k := known.get((service, attr))) is not None:
                        for o, x in zip(out, (conv, k[0], k[1], read_cell(raw, k[2]), turn, row, pos), strict=True):
                            o.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(o, f.type) for o, f in zip(out, schema, strict=True)], schema=schema)

    # The counted row is chosen among all types, since a patch may have been delivered as another type as well; the
    # payloads of other types needn't be shuffled for that.
    note = F.when(norm_type(F.col("patch_type")) == "slot", F.col("payload"))
    rows = counted(patches.select("conv_id", "patch_id", "ingested_at", "row_id", "turn_index", note.alias("payload")), "row_id", "turn_index", "payload").where("payload IS NOT NULL")
    notes = rows.select("conv_id", "turn_index", "row_id", "payload").mapInArrow(run, "conv_id BIGINT, service STRING, attr_name STRING, cell STRING, turn_index INT, row_id BIGINT, pos INT")
    return notes.groupBy("conv_id", "service", "attr_name").agg(F.max_by("cell", F.struct("turn_index", "row_id", "pos")).alias("cell"))


def _columns(rows: list[Row]) -> dict[str, tuple[list[tuple[str, str]], str]]:
    """Column name -> (the attributes it holds, type); attributes of one name and type share a column."""
    kinds: dict[str, set[str]] = {}
    for r in rows:
        kinds.setdefault(r.attr_name, set()).add(r.value_type.strip().lower())
    out: dict[str, tuple[list[tuple[str, str]], str]] = {}
    for r in rows:
        kind = r.value_type.strip().lower()
        name = r.attr_name if len(kinds[r.attr_name]) == 1 else f"{r.attr_name}_{kind}"
        if name in ("conv_id", "service"):
            name += "_"
        out.setdefault(name, ([], kind))[0].append((r.service, r.attr_name))
    return out


_SPARK = {"int": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE"}


def wide_slots(patches: DataFrame, catalog: DataFrame, block_columns: int = BLOCK_COLUMNS) -> DataFrame:
    """One row per conversation and service with a typed column per catalogued attribute (times as HH:mm)."""
    columns = _columns(_catalog(catalog))
    spark = patches.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cells = slot_cells(patches, catalog).where("cell IS NOT NULL").repartition(n, "conv_id", "service")
    names = list(columns)
    wide = None
    for i in range(0, len(names), block_columns):
        aggs = []
        for name in names[i : i + block_columns]:
            attrs, kind = columns[name]
            value = F.max(F.when(F.col("attr_name").isin(sorted({a for _, a in attrs})) & F.col("service").isin([s for s, _ in attrs]), F.col("cell")))
            aggs.append(value.cast(_SPARK.get(kind, "STRING")).alias(name))
        block = cells.groupBy("conv_id", "service").agg(*aggs)
        wide = block if wide is None else wide.join(block, ["conv_id", "service"])
    return cells.select("conv_id", "service").distinct() if wide is None else wide


def found(patches: DataFrame, catalog: DataFrame) -> DataFrame:
    """(conv_id, service, attr_name, cell): the filled cells of the wide table, written as strings."""
    wide = wide_slots(patches, catalog)
    cells = []
    for name, (attrs, kind) in _columns(_catalog(catalog)).items():
        text = F.format_string("%.2f", F.col(name)) if kind == "double" else F.col(name).cast("string")
        cells.append(F.struct(F.lit(attrs[0][1]).alias("attr_name"), F.when(F.col(name).isNotNull(), text).alias("cell")))
    if not cells:
        return wide.select("conv_id", "service", F.lit("").alias("attr_name"), F.lit("").alias("cell"))
    return wide.where("conv_id IS NOT NULL").select("conv_id", "service", F.explode(F.filter(F.array(*cells), lambda x: x["cell"].isNotNull())).alias("c")).select("conv_id", "service", "c.attr_name", "c.cell")
