"""Reading of JSON arrays out of replies that hold more, or damaged, text."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FENCE = r"(?s)```(?:json)?\s*(.*?)\s*```"


def strip_fences(text: Column) -> Column:
    """Contents of the first code fence, else the text, without outer white space."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(bare.rlike(_FENCE), F.regexp_extract(bare, _FENCE, 1)).otherwise(bare)


def repair(text: Column) -> Column:
    """Typographic quotes to plain ones, no comma before a closing bracket."""
    plain = F.translate(text, "“”‘’", "\"\"''")
    return F.regexp_replace(plain, r",\s*([\]}])", "$1")


def _balanced(text: str | None) -> str | None:
    if not text or (start := text.find("[")) < 0:
        return None
    depth = 0
    # Strings are passed over whole; an unclosed one runs to the end.
    for m in re.finditer(r'"(?:[^"\\]|\\.)*(?:"|\Z)|[\[\]]', text[start:], re.S):
        if m[0] == "[":
            depth += 1
        elif m[0] == "]":
            depth -= 1
            if not depth:
                return text[start : start + m.end()]
    return None


def balanced_array(text: Column) -> Column:
    """From the first bracket to the one that closes it, strings passed over; null if it stays open."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(_balanced, na_action="ignore")

    return run(text)


def parse_array(raw: str | None) -> list | None:
    """The array that a reply holds: the whole text, the first list of an object, or a balanced, perhaps repaired, part."""
    if raw is None:
        return None
    text = raw.strip()
    if m := re.search(_FENCE, text):
        text = m[1]
    try:
        whole = json.loads(text.strip())
    except ValueError:
        part = _balanced(text)
        fixed = part and re.sub(r",\s*([\]}])", r"\1", part.translate({0x201C: '"', 0x201D: '"', 0x2018: "'", 0x2019: "'"}))
        for candidate in filter(None, (part, fixed)):
            try:
                got = json.loads(candidate)
            except ValueError:
                continue
            if isinstance(got, list):
                return got
        return None
    if isinstance(whole, dict):
        return next((v for v in whole.values() if isinstance(v, list)), None)
    return whole if isinstance(whole, list) else None


def explode_items(replies: DataFrame) -> DataFrame:
    """(conv_id, turn_index, item_no, type, payload, dependencies, error) of (conv_id, turn_index, llm_response) rows.

    item_no is -1 with ``error`` set where no array can be read; ids among the dependencies are strings or integers.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("turn_index", pa.int32()), ("item_no", pa.int32()), ("type", pa.string()), ("payload", pa.string()), ("dependencies", pa.list_(pa.string())), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for conv, turn, raw in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn_index", "llm_response")), strict=True):
                items = parse_array(raw)
                if items is None:
                    rows.append((conv, turn, -1, None, None, None, "parse_failure"))
                for i, x in enumerate(items or ()):
                    if isinstance(x, dict) and all(k in x for k in ("type", "payload", "patch_id")):
                        deps = [str(v) for v in x.get("dependencies") or () if isinstance(v, (str, int))]
                        rows.append((conv, turn, i, str(x["type"]), str(x["payload"])[:200], deps, None))
            columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return replies.select("conv_id", "turn_index", "llm_response").mapInArrow(run, "conv_id BIGINT, turn_index INT, item_no INT, type STRING, payload STRING, dependencies ARRAY<STRING>, error STRING")
