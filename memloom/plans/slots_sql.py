"""SQL for the cells of slot notes, independent of the parser in ``operators.slots``."""

from __future__ import annotations

from memloom.operators import slots

_UNIT = r"(?:[a-z%€$£]+\.?(?:\s+[a-z]+\.?)*)"
_LEAD = r"(?:[€$£]|[a-z]+\s)?\s*"


def _list(xs: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


_NUMBERS = _list(slots.NUMBERS)


def _month(x: str) -> str:
    return f"CASE WHEN {x} <> '' THEN list_position(list_transform({_list(slots.MONTHS)}, lambda mo: mo = {x} OR (length({x}) >= 3 AND starts_with(mo, {x}))), true) END"


def _day(y: str, m: str, d: str) -> str:
    return f"TRY_CAST({y} || '-' || lpad(({m})::VARCHAR, 2, '0') || '-' || lpad({d}, 2, '0') AS DATE)"


def cells(counted: str) -> str:
    """counted: SQL that ends after the definition of the table ``counted``."""
    plain = lambda x: rf"regexp_replace(lower({x}), '[\W_]+', '', 'g')"
    return (
        counted
        + rf"""
, s AS (SELECT conv_id, turn_index, row_id, regexp_split_to_array(payload, '[;|\n]') AS parts FROM counted WHERE payload IS NOT NULL AND regexp_replace(lower(trim(patch_type, ' ')), 's+$', '') = 'slot')
, p AS (SELECT conv_id, turn_index, row_id, i AS pos, parts[i] AS part FROM (SELECT *, UNNEST(range(1, len(parts) + 1)) AS i FROM s))
, m AS (SELECT *, regexp_extract(part, '^\s*(?:\[\s*slots?\s*\]\s*)?([a-z0-9][\w -]*?)\s*\.\s*([\w -]+?)\s*(?:->|=>|:=|→|=|:)\s*(.*?)\s*$', ['sv', 'at', 'raw'], 'i') AS n FROM p)
, k AS (SELECT m.conv_id, c.service, c.attr_name, c.value_type AS kind, trim(trim(trim(regexp_replace(lower(n.raw), '\s+', ' ', 'g')), '"'''), ' ') AS v
  FROM m JOIN slot_catalog c ON {plain("n.sv")} = {plain("c.service")} AND {plain("n.at")} = {plain("c.attr_name")}
  WHERE n.sv <> '' QUALIFY row_number() OVER (PARTITION BY m.conv_id, c.service, c.attr_name ORDER BY m.turn_index DESC NULLS LAST, m.row_id DESC, m.pos DESC) = 1)
, d AS (SELECT *, regexp_extract(v, '^(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}})$', ['y', 'm', 'd']) AS ymd, regexp_extract(v, '^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})$', ['d', 'm', 'y']) AS dmy,
    regexp_extract(v, '^(\d{{1,2}})\.?\s+([a-z]+)\.?,?\s+(\d{{4}})$', ['d', 'm', 'y']) AS dm, regexp_extract(v, '^([a-z]+)\.?\s+(\d{{1,2}}),?\s+(\d{{4}})$', ['m', 'd', 'y']) AS md,
    regexp_extract(v, '^(\d{{1,2}}):(\d{{2}})(?::\d{{2}})?\s*(a\.?m\.?|p\.?m\.?|h|hrs?|uhr)?$', ['h', 'm', 't']) AS clock, regexp_extract(v, '^(\d{{2}})(\d{{2}})(?:\s*(?:h|hrs?|uhr))?$', ['h', 'm']) AS digits
  FROM k WHERE NOT list_contains({_list(sorted(slots.NO_VALUE))}, v))
, t AS (SELECT *, TRY_CAST(coalesce(nullif(clock.h, ''), digits.h) AS INT) AS h0, TRY_CAST(coalesce(nullif(clock.m, ''), digits.m) AS INT) AS mi, left(replace(clock.t, '.', ''), 2) AS half FROM d)
, u AS (SELECT *, CASE WHEN half IN ('am', 'pm') THEN CASE WHEN h0 BETWEEN 1 AND 12 THEN h0 % 12 + CASE half WHEN 'pm' THEN 12 ELSE 0 END END ELSE h0 END AS h FROM t)
, cells AS (SELECT conv_id, service, attr_name, CASE kind
    WHEN 'string' THEN v
    WHEN 'boolean' THEN CASE WHEN list_contains({_list(sorted(slots.TRUE))}, v) THEN 'true' WHEN list_contains({_list(sorted(slots.FALSE))}, v) THEN 'false' END
    WHEN 'int' THEN CASE WHEN regexp_full_match(v, '{_LEAD}[+-]?\d{{1,18}}(?:[.,]0*)?\s*{_UNIT}?') THEN regexp_extract(v, '([+-]?\d{{1,18}})', 1)::BIGINT::VARCHAR
      WHEN list_contains({_NUMBERS}, split_part(v, ' ', 1)) AND regexp_full_match(v, '[a-z]+(?: {_UNIT})?') AND NOT list_has_any(string_split(v, ' ')[2:], list_concat(['or', 'to'], {_NUMBERS})) THEN (list_position({_NUMBERS}, split_part(v, ' ', 1)) - 1)::VARCHAR END
    WHEN 'double' THEN CASE WHEN regexp_full_match(v, '{_LEAD}[+-]?\d{{1,15}}(?:[.,]\d*)?\s*{_UNIT}?') THEN printf('%.2f', replace(regexp_extract(v, '([+-]?\d{{1,15}}(?:[.,]\d*)?)', 1), ',', '.')::DOUBLE) END
    WHEN 'time' THEN CASE WHEN h < 24 AND mi < 60 THEN lpad(h::VARCHAR, 2, '0') || ':' || lpad(mi::VARCHAR, 2, '0') END
    WHEN 'date' THEN (CASE WHEN ymd.y <> '' THEN {_day("ymd.y", "ymd.m", "ymd.d")} WHEN dmy.y <> '' THEN {_day("dmy.y", "dmy.m", "dmy.d")}
      WHEN dm.y <> '' THEN {_day("dm.y", _month("dm.m"), "dm.d")} WHEN md.y <> '' THEN {_day("md.y", _month("md.m"), "md.d")} END)::VARCHAR
    END AS cell FROM u)
SELECT conv_id, service, attr_name, cell FROM cells WHERE cell IS NOT NULL
"""
    )
