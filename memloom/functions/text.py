"""Text functions as Column expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memloom.schema import REVISION_MARKS, TOPIC_STOP_WORDS, TYPES, UNITS


TOKEN = r"\p{L}+|\p{N}{1,3}|[^\s\p{L}\p{N}]+"


def count_tokens(text: Column) -> Column:
    """Runs of letters, up to three digits, or other marks: the native stand-in for a subword tokenizer."""
    return F.size(F.regexp_extract_all(text, F.lit(TOKEN), 0))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_payload(text: Column, most: int = 200) -> Column:
    return F.substring(collapse(text), 1, most)


def fingerprint(payload: Column) -> Column:
    """Order-preserving: md5 of the lower-case, collapsed text, 16 hex digits."""
    return F.substring(F.md5(F.lower(collapse(payload))), 1, 16)


def words_of(text: Column) -> Column:
    """White-space separated words; empty for a blank text."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def topic_keyword(text: Column) -> Column:
    low = F.lower(text)
    words = F.regexp_extract_all(low, F.lit("([a-z]{3,})"), 1)
    telling = F.filter(words, lambda w: ~F.array_contains(F.array(*(F.lit(x) for x in TOPIC_STOP_WORDS)), w))
    number = F.try_element_at(F.regexp_extract_all(low, F.lit(r"(\d+[.%a-z]*)"), 1), F.lit(1))
    first = F.try_element_at(telling, F.lit(1))
    return F.when(number.isNotNull(), F.concat_ws("_", F.coalesce(first, F.lit("rule")), number)).otherwise(F.coalesce(first, F.try_element_at(words, F.lit(1)), F.lit("topic")))


def slot_key(patch_type: Column, payload: Column) -> Column:
    return F.concat_ws("::", patch_type, topic_keyword(payload))


def tag(patch_type: Column) -> Column:
    known = F.create_map(*(x for t, v in TYPES.items() for x in (F.lit(t), F.lit(v[0]))))
    return F.coalesce(F.try_element_at(known, patch_type), F.upper(F.substring(patch_type, 1, 3)))


def prompt_line(patch_type: Column, payload: Column) -> Column:
    return F.concat(F.lit("["), tag(patch_type), F.lit("] "), payload)


def token_cost(patch_type: Column, payload: Column) -> Column:
    return count_tokens(prompt_line(patch_type, payload))


def normalize_type(raw: Column) -> Column:
    """Canonical type, or null: lower case, without trailing s, one alias."""
    t = F.regexp_replace(F.lower(raw), "s+$", "")
    t = F.when(t == "constrain", "constraint").otherwise(t)
    return F.when(t.isin(list(TYPES)), t)


def jaccard(a: Column, b: Column) -> Column:
    """Of lower-case word sets; punctuation belongs to the words."""
    x, y = words_of(F.lower(a)), words_of(F.lower(b))
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))


def delta_text(new: Column, base: Column) -> Column:
    n, b = words_of(F.lower(new)), words_of(F.lower(base))
    more, less = F.array_sort(F.array_except(n, b)), F.array_sort(F.array_except(b, n))
    part = lambda sign, ws: F.when(F.size(ws) > 0, F.concat(F.lit(f"{sign}["), F.array_join(ws, " "), F.lit("]")))
    return F.coalesce(F.nullif(F.concat_ws(" ", part("+", more), part("-", less)), F.lit("")), new)


def _is_upper(w: Column) -> Column:
    return (w == F.upper(w)) & (w != F.lower(w))


def _starts_upper(w: Column) -> Column:
    return _is_upper(F.substring(w, 1, 1))


def trim_numeric(payload: Column, most: Column) -> Column:
    """The ``most`` weightiest words in their order: digits, percent or capitals, capital initials weigh."""
    words = words_of(payload)

    def entry(w: Column, i: Column) -> Column:
        weight = F.when(w.rlike(r"\d"), 2).otherwise(0) + F.when(w.contains("%") | _is_upper(w), 1).otherwise(0) + F.when(_starts_upper(w), 1).otherwise(0)
        return F.struct((-weight).alias("order"), i.alias("i"), w.alias("w"))

    best = F.slice(F.array_sort(F.transform(words, entry)), F.lit(1), most)
    kept = F.array_sort(F.transform(best, lambda e: F.struct(e["i"].alias("i"), e["w"].alias("w"))))
    return F.when(F.size(words) <= most, payload).otherwise(F.array_join(F.transform(kept, lambda e: e["w"]), " "))


def _strip_marks(w: Column) -> Column:
    return F.regexp_replace(w, "[.,;:]+$", "")


def ultra_compact(payload: Column) -> Column:
    """At most four words: the first capitalised keyword, then numbers and units in lower case."""
    words = words_of(payload)
    low = lambda w: _strip_marks(F.lower(w))
    counts = lambda w: w.rlike(r"\d") | w.contains("%") | low(w).isin(UNITS)
    keep = F.transform(F.filter(words, counts), low)
    keyword = F.slice(F.filter(words, lambda w: ~counts(w) & _starts_upper(w) & (F.length(w) >= 2)), 1, 1)
    parts = F.slice(F.concat(keyword, keep), 1, 4)
    return F.when(F.size(words) == 0, payload).otherwise(F.coalesce(F.nullif(F.array_join(parts, " "), F.lit("")), F.try_element_at(words, F.lit(1))))


def single_token(payload: Column) -> Column:
    """The most telling word: a number, else an acronym, else a capitalised word, else the first."""
    words = words_of(payload)
    bare = F.transform(words, _strip_marks)
    first = lambda ws: F.try_element_at(ws, F.lit(1))
    number = _strip_marks(first(F.filter(words, lambda w: w.rlike(r"\d"))))
    acronym = first(F.filter(bare, lambda w: (F.length(w) >= 2) & _is_upper(w)))
    capital = first(F.filter(bare, _starts_upper))
    return F.coalesce(number, acronym, capital, first(bare), F.lit("?"))


def has_revision_mark(payload: Column) -> Column:
    out = F.lit(False)
    for m in REVISION_MARKS:
        out = out | F.lower(payload).contains(m)
    return out


def raw_token_estimate(text: Column) -> Column:
    return F.floor(F.size(words_of(text)) * 4 / 3).cast("long")
