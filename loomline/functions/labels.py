"""Label sets as one canonical string, and the operations on it.

``lkey`` lists the metric name first, then the present labels by name, ``name STX value`` joined by SOH. It identifies a series,
groups and joins cheaply, and turns back into a map wherever a label is needed. Labels with an empty
value are absent.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAIR, SEP = "\x02", "\x01"
NAME = "__name__"


def key_of_map(labels: Column) -> Column:
    """Canonical string of a map; null and empty values are left out."""
    entries = F.filter(F.map_entries(labels), lambda e: F.length(e["value"]) > 0)
    return F.coalesce(F.array_join(F.array_sort(F.transform(entries, lambda e: F.concat(e["key"], F.lit(PAIR), e["value"]))), SEP), F.lit(""))


def key_of_columns(columns: dict[str, Column]) -> Column:
    """Canonical string of labels held in columns (null or empty: absent)."""
    parts = [F.when(F.length(c.cast("string")) > 0, F.concat(F.lit(k + PAIR), c.cast("string"))) for k, c in sorted(columns.items())]
    return F.concat_ws(SEP, *parts) if parts else F.lit("")


def to_map(lkey: Column) -> Column:
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.when(lkey == "", empty).otherwise(F.str_to_map(lkey, F.lit(SEP), F.lit(PAIR)))


def label(lkey: Column, name: str) -> Column:
    """Value of a label, '' if absent."""
    if not name:
        return F.lit("")
    head = SEP + name + PAIR
    rest = F.substring_index(F.concat(F.lit(SEP), lkey), head, -1)
    return F.when(F.contains(F.concat(F.lit(SEP), lkey), F.lit(head)), F.substring_index(rest, SEP, 1)).otherwise(F.lit(""))


def keep(lkey: Column, names: list[str]) -> Column:
    if not names:
        return F.lit("")
    return F.array_join(F.filter(F.split(lkey, SEP), lambda p: F.substring_index(p, PAIR, 1).isin(*names)), SEP)


def drop(lkey: Column, names: list[str]) -> Column:
    return F.array_join(F.filter(F.split(lkey, SEP), lambda p: ~F.substring_index(p, PAIR, 1).isin(*names)), SEP) if names else lkey


def put(lkey: Column, name: str, value: Column) -> Column:
    """The label set with ``name`` set to ``value``; an empty value removes the label."""
    if name == NAME:
        rest = drop(lkey, [NAME])
        return F.when(F.length(value) > 0, named(rest, value)).otherwise(rest)
    first = F.substring_index(lkey, SEP, 1)
    has_name = F.startswith(lkey, F.lit(NAME + PAIR))
    others = F.filter(F.split(lkey, SEP), lambda p: ~F.substring_index(p, PAIR, 1).isin(name, NAME) & (p != ""))
    with_new = F.when(F.length(value) > 0, F.array_append(others, F.concat(F.lit(name + PAIR), value))).otherwise(others)
    joined = F.array_join(F.array_sort(with_new), SEP)
    return F.when(has_name & (joined != ""), F.concat(first, F.lit(SEP), joined)).when(has_name, first).otherwise(joined)


def named(lkey: Column, metric: Column) -> Column:
    """A key without metric name, with one put in front."""
    head = F.concat(F.lit(NAME + PAIR), metric)
    return F.when(lkey == "", head).otherwise(F.concat(head, F.lit(SEP), lkey))


def matches(value: Column, op: str, wanted: str) -> Column:
    """Matcher on a label value ('' if absent). Regular expressions match the whole value; a broken one matches nothing."""
    if op in ("=", "!="):
        return value == wanted if op == "=" else value != wanted
    import re

    try:
        re.compile(wanted)
    except re.error:
        return F.lit(op == "!~")
    hit = value.rlike(f"^(?:{wanted})$")
    return hit if op == "=~" else ~hit
