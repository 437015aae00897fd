"""String, path and map functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zero_padded(number: Column, width: int) -> Column:
    """at least `width` characters; longer numbers stay whole (lpad would cut them)."""
    s = number.cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def base_name(path: Column) -> Column:
    """F2."""
    return F.element_at(F.split(path, "/"), -1)


def moved(path: Column, old: str, new: str) -> Column:
    """the path under another prefix; others stay."""
    return F.when(F.startswith(path, F.lit(old)), F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 20))).otherwise(path)


def moved_values(paths: Column, old: str, new: str) -> Column:
    """for the values of a map."""
    return F.transform_values(paths, lambda _, v: moved(v, old, new))


def first_int(name: Column) -> Column:
    """the first run of digits, null where there is none."""
    return F.expr("try_cast(null as bigint)") if name is None else F.nullif(F.regexp_extract(name, r"(\d+)", 1), F.lit("")).cast("long")


def stamp(time: Column) -> Column:
    """F21."""
    return F.date_format(time, "ddMMyy_HHmmss")


def updated(base: Column, changes: Column) -> Column:
    """a map with the entries of another put over its own."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(changes, k)), changes)


def sorted_entries(pairs: Column) -> Column:
    """a map's entries in order of their keys."""
    return F.array_sort(F.map_entries(pairs))


def literal(value: Column, kind: str) -> Column:
    """A stored parameter as a number where it is one, else null."""
    return F.try_to_number(value, F.lit("999999999999")).cast(kind) if kind == "long" else value.try_cast(kind)


def json_value(column: Column, path: str, kind: str) -> Column:
    """a scalar of a JSON text, null where it is absent or no such value."""
    return F.get_json_object(column, path).try_cast(kind)
