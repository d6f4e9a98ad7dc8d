"""Column expressions on text: number formats, list text, file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column, places: int = 6) -> Column:
    return F.format_string(f"%.{places}f", value)


def percent(ratio: Column, places: int = 2) -> Column:
    return F.format_string(f"%.{places}f%%", ratio * 100.0)


def grouped(value: Column) -> Column:
    """Thousands separated by commas."""
    return F.format_number(value, 0)


def parse_int_list(text: Column) -> Column:
    """``'[4096, 1024]'`` to ``array<int>``."""
    return F.from_json(text, "array<int>")


def show_int_list(values: Column) -> Column:
    """``array<int>`` to ``'[4096, 1024]'``."""
    return F.concat(F.lit("["), F.array_join(values.cast("array<string>"), ", "), F.lit("]"))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def stem(path: Column) -> Column:
    """File name without folders and without its last extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")
