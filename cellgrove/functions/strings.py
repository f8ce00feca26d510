"""Path and tag helpers, all built-in string expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    """Last extension in lower case, dot included."""
    return F.lower(F.regexp_extract(file_name(path), r"(?<=.)(\.[^.]*)$", 1))


def parent(path: Column) -> Column:
    """Name of the folder that holds the file."""
    return F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)


def key(label: Column, path: Column) -> Column:
    """Join key of a file: label and stem, spaces replaced."""
    return F.replace(F.concat_ws("_", label, stem(path)), F.lit(" "), F.lit("_"))


def tag(text: Column) -> Column:
    """Keep letters, digits, dot, dash and underscore; collapse the rest."""
    return F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_")


def signed(value: Column) -> Column:
    """Two decimals with an explicit sign."""
    return F.format_string("%+.2f", value)
