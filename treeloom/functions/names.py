"""Rules for names of references, users and directory entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_BYTES = 1024
CONTROL = "[\\x00-\\x1f\\x7f]"


def reference_error(name: Column) -> Column:
    """Why a reference name is refused; null if it is fine. A slash has no meaning."""
    return F.when(F.octet_length(name) == 0, "empty").when(F.octet_length(name) > MOST_BYTES, "too long").when(name.contains("@"), "at sign").when(name.rlike(CONTROL), "control character")


def user_error(name: Column) -> Column:
    """As reference_error, but an at sign is allowed."""
    return F.when(F.octet_length(name) == 0, "empty").when(F.octet_length(name) > MOST_BYTES, "too long").when(name.rlike(CONTROL), "control character")


def unsafe_entry(name: Column) -> Column:
    """Entry names that an export refuses."""
    return name.isin("", ".", "..") | name.contains("/")


def unsafe_path(path: Column) -> Column:
    """Archive paths that an extraction refuses: absolute ones and those with a parent part."""
    return path.startswith("/") | F.array_contains(F.split(path, "/"), "..")
