"""Normal forms of keys, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_id(c: Column) -> Column:
    """Runs of anything but ASCII letters and digits become ``_``, outer ``_`` go, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))


def folded(c: Column) -> Column:
    """Without outer white space, lower case."""
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def make_id(*parts: Column) -> Column:
    """Id of several parts: empty parts are dropped, outer ``_`` and ``.`` of each part are trimmed."""
    cleaned = [F.regexp_replace(F.coalesce(p, F.lit("")), r"^[_.]+|[_.]+$", "") for p in parts]
    return normal_id(F.array_join(F.filter(F.array(*cleaned), lambda p: p != ""), "_"))


def path_form(c: Column) -> Column:
    r"""``\`` as ``/``, leading ``./`` dropped."""
    return F.regexp_replace(F.regexp_replace(c, r"\\", "/"), r"^(\./)+", "")
