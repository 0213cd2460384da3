"""String expressions: trimming, company keys and country codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fumarole import vocab

# (?U): white space, letters and word boundaries in the Unicode sense
_EDGES = r"(?U)^\s+|\s+$"
_RUNS = r"(?U)\s+"
_SUFFIX = "(?U)" + vocab.COMPANY_SUFFIX


def strip(c: Column) -> Column:
    """Drop any white space at both ends (``trim`` alone only drops spaces)."""
    return F.regexp_replace(c, _EDGES, "")


def company_key(c: Column) -> Column:
    """Lower case, without legal-form words, single-spaced.

    A dot after the last suffix word stays, since no word boundary follows it:
    "Acme Inc." gives "acme .".
    """
    bare = F.regexp_replace(F.lower(c), _SUFFIX, "")
    return F.regexp_replace(strip(bare), _RUNS, " ")


def country_code(c: Column, looked_up: Column) -> Column:
    """Three-letter code of a trimmed country text.

    ``looked_up`` is the code found for the text in an alias table, null if none was.
    """
    return (
        F.when(c.rlike(r"^\p{L}{3}$"), F.upper(c))
        .otherwise(F.coalesce(looked_up, F.substring(F.upper(c), 1, 3)))
    )


def country_upper(c: Column) -> Column:
    """The plain rule without an alias table: trimmed upper case."""
    return strip(F.upper(c))
