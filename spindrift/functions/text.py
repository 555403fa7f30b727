"""Column functions for keys that were typed or exported with blanks and in any case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bare(text: Column) -> Column:
    """``text`` without outer white space of any kind; null stays null."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def name_key(text: Column) -> Column:
    """``text`` as a key: lower case, without outer white space; null stays null."""
    return F.lower(bare(text))
