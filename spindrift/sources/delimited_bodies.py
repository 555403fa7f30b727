"""Small delimited files held as text in a column, turned into typed result rows.

Every file has its own separator, column order, quoting, line ends and number
format.  All of it is worked out per row with built-in functions, so a million
files are one narrow stage without Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = (",", ";", "\t", "|")


def _occurrences(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _pattern(sep: Column) -> Column:
    """A separator as a regular expression."""
    return F.concat(F.lit("\\"), sep)


def _fields(line: Column, sep: Column) -> Column:
    """Split one line at its separator; a separator between quotes is text; a line with an open quote has no fields."""
    e = _pattern(sep)
    within = F.concat(e, F.lit('( *"(?:[^"]|"")*" *|[^'), e, F.lit("]*)"))
    quoted = F.when(_occurrences(line, '"') % 2 == 0, F.regexp_extract_all(F.concat(sep, line), within, F.lit(1))).otherwise(F.array().cast("array<string>"))
    return F.when(line.contains('"'), quoted).otherwise(F.split(line, e))


def _clean(field: Column) -> Column:
    """A field without outer blanks and quotes."""
    bare = F.regexp_replace(F.regexp_replace(field, r"^\s+|\s+$", ""), r'^"\s*|\s*"$', "")
    return F.when(field.contains('"'), F.replace(bare, F.lit('""'), F.lit('"'))).otherwise(F.trim(field, F.lit(" \t\x0b\f\r\n")))


def _number(field: Column) -> Column:
    """A number with a decimal point or comma; null if it is none."""
    return F.replace(field, F.lit(","), F.lit(".")).try_cast("double")


def read_bodies(files: DataFrame, body: str, keep: list[str], text_fields: list[str], number_fields: list[str], broken: str | None = None) -> DataFrame:
    """One row for each complete line of each body.

    ``keep`` are columns of ``files`` to carry, ``text_fields`` and
    ``number_fields`` the header names to read (compared without case).  A line is
    complete if it has as many fields as the header and no open quote.  With
    ``broken`` other lines give rows too, whose fields are null; that column tells
    them.  Null and empty bodies and bodies of a header alone give no rows; a header
    repeated within a body gives rows whose numbers are null; a field missing from
    the header is null.
    """
    text = F.regexp_replace(F.col(body), "^\ufeff", "")
    lines = F.filter(F.split(text, "\r\n|\n|\r"), lambda x: F.trim(x) != "")

    def separator(head: Column) -> Column:
        counts = F.array(*[F.struct(_occurrences(head, s).alias("n"), F.lit(-i).alias("k"), F.lit(s).alias("s")) for i, s in enumerate(SEPARATORS)])
        return F.array_max(counts)["s"]

    # A variable of a lambda is worked out once: the lines of a body, then its separator, then each line's fields.
    # What is exploded are the fields, so neither the filter nor the columns made of them split a line again.
    parted = F.transform(F.array(lines), lambda v: F.struct(v.alias("lines"), separator(F.get(v, F.lit(0))).alias("sep")))
    parted = F.transform(
        parted,
        lambda v: F.struct(
            F.transform(_fields(F.get(v["lines"], F.lit(0)), v["sep"]), lambda x: F.lower(_clean(x))).alias("_names"),
            F.transform(F.slice(v["lines"], 2, F.greatest(F.size(v["lines"]), F.lit(0))), lambda x: _fields(x, v["sep"])).alias("_rows"),
        ),
    )
    rows = files.where(F.col(body).isNotNull()).select(*keep, F.explode(parted).alias("_b"))
    rows = rows.select(*keep, F.col("_b._names").alias("_names"), F.explode("_b._rows").alias("_fields"))
    whole = F.size("_fields") == F.size("_names")
    if broken is None:
        rows = rows.where(whole)

    def value(name: str) -> Column:
        at = F.array_position("_names", name.lower())
        return F.when((at > 0) & whole, _clean(F.try_element_at("_fields", at.cast("int"))))

    return rows.select(
        *keep,
        *[F.nullif(value(n), F.lit("")).alias(n.lower()) for n in text_fields],
        *[_number(value(n)).alias(n.lower()) for n in number_fields],
        *([(~whole).alias(broken)] if broken else []),
    )
