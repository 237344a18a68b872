"""CSV with inferred types (A5).

Column types are found over the whole file, not a sample: each task notes for
every column which types all its cells allow, and the notes merge to the least
type of a lattice that holds them all ::

    empty < boolean                            < string
    empty < long < decimal integer < double    < string
    empty < date < timestamp                   < string

It is one pass with a few flags per column to merge.  Records whose number of
cells is not the header's don't vote; they are kept with their whole text in a
column of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAD = "_bad_record"

_INTEGER = r"^\s*[+-]?[0-9]{1,38}\s*$"
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$|^\s*[+-]?(inf|Infinity)\s*$"
#: Type of the lattice -> what a cell has to be for it, in the order tried.
LATTICE = {
    "boolean": "lower(trim({c})) IN ('true', 'false')",
    "bigint": "{c} rlike r'" + _INTEGER + "' AND try_cast(trim({c}) AS BIGINT) IS NOT NULL",
    "decimal(38,0)": "{c} rlike r'" + _INTEGER + "'",
    "double": "{c} rlike r'" + _NUMBER + "'",
    "date": "{c} rlike r'^[0-9]{4}-[0-9]{2}-[0-9]{2}$' AND try_cast({c} AS DATE) IS NOT NULL",
    "timestamp_ntz": "{c} rlike r'^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9:.]+)?$' "
                     "AND try_cast({c} AS TIMESTAMP_NTZ) IS NOT NULL",
}


def _reader(spark: SparkSession, multi_line: bool, null: str):
    return (spark.read.option("header", True).option("quote", '"').option("escape", '"')
            .option("multiLine", multi_line).option("nullValue", null).option("mode", "PERMISSIVE"))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column_types(cells: DataFrame) -> dict[str, str]:
    """The least type of the lattice for each text column; ``string`` where
    none holds every cell, or no cell has a value."""
    flags = []
    for i, c in enumerate(cells.columns):
        flags.append(F.count(F.col(_quoted(c))).alias(f"n{i}"))
        for k, rule in enumerate(LATTICE.values()):
            fits = rule.replace("{c}", _quoted(c))
            flags.append(F.expr(f"bool_and(CASE WHEN {_quoted(c)} IS NOT NULL THEN {fits} END)").alias(f"t{i}_{k}"))
    row = cells.agg(*flags).first()
    found = {}
    for i, c in enumerate(cells.columns):
        fits = [t for k, t in enumerate(LATTICE) if row[f"t{i}_{k}"]]
        found[c] = fits[0] if row[f"n{i}"] and fits else "string"
    return found


def read_csv_inferred(spark: SparkSession, path: str, multi_line: bool = True, null: str = "",
                      bad: str = BAD) -> DataFrame:
    """A header CSV with a type for each column that holds all its cells.

    The column ``bad`` holds the whole text of records with more or fewer cells
    than the header, whose other columns are NULL; it is NULL for good ones.
    Cells equal to ``null`` are NULL and fit any type.  Quoted cells may span
    lines; with ``multi_line`` a file is read whole by one task (write many
    files), without it a record ends at its line's end and files are split.
    A file with a header only gives no rows, of text columns.
    """
    names = _reader(spark, multi_line, null).csv(path).columns
    if bad in names:
        raise ValueError(f"the file has a column {bad}: choose another name for bad records")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, bad]])
    text = (_reader(spark, multi_line, null).option("columnNameOfCorruptRecord", bad)
            .option("enforceSchema", True).schema(schema).csv(path))
    good = F.col(_quoted(bad)).isNull()
    types = column_types(text.filter(good).select(*[F.col(_quoted(n)) for n in names]))
    cast = []
    for n in names:
        cell = F.when(good, F.col(_quoted(n)))
        if types[n] != "string":
            cell = F.trim(cell).try_cast(types[n])
        cast.append(cell.alias(n))
    # Spark refuses to read the column of bad records alone: another goes with it
    whole = F.concat(F.col(_quoted(bad)), F.substring(F.coalesce(F.col(_quoted(names[0])), F.lit("")), 1, 0))
    return text.select(*cast, whole.alias(bad))
