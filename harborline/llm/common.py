"""Column expressions and small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space of all operators: space and the control characters from tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other letter as it is; plain ASCII takes the faster built-in function."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words(text: Column) -> Column:
    """Maximal runs of characters that are not white space; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), lambda word: word != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once; inside a lambda a plain column expression is computed per element."""
    return F.transform(F.array(value), body)[0]


def unit(*parts: Column | str) -> Column:
    """A number in [0, 1) with 52 random-looking bits, the same in every engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def as_row(df: DataFrame) -> DataFrame:
    """All columns packed into one struct ``row``, so that names an operator adds cannot clash with names of the input."""
    return df.select(F.struct(*(F.col(f"`{name}`") for name in df.columns)).alias("row"))


def field(name: str) -> Column:
    return F.col("row").getField(name)


def unpacked(df: DataFrame, **added: Column) -> DataFrame:
    """The packed columns again, with ``added`` ones at the end; an input column of an added name is replaced."""
    names = [f.name for f in df.schema["row"].dataType.fields]
    taken = {name.lower() for name in added}
    kept = [field(name).alias(name) for name in names if name.lower() not in taken]
    return df.select(*kept, *(column.alias(name) for name, column in added.items()))


def replaced(df: DataFrame, name: str, column: Column) -> DataFrame:
    """The packed columns again, in their order, with the values of one of them replaced."""
    names = [f.name for f in df.schema["row"].dataType.fields]
    return df.select(*((column if each == name else field(each)).alias(each) for each in names))


def small_text_batches(spark: SparkSession, rows: int = 512) -> None:
    """Whole texts are wide rows: pass fewer of them to Python at a time, unless the session has its own setting."""
    if spark.conf.get(BATCH_ROWS, None) is None:
        spark.conf.set(BATCH_ROWS, str(rows))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
