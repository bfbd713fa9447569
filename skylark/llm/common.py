"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylark.session import checkpointed  # noqa: F401  shared by the operators

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one Arrow batch: texts may be long, and a batch is what a Python worker holds at once.
BATCH_ROWS = 400


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what a Python worker holds: plans made from now on send at most so many rows a batch. A session's lower bound stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def append(df: DataFrame, **columns: Column) -> DataFrame:
    """df and the columns; a column of the same name gives way to the new one."""
    return df.withColumns(columns)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def unfold(df: DataFrame, struct: str, fields: list[str]) -> DataFrame:
    """The fields of a struct column as columns, instead of same-named columns of df."""
    return df.withColumns({f: F.col(f"`{struct}`.`{f}`") for f in fields}).drop(struct)


def texts_of(batches: Iterator) -> Iterator[list[str | None]]:
    """The Python strings of Arrow arrays."""
    for batch in batches:
        yield batch.to_pylist()
