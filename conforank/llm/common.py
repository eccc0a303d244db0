"""Shared column expressions and small helpers of the text operators.

Conventions of every operator here: rows of ``docs`` with null text count as empty
text; other columns are carried along inside one struct, so none of their names can
clash with working columns, and a column named like a result is replaced by it.
"""

from __future__ import annotations

import functools
import re
import sys
from collections.abc import Callable
from types import ModuleType

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
#: Rows handled at once in a Python task.
BATCH_ROWS = 500
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER_MAP = str.maketrans(UPPER, LOWER)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; plain ASCII takes the faster way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body``."""
    return F.transform(F.array(value), body)[0]


def carried(docs: DataFrame) -> DataFrame:
    """``_all`` (the whole row), ``_id``, ``_text`` (never null) and ``_hash`` of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.struct("*").alias("_all"), F.col("doc_id").alias("_id"), text.alias("_text")).withColumn(
        "_hash", F.xxhash64("_text")
    )


def restored(df: DataFrame, like: DataFrame, text: Column | None = None, **results: Column) -> DataFrame:
    """The columns of ``like`` out of ``_all``, with ``text`` and the results put in."""
    put = results if text is None else {"text": text, **results}
    old = [F.col("_all").getField(c).alias(c) for c in like.columns if c not in put]
    new = {c: value.alias(c) for c, value in put.items()}
    if text is None:
        return df.select(*old, *new.values())
    order = [c for c in like.columns if c not in results]
    return df.select(*[new.pop(c) if c in new else F.col("_all").getField(c).alias(c) for c in order], *new.values())


#: Words between the six ASCII white-space characters.
ascii_words = re.compile(r"[^\x20\x09-\x0D]+").findall


def unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Module entry of what a process remembers. Task functions bring copies of this package's globals,
#: new ones for each task and filled with the driver's values; only the interpreter's modules stay.
HELD = "_conforank_held"


def _held() -> dict[tuple, object]:
    return vars(sys.modules.setdefault(HELD, ModuleType(HELD))).setdefault("things", {})


def alone(make: Callable) -> Callable:
    """Cache of what ``make`` gives; a process keeps one such thing, of any maker, and lets the last one go.

    Each process makes its own: nothing of the driver's is sent with a task. Python workers live
    on from task to task and stage to stage, so what an operator remembers would stay beside the
    next one's.
    """

    @functools.wraps(make)
    def get(*args):
        held, key = _held(), (make.__module__, make.__name__, args)
        if key not in held:
            held.clear()
            pa.default_memory_pool().release_unused()
            held[key] = make(*args)
        return held[key]

    return get
