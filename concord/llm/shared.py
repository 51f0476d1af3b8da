"""Helpers of the operators: tables written on the way, Arrow maps, stores of a worker, names."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.operators.graph import connected_components
from concord.operators.tables import discard, materialise, shared_dir

__all__ = ["WORD", "Scratch", "add_schema", "ascii_lower", "connected_components", "discard", "free_names", "hold", "map_arrow", "materialise", "shared_dir"]

#: ASCII white space, the only separator of words in these operators.
WORD = r"[^\x20\x09-\x0D]+"


class Scratch:
    """Tables that a computation writes on its way; all but those its result still reads go at its end."""

    def __init__(self):
        self.made: list[DataFrame] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.made.append(materialise(df, name))
        return self.made[-1]

    def clear(self, *keep: DataFrame) -> None:
        for df in self.made:
            if not any(df is k for k in keep):
                discard(df)
        self.made = list(keep)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with the schema given as DDL."""
    return df.mapInArrow(fn, schema)


_holder: list = [None, None]


def hold(name: str, drop: Callable[[], None]) -> None:
    """Let one operator at a time keep a store in this worker process: the one before drops its own."""
    if _holder[0] != name:
        if _holder[1]:
            _holder[1]()
        _holder[:] = [name, drop]


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def add_schema(df: DataFrame, *extra: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in extra)])
