"""Order-dependent rules over the rows of each key, without a call per key into pandas."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

BATCH = 10_000


def per_key(df: DataFrame, key: str, rule: Callable[[list[dict]], Iterable[tuple]], schema: str) -> DataFrame:
    """``rule`` on the rows of each value of ``key``; one key's rows are in memory at a time.

    Rows are dealt by key and sorted by it, so keys stream through a task and Spark spills the sort. A key's
    rows must fit a task: use it where keys are small by nature, such as a company's rounds.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[] for _ in kinds]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds)

    def run(batches):
        held, made, at = [], [], None
        for batch in batches:
            for row in batch.to_pylist():
                if held and row[key] != at:
                    made += rule(held)
                    held = []
                at = row[key]
                held.append(row)
            if len(made) >= BATCH:
                yield out(made)
                made = []
        if held:
            made += rule(held)
        yield out(made)

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def scan(df: DataFrame, key: str, order: list, begin: Callable[[], Callable[[dict], Iterable[tuple]]], schema: str) -> DataFrame:
    """Each key's rows in ``order``, one at a time, through the function that ``begin`` makes for the key.

    Nothing of a key is held but what that function keeps, so keys may be of any size if it forgets.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        at, step = object(), None
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                if row[key] != at:
                    at, step = row[key], begin()
                made += step(row)
            columns = list(zip(*made)) if made else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
