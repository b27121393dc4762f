"""Running Python over Arrow batches of a few columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Input partitions for each core below which a table is spread before work that costs far more than moving it.
PARTITIONS_PER_CORE = 3


def spread(df: DataFrame) -> DataFrame:
    """``df`` in enough partitions to keep all cores busy. What is read from tables of more splits than that (any large one) isn't moved. Only the
    sizes that the plan's leaves state are looked at: nothing is run, and no row depends on it."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df if size >= 2 * cores * split else df.repartition(PARTITIONS_PER_CORE * cores)


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[..., Iterator[tuple]]]) -> DataFrame:
    """Each row of ``df`` to any number of rows of ``schema``. ``make`` builds the row function once a task; it gets the columns
    as arguments and yields tuples."""
    fields = T._parse_datatype_string(schema).fields
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            rows: list[tuple] = []
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.extend(function(*values))
                if len(rows) >= 50_000:
                    yield _batch(rows, arrow)
                    rows = []
            if rows:
                yield _batch(rows, arrow)

    return df.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
