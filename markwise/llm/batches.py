"""Arrow batches between Spark and the per-task helpers of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from markwise.session import fresh_path

#: Rows that are made per output batch where an operator makes its own rows.
ROWS_OUT = 2000
#: Rows that a helper works on at a time; what it holds meanwhile grows with them.
SLICE_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``written`` for tables of packed numbers: compressed with zstd."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts_of(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them."""
    wide = pa.types.is_large_string(column.type)
    return column.cast(pa.large_binary() if wide else pa.binary()).to_pylist()


def add_columns(
    df: DataFrame,
    inputs: list[str],
    outputs: T.StructType,
    make: Callable[[], Callable[..., list]],
    keep: list[str] | None = None,
) -> DataFrame:
    """``df[keep]`` with the columns ``outputs`` appended, a batch at a time.

    ``make`` runs once per task and returns the function that turns the input
    arrays of a batch into one list or array per output column. A kept column
    with the name of an output column gives way to it. Rows stay as they are,
    so repeated rows and null keys need no care. The input columns are passed
    under names of their own; clashes with other columns do no harm.
    """
    fresh = {field.name for field in outputs}
    kept = [name for name in (df.columns if keep is None else keep) if name not in fresh]
    schema = T.StructType([df.schema[name] for name in kept] + list(outputs))
    sent = df.select(
        *[df[name].alias(f"k{i}") for i, name in enumerate(kept)],
        *[df[name].alias(f"i{i}") for i, name in enumerate(inputs)],
    )
    n_kept, n_inputs = len(kept), len(inputs)
    kinds = [field.dataType for field in outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        work = make()
        types = [to_arrow_type(kind) for kind in kinds]
        for batch in (whole.slice(i, SLICE_ROWS) for whole in batches for i in range(0, whole.num_rows, SLICE_ROWS)):
            made = work(*[batch.column(n_kept + i) for i in range(n_inputs)])
            arrays = [batch.column(i) for i in range(n_kept)]
            arrays += [
                column if isinstance(column, pa.Array) and column.type == kind else pa.array(column, kind)
                for column, kind in zip(made, types, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
        # the worker lives on for other stages
        pa.default_memory_pool().release_unused()

    return sent.mapInArrow(run, schema)


def emit(schema_names: list[str], types: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays(
        [pa.array(column, kind) for column, kind in zip(columns, types, strict=True)], names=schema_names
    )
