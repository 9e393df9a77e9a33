"""Column expressions on lesson-config values: key case, escaping, flags."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markwise import fixed_values as fixed
from markwise.functions.text import strip


def snake_case(name: str) -> str:
    return re.sub(r"(?<=.)([A-Z])", r"_\1", name).lower()


def camel_case(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(part.capitalize() for part in rest)


def _renamed(data_type: T.DataType, rename) -> T.DataType:
    if isinstance(data_type, T.StructType):
        return T.StructType(
            [T.StructField(rename(f.name), _renamed(f.dataType, rename), f.nullable) for f in data_type]
        )
    if isinstance(data_type, T.ArrayType):
        return T.ArrayType(_renamed(data_type.elementType, rename), data_type.containsNull)
    if isinstance(data_type, T.MapType):
        return T.MapType(data_type.keyType, _renamed(data_type.valueType, rename), data_type.valueContainsNull)
    return data_type


def rename_keys(df: DataFrame, rename=snake_case) -> DataFrame:
    """Rename top-level and nested field names; values are untouched."""
    return df.select(
        *[F.col(f"`{f.name}`").cast(_renamed(f.dataType, rename)).alias(rename(f.name)) for f in df.schema]
    )


def snake_case_column(key: Column) -> Column:
    return F.lower(F.regexp_replace(key, r"(?<=.)([A-Z])", "_$1"))


def escape_features(values: Column) -> Column:
    """Prefix YAML-ambiguous words with a bar."""
    return F.transform(
        values,
        lambda v: F.when(F.lower(strip(v)).isin(fixed.ESCAPED_WORDS), F.concat(F.lit(fixed.ESCAPE), v)).otherwise(v),
    )


def unescape_features(values: Column) -> Column:
    def one(v: Column) -> Column:
        rest = F.substring(v, 2, 1 << 30)
        escaped = v.startswith(fixed.ESCAPE) & F.lower(strip(rest)).isin(fixed.ESCAPED_WORDS)
        return F.when(escaped, rest).otherwise(v)

    return F.transform(values, one)


def flag(value: Column, default: bool = False) -> Column:
    """A config flag: 1 / t / true in any case; absent means ``default``."""
    read = F.lower(value.cast("string")).isin("1", "t", "true")
    return F.coalesce(read, F.lit(default))


def environment_flag(value: str | None) -> bool:
    """The stricter reading used for job parameters: only 1 or true."""
    return (value or "").lower() in ("1", "true")
