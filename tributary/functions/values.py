"""Tagged values: ``{"kind": ..., "value": ...}`` text, its order, and the type lattice.

The text form is canonical (sorted keys, no spaces), so it groups, sorts and hashes
like the value it stands for; Int 1 and Float 1.0 are different values.
"""

from __future__ import annotations

import base64
import datetime
import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The nine kinds, their Spark types, and what each may widen to.
SPARK = {"Null": "void", "Bool": "boolean", "Int": "bigint", "Float": "double", "Text": "string", "Bytes": "binary", "Timestamp": "timestamp", "List": "string", "Map": "string"}
WIDENS = {("Int", "Float"), ("Int", "Text"), ("Bool", "Text"), ("Timestamp", "Int")}


def widens(old: str, new: str) -> bool:
    return old == new or old == "Null" or (old, new) in WIDENS


def accepts(declared: str, kind: str) -> bool:
    """A declared type takes itself and null."""
    return kind in (declared, "Null")


def kind_of(value: Any) -> str:
    for kinds, name in ((bool, "Bool"), (int, "Int"), (float, "Float"), (str, "Text"), ((bytes, bytearray), "Bytes"), (datetime.datetime, "Timestamp"), ((list, tuple), "List"), (dict, "Map")):
        if isinstance(value, kinds):
            return name
    return "Null"


def tagged(value: Any) -> dict:
    kind = kind_of(value)
    if kind == "Null":
        return {"kind": "Null"}
    if kind == "Bytes":
        value = base64.b64encode(value).decode()
    elif kind == "Timestamp":
        value = int(value.timestamp() * 1000)
    elif kind == "List":
        value = [tagged(v) for v in value]
    elif kind == "Map":
        value = {k: tagged(v) for k, v in value.items()}
    return {"kind": kind, "value": value}


def encode(value: Any) -> str:
    return json.dumps(tagged(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def spark_kind(kind: T.DataType) -> str:
    for types, name in ((T.BooleanType, "Bool"), (T.IntegralType, "Int"), (T.NumericType, "Float"), (T.StringType, "Text"), (T.BinaryType, "Bytes"), ((T.TimestampType, T.TimestampNTZType, T.DateType), "Timestamp"), (T.ArrayType, "List"), ((T.StructType, T.MapType), "Map")):
        if isinstance(kind, types):
            return name
    return "Null"


def encoded(c: Column, kind: T.DataType) -> Column:
    """Canonical text of a typed scalar column; null gives the Null value."""
    name = spark_kind(kind)
    if name in ("List", "Map"):
        raise TypeError(f"{kind} has no scalar form")
    value = {"Bytes": lambda: F.base64(c), "Timestamp": lambda: F.unix_millis(c.cast("timestamp"))}.get(name, lambda: c)()
    text = F.to_json(F.struct(F.lit(name).alias("kind"), value.alias("value")))
    return F.when(c.isNull(), F.lit('{"kind":"Null"}')).otherwise(text)


def kind(c: Column) -> Column:
    return F.get_json_object(c, "$.kind")


def number(c: Column) -> Column:
    """The value of an Int or Float, as a double; null for other kinds."""
    return F.when(kind(c).isin("Int", "Float"), F.get_json_object(c, "$.value").cast("double"))


def untyped_sum(c: Column) -> Column:
    """Sum of a column of mixed kinds, tagged: Int unless a Float is in the group, other kinds skipped, zero for none; integers saturate."""
    whole = F.sum(F.when(kind(c) == "Int", F.get_json_object(c, "$.value").cast("decimal(19,0)")))
    low, high = (F.lit(v).cast("decimal(38,0)") for v in (-(2**63), 2**63 - 1))
    whole = F.least(F.greatest(F.coalesce(whole, F.lit(0).cast("decimal(38,0)")), low), high)
    any_float = F.max((kind(c) == "Float").cast("int")) == 1
    return F.when(any_float, F.to_json(F.struct(F.lit("Float").alias("kind"), F.sum(number(c)).alias("value")))).otherwise(
        F.to_json(F.struct(F.lit("Int").alias("kind"), whole.cast("long").alias("value")))
    )


def untyped_mean(c: Column) -> Column:
    """Sum of the numbers over the count of all non-null values."""
    n = F.count(F.when(kind(c) != "Null", 1))
    return F.when(n > 0, F.coalesce(F.sum(number(c)), F.lit(0.0)) / n)
