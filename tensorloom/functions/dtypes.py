"""The element types of a container: one row each, with what layout and codecs need to know."""

from __future__ import annotations

from dataclasses import dataclass
from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class DType:
    """``packing`` is the integer type whose bits are stored where numpy lacks the type itself."""

    name: str
    size: int
    numpy: str
    packing: str
    spark: str


# The supported element types, their bytes, storage and decoded Spark types.
DTYPES = (
    DType("float32", 4, "float32", "float32", "float"),
    DType("float64", 8, "float64", "float64", "double"),
    DType("float16", 2, "float16", "float16", "float"),
    DType("int8", 1, "int8", "int8", "tinyint"),
    DType("int16", 2, "int16", "int16", "smallint"),
    DType("int32", 4, "int32", "int32", "int"),
    DType("int64", 8, "int64", "int64", "bigint"),
    DType("uint8", 1, "uint8", "uint8", "smallint"),
    DType("uint16", 2, "uint16", "uint16", "int"),
    DType("uint32", 4, "uint32", "uint32", "bigint"),
    DType("uint64", 8, "uint64", "uint64", "decimal(20,0)"),
    DType("bool", 1, "bool_", "bool", "boolean"),
    DType("complex64", 8, "complex64", "complex64", "struct<re:float,im:float>"),
    DType("complex128", 16, "complex128", "complex128", "struct<re:double,im:double>"),
    DType("float8_e4m3fn", 1, "uint8", "uint8", "float"),
    DType("float8_e4m3fnuz", 1, "uint8", "uint8", "float"),
    DType("float8_e5m2", 1, "uint8", "uint8", "float"),
    DType("float8_e5m2fnuz", 1, "uint8", "uint8", "float"),
    DType("float8_e8m0fnu", 1, "uint8", "uint8", "float"),
    DType("bfloat16", 2, "uint16", "uint16", "float"),
    DType("complex32", 4, "uint32", "uint32", "struct<re:float,im:float>"),
)
BY_NAME = {d.name: d for d in DTYPES}


def dtype(name: str) -> DType:
    """The type of that name; 4-bit floats and anything else unknown are refused."""
    name = name.removeprefix("torch.")
    if name.startswith("float4"):
        raise ValueError(f"4-bit floats cannot be packed: {name}")
    if name not in BY_NAME:
        raise ValueError(f"Unsupported dtype for packing: {name}")
    return BY_NAME[name]


def align_elems(align_bytes: int, size: int) -> int:
    """Elements between aligned tensor offsets; 0 for no alignment."""
    return align_bytes // gcd(align_bytes, size) if align_bytes else 0


def align_block(align_bytes: int, size: int) -> int:
    """Bytes to whose multiples a block's start is rounded up: the least common multiple."""
    return align_bytes * size // gcd(align_bytes, size) if align_bytes else size


def element_size(name: Column) -> Column:
    """A dtype name's bytes per element, by a map literal; null for unknown names."""
    return F.create_map(*[F.lit(x) for d in DTYPES for x in (d.name, d.size)])[name].cast("bigint")


def dimension(spark: SparkSession, align_bytes: int = 128) -> DataFrame:
    """dtype, elem_size, align_elems, align_block, numpy_dtype, packing_dtype, spark_type: 21 rows."""
    rows = [(d.name, d.size, align_elems(align_bytes, d.size), align_block(align_bytes, d.size), d.numpy, d.packing, d.spark) for d in DTYPES]
    return spark.createDataFrame(
        rows, "dtype string, elem_size bigint, align_elems bigint, align_block bigint, numpy_dtype string, packing_dtype string, spark_type string"
    )
