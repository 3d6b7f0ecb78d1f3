"""The public safetensors format: a JSON header with byte ranges, then the payload."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.functions.dtypes import dtype
from tensorloom.functions.scalars import CHUNK_CAP
from tensorloom.sources.container import open_input
from tensorloom.sources.datasource import register

# The format's names for element types.
NAMES = {
    "F64": "float64", "F32": "float32", "F16": "float16", "BF16": "bfloat16", "I64": "int64", "I32": "int32", "I16": "int16", "I8": "int8",
    "U64": "uint64", "U32": "uint32", "U16": "uint16", "U8": "uint8", "BOOL": "bool", "F8_E4M3": "float8_e4m3fn", "F8_E5M2": "float8_e5m2",
    "F8_E8M0": "float8_e8m0fnu", "C64": "complex64",
}
LENGTH = struct.Struct("<Q")


def header(path: str) -> tuple[dict, int]:
    """The header without its metadata entry, and the payload's first byte."""
    file, size = open_input(path)
    with file:
        if size < LENGTH.size:
            raise ValueError(f"{path}: {size} bytes, less than a header's length field")
        (n,) = LENGTH.unpack(file.read(LENGTH.size))
        if n > size - LENGTH.size:
            raise ValueError(f"{path}: a header of {n} bytes would end beyond the file")
        found = json.loads(file.read(n).decode("utf-8"))
    found.pop("__metadata__", None)
    return found, LENGTH.size + n


def read(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_CAP) -> DataFrame:
    """name, dtype, shape, ord, chunk_idx, payload: the file's tensors in chunks, in header order."""
    register(spark)
    found, base = header(path)
    rows = []
    for i, (name, t) in enumerate(found.items()):
        d = dtype(NAMES[t["dtype"]])
        start, end = t["data_offsets"]
        step = max(d.size, chunk_bytes // d.size * d.size)
        for c, at in enumerate(range(start, max(end, start + 1), step)):
            rows.append((name, d.name, [int(x) for x in t["shape"]], i, c, base + at, min(step, end - at)))
    plan = spark.createDataFrame(rows, "name string, dtype string, shape array<bigint>, ord bigint, chunk_idx bigint, start bigint, n bigint")
    plan = plan.repartition(max(1, min(len(rows), sum(r[-1] for r in rows) // CHUNK_CAP + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, _ = open_input(path)
        with file:
            for batch in batches:
                for i in range(batch.num_rows):
                    one = batch.slice(i, 1)
                    file.seek(one.column(5)[0].as_py())
                    raw = file.read(one.column(6)[0].as_py())
                    yield pa.RecordBatch.from_arrays([*one.columns[:5], pa.array([raw], pa.binary())], names=[*one.schema.names[:5], "payload"])

    return plan.mapInArrow(run, "name string, dtype string, shape array<bigint>, ord bigint, chunk_idx bigint, payload binary")


def write(tensors: DataFrame, path: str) -> None:
    """``tensors(name, dtype, shape, payload)`` as one file; written like a container, in parts."""
    spark = register(tensors.sparkSession)
    names = {v: k for k, v in NAMES.items()}
    heads = tensors.select("name", "dtype", "shape", F.octet_length("payload").cast("bigint").alias("n")).orderBy("name").collect()
    at, entries, places = 0, {}, []
    for r in heads:
        if r["dtype"] not in names:
            raise ValueError(f"safetensors has no type for {r['dtype']}")
        entries[r["name"]] = {"dtype": names[r["dtype"]], "shape": list(r["shape"]), "data_offsets": [at, at + r["n"]]}
        places.append((r["name"], at))
        at += r["n"]
    text = json.dumps(entries, ensure_ascii=False, separators=(",", ":")).encode("utf-8")
    text += b" " * (-len(text) % 8)
    starts = spark.createDataFrame(places, "name string, start_byte bigint")
    rows = tensors.join(starts, "name").select("start_byte", "payload")
    rows.write.format("tensorpack").mode("append").options(path=path, head=(LENGTH.pack(len(text)) + text).hex(), payload_bytes=str(at)).save()
