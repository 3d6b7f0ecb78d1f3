"""A landing folder of containers as a growing catalogue (an extension of this library).

Each trigger lists new files with Spark's own file source, which keeps the record of what it has
seen, and reads their footers only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.shipping import ship
from tensorloom.sources import container
from tensorloom.sources.container import Signature

COLUMNS = "path string, is_valid boolean, error string, name string, dtype string, shape array<bigint>, length bigint, size bigint, seen timestamp"


def stream(spark: SparkSession, folder: str, signature: Signature = Signature(), files_per_trigger: int = 1000) -> DataFrame:
    """One row for each tensor of each file that lands in ``folder``; a faulty file is one row with its error."""
    ship(spark)
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    landed = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.pack").load(folder)
    # Without the content column no payload is read here.
    found = landed.select("path", "modificationTime", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("is_valid", pa.bool_()), ("error", pa.string()), ("name", pa.string()), ("dtype", pa.string()), ("shape", pa.list_(pa.int64())), ("length", pa.int64()), ("size", pa.int64()), ("seen", batches_type)])
        for batch in batches:
            rows = []
            for path, seen, size in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                try:
                    f = container.read_footer(path, signature)
                    rows += [(path, True, None, e.name, f.blocks[e.macroblock].dtype, list(e.shape), e.length, size, seen) for e in f.index]
                except Exception as e:  # noqa: BLE001  the row says what was wrong
                    rows.append((path, False, f"{e}"[:500], None, None, None, None, size, seen))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    batches_type = pa.timestamp("us", tz="UTC")
    return found.mapInArrow(run, COLUMNS)


def totals(tensors: DataFrame, late: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """Files' tensors and elements by event time window and type, with a watermark for late files."""
    held = tensors.where("is_valid").withWatermark("seen", late)
    return held.groupBy(F.window("seen", width), "dtype").agg(F.count("*").alias("n_tensors"), F.sum("length").alias("n_elems"))
