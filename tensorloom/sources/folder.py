"""Many containers in one folder, each written whole by one task."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tensorloom.functions.scalars import CHUNK_CAP
from tensorloom.sources import container

WRITTEN = "path string, n_tensors bigint, n_bytes bigint"
#: Kinds of pieces, in their order at one place: where a tensor starts, its bytes, and a file's end.
PLACE, PAYLOAD, FOOTER = 0, 1, 2


class _Open:
    """One container being written beside its place; a failed attempt leaves a file in ``folder`` only."""

    def __init__(self, path: str, folder: str):
        self.path, self.at, self.tensors = path, 0, 0
        self.place: tuple[str, int] | None = None
        self.system, self.inner = container.file_system(path)
        where = container.file_system(folder)[1]
        self.system.create_dir(where, recursive=True)
        self.part = f"{where}/{uuid.uuid4().hex}"
        self.out = self.system.open_output_stream(self.part)

    def tensor(self, name: str, raw) -> None:
        """The bytes of the tensor whose place came last."""
        if self.place is None or self.place[0] != name:
            raise ValueError(f"{self.path} has no place for {name}; are names repeated?")
        self.put(self.place[1], raw)
        self.place, self.tensors = None, self.tensors + 1

    def put(self, start: int, raw) -> None:
        if not len(raw):
            return  # an empty tensor has a place but no bytes
        if start < self.at:
            raise ValueError(f"pieces of {self.path} overlap at byte {start}; are names repeated?")
        while self.at < start:
            n = min(start - self.at, CHUNK_CAP)
            self.out.write(b"\0" * n)
            self.at += n
        self.out.write(raw)
        self.at += len(raw)

    def close(self, start: int, trailer: bytes) -> tuple[str, int, int]:
        self.put(start, trailer)
        self.out.close()
        self.system.move(self.part, self.inner)
        return self.path, self.tensors, self.at


def write(pieces: DataFrame, unfinished: str, signature: container.Signature) -> DataFrame:
    """Write ``pieces(path, macroblock, rank, name, kind, start_byte, payload)`` and give path, n_tensors, n_bytes of each file.

    Pieces are dealt by path and sorted in the order of the file inside a task, a tensor's place before
    its bytes, which go to the file as they come; the footer comes last, closes the file and publishes
    it by renaming. A task that runs again writes the same bytes and replaces the file.
    """
    dealt = pieces.repartition("path").sortWithinPartitions("path", "macroblock", "rank", "name", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = None
        for batch in batches:
            done = []
            for path, name, kind, start, raw in zip(*[batch[c].to_pylist() for c in ("path", "name", "kind", "start_byte")], batch["payload"]):
                if file is None:
                    file = _Open(path, unfinished)
                if file.path != path:
                    raise ValueError(f"{file.path} has no footer")
                if file.place is not None and kind != PAYLOAD:
                    raise ValueError(f"{path} lacks the bytes of {file.place[0]}; are names repeated?")
                if kind == PLACE:
                    file.place = name, start
                elif kind == PAYLOAD:
                    file.tensor(name, memoryview(raw.as_buffer()))
                else:
                    done.append(file.close(start, container.trailer(raw.as_py(), signature)))
                    file = None
            if done:
                paths, tensors, sizes = zip(*done)
                yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(tensors, pa.int64()), pa.array(sizes, pa.int64())], ["path", "n_tensors", "n_bytes"])

    return dealt.select("path", "name", "kind", "start_byte", "payload").mapInArrow(run, WRITTEN)
