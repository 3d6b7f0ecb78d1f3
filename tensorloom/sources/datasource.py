"""The container as a Spark data source: ``spark.read.format("tensorpack")`` and three more names.

``tensorpack.meta`` gives one row a file, ``tensorpack.blocks`` and ``tensorpack.index`` one a block or
tensor, from the footer alone; ``tensorpack`` gives payload chunks. The four are separate because a
Python source is not told which columns a query needs. Filters on ``name`` and ``macroblock`` are
taken over by the scan, so the bytes of tensors that a query leaves out are never read.

Options: ``path`` (a file, a directory or a glob; several separated by commas), ``chunk_bytes``,
``magic`` and ``prefix`` (another writer's signature), ``mode`` (``failfast``, or ``permissive`` for
``meta``: faulty files become rows with ``is_valid`` false and an ``error``), ``legacy_scalar_shape``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from tensorloom.functions.scalars import CHUNK_CAP, CHUNK_FLOOR, CHUNK_GOAL
from tensorloom.shipping import ship
from tensorloom.sources import container
from tensorloom.sources.container import Entry, Signature

BLOCK = "macroblock int, dtype string, offset_bytes bigint, length_bytes bigint, length_elems bigint"
META = "path string, is_valid boolean, error string, format string, target_dtype string, align_bytes bigint, total_elems bigint, total_payload_bytes bigint, n_blocks int, n_tensors bigint"
INDEX = "path string, macroblock int, dtype string, name string, shape array<bigint>, offset bigint, length bigint"
CHUNKS = "path string, macroblock int, dtype string, name string, shape array<bigint>, length bigint, chunk_idx bigint, n_chunks bigint, payload binary"


def signature(options) -> Signature:
    magic = options.get("magic")
    # Eight characters as they are, or seven and an implied NUL.
    raw = magic.encode("latin-1").ljust(8, b"\0") if magic else container.MAGIC
    return Signature(raw, options.get("prefix") or container.PREFIX)


def files(path: str) -> list[str]:
    """The files of a comma-separated list of files, directories and globs, sorted."""
    import fnmatch

    from pyarrow import fs

    out: list[str] = []
    for one in filter(None, (p.strip() for p in path.split(","))):
        is_uri = "://" in one or one.startswith("file:")
        head = one.rsplit("/", 1)[0] if any(c in one.rsplit("/", 1)[-1] for c in "*?[") else one
        system, inner = fs.FileSystem.from_uri(head) if is_uri else (fs.LocalFileSystem(), head or "/")
        prefix = head[: len(head) - len(inner)] if is_uri and head.endswith(inner) else ""
        info = system.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(one)
        if info.type == fs.FileType.File:
            out.append(one)
            continue
        pattern = one.rsplit("/", 1)[-1] if head != one else "*"
        for f in system.get_file_info(fs.FileSelector(inner, recursive=head == one)):
            if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern) and not f.base_name.startswith(("_", ".")):
                out.append(prefix + f.path)
    return sorted(out)


class Split(InputPartition):
    """A part of one file: the whole footer, or ranges of payload."""

    def __init__(self, path: str, ranges: list | None = None):
        super().__init__(0)
        self.path, self.ranges = path, ranges


class _Reader(DataSourceReader):
    def __init__(self, options, schema):
        self.options, self.out, self.signature = dict(options), schema, signature(options)
        self.tests: list = []

    def pushFilters(self, filters):
        """Take over tests of name and macroblock; the others stay in the plan."""
        for f in filters:
            inner = f.child if isinstance(f, Not) else f
            known = isinstance(inner, (EqualTo, In, IsNotNull, StringStartsWith, StringEndsWith, StringContains)) and inner.attribute in (("name",), ("macroblock",))
            if known:
                self.tests.append(f)
            else:
                yield f

    def keeps(self, e: Entry) -> bool:
        def holds(f) -> bool:
            if isinstance(f, Not):
                return not holds(f.child)
            x = getattr(e, f.attribute[0])
            if isinstance(f, IsNotNull):
                return x is not None
            if isinstance(f, EqualTo):
                return x == f.value
            if isinstance(f, In):
                return x in f.value
            if isinstance(f, StringStartsWith):
                return x.startswith(f.value)
            return x.endswith(f.value) if isinstance(f, StringEndsWith) else f.value in x

        return all(map(holds, self.tests))

    def partitions(self):
        return [Split(p) for p in files(self.options["path"])]

    def shape(self, e: Entry) -> list[int]:
        return list(e.shape) or ([1] if str(self.options.get("legacy_scalar_shape", "false")).lower() == "true" else [])


class MetaReader(_Reader):
    def pushFilters(self, filters):
        yield from filters

    def read(self, split: Split) -> Iterator[tuple]:
        try:
            f = container.read_footer(split.path, self.signature)
        except Exception as e:
            if str(self.options.get("mode", "failfast")).lower() != "permissive":
                raise
            yield (split.path, False, f"{e}"[:500], None, None, None, None, None, None, None)
            return
        yield (split.path, True, None, f.format, f.target_dtype, f.align_bytes, f.total_elems, f.total_payload_bytes, len(f.blocks), len(f.index))


class BlockReader(_Reader):
    def pushFilters(self, filters):
        yield from filters

    def read(self, split: Split) -> Iterator[tuple]:
        for b in container.read_footer(split.path, self.signature).blocks:
            yield (split.path, b.macroblock, b.dtype, b.offset_bytes, b.length_bytes, b.length_elems)


class IndexReader(_Reader):
    def read(self, split: Split) -> Iterator[tuple]:
        f = container.read_footer(split.path, self.signature)
        for e in f.index:
            if self.keeps(e):
                yield (split.path, e.macroblock, f.blocks[e.macroblock].dtype, e.name, self.shape(e), e.offset, e.length)


class ChunkReader(_Reader):
    """Payload chunks; a task gets ranges of one file that add up to a few chunks.

    Of few files the driver reads the footers, to split large ones; many files are one task each,
    which reads its own footer, so the driver's work does not grow with their content.
    """

    MANY = 64

    def partitions(self):
        paths = files(self.options["path"])
        if len(paths) >= self.MANY:
            return [Split(p) for p in paths]
        out = []
        for path in paths:
            held, size = [], 0
            for piece, most in self.planned(path):
                held.append(piece)
                size += piece[-1]
                if size >= max(most, CHUNK_CAP):
                    out.append(Split(path, held))
                    held, size = [], 0
            if held:
                out.append(Split(path, held))
        return out

    def planned(self, path: str) -> Iterator[tuple[tuple, int]]:
        """(block, dtype, name, shape, length, chunk, chunks, start, bytes) of a file's chunks, and the most bytes of one."""
        f = container.read_footer(path, self.signature)
        container.check_alignment(f)  # of all rows, ignored ones too
        share = min(max(CHUNK_FLOOR, f.total_payload_bytes // CHUNK_GOAL), CHUNK_CAP)
        most = int(self.options.get("chunk_bytes") or share)
        kept = sorted((e for e in f.index if self.keeps(e)), key=lambda e: (f.blocks[e.macroblock].offset_bytes, e.offset))
        for e in kept:
            own = list(container.ranges(f, [e], most))
            for _, d, chunk, start, n in own:
                yield (e.macroblock, d, e.name, self.shape(e), e.length, chunk, len(own), start, n), most

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        file, _ = container.open_input(split.path)
        schema = pa.schema(
            [("path", pa.string()), ("macroblock", pa.int32()), ("dtype", pa.string()), ("name", pa.string()), ("shape", pa.list_(pa.int64())), ("length", pa.int64()), ("chunk_idx", pa.int64()), ("n_chunks", pa.int64()), ("payload", pa.binary())]
        )
        with file:
            rows, size = [], 0
            ranges = split.ranges if split.ranges is not None else (piece for piece, _ in self.planned(split.path))
            for block, d, name, shape, length, chunk, n_chunks, start, n in ranges:
                file.seek(start)
                raw = file.read(n)
                if len(raw) != n:
                    raise ValueError(f"{split.path}: {name} ends beyond the file")
                rows.append((split.path, block, d, name, shape, length, chunk, n_chunks, raw))
                size += n
                if size >= CHUNK_FLOOR or len(rows) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


class _Source(DataSource):
    reader_type: type
    columns = ""

    def schema(self):
        return self.columns

    def reader(self, schema):
        return self.reader_type(self.options, schema)


class MetaSource(_Source):
    reader_type, columns = MetaReader, META

    @classmethod
    def name(cls):
        return "tensorpack.meta"


class BlockSource(_Source):
    reader_type, columns = BlockReader, f"path string, {BLOCK}"

    @classmethod
    def name(cls):
        return "tensorpack.blocks"


class IndexSource(_Source):
    reader_type, columns = IndexReader, INDEX

    @classmethod
    def name(cls):
        return "tensorpack.index"


class Placed(WriterCommitMessage):
    """What one task wrote."""

    def __init__(self, part: str, pieces: list):
        self.part, self.pieces = part, pieces


class PackWriter(DataSourceWriter):
    """Writes ``(start_byte, payload)`` rows of a planned file; places count from after ``head``.

    Each task writes one part file into a folder of this write beside the destination and remembers
    where its pieces belong. ``commit`` streams the parts into a file of that folder at their places,
    appends the planned footer and publishes by renaming, so a reader sees the old file or the new one.
    The folder goes at the end with whatever failed or speculative attempts left in it; two writers of
    one destination don't meet. On object stores the rename is a copy.
    """

    def __init__(self, options):
        import uuid

        self.path, self.size = options["path"], int(options["payload_bytes"])
        self.head, self.footer = bytes.fromhex(options.get("head") or ""), bytes.fromhex(options.get("footer") or "")
        self.run = uuid.uuid4().hex

    def _place(self) -> tuple:
        system, inner = container.file_system(self.path)
        return system, inner, f"{inner}.write-{self.run}"

    def write(self, iterator) -> Placed:
        import uuid

        system, _, folder = self._place()
        system.create_dir(folder, recursive=True)
        part, pieces, at = f"{folder}/{uuid.uuid4().hex}", [], 0
        with system.open_output_stream(part) as out:
            for row in iterator:
                raw = bytes(row["payload"])
                if not raw:
                    continue  # an empty tensor has a place but no bytes
                out.write(raw)
                pieces.append((row["start_byte"], at, len(raw)))
                at += len(raw)
        return Placed(part, pieces)

    def commit(self, messages) -> None:
        import heapq

        system, inner, folder = self._place()
        system.create_dir(folder, recursive=True)
        done = [m for m in messages if m is not None]
        opened = {m.part: system.open_input_file(m.part) for m in done}
        try:
            with system.open_output_stream(f"{folder}/whole") as out:
                out.write(self.head)
                at = 0
                for start, part, offset, n in heapq.merge(*[sorted((s, m.part, o, n) for s, o, n in m.pieces) for m in done]):
                    if start < at:
                        raise ValueError(f"pieces overlap at byte {start}")
                    out.write(b"\0" * (start - at))
                    file = opened[part]
                    file.seek(offset)
                    for begin in range(0, n, CHUNK_CAP):
                        out.write(file.read(min(CHUNK_CAP, n - begin)))
                    at = start + n
                if at > self.size:
                    raise ValueError(f"{at} payload bytes, planned {self.size}")
                out.write(b"\0" * (self.size - at))
                out.write(self.footer)
            system.move(f"{folder}/whole", inner)
        finally:
            for f in opened.values():
                f.close()
            self.abort(messages)

    def abort(self, messages) -> None:
        system, _, folder = self._place()
        try:
            system.delete_dir(folder)
        except OSError:
            pass  # no task had begun


class PackSource(_Source):
    reader_type, columns = ChunkReader, CHUNKS

    @classmethod
    def name(cls):
        return "tensorpack"

    def writer(self, schema, overwrite):
        return PackWriter(self.options)


def register(spark: SparkSession) -> SparkSession:
    """Make the formats known to a session and let scans take over filters."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (MetaSource, BlockSource, IndexSource, PackSource):
        spark.dataSource.register(source)
    return spark
