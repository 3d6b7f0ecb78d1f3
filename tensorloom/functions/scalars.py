"""Scalar functions as column expressions (integers stay integers; no UDF)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Chunk sizing: least bytes, chunks aimed at, most bytes.
CHUNK_FLOOR, CHUNK_GOAL, CHUNK_CAP = 4 << 20, 150, 64 << 20


def numel(shape: Column) -> Column:
    """The number of elements of a shape; 1 for a scalar's empty shape."""
    return F.aggregate(shape, F.lit(1).cast("bigint"), lambda a, x: a * x)


def padding(n: Column, multiple: Column) -> Column:
    """What is missing from ``n`` to the next multiple; 0 where the multiple is 0."""
    return F.when(multiple > 0, F.pmod(-n, multiple)).otherwise(F.lit(0).cast("bigint"))


def align_up(n: Column, multiple: Column) -> Column:
    return n + padding(n, multiple)


def int_div(n: Column, d: Column) -> Column:
    """Integer quotient of non-negative numbers, exact beyond 2**53 (no doubles on the way)."""
    return ((n - F.pmod(n, d)).cast("decimal(38,0)") / d.cast("decimal(20,0)")).cast("bigint")


def ceil_div(n: Column, d: Column) -> Column:
    """Integer quotient, rounded up."""
    return int_div(n + d - 1, d)


def chunk_bytes(total: Column, floor: int = CHUNK_FLOOR) -> Column:
    """Bytes of a copy chunk: a share of the block, within bounds."""
    share = int_div(total, F.lit(CHUNK_GOAL).cast("bigint"))
    return F.least(F.greatest(F.lit(floor).cast("bigint"), share), F.lit(CHUNK_CAP).cast("bigint"))


def streams(asked: Column) -> Column:
    """A stream or buffer count between 1 and 8."""
    return F.greatest(F.lit(1), F.least(asked, F.lit(8)))


def fixed2(x: Column) -> Column:
    """A non-negative double with two decimals, rounded from its exact binary value, ties to even.

    The engine's own formatting rounds the shortest decimal that stands for the double, half up,
    which differs at ties. The product with 200 is exact in two parts: the double's first 24 bits
    and the rest.
    """
    low = F.floor(x * 100).cast("bigint")
    head = x.cast("float").cast("double")
    above = (head * 200.0 - (low * 2 + 1).cast("double")) + (x - head) * 200.0
    hundredths = low + F.when((above > 0) | ((above == 0) & (F.pmod(low, F.lit(2)) == 1)), 1).otherwise(0)
    cents = F.pmod(hundredths, F.lit(100).cast("bigint"))
    return F.concat(int_div(hundredths, F.lit(100).cast("bigint")).cast("string"), F.lit("."), F.lpad(cents.cast("string"), 2, "0"))


def _first(steps: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value of the first condition that holds."""
    return reduce(lambda rest, s: F.when(s[0], s[1]).otherwise(rest), reversed(steps), otherwise)


def human_elements(n: Column) -> Column:
    """1234567 as ``1.23M``; thresholds are exclusive, smaller numbers are plain."""
    step = lambda limit, unit: (n > limit, F.concat(fixed2(n / F.lit(limit)), F.lit(unit)))
    return _first([step(1e9, "B"), step(1e6, "M"), step(1e3, "K")], n.cast("string"))


def human_duration(seconds: Column) -> Column:
    """Seconds as ns, µs, ms, s, ``1m5s`` or ``1h1m1s``."""
    whole = lambda x: F.rint(x).cast("bigint").cast("string")
    quotient = lambda x, d: whole(F.floor(x / F.lit(d)).cast("double"))
    rest = whole(F.pmod(seconds, F.lit(60.0)))
    scaled = lambda factor, unit: F.concat(fixed2(seconds * factor if factor != 1 else seconds), F.lit(unit))
    steps = [
        (seconds < 1e-6, scaled(1e9, "ns")),
        (seconds < 1e-3, scaled(1e6, "µs")),
        (seconds < 1.0, scaled(1e3, "ms")),
        (seconds < 60.0, scaled(1, "s")),
        (seconds < 3600.0, F.concat(quotient(seconds, 60.0), F.lit("m"), rest, F.lit("s"))),
    ]
    minutes = quotient(F.pmod(seconds, F.lit(3600.0)), 60.0)
    return _first(steps, F.concat(quotient(seconds, 3600.0), F.lit("h"), minutes, F.lit("m"), rest, F.lit("s")))


def parent(name: Column) -> Column:
    """All before the last dot of a dotted name; empty without a dot."""
    return F.when(name.contains("."), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(F.lit(""))


def leaf(name: Column) -> Column:
    """All after the last dot."""
    return F.element_at(F.split(name, r"\."), -1)


def extension(path: Column) -> Column:
    """A path's extension with its dot, of the last segment only; leading dots don't count."""
    return F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]*)$", 1)


def without_class_prefix(name: Column, prefixes: tuple[str, ...] = ("Flax", "TF")) -> Column:
    """A class name without the first of the prefixes that it begins with."""
    return F.regexp_replace(name, "^(?:" + "|".join(prefixes) + ")", "")


def reference(ref: Column) -> Column:
    """``repository--module.Class`` as a struct; without ``--`` the repository is null."""
    parts = F.split(ref, "--", 2)
    rest = F.element_at(parts, -1)
    return F.struct(F.when(F.size(parts) > 1, parts[0]).alias("repository"), parent(rest).alias("module"), leaf(rest).alias("class_name"))


def decimal_gb_per_second(n_bytes: Column, seconds: Column) -> Column:
    """Throughput in units of 1000**3 bytes."""
    return n_bytes / seconds / F.lit(1e9)


def close_excess(a: Column, b: Column, atol: float, rtol: float) -> Column:
    """By how much two numbers are further apart than ``atol + rtol * |b|``; 0 or less where they are close."""
    return F.abs(a - b) - (F.lit(atol) + F.lit(rtol) * F.abs(b))


def last_segment(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def slashes(path: Column) -> Column:
    return (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))).cast("bigint")


def zero_padded(n: Column, width: Column) -> Column:
    """Digits filled with zeros to a width, never cut."""
    text = n.cast("string")
    return F.call_function("lpad", text, F.greatest(width, F.length(text)), F.lit("0"))


def left_justified(text: Column, width: int) -> Column:
    """Text filled with blanks to a width, never cut."""
    return F.call_function("rpad", text, F.greatest(F.lit(width), F.length(text)), F.lit(" "))


def u64_le(raw: Column) -> Column:
    """The unsigned little-endian number in a binary value of 8 bytes, as a decimal."""
    pairs = F.regexp_extract_all(F.hex(raw), F.lit("(..)"), F.lit(1))
    return F.conv(F.array_join(F.reverse(pairs), ""), 16, 10).cast("decimal(20,0)")
