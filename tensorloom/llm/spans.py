r"""Places of regular expression matches as column expressions.

Spark gives the matches of a pattern and, by splitting at it, the gaps between them; the running
sum of their lengths gives every place. All in code points, end exclusive, leftmost and
non-overlapping. Sums run in blocks, so a text with ``k`` matches costs about ``k`` times the
square root of ``k`` steps and never a quadratic number.

Patterns must not nest an unbounded group in a greedy quantifier (the JVM's engine recurses once
for each repetition and can run out of stack on long texts); a possessive group, ``(?:...)++``,
loops and is what the operators use.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 128
#: Code points around a match that are kept for looking at its context.
BEFORE, AFTER = 40, 24


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` evaluated once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(steps: Column) -> Column:
    """For an array of ints, the sum before each element, as an array of ints."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    def blocks(parts: Column) -> Column:
        sums = F.transform(parts, total)
        starts = bind(sums, lambda s: F.transform(s, lambda _, i: total(F.slice(s, 1, i))))
        inner = lambda part, start: F.transform(part, lambda _, j: start + total(F.slice(part, 1, j)))
        return F.flatten(F.zip_with(parts, starts, inner))

    n = F.floor((F.size(steps) - 1) / _BLOCK).cast("int")
    return bind(F.transform(F.sequence(F.lit(0), n), lambda b: F.slice(steps, b * _BLOCK + 1, _BLOCK)), blocks)


def matches(text: Column, pattern: str) -> Column:
    """The matches in a non-null text: array of (start, end, text, before, after)."""
    kind = "array<struct<start:int,end:int,text:string,before:string,after:string>>"

    def placed(found: Column) -> Column:
        def cut(gaps: Column) -> Column:
            steps = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.length(g) + F.length(m))

            def one(m: Column, i: Column, sums: Column) -> Column:
                start = F.get(sums, i) + F.length(F.get(gaps, i))
                return F.struct(
                    start.alias("start"),
                    (start + F.length(m)).alias("end"),
                    m.alias("text"),
                    F.substring(F.get(gaps, i), -BEFORE, BEFORE).alias("before"),
                    F.substring(F.get(gaps, i + 1), 1, AFTER).alias("after"),
                )

            return bind(bind(steps, running), lambda sums: F.transform(found, lambda m, i: one(m, i, sums)))

        return F.when(F.size(found) == 0, F.array().cast(kind)).otherwise(bind(F.split(text, pattern, -1), cut).cast(kind))

    return bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def nothing(kind: str) -> Column:
    """The empty array of a type."""
    return F.array().cast(kind)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of an array of spans, comma-joined in the array's order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in capitals and angle brackets.

    Spans may overlap: of overlapping spans the first one's name stands for all of them.
    """
    area = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def grow(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        return F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["end"] > s["start"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider))).otherwise(
            F.concat(done, F.array(s))
        )

    def cut(areas: Column) -> Column:
        from_ = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(areas, i - 1)["end"])
        piece = lambda s, i: F.concat(text.substr(from_(i) + 1, s["start"] - from_(i)), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        tail = F.element_at(areas, -1)["end"]
        return F.concat(F.array_join(F.transform(areas, piece), ""), text.substr(tail + 1, F.length(text)))

    kind = "array<struct<start:int,end:int,kind:string>>"
    disjoint = bind(area, lambda a: F.aggregate(a, nothing(kind), grow))
    return F.when(F.size(spans) == 0, text).otherwise(bind(disjoint, cut))
