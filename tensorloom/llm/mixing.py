"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words: its share by weight of all words, held to at most
``cap`` times its own words, with the excess shared again by weight until no source is above its
cap. Inside a source, documents have unequal inclusion: a document of utility ``v`` is expected
``e = min(cap, c * v)`` times, with the source's ``c`` such that the expected words add up to its
target. By default ``v`` is the square root of the document's size over the source's mean size,
inside ``[1/2, 2]``, so longer documents are likelier; ``utility`` puts any other measure in its
place (a quality score, or 1 for equal odds). Utilities are rounded to steps of 1/16.

A document takes ``floor(e)`` certain whole copies. One more is drawn by Pareto order sampling with
inclusion probability ``p = e - floor(e)``: with a uniform number ``u`` fixed by the key, documents
are ranked by ``(u/(1-u)) / (p/(1-p))`` and taken from the lowest rank on, up to the place where the
words taken are nearest to those still missing.

In a source of few documents that place may be off by half a document. Where that is more than
``TOLERANCE`` of the target, one exchange follows: of the ``NEAR`` documents on either side of the
cut, a run of taken ones (in order of rank) leaves and a run of others comes in, so that the gap is
inside the tolerance with the fewest documents changed, or else as small as can be. All other
documents keep the decision of the Pareto draw.

Scale: the text is read once, to count words; the small table of sizes is written to the shared
folder. The cut is found without sorting a source in one task: ranks fall into ``BINS`` bins, the
bins' words are summed (partial sums first), and only the documents inside one bin are put in order.
A source that holds a third of all rows is spread over its bins. Utilities are summed by step, at
most 25 rows a source, and an exchange sees ``2 * NEAR`` rows a source. The only unpartitioned
windows are over one row per source.

Defined results: null and empty texts have size 0, are never needed to meet a target and take no
words; a null source is a source of its own, placed last; a null utility counts as 1. Repeated rows
and rows of a null or repeated key are separate documents with copies of their own; where they tie
(on the cut too), size and then their order in the input decide. Very long texts count by all their
words, and one that no subset can balance leaves its source off by part of its size. An empty table
gives an empty one. Extra columns are not read by :func:`mix`; :func:`repeat` hands them on
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.llm.scratch import for_workers, written
from tensorloom.llm.words import n_words

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source may be taken more than so many times.
CAP = 3
#: Bins of the rank by which the cut is found, at most, and the documents for which there is one.
BINS, BIN_ROWS = 4096, 1024
#: Utilities count in steps of one in so many, from half to twice the usual one.
STEPS = 16
#: The part of its target that a source may be off before documents are exchanged.
TOLERANCE = 0.001
#: Documents on each side of the cut that an exchange may touch.
NEAR = 64
#: Keys with their copies that are broadcast at most (16 bytes each); beyond, texts are joined by a shuffle.
BROADCAST_ROWS = 500_000


def uniform(key: Column, seed: str) -> Column:
    """A number inside (0, 1) fixed by the key: 52 bits of an MD5 digest, plus half a step."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Source, source_size, target, n (its rows): one row per source of ``sizes(source, size)``.

    Sharing the excess again and again ends at one level ``x`` at which every source gets
    ``min(cap * size, x * weight)``. In order of ``cap * size / weight`` the capped sources come
    first, so the level follows from running sums.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ratio = F.col("cap_words") / F.col("weight")
    rising = Window.orderBy(ratio, F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    w = F.array(*[F.lit(float(x)) for x in weights])
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    own = own.withColumn("weight", F.element_at(w, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    own = own.withColumn("cap_words", F.col("source_size") * F.lit(float(cap)))
    rest_words = F.sum("source_size").over(every) - F.coalesce(F.sum("cap_words").over(before), F.lit(0.0))
    rest_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = rest_words / rest_weight
    own = own.withColumn("level", F.when(level <= ratio, F.struct(F.row_number().over(rising), level.alias("x"))))
    # The first source in this order that stays below its cap sets the level for all; where none does, all are capped.
    own = own.withColumn("level", F.min("level").over(every)["x"])
    target = F.least(F.col("cap_words"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap_words")))
    return own.select("source", F.col("source_size").cast("long").alias("source_size"), target.alias("target"), "n")


def _expected(sizes: DataFrame, goals: DataFrame, cap: int) -> DataFrame:
    """Source, step, whole, p, missing: one row for each step of utility of each source.

    Steps that reach the cap are the highest ones, so the level ``c`` follows from running sums.
    """
    strata = sizes.groupBy("source", "step").agg(F.sum("size").alias("words"))
    strata = strata.join(goals.select(F.col("source").alias("s"), "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    falling = Window.partitionBy("source").orderBy(F.col("step").desc())
    above = F.coalesce(F.sum("words").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("step") * F.col("words")).over(falling.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    strata = strata.withColumn("above", above).withColumn("rest", rest)
    level = F.when(F.col("rest") > 0, (F.col("target") - F.lit(float(cap)) * F.col("above")) / F.col("rest"))
    strata = strata.withColumn("level", F.when(level * F.col("step") <= F.lit(float(cap)), F.struct((-F.col("step")).alias("nth"), level.alias("c"))))
    strata = strata.withColumn("level", F.min("level").over(Window.partitionBy("source"))["c"])
    expected = F.least(F.lit(float(cap)), F.coalesce(F.col("level") * F.col("step"), F.lit(float(cap))))
    strata = strata.withColumn("e", F.when(F.abs(expected - F.round(expected)) < 1e-9, F.round(expected)).otherwise(expected))
    strata = strata.withColumn("whole", F.floor("e")).withColumn("p", F.col("e") - F.col("whole"))
    missing = F.col("target") - F.sum(F.col("whole") * F.col("words")).over(Window.partitionBy("source"))
    return strata.select("source", "step", F.col("whole").cast("long").alias("whole"), "p", missing.alias("missing"))


def exchange(taken: np.ndarray, passed: np.ndarray, gap: float, tolerance: float) -> tuple[slice, slice]:
    """The run of ``taken`` that leaves and the run of ``passed`` that comes, as slices.

    Sizes are in order of closeness to the cut; ``gap`` words are missing.
    """

    def runs(sizes: np.ndarray):
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = [(0, 0), *[(i, n) for i in range(len(sizes)) for n in range(1, len(sizes) - i + 1)]]
        first, n = np.array(at, np.int64).T
        return first, n, (ends[first + n] - ends[first]).astype(np.float64)

    (a, an, a_words), (b, bn, b_words) = runs(taken), runs(passed)
    left = np.abs(np.round(gap + a_words[:, None] - b_words[None, :], 6))
    score = np.where(left <= tolerance, 0.0, left)
    best = np.argwhere(score == score.min())
    changes = an[best[:, 0]] + bn[best[:, 1]]
    best = best[changes == changes.min()]
    i, j = best[np.argmin(left[best[:, 0], best[:, 1]])]
    return slice(a[i], a[i] + an[i]), slice(b[j], b[j] + bn[j])


def _exchanged(drawn: DataFrame) -> DataFrame:
    """``flip``: the rows whose draw is turned round, at most ``2 * NEAR`` of a source."""
    got = drawn.groupBy("source").agg(F.first("missing").alias("m"), F.first("target").alias("t"), F.sum(F.col("size") * F.col("extra")).alias("got"))
    got = got.select(F.col("source").alias("s"), F.round(F.col("m") - F.col("got"), 6).alias("gap"), (F.lit(TOLERANCE) * F.col("t")).alias("tolerance"))
    got = written(got.where(F.abs("gap") > F.col("tolerance")), "gaps")
    open_ = drawn.where((F.col("p") > 0) & (F.col("size") > 0)).join(F.broadcast(got) if _few(got) else got, F.col("source").eqNullSafe(F.col("s")))
    off = F.when(F.col("extra") == 1, -F.col("rank")).otherwise(F.col("rank"))
    nearest = Window.partitionBy("source", "extra").orderBy(off, "key", "size", "row")
    near = open_.withColumn("nth", F.row_number().over(nearest)).where(F.col("nth") <= NEAR).select("source", "extra", "nth", "size", "row", "gap", "tolerance")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("nth")
        taken, passed = pdf[pdf["extra"] == 1], pdf[pdf["extra"] == 0]
        out, in_ = exchange(taken["size"].to_numpy(), passed["size"].to_numpy(), float(pdf["gap"].iloc[0]), float(pdf["tolerance"].iloc[0]))
        return pd.DataFrame({"flip": pd.concat([taken["row"].iloc[out], passed["row"].iloc[in_]]).astype("int64")})

    return near.groupBy("source").applyInPandas(run, "flip bigint")


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    utility: Column | None = None,
    weights: tuple = WEIGHTS,
    cap: int = CAP,
    seed: str = "mix-1",
    row: str | None = None,
) -> DataFrame:
    """Key, source, size, source_size, target, copies, drawn, exchanged: one row per row of ``docs``.

    ``copies`` is the number of times the mix takes the document, ``cap`` at most; ``drawn`` says
    whether one of them was drawn, ``exchanged`` whether that is against the Pareto order. ``row``
    names a column of ``docs`` that is a unique long; it breaks ties and is returned too.
    """
    for_workers(docs.sparkSession)
    sizes = docs.select(
        F.col(key).alias("key"),
        F.col(source).alias("source"),
        n_words(F.col(text)).alias("size"),
        uniform(F.col(key), seed).alias("u"),
        (F.lit(None) if utility is None else F.coalesce(utility, F.lit(1.0))).cast("double").alias("utility"),
        (F.monotonically_increasing_id() if row is None else F.col(row)).alias("row"),
    )
    sizes = written(sizes, "sizes")
    bins = max(1, min(BINS, sizes.count() // BIN_ROWS))
    goals = written(targets(sizes, weights, cap), "targets")  # one row per source
    held = goals.select(F.col("source").alias("s"), "source_size", "target", "n")
    sizes = sizes.join(held, sizes["source"].eqNullSafe(held["s"])).drop("s")
    by_size = F.when(F.col("source_size") > 0, F.sqrt(F.col("size") / (F.col("source_size") / F.col("n"))))
    step = F.floor(F.coalesce("utility", by_size, F.lit(1.0)) * F.lit(float(STEPS)) + F.lit(0.5))
    sizes = sizes.withColumn("step", F.greatest(F.least(step, F.lit(2 * STEPS)), F.lit(STEPS // 2)).cast("long"))
    strata = written(_expected(sizes, goals, cap), "strata")  # a few rows per source
    strata = strata.select(F.col("source").alias("s"), F.col("step").alias("t"), "whole", "p", "missing")
    ranked = sizes.join(strata, sizes["source"].eqNullSafe(strata["s"]) & (sizes["step"] == strata["t"])).drop("s", "t")
    # A rank q becomes q/(1+q), which is in (0, 1) and has the same order.
    odds = F.col("u") / (F.lit(1.0) - F.col("u")) * ((F.lit(1.0) - F.col("p")) / F.col("p"))
    ranked = ranked.withColumn("rank", F.when(F.col("p") > 0, odds / (F.lit(1.0) + odds)))
    ranked = ranked.withColumn("bin", F.when(F.col("p") > 0, F.least(F.floor(F.col("rank") * F.lit(bins)), F.lit(bins - 1))).cast("int"))
    by_bin = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranked.where(F.col("p") > 0).groupBy("source", "bin").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(by_bin), F.lit(0)))
    sums = sums.select(F.col("source").alias("s"), F.col("bin").alias("b"), "before", "words")
    placed = ranked.join(sums, ranked["source"].eqNullSafe(sums["s"]) & (ranked["bin"] == sums["b"]), "left").drop("s", "b")
    # Only the bin in which a source's missing words end has its documents put in order.
    ends = F.coalesce((F.col("before") < F.col("missing")) & (F.col("before") + F.col("words") >= F.col("missing")), F.lit(False))
    order = Window.partitionBy("source").orderBy("rank", "key", "size", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    through = F.col("before") + F.sum("size").over(order)
    up_to = through - F.col("size")
    nearer = (through <= F.col("missing")) | (through - F.col("missing") < F.col("missing") - up_to)
    cut = placed.where(ends).withColumn("extra", ((up_to < F.col("missing")) & nearer).cast("long"))
    other = placed.where(~ends).withColumn("extra", F.coalesce(F.col("before") < F.col("missing"), F.lit(False)).cast("long"))
    columns = ("key", "source", "size", "source_size", "target", "whole", "p", "missing", "rank", "extra", "row")
    drawn = written(other.unionByName(cut).select(*columns), "drawn")
    flips = written(_exchanged(drawn), "exchanged")
    both = drawn.join(F.broadcast(flips) if flips.count() <= BROADCAST_ROWS else flips, F.col("row") == F.col("flip"), "left")
    turned = F.col("flip").isNotNull()
    extra = F.when(turned, 1 - F.col("extra")).otherwise(F.col("extra"))
    found = both.select(
        F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target",
        (F.col("whole") + extra).cast("long").alias("copies"), (extra == 1).alias("drawn"), turned.alias("exchanged"), F.col("row").alias("__row"),
    )
    return found.drop("__row") if row is None else found.withColumnRenamed("__row", row)


def _few(sources: DataFrame) -> bool:
    """Whether one row for each source is small enough to broadcast."""
    return sources.count() <= 100_000


def repeat(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **params) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as the mix takes it, columns unchanged.

    Copies are decided row by row, so rows that share a key, null or not, have copies of their own.
    ``utility`` may use the columns ``key``, ``source`` and ``text``, and ``doc``, the row as a struct.
    """
    rows = docs.select(F.struct(*[docs[c].alias(c) for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "rows")
    of = rows.select("row", "doc", *[F.col("doc").getField(c).alias(n) for n, c in (("key", key), ("text", text), ("source", source))])
    mixed = mix(of, key="key", row="row", **params)
    taken = written(mixed.where(F.col("copies") > 0).select(F.col("row").alias("at"), "copies"), "taken")
    taken = F.broadcast(taken) if taken.count() <= BROADCAST_ROWS else taken
    kept = rows.join(taken, rows["row"] == taken["at"]).select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return kept.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
