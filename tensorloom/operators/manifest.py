"""Component manifests: which parts of a pipeline are saved, loaded, and with which type."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def saveable(components: DataFrame, expected: DataFrame, optional: Sequence[str] = ()) -> DataFrame:
    """Components that the pipeline expects, without optional ones that are null, by name."""
    known = components.join(expected.select("name").distinct(), "name", "left_semi")
    return known.filter(~(F.col("name").isin(*optional) & F.col("class").isNull())) if optional else known


def loadable(components: DataFrame, passed_as_none: DataFrame) -> DataFrame:
    """Components with a library, without those that the caller passed as nothing."""
    return components.filter(F.col("library").isNotNull()).join(passed_as_none.select("name").distinct(), "name", "left_anti")


def dtype_on_load(name: Column, by_name: Mapping[str, str]) -> Column:
    """The component's type, else the map's default, else float32."""
    given = {k: v for k, v in by_name.items()}
    table = F.create_map(*[F.lit(x) for kv in given.items() for x in kv]) if given else None
    own = [table[name], table[F.lit("default")]] if table is not None else []
    return F.coalesce(*own, F.lit("float32"))


def dtype_on_save(name: Column, dtypes: Mapping[str, str] | str | None) -> Column:
    """A single type for all, or the component's own, or none."""
    if isinstance(dtypes, Mapping):
        return F.create_map(*[F.lit(x) for kv in dtypes.items() for x in kv])[name] if dtypes else F.lit(None).cast("string")
    return F.lit(dtypes).cast("string")


def set_check(expected: Column, passed: Column, provided: Column, optional: Column) -> list[Column]:
    """Set arithmetic over name arrays: what is missing, whether optional names cover it, what is needed."""
    missing = F.array_except(expected, provided)
    covered = F.size(F.array_except(missing, F.array_union(passed, optional))) == 0
    required = F.array_except(F.array_union(provided, passed), optional)
    return [F.array_sort(missing).alias("missing"), covered.alias("covered"), F.array_sort(required).alias("required")]


def family(config: DataFrame) -> DataFrame:
    """``config`` with ``family``: which library's version key it has; both or neither is an error value."""
    first, second = F.col("transformers_version").isNotNull(), F.col("_diffusers_version").isNotNull()
    kind = F.when(first & ~second, "transformers").when(second & ~first, "diffusers").when(first & second, "ambiguous").otherwise("unknown")
    return config.withColumn("family", kind)


def picked(options: Column, keys: Sequence[str]) -> Column:
    """An option map with the listed keys only (what a function's signature takes)."""
    return F.map_filter(options, lambda k, _: k.isin(*keys)) if keys else F.map_filter(options, lambda k, _: F.lit(False))


def dropped(options: Column, keys: Sequence[str]) -> Column:
    """An option map without the listed keys."""
    return F.map_filter(options, lambda k, _: ~k.isin(*keys)) if keys else options


def with_device(components: DataFrame, devices: DataFrame, default: str | None = None) -> DataFrame:
    """``components(name, ...)`` with the device of ``devices(name, device)``, else ``default`` (null if none)."""
    placed = devices.groupBy("name").agg(F.min("device").alias("device"))
    return components.join(placed, "name", "left").withColumn("device", F.coalesce("device", F.lit(default).cast("string")))


def first_set(*values: Column) -> Column:
    """The first value that is neither null nor 0: settings, then the environment's, then a default."""
    return F.coalesce(*[F.when(v != 0, v) for v in values[:-1]], values[-1])
