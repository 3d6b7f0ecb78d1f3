"""Name predicates: which tensors a call leaves out."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _tests(name: Column, names, prefixes, suffixes) -> list[Column]:
    return [
        *([name.isin(*names) if len(names) > 1 else name == names[0]] if names else []),
        *[name.startswith(p) for p in prefixes or ()],
        *[name.endswith(s) for s in suffixes or ()],
    ]


def ignored(name: Column, names: Sequence[str] | None = None, prefixes: Sequence[str] | None = None, suffixes: Sequence[str] | None = None) -> Column:
    """Whether a name is listed, or starts or ends with a listed string. Case counts, no patterns.

    A null name is not ignored. An absent or empty list matches nothing.
    """
    return F.coalesce(reduce(or_, _tests(name, names, prefixes, suffixes), F.lit(False)), F.lit(False))


def keep(df: DataFrame, names=None, prefixes=None, suffixes=None, column: str = "name", nulls: bool = True) -> DataFrame:
    """The rows whose name is not ignored.

    Without ``nulls`` the column is known to have none, and every test is a filter of its own, which
    a scan can take over.
    """
    if not (names or prefixes or suffixes):
        return df
    if nulls:
        return df.filter(~ignored(F.col(column), names, prefixes, suffixes))
    return reduce(lambda d, t: d.filter(~t), _tests(F.col(column), list(names or ()), prefixes, suffixes), df)


def misaligned(offset: Column, align: Column) -> Column:
    """Whether an element offset is off its alignment; never where alignment is 0."""
    return (align > 0) & (F.pmod(offset, F.greatest(align, F.lit(1))) != 0)


def resolved(call: Sequence[str] | None, default: Sequence[str] | None) -> list[str] | None:
    """A call's list, or the class default where the call's is absent or empty; no union."""
    return list(call) if call else (list(default) if default else None)
