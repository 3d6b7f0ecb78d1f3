r"""Words as every corpus operator understands them: runs of anything but the six ASCII blanks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Space, tab, line feed, vertical tab, form feed and carriage return, as in ``[\x20\x09-\x0D]``.
BLANKS = r"[\x20\x09-\x0D]"
NOT_BLANK = r"[^\x20\x09-\x0D]"


def words(text: Column) -> Column:
    """The words of a non-null text, in order."""
    return F.array_remove(F.split(text, BLANKS + "+"), "")


def n_words(text: Column) -> Column:
    """The number of words of a text as a long; 0 for null."""
    return F.coalesce(F.size(words(text)), F.lit(0)).cast("long")
