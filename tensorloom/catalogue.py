"""Registry of the library's own queries and their SQL oracles."""

from __future__ import annotations

from tensorloom.plans import files, library

QUERIES = {**library.QUERIES, **files.QUERIES}
ORACLES = {**library.ORACLES, **files.ORACLES}
