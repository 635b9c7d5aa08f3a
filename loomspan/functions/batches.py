"""Rows of Python scans in lists of a bounded length."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice


def batches(rows: Iterable, size: int = 4096) -> Iterator[list]:
    """Lists of at most ``size`` rows; no more than these are held, however many rows a batch of files gives."""
    rows = iter(rows)
    while some := list(islice(rows, size)):
        yield some
