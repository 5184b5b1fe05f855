"""Streaming Arrow batches in blocks of about a given number of bytes, so that memory does not follow the partition."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa


def blocks(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Concatenated batches; a block closes once it holds ``limit`` bytes. A single larger row is a block of its own."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        step = max(1, b.num_rows * limit // max(1, b.nbytes * 2)) if b.nbytes > limit else max(1, b.num_rows)
        for at in range(0, b.num_rows, step):
            part = b.slice(at, step)
            held.append(part)
            size += part.nbytes
            if size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def per_block(f: Callable[[pa.Table], pa.Table | pa.RecordBatch], limit: int = 48 << 20):
    """A ``mapInArrow`` function from one over whole blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in blocks(batches, limit):
            out = f(t)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out.to_batches()

    return run
