"""Rows in order, packed into runs, where one key may hold any share of all rows.

Rows are dealt out by ranges of (key, order), so a key with many rows spans several tasks; each
task packs its rows into runs of bounded length.  What a run comes to (a sum, a filter's element)
is then small, and runs of one key are put together in the order of (part, first).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame


def packed_runs(rows: DataFrame, key: str, order: list[str], values: list[str], *, size: int = 4096, partitions: int | None = None) -> DataFrame:
    """key, part, first and an array of every value column: runs of at most `size` rows of one key, in order.

    part grows with the order of a key's runs, and within a part first does (the place of the
    run's first row among the key's rows there).  Nulls come first; the key and the values are
    numbers or, for the key, strings.
    """
    partitions = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (key, *values)}
    names = [key, "part", "first", *values]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, start = TaskContext.get().partitionId(), None, 0

        def emit(done: pa.Table, cut: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
            at = pa.array(np.append(cut, done.num_rows), pa.int32())
            lists = [pa.ListArray.from_arrays(at, done.column(v).combine_chunks()) for v in values]
            return pa.RecordBatch.from_arrays([done.column(key).combine_chunks().take(pa.array(cut)), pa.array([part] * len(cut), pa.int32()), pa.array(place[cut]), *lists], names=names)

        for batch in (b for b in batches if b.num_rows):
            table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
            codes = table.column(key).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            new = np.concatenate([[True], codes[1:] != codes[:-1]])
            run = np.flatnonzero(new)
            place = np.arange(len(codes)) - np.repeat(run, np.diff(np.append(run, len(codes))))
            place[: run[1] if len(run) > 1 else len(codes)] += start
            new[1:] |= place[1:] // size != place[:-1] // size
            cut = np.flatnonzero(new)
            if cut[-1]:
                yield emit(table.slice(0, int(cut[-1])), cut[:-1], place)
            held, start = table.slice(int(cut[-1])), int(place[cut[-1]])
        if held is not None:
            yield emit(held.combine_chunks(), np.zeros(1, np.int64), np.array([start]))

    dealt = rows.repartitionByRange(partitions, key, *order).sortWithinPartitions(key, *order).select(key, *values)
    return dealt.mapInArrow(pack, ", ".join([f"`{key}` {kinds[key]}", "part int", "first long", *(f"`{v}` array<{kinds[v]}>" for v in values)]))
