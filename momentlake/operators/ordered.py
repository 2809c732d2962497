"""Ordered passes: per-key state over rows in order, without holding a key's rows.

Rows are spread by key and sorted by Spark (spilling as needed); a Python pass then walks each partition once, an
Arrow batch at a time, keeping only the state of the key at hand. The state is handed whole stretches of a key's
rows as arrays, so what it does for rows that change nothing is vectorised.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def stretches(columns: list[pa.Array], n: int) -> np.ndarray:
    """Where the rows' keys change: the first row of each stretch of equal keys, and the number of rows at the end."""
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        if n > 1:
            a, b = c.slice(1), c.slice(0, n - 1)
            differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
            new[1:] |= differ | (a.is_valid().to_numpy(zero_copy_only=False) != b.is_valid().to_numpy(zero_copy_only=False))
    return np.append(np.nonzero(new)[0], n)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by ``keys`` as tables of whole groups, with the first row of each group and the number of rows; a group is held until it is complete."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        held = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
        cuts = stretches([held.column(c).combine_chunks() for c in keys], held.num_rows)
        if cuts[-2]:
            yield held.slice(0, cuts[-2]), cuts[:-1]
        held = held.slice(cuts[-2])
    if held is not None:
        yield held, np.array([0, held.num_rows])


def ordered_pass(df: DataFrame, keys: list[str], order: list[Column], columns: list[str], start: Callable[[], object], walk: Callable[..., list], out: str) -> DataFrame:
    """Rows ``columns`` extended by the arrays that ``walk(state, *columns)`` returns for a stretch of a key's rows, in order; ``start()`` makes the state of a new key.

    ``out`` is the DDL of the added columns. A key's stretches come one after the other, one for each batch that holds it.
    """
    added = StructType.fromDDL(out)
    ordered = df.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys, *order)
    schema = StructType(ordered.schema.fields + added.fields)
    types = to_arrow_schema(added).types
    names, k = schema.names, len(keys)

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            if not b.num_rows:
                continue
            parts: list[list] = []
            cuts = stretches(b.columns[:k], b.num_rows)
            heads = list(zip(*(c.take(pa.array(cuts[:-1])).to_pylist() for c in b.columns[:k])))
            for head, lo, hi in zip(heads, cuts[:-1].tolist(), cuts[1:].tolist()):
                if state is None or head != key:
                    key, state = head, start()
                parts.append(walk(state, *(c.slice(lo, hi - lo) for c in b.columns[k:])))
            new = [pa.array(np.concatenate([p[i] for p in parts]), t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names)

    return ordered.mapInArrow(passes, schema)
