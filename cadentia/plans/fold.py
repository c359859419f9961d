"""A fold along each key's order, for state that decides its own next step."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Step = Callable[[object, tuple], tuple[object, tuple]]


def ordered_fold(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Step, schema: T.StructType
) -> DataFrame:
    """Run ``state, output = step(state, row)`` over each key's rows in order.

    ``state`` is None at a key's first row, ``row`` a named tuple, and
    ``output`` the values after the key and order columns in ``schema``. Rows
    stream through in Arrow batches: a task holds one batch and one state,
    never a key's history. Keys run in parallel. Inside a key the steps run one
    after the other, which is inherent where the state gates its own update, so
    callers hand over as few rows per key as the semantics allow.
    """
    names = [*keys, *order]
    width = len(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                key = row[:width]
                if key != current:
                    current, state = key, None
                state, values = step(state, row)
                out.append((*row[: len(names)], *values))
            yield pd.DataFrame(out, columns=schema.names)

    front = df.select(*names, *[c for c in df.columns if c not in names])
    return (
        front.repartition(*keys).sortWithinPartitions(*names).mapInPandas(run, schema)
    )
