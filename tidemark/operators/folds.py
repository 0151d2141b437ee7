"""Folds over rows in order, where order decides and no window function can say it."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Result rows that a task gathers before it gives them out.
OUT_ROWS = 10_000


def fold(rows: DataFrame, keys: list[str], order: list[str], f: Callable[[list], list[tuple]], schema: str) -> DataFrame:
    """f gets the rows of each key (nulls agree) in order, as named tuples, and gives result tuples.

    Spark shuffles and sorts by key; a task then reads its groups one after the other from the
    sorted stream, so small groups cost no call of their own and only one group is held at a time.
    """
    names = [x.split()[0] for x in schema.split(", ")]
    types = {n: "Int64" for n, x in zip(names, schema.split(", ")) if x.split()[1] == "long"}

    def run(batches):
        stream = (r for pdf in batches for r in pdf.itertuples(index=False, name="Row"))
        out = []
        for _, group in itertools.groupby(stream, key=lambda r: r.fold_key):
            out += f(list(group))
            if len(out) >= OUT_ROWS:
                yield pd.DataFrame(out, columns=names).astype(types)
                out = []
        yield pd.DataFrame(out, columns=names).astype(types)

    keyed = rows.withColumn("fold_key", F.to_json(F.struct(*keys)))
    return keyed.repartition("fold_key").sortWithinPartitions("fold_key", *order).mapInPandas(run, schema)
