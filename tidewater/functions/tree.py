"""Long series reduced by an associative product: chunks by themselves, then a tree over the chunks in order."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.ordered import CHUNK, placed

FAN = 64
#: Levels of FAN nodes below the root: the root has one value for FAN ** LEVELS chunks.
LEVELS = 2


def reduced(df: DataFrame, of_chunk: Callable[[pd.DataFrame], np.ndarray], product: Callable[[np.ndarray, np.ndarray], np.ndarray], by: str = "asset", ts: str = "bar", chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """by, value: the product of what of_chunk makes of each chunk's rows in order (a vector of numbers; -inf is kept)."""
    key = f"`{by}` {df.schema[by].dataType.simpleString()}"
    schema = f"{key}, _c long, value array<double>"

    def leaf(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("_at", ignore_index=True)
        return pd.DataFrame({by: p[by][:1], "_c": p["_c"][:1], "value": [of_chunk(p)]})

    def node(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("_c", ignore_index=True)
        whole = np.asarray(p["value"][0], float)
        for v in p["value"][1:]:
            whole = product(whole, np.asarray(v, float))
        return pd.DataFrame({by: p[by][:1], "_c": p["_c"][:1] // fan, "value": [whole]})

    x = placed(df, by, ts).withColumn("_c", F.floor(F.col("_at") / chunk))
    x = x.groupBy(by, "_c").applyInPandas(leaf, schema)
    for _ in range(LEVELS):
        x = x.groupBy(by, F.floor(F.col("_c") / fan)).applyInPandas(node, schema)
    return x.groupBy(by).applyInPandas(node, schema).drop("_c")
