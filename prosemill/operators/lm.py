"""Features from a language model's token statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tokens of a paragraph that count.
MOST_TOKENS = 256


def token_stats(df: DataFrame, keys: list[str], logits: str = "logits", token: str = "next_token") -> DataFrame:
    """keys, observed, entropy, variance, rank of each row's next token, from its row of logits (array<float>)."""
    schema = T.StructType([*df.select(*keys).schema.fields, *T.StructType.fromDDL("observed double, entropy double, variance double, rank int").fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            z = np.stack(b[logits].to_numpy()).astype(np.float64)
            z -= z.max(axis=1, keepdims=True)
            logp = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
            p = np.exp(logp)
            entropy = -(p * logp).sum(axis=1)
            at = b[token].to_numpy()
            observed = logp[np.arange(len(z)), at]
            variance = (p * logp * logp).sum(axis=1) - entropy**2
            rank = 1 + (logp > observed[:, None]).sum(axis=1)
            yield b[keys].assign(observed=observed, entropy=entropy, variance=variance, rank=rank.astype(np.int32))

    return df.select(*keys, logits, token).mapInPandas(run, schema)


def lm_features(stats: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """keys, lm: eight values of a paragraph from its first tokens: observed, entropy, variance, rank by token."""
    curvature = (F.sum("observed") + F.sum("entropy")) / F.sqrt(F.greatest(F.sum("variance"), F.lit(1e-6)))
    values = [
        F.avg("observed"), F.avg("entropy"), curvature, F.when(F.sum("entropy") > 0, -F.sum("observed") / F.sum("entropy")).otherwise(0.0), F.avg(F.log(F.col("rank").cast("double"))),
        F.avg((F.col("rank") == 1).cast("double")), F.avg((F.col("rank") <= 10).cast("double")), F.when(F.count("*") > 1, F.stddev_samp("observed")).otherwise(0.0),
    ]
    return stats.filter(F.col(pos) < MOST_TOKENS).groupBy(*keys).agg(F.array(*values).alias("lm"))
