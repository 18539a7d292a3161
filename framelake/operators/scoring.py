"""Plug-in scorers.  The model is the caller's; batching, softmax and votes are ours."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from framelake.functions.features import softmax
from framelake.operators.layout import group_batches, split_groups

Scorer = Callable[[pd.DataFrame], pd.DataFrame]
LOGITS = ["logit0", "logit1"]


def _with_logits(df: DataFrame) -> T.StructType:
    return T.StructType([*df.schema.fields, *[T.StructField(c, T.DoubleType()) for c in LOGITS]])


def _with_probabilities(df: DataFrame) -> DataFrame:
    p = softmax([F.col(c) for c in LOGITS])
    return df.withColumns({"p0": p[0], "p1": p[1]})


def score_rows(df: DataFrame, model: Scorer) -> DataFrame:
    """A model that scores rows one by one: Arrow batches, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield model(b)

    return _with_probabilities(df.mapInPandas(run, _with_logits(df)))


def score_groups(df: DataFrame, keys: Sequence[str], model: Scorer) -> DataFrame:
    """A model that needs a whole window or chunk at once; cut windows with ``scoring_chunks`` first to bound it.

    The model is called once per window; windows travel in batches, since
    handing over each small one alone costs more than most models.
    """
    schema = _with_logits(df)

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([model(g.reset_index(drop=True)) for g in split_groups(batch, list(keys))], ignore_index=True)[schema.names]

    return _with_probabilities(group_batches(df, keys, run, schema))
