"""Labels from a model the caller supplies, in Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

# Fixed value: texts per model call.
BATCH_ROWS = 50

Predict = Callable[[list[str]], Sequence[str]]

# Models of this worker process by the call of ``batch_score`` that made them.
_MODELS: dict[str, Predict] = {}


def batch_score(
    articles: DataFrame,
    model_factory: Callable[[], Predict],
    columns: tuple[str, ...] = ("shorttext", "fulltext"),
    drop: tuple[str, ...] = ("fulltext", "shorttext", "date", "title"),
    batch_rows: int = BATCH_ROWS,
) -> DataFrame:
    """Add ``<column>_sentiment`` per text column and drop the texts.

    ``model_factory`` gives the function that labels a list of texts. It is called once per worker
    process, which keeps the model for the tasks that follow. A null text is passed on as an empty one.
    Tasks work through their rows as a stream of batches.
    """
    kept = [f for f in articles.schema.fields if f.name not in drop]
    schema = StructType(kept + [StructField(f"{c}_sentiment", StringType()) for c in columns])
    names = [f.name for f in kept]
    model_id = uuid.uuid4().hex

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from mentionmill.operators.model import _MODELS  # the module's own dict, not a copy sent with the task

        if model_id not in _MODELS:
            _MODELS[model_id] = model_factory()
        predict = _MODELS[model_id]
        for batch in batches:
            for at in range(0, len(batch), batch_rows):
                part = batch.iloc[at : at + batch_rows]
                out = part[names].copy()
                for c in columns:
                    out[f"{c}_sentiment"] = list(predict(part[c].fillna("").tolist()))
                yield out

    needed = list(dict.fromkeys([*names, *columns]))
    return articles.select(*needed).mapInPandas(label, schema)
