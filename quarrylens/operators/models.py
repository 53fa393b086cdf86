"""Slots for models: text encoders and answer generators.

Both run in Arrow batches where the rows are.  A factory is called once per
Python worker, so a model is loaded once, not per batch or row.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.operators.dense import ENCODE_BATCH

# Fixed values -------------------------------------------------------------
PASSAGE_PREFIX = "Represent this sentence for searching relevant passages: "
QUERY_PREFIX = "Represent this question for retrieving relevant documents: "
MAX_ATTEMPTS = 3
MIN_WAIT_SECONDS = 1
MAX_WAIT_SECONDS = 4
# --------------------------------------------------------------------------

Encoder = Callable[[np.ndarray], np.ndarray]
Generator = Callable[[Sequence[dict]], str]


def embed(text: Column, make_encoder: Callable[[], Encoder], prefix: str = PASSAGE_PREFIX, batch_size: int = ENCODE_BATCH) -> Column:
    """Unit vectors of prefixed texts; use ``QUERY_PREFIX`` for queries."""

    def make_unit_encoder() -> Encoder:
        encoder = make_encoder()

        def encode(texts: np.ndarray) -> np.ndarray:
            vectors = np.asarray(encoder(texts), dtype=np.float64)
            norms = np.linalg.norm(vectors, axis=1, keepdims=True)
            return (vectors / np.where(norms > 0, norms, 1.0)).astype(np.float32)

        return encode

    encode = predict_batch_udf(make_unit_encoder, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return encode(F.concat(F.lit(prefix), text))


def generate(
    prompts: DataFrame, make_generator: Callable[[], Generator], wait: Callable[[float], None] = time.sleep
) -> DataFrame:
    """Model text per prompt: query_id, text, error, latency_ms (all attempts and pauses).

    ``prompts`` has (query_id, messages).  A call is tried three times with a
    growing pause; an empty text counts as a failure.  What fails in the end
    has no text and its error, so that parsing turns it into a decline.
    """

    def answer(generator: Generator, messages: list[dict]) -> tuple[str | None, str | None]:
        error = None
        for attempt in range(MAX_ATTEMPTS):
            if attempt:
                wait(min(MAX_WAIT_SECONDS, max(MIN_WAIT_SECONDS, 2 ** (attempt - 1))))
            try:
                text = generator(messages)
                if text and text.strip():
                    return text, None
                error = "empty response"
            except Exception as exc:  # noqa: BLE001  any model error is a failed attempt
                error = str(exc)
        return None, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generator = make_generator()
        for batch in batches:
            rows = []
            for query, messages in zip(batch["query_id"], batch["messages"]):
                start = time.perf_counter()
                text, error = answer(generator, list(messages))
                rows.append((query, text, error, 1000 * (time.perf_counter() - start)))
            yield pd.DataFrame(rows, columns=["query_id", "text", "error", "latency_ms"])

    kind = prompts.schema["query_id"].dataType.simpleString()
    return prompts.select("query_id", "messages").mapInPandas(run, f"query_id {kind}, text string, error string, latency_ms double")
