"""User functions inside Spark tasks: extractors and spam scorers."""

from __future__ import annotations

from typing import Any, Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

# The scorer sees this many characters of "subject. body".
SCORER_CHARS = 512


def with_extractor(messages: DataFrame, extractor: Callable[[str, Mapping[str, Any]], Any] | None = None,
                   config: Mapping[str, Any] | None = None, body: str = "body",
                   make_extractor: Callable[[], Callable[[str, Mapping[str, Any]], Any]] | None = None) -> DataFrame:
    """Run ``extractor(text, config) -> json`` on each message: ``uid, reply, error``.

    Instead of an extractor, ``make_extractor()`` may be given: each task builds
    its own with it, once, as one that loads a model must. Results that are not
    strings are converted. A message whose extractor call fails gets a null
    reply and the failure in ``error``; the job goes on. A factory that fails
    ends the job.
    """
    if (extractor is None) == (make_extractor is None):
        raise ValueError("give either an extractor or a factory of one")
    settings = dict(config or {})

    def call(use: Callable, text: str) -> tuple[str | None, str | None]:
        try:
            reply = use(text or "", settings)
        except Exception as err:   # noqa: BLE001 - failures are reported by row
            return None, f"{type(err).__name__}: {err}"
        return (reply if isinstance(reply, str) else str(reply)), None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        use = extractor if make_extractor is None else make_extractor()
        for batch in batches:
            called = [call(use, t) for t in batch["body"]]
            yield pd.DataFrame({"uid": batch["uid"], "reply": [r for r, _ in called],
                                "error": [e for _, e in called]})

    return (messages.select("uid", F.col(body).alias("body"))
            .mapInPandas(run, "uid string, reply string, error string"))


def with_scorer(messages: DataFrame, make_scorer: Callable[[], Callable[[str], float]],
                column: str = "ml_spam_probability") -> DataFrame:
    """Add a spam probability from a scorer that each worker builds once.

    ``make_scorer()`` loads the model; the scorer gets the first 512
    characters of ``"subject. body"``. A failing call counts as 0. Only those
    characters travel to Python.
    """
    @pandas_udf(DoubleType())
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = make_scorer()

        def safe(text: str) -> float:
            try:
                return float(scorer(text))
            except Exception:   # noqa: BLE001 - failures count as no evidence
                return 0.0

        for series in texts:
            yield series.map(safe).astype("float64")

    head = F.substring(F.concat(F.coalesce("subject", F.lit("")), F.lit(". "),
                                F.coalesce("body", F.lit(""))), 1, SCORER_CHARS)
    return messages.withColumn(column, score(head))
