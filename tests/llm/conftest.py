import pytest
from pyspark import cloudpickle

import mailspark

cloudpickle.register_pickle_by_value(mailspark)

CLASH = "key string, t string, id bigint, n int, spans string, start int, token string, words string, rules string, to string"


@pytest.fixture
def docs(spark):
    """``documents`` from texts (ids 0, 1, ...) or (id, text) pairs, with columns named like working ones."""
    def make(texts, first=0):
        pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts, first)]
        return spark.createDataFrame([(i, t, "en", "src1", len(t or ""), "k", "t", 1, 2, "s", 3, "w", "w", "r", "x")
                                      for i, t in pairs],
                                     "doc_id bigint, text string, lang string, source string, n_chars bigint, " + CLASH)
    return make
