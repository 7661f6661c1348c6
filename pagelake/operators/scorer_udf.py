"""Iterator pandas UDF wrapper for pluggable scorers (kept in a module without
postponed annotations: Spark reads the type hints to pick the iterator form)."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

OUT_TYPE = T.StructType([T.StructField("labels", T.ArrayType(T.StringType())),
                         T.StructField("scores", T.ArrayType(T.DoubleType())),
                         T.StructField("error", T.StringType())])


def make_scorer_udf(fn, labels: list, loader=None):
    """(texts, labels) -> frame(labels, scores) scorer as an Iterator pandas
    UDF. ``loader()``, if given, runs once per task and its result is the
    scorer's third argument (a model that all batches of the task share). When
    a batch fails its rows are scored one by one, so that only the rows that
    fail get empty results and their error."""

    @F.pandas_udf(OUT_TYPE)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        more = (loader(),) if loader is not None else ()

        def run(texts):
            res = fn(texts, labels, *more)
            return list(res["labels"]), list(res["scores"]), [None] * len(texts)

        for texts in batches:
            try:
                found = run(texts)
            except Exception:  # noqa: BLE001 -- told apart row by row
                found = [], [], []
                for i in range(len(texts)):
                    try:
                        one = run(texts.iloc[i : i + 1])
                    except Exception as ex:  # noqa: BLE001
                        one = [[]], [[]], [str(ex)]
                    for whole, part in zip(found, one):
                        whole.extend(part)
            yield pd.DataFrame(dict(zip(("labels", "scores", "error"), found)))
    return score
