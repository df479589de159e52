"""Incremental runs: new documents merged batch by batch, and ratings kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.dedup import keep_first
from tidemark.operators.tournament import fold


def merge_stream(incoming: DataFrame, path: str, key: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch's rows of keys that the table at path lacks; any age is welcome, as all history is compared.

    A batch that is replayed after a failure finds its rows there and adds none. Each batch reads the keys of all history
    (one column of it): a horizon would forget ids that may come again.
    """

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        own = keep_first(batch, key, *(F.col(c) for c in batch.columns))
        try:
            own = own.join(spark.read.parquet(path).select(key), key, "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        own.write.mode("append").parquet(path)

    return incoming.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rating_stream(log: DataFrame) -> DataFrame:
    """Ratings of each tournament after each micro-batch of its log, from state: tournament, id, mu, sigma, n.

    Rows of one batch are taken in the order of seq; later batches continue from there. The state of a tournament is one
    row with all its players, as any two of them may meet next.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = dict(zip(state.get[0], zip(*state.get[1:]))) if state.exists else {}
        rows = pd.concat(list(parts))
        rows = rows[rows["winner"].isin(["A", "B"]) & (rows["a"] != rows["b"])]
        known = fold(rows, known)
        state.update((list(known), [v[0] for v in known.values()], [v[1] for v in known.values()], [v[2] for v in known.values()]))
        changed = pd.unique(pd.concat([rows["a"], rows["b"]])) if len(rows) else []
        yield pd.DataFrame([(key[0], k, *known[k]) for k in changed], columns=["tournament", "id", "mu", "sigma", "n"]).astype({"mu": float, "sigma": float, "n": "int64"})

    out = "tournament int, id string, mu double, sigma double, n long"
    state = "ids array<string>, mu array<double>, sigma array<double>, n array<long>"
    return log.groupBy("tournament").applyInPandasWithState(step, out, state, "update", GroupStateTimeout.NoTimeout)
