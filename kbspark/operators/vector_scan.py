"""Exact cosine search of a bounded number of queries over a table of vectors, without a shuffle of vectors.

The queries go to every task; a task keeps the best of each as it reads, and only those leave it. So the work grows with the vectors, memory
with the queries, and what is shuffled with queries times tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from kbspark.operators.keyword_scan import CELLS, cut


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; a row of zeros stays."""
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def matrix(rows: pa.ListArray, size: int) -> np.ndarray:
    """Lists of one length as rows, in double precision."""
    if not pc.all(pc.equal(pc.list_value_length(rows), size)).as_py():
        raise ValueError(f"vectors must have {size} components, as the queries have")
    return rows.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)


def best_vectors(vectors: DataFrame, queries: pd.DataFrame) -> DataFrame:
    """vectors (chunk_id, embedding), queries (query_id, embedding, limit; one row a query) -> query_id, chunk_id, score: at least the `limit`
    best of each query, and no more than those of each task."""
    ids, limit = queries["query_id"].to_numpy(np.int64), queries["limit"].to_numpy(np.int64)
    asked = unit(np.stack(queries["embedding"].to_list()).astype(float))
    most, step = int(limit.max()), max(1, CELLS // len(ids))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, fresh, waiting = pd.DataFrame({"q": np.zeros(0, np.int64), "score": np.zeros(0), "chunk_id": np.zeros(0, object)}), [], 0
        floor = np.full(len(ids), -np.inf)  # nothing below it can be among the best of a query
        for part in (batch.slice(i, step) for batch in batches for i in range(0, batch.num_rows, step)):
            got = np.round(asked @ unit(matrix(part.column("embedding"), asked.shape[1])).T, 6)
            many = np.flatnonzero((got >= floor[:, None]).sum(1) > most)
            if len(many):
                floor[many] = np.maximum(floor[many], np.partition(got[many], -most, axis=1)[:, -most])
            q, at = np.nonzero(got >= floor[:, None])
            if not len(q):
                continue
            fresh.append(pd.DataFrame({"q": q, "score": got[q, at], "chunk_id": part.column("chunk_id").take(pa.array(at)).to_numpy(zero_copy_only=False)}))
            waiting += len(q)
            if waiting > len(ids) * most:
                kept, fresh, waiting = cut(pd.concat([kept[fresh[0].columns], *fresh]), limit), [], 0
                last = kept[kept["place"].to_numpy() == limit[kept["q"].to_numpy()] - 1]
                floor[last["q"].to_numpy()] = np.maximum(floor[last["q"].to_numpy()], last["score"].to_numpy())
        if fresh:
            kept = cut(pd.concat([kept[fresh[0].columns], *fresh]), limit)
        yield pa.RecordBatch.from_pydict({"query_id": pa.array(ids[kept["q"].to_numpy()]), "chunk_id": pa.array(kept["chunk_id"], pa.string()), "score": pa.array(kept["score"], pa.float64())})

    return vectors.select("chunk_id", "embedding").filter("embedding is not null").mapInArrow(score, "query_id long, chunk_id string, score double")
