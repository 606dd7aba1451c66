"""BM25 of a bounded number of questions over a table of texts, without an index and without a shuffle of postings.

One pass counts the asked terms, one scores. The terms of the questions go to every task; a task keeps the best of each question as it reads,
and only those leave it. So the work grows with the texts, memory with the questions, and what is shuffled with questions times tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Scores that a task holds at once: questions times chunks.
CELLS = 400_000


def postings(words: pa.ListArray, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For lists of words: row, number of the term in names and tf of each posting, ordered by row, and the length of each row."""
    row = pc.list_parent_indices(words).to_numpy(zero_copy_only=False).astype(np.int64)
    term = pc.index_in(words.flatten(), value_set=names).fill_null(-1).to_numpy(zero_copy_only=False)
    known = term >= 0
    key, tf = np.unique(row[known] * len(names) + term[known], return_counts=True)
    return key // len(names), key % len(names), tf, np.bincount(row, minlength=len(words))


def count_terms(words: DataFrame, names: list[str], split: Callable[[pa.Array], pa.ListArray] | None = None) -> tuple[np.ndarray, int, float]:
    """words (w) -> in how many rows each name stands, the number of rows with words, and their mean length. For split see best_chunks."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, df, n, total = pa.array(names, pa.string()), np.zeros(len(names) + 1, np.int64), 0, 0
        for batch in batches:
            _, term, _, length = postings(split(batch.column("w")) if split else batch.column("w"), known)
            df += np.bincount(term, minlength=len(df))
            n, total = n + int(np.count_nonzero(length)), total + int(length.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": pa.array([-1, *some], pa.int64()), "df": pa.array([n, *df[some]], pa.int64()), "total": pa.array([total, *[0] * len(some)], pa.int64())})

    rows = words.select("w").mapInArrow(count, "term long, df long, total long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total")).collect()
    df, n, total = np.zeros(len(names), np.int64), 0, 0
    for r in rows:
        if r.term < 0:
            n, total = r.df, r.total
        else:
            df[r.term] = r.df
    return df, n, total / max(1, n)


def cut(found: pd.DataFrame, limit: np.ndarray) -> pd.DataFrame:
    """The best of each question, by score and then chunk_id, with their place from 0."""
    found = found.sort_values(["q", "score", "chunk_id"], ascending=[True, False, True])
    found["place"] = found.groupby("q").cumcount()
    return found[found["place"].to_numpy() < limit[found["q"].to_numpy()]]


def best_chunks(words: DataFrame, questions: pd.DataFrame, k1: float, b: float, split: Callable[[pa.Array], pa.ListArray] | None = None) -> DataFrame:
    """words (chunk_id, w), questions (query_id, term, limit; one row a term) -> query_id, chunk_id, score: at least the `limit` best chunks
    of each question, and no more than those of each task. w holds lists of words, or texts that split makes into such in the tasks."""
    names = sorted(questions["term"].unique())
    df, n, mean = count_terms(words, names, split)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    ids, q_of = np.unique(questions["query_id"].to_numpy(), return_inverse=True)
    limit = np.zeros(len(ids), np.int64)
    limit[q_of] = questions["limit"]
    term_of = np.searchsorted(names, questions["term"].to_numpy(object))
    asks = q_of[np.argsort(term_of, kind="stable")]  # the questions of each term, one term after the other
    n_asks = np.bincount(term_of, minlength=len(names))
    first = np.cumsum(n_asks) - n_asks
    most, step = int(limit.max()), max(1, CELLS // len(ids))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, kept, fresh, waiting = pa.array(names, pa.string()), pd.DataFrame({"q": np.zeros(0, np.int64), "score": np.zeros(0), "chunk_id": np.zeros(0, object)}), [], 0
        floor = np.full(len(ids), 1e-300)  # nothing below it can be among the best of a question
        for part in (batch.slice(i, step) for batch in batches for i in range(0, batch.num_rows, step)):
            row, term, tf, length = postings(split(part.column("w")) if split else part.column("w"), known)
            share = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[row] / mean))
            times = n_asks[term]
            asked = asks[np.repeat(first[term] - np.cumsum(times) + times, times) + np.arange(times.sum())]
            got = np.bincount(asked * len(length) + np.repeat(row, times), np.repeat(share, times), len(ids) * len(length)).reshape(len(ids), -1)
            many = np.flatnonzero((got >= floor[:, None]).sum(1) > most)
            if len(many):
                floor[many] = np.maximum(floor[many], np.partition(got[many], -most, axis=1)[:, -most] - 2e-6)
            q, at = np.nonzero(got >= floor[:, None])
            if not len(q):
                continue
            fresh.append(pd.DataFrame({"q": q, "score": np.round(got[q, at], 6), "chunk_id": part.column("chunk_id").take(pa.array(at)).to_numpy(zero_copy_only=False)}))
            waiting += len(q)
            if waiting > len(ids) * most:
                kept, fresh, waiting = cut(pd.concat([kept[fresh[0].columns], *fresh]), limit), [], 0
                last = kept[kept["place"].to_numpy() == limit[kept["q"].to_numpy()] - 1]
                floor[last["q"].to_numpy()] = np.maximum(floor[last["q"].to_numpy()], last["score"].to_numpy() - 2e-6)  # scores are rounded
        if fresh:
            kept = cut(pd.concat([kept[fresh[0].columns], *fresh]), limit)
        yield pa.RecordBatch.from_pydict({"query_id": pa.array(ids[kept["q"].to_numpy()]), "chunk_id": pa.array(kept["chunk_id"], pa.string()), "score": pa.array(kept["score"], pa.float64())})

    return words.select("chunk_id", "w").mapInArrow(score, "query_id long, chunk_id string, score double")
