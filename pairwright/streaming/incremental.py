"""Scoring new pairs as they arrive."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import matching as m


def score_batch(
    pairs: DataFrame, jobs: DataFrame, candidates: DataFrame, existing: DataFrame,
    weights: Mapping[str, float] | None = None,
) -> DataFrame:
    """Stored rows for the pairs of one batch that are new or were scored under other weights."""
    todo = m.pending_pairs(pairs.select("job_id", "candidate_id").distinct(), existing, weights)
    return m.match_results(m.score_pairs(todo, jobs, candidates, weights))


def incremental_scoring(
    pairs: DataFrame,
    jobs: Callable[[], DataFrame],
    candidates: Callable[[], DataFrame],
    read_existing: Callable[[], DataFrame],
    target: str,
    checkpoint: str,
    weights: Mapping[str, float] | None = None,
) -> StreamingQuery:
    """Score a stream of pairs micro-batch by micro-batch into the match store at ``target``.

    A pair has one row in the store: scored again, under other weights or in a batch that is
    retried after a lost executor or driver, it takes the place of the old one.  The profile
    readers are called per batch and see current tables.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        m.write_matches(score_batch(batch, jobs(), candidates(), read_existing(), weights), target)

    return (
        pairs.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
