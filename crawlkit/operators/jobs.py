"""Attempts, dead letters and retention of jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlkit.functions.retry import INGEST_ATTEMPTS, ingest_backoff_ms
from crawlkit.operators.spread import ranked, top_per_key

# Finished jobs kept per queue.
KEEP_COMPLETED, KEEP_FAILED = 1000, 5000


def retain_latest(
    jobs: DataFrame, completed: int = KEEP_COMPLETED, failed: int = KEEP_FAILED
) -> DataFrame:
    """Unfinished jobs, and the newest finished ones per queue and state.

    Each state is a branch with its own literal limit, which the planner can apply before
    the shuffle (up to ``spark.sql.optimizer.windowGroupLimitThreshold``).
    """
    order = [F.desc("ts"), F.desc("job_id")]
    kept = jobs.where(~F.coalesce(F.col("state").isin("completed", "failed"), F.lit(False)))
    for state, limit in (("completed", completed), ("failed", failed)):
        finished = jobs.where(F.col("state") == state)
        kept = kept.unionByName(top_per_key(finished, ["queue", "state"], order, limit, "job_id"))
    return kept


def attempt_number(
    job_events: DataFrame, cap: Column | int, ts: str = "ts", seq: str = "seq"
) -> DataFrame:
    """Number the attempts of each job; from the cap on a job is exhausted."""
    cap = F.lit(cap) if isinstance(cap, int) else cap
    numbered = ranked(job_events, ["job_id"], [F.col(ts), F.col(seq)], "attempt")
    return numbered.withColumn("exhausted", F.col("attempt") >= cap)


def dead_letters(attempts: DataFrame, cap: Column | int) -> DataFrame:
    """The attempt with which a job used up its cap, if that one failed too."""
    cap = F.lit(cap) if isinstance(cap, int) else cap
    return attempts.where((F.col("attempt") == cap) & F.col("error").isNotNull())


def retry_schedule(attempts: DataFrame, cap: int = INGEST_ATTEMPTS) -> DataFrame:
    """Wait after each ingest attempt and the total wait up to it, in milliseconds.

    Waits double, so the total is twice the last wait less the first: no window needed.
    """
    wait = ingest_backoff_ms(F.col("attempt"))
    first = ingest_backoff_ms(F.lit(1))
    return attempts.where(F.col("attempt") < cap).withColumns(
        {"delay_ms": wait, "total_ms": 2 * wait - first}
    )
