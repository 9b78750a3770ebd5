"""What each lead carries from call to call, in versions that follow the batches of a stream."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from callwise.config import DEFAULTS
from callwise.plans.sequence import sequence_columns

INPUT_COLUMNS = ("lead_id", "interaction_id", "day", "next_step", "outcome")


class LeadState:
    """The state of all leads under ``path``, one folder per batch that holds the leads of that batch.

    A batch reads the versions before its own only and overwrites its own, so a batch that is replayed gives the
    same rows and the same state. The newest version of a lead holds.
    """

    def __init__(self, path: str) -> None:
        self.path = path

    def before(self, batch: DataFrame, batch_id: int) -> DataFrame | None:
        """One row per lead of ``batch`` that earlier batches have met."""
        try:
            versions = batch.sparkSession.read.parquet(f"{self.path}/state")
        except AnalysisException:  # no batch has been written
            return None
        leads = batch.select("lead_id").distinct()
        return versions.where(F.col("version") < batch_id).join(leads, "lead_id", "left_semi").groupBy("lead_id").agg(
            F.max_by(F.struct("calls", "first_day", "last_day", "step", "outcome"), "version").alias("s")).select("lead_id", "s.*")

    def advance(self, batch: DataFrame, batch_id: int, rows_per_slice: int | None = None) -> None:
        """Numbers the calls of a batch, hands each what the call before left behind, and writes both rows and state."""
        calls = batch.select(*INPUT_COLUMNS).where("lead_id IS NOT NULL")
        calls = calls.withColumns({c: F.coalesce(c, F.lit(DEFAULTS.sentinel)) for c in ("next_step", "outcome")}).persist()
        placed = sequence_columns(calls, ["lead_id"], ["day", "interaction_id"], number="position", firsts={"_first": "day"},
                                  lags={"_step": "next_step", "_outcome": "outcome", "_day": "day"}, rows_per_slice=rows_per_slice)
        last = calls.groupBy("lead_id").agg(
            F.count(F.lit(1)).alias("n"), F.min("day").alias("first"),
            F.max_by(F.struct("day", "next_step", "outcome"), F.struct("day", "interaction_id")).alias("l"))
        known = self.before(calls, batch_id)
        if known is None:
            known = calls.sparkSession.createDataFrame([], "lead_id long, calls long, first_day int, last_day int, step string, outcome string")
        known = known.withColumnsRenamed({"lead_id": "_lead", "outcome": "last_outcome"}).persist()
        both = placed.join(known, F.col("lead_id") == F.col("_lead"), "left")
        sentinel = F.lit(DEFAULTS.sentinel)
        day = F.col("day").cast("int")
        rows = both.select(
            "interaction_id", "lead_id", (F.col("position") + F.coalesce("calls", F.lit(0))).alias("call_number"),
            F.coalesce("_step", "step", sentinel).alias("prev_next_step"), F.coalesce("_outcome", "last_outcome", sentinel).alias("prev_outcome"),
            (day - F.coalesce("_day", "last_day", "day")).cast("int").alias("days_since_last_call"),
            (day - F.coalesce("first_day", "_first")).cast("int").alias("days_since_entry"))
        rows.write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch_id}")
        newest = last.join(known, F.col("lead_id") == F.col("_lead"), "left").select(
            "lead_id", (F.col("n") + F.coalesce("calls", F.lit(0))).alias("calls"), F.coalesce("first_day", "first").cast("int").alias("first_day"),
            F.col("l.day").cast("int").alias("last_day"), F.col("l.next_step").alias("step"), F.col("l.outcome").alias("outcome"))
        # The state comes last: until it is there, a replay starts from the versions before.
        newest.write.mode("overwrite").parquet(f"{self.path}/state/version={batch_id}")
        known.unpersist()
        calls.unpersist()

    def rows(self, spark: SparkSession) -> DataFrame:
        """All rows of all batches."""
        return spark.read.parquet(f"{self.path}/rows").drop("batch")


def carry_lead_state(stream: DataFrame, path: str, checkpoint: str, rows_per_slice: int | None = None) -> StreamingQuery:
    """Calls with their number in the lead and what the previous call left behind, written under ``path``.

    Needs the columns ``INPUT_COLUMNS`` (``day`` counts days from a fixed date); rows without a lead are left out. Inside a batch calls are
    sorted; a lead of any size is cut into slices. Across batches the calls of a lead must arrive in order. Every batch is
    a few joins and windows over its own leads; a replayed batch changes nothing.
    """
    state = LeadState(path)
    return (stream.writeStream.foreachBatch(lambda batch, i: state.advance(batch, i, rows_per_slice))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
