"""Structured Streaming forms: chunk assembly with state, incremental profiles, windows over event time.

Each function takes a streaming DataFrame; ``run_available`` drives one over
what is there now, writing results and checkpoints to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from merloom.session import new_path

ASSEMBLED = "read_id long, mate int, name string, kind string, seq string, n_chunks int, complete boolean"
#: of each chunk at hand: number, time of reading (microseconds), whether it is the last, and its fields
_STATE = "done boolean, no array<int>, at array<bigint>, last array<boolean>, name array<string>, kind array<string>, seq array<string>"
_FIRST = -1  # number of a chunk without one: it stands before all others


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """New parquet files of a folder (or one file) as a stream."""
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"  # as a pattern, a single file is taken too
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(pattern)


def _assemble(keep_ms: int):
    """Chunks of one record, in any order and perhaps twice; the record goes out once the last chunk and all before it are there.

    State that has seen no chunk for ``keep_ms`` ends: that of a record that went
    out is forgotten, any other record goes out as it is, marked incomplete.
    """
    fields = ["no", "at", "last", "name", "kind", "seq"]

    def record(key: tuple, have: pd.DataFrame, complete: bool) -> pd.DataFrame:
        first = lambda c: next((x for x in have[c] if x is not None and not pd.isna(x)), None)
        mate = None if key[1] < 0 else key[1]
        return pd.DataFrame({"read_id": [key[0]], "mate": pd.array([mate], dtype="Int32"), "name": [first("name")], "kind": [first("kind")], "seq": ["".join(have["seq"])], "n_chunks": [len(have)], "complete": [complete]})

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, *held = state.get if state.exists else (False, *[[] for _ in fields])
        have = pd.DataFrame(dict(zip(fields, held)), dtype=object)
        if state.hasTimedOut:
            state.remove()
            if not done and len(have):
                yield record(key, have, False)
            return
        new = [p for p in pdfs if len(p)]
        if not done and new:
            x = pd.concat(new)
            x = pd.DataFrame(
                {
                    "no": x["chunk_no"].fillna(_FIRST).astype("int64"), "at": x["at"].fillna(0).astype("int64"), "last": x["finished"].eq(True), "name": x["name"], "kind": x["kind"],
                    "seq": x["seq"].fillna("").str.replace(r"\s+", "", regex=True),
                }
            )
            # of copies the one read last, and of these the one that came first
            have = pd.concat([have, x.astype(object)]).sort_values(["no", "at"], ascending=[True, False], kind="stable").drop_duplicates("no")
            ends = have["no"][have["last"].astype(bool)]
            if len(ends) and set(range(int(max(ends)) + 1)) <= set(have["no"]):
                yield record(key, have[have["no"] <= max(ends)], True)
                done, have = True, have.iloc[:0]
        whole = [[None if not isinstance(v, (str, bool)) and pd.isna(v) else v for v in have[c]] for c in fields]
        state.update((done, [int(v) for v in whole[0]], [int(v) for v in whole[1]], [bool(v) for v in whole[2]], *whole[3:]))
        state.setTimeoutDuration(keep_ms)

    return run


def assemble_stream(chunks: DataFrame, keep_ms: int = 3_600_000) -> DataFrame:
    """Whole records from a stream of chunks; state is kept per (read_id, mate) until ``keep_ms`` without a chunk."""
    at = F.unix_micros(F.col("read_at").cast("timestamp")).alias("at")
    keyed = chunks.withColumn("m", F.coalesce("mate", F.lit(-1))).select("read_id", "m", "chunk_no", "name", "kind", "seq", "finished", at)
    return keyed.groupBy("read_id", "m").applyInPandasWithState(_assemble(keep_ms), ASSEMBLED, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def event_windows(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums by type in tumbling windows; rows later than the watermark are dropped, windows come out once closed."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user: events no further apart than the gap."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return w.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


@contextmanager
def _only_new_data(spark: SparkSession) -> Iterator[None]:
    """A stream over what is there now must not go on to wait for timeouts: these end state of streams that run on."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    old = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, old)


def run_available(stream: DataFrame, mode: str = "append", stateful: bool = False) -> DataFrame:
    """Run a stream over all that is there and give what it wrote; ``stateful`` streams hold state with timeouts of their own."""
    spark = stream.sparkSession
    base = new_path(spark)
    with _only_new_data(spark) if stateful else nullcontext():
        q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/out")
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def run_batches(stream: DataFrame, partial: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Partial results of every micro-batch, written under the number of the batch, so that a batch run again replaces its own."""
    spark = stream.sparkSession
    base = new_path(spark)

    def one(df: DataFrame, batch: int) -> None:
        partial(df).write.mode("overwrite").parquet(f"{base}/out/batch={batch}")

    with _only_new_data(spark):
        q = stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("batch")
