"""Structured Streaming forms: deduplication against all history, running counters, label state, ratings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.keys import summary_key
from ..operators.dedup import dense_ids
from ..operators.ranking import Elo
from ..shipping import by_value
from ..storage import exists, round_table, scratch


def unique_topics(stream: DataFrame, summary: str, watermark: tuple[str, str] | None = None) -> DataFrame:
    """The first row of each key. Without a watermark the state keeps all keys, as the batch operator's history does."""
    keyed = stream.withColumn("key", summary_key(F.col(summary)))
    if watermark:
        return keyed.withWatermark(*watermark).dropDuplicatesWithinWatermark(["key"])
    return keyed.dropDuplicates(["key"])


#: The state store that processors of keyed state need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstOfKey(StatefulProcessor):
    """Gives a key's first row, and remembers that it was there."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "pos bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = min(int(pdf["pos"].min()) for pdf in rows)
        if not self.seen.exists():
            self.seen.update((first,))
            yield pd.DataFrame({"key": [key[0]], "pos": [first]})

    def close(self) -> None:
        pass


def _least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.groupby("key", as_index=False)["pos"].min()


def numbered_heads(stream: DataFrame, summary: str, pos: str, path: str, checkpoint: str):
    """Appends key, pos, cluster_idx of each new key to the table at path, by micro-batches; needs the RocksDB state store.

    The state says which keys were there before; tasks send it a key's least pos once a batch of rows, so a frequent key is no
    more work than others. New keys are numbered in order of pos after those of the batches before, whose number is
    read from the table, so numbers are those of the batch operator where rows arrive in order. A batch that is
    repeated after a failure overwrites its own folder. Rows without a key are left out: they are never merged.
    """
    keyed = stream.select(summary_key(F.col(summary)).alias("key"), F.col(pos).cast("long").alias("pos")).where("key <> ''")
    heads = keyed.mapInPandas(_least, "key string, pos bigint").groupBy("key").transformWithStateInPandas(FirstOfKey(), "key string, pos bigint", "append", "none")

    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        known = spark.read.schema("key string, pos bigint, cluster_idx bigint, epoch bigint").parquet(path).where(F.col("epoch") < epoch).count() if exists(spark, path) else 0
        with scratch(spark):
            # The state moves on when it is read, so what it gave is written before it is read twice.
            new = round_table(batch, "heads")
            rows = dense_ids(new, "pos", known).select("key", "pos", F.col("id").alias("cluster_idx"), F.lit(epoch).cast("long").alias("epoch"))
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(path)

    heads.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return heads.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def running_counts(stream: DataFrame, *by: str) -> DataFrame:
    """by, n_all, n_deduped, n_refused so far; for update mode."""
    head = F.coalesce("is_head", F.lit(False))
    return stream.groupBy(*by).agg(F.count("*").alias("n_all"), F.sum(head.cast("long")).alias("n_deduped"), F.sum((head & F.coalesce("is_refusal", F.lit(False))).cast("long")).alias("n_refused"))


def event_counts(stream: DataFrame, ts: str, late: str, window: str, *by: str) -> DataFrame:
    """Counts in event-time windows, closed once `late` has passed."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window), *by).agg(F.count("*").alias("n"))


def append_table(stream: DataFrame, path: str, checkpoint: str):
    """Appends each micro-batch to a table once: a batch that is repeated after a failure overwrites its own folder."""

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(path)

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def feedback(stream: DataFrame, path: str, step: Callable[[DataFrame, DataFrame | None], DataFrame], checkpoint: str):
    """A loop whose state grows without end: step(batch, known) gives the rows that a micro-batch adds to the table at path.

    known is the table before the batch (None at first). A batch that is repeated after a failure sees the rows of earlier
    batches only, and overwrites its own.
    """

    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        there = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
        known = spark.read.parquet(path).where(F.col("epoch") < epoch).drop("epoch") if there else None
        rows = step(batch, known).withColumn("epoch", F.lit(epoch))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(path)

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).start()


class CurrentLabel(StatefulProcessor):
    """Keeps the label with the largest seq of each topic."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("label", "seq bigint, cluster string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seq, cluster = self.state.get() if self.state.exists() else (-1, None)
        for pdf in rows:
            for s, c in zip(pdf["seq"], pdf["cluster"]):
                if s > seq:
                    seq, cluster = int(s), c
        self.state.update((seq, cluster))
        yield pd.DataFrame({"topic_id": [key[0]], "seq": [seq], "cluster": [cluster]})

    def close(self) -> None:
        pass


def current_labels(stream: DataFrame) -> DataFrame:
    """topic_id, seq, cluster after each micro-batch. Needs the RocksDB state store."""
    return stream.groupBy("topic_id").transformWithStateInPandas(CurrentLabel(), "topic_id bigint, seq bigint, cluster string", "update", "none")


class EloState(StatefulProcessor):
    """Ratings of one system, updated by each comparison in order of seq within a micro-batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ratings = handle.getMapState("ratings", "topic string", "rating double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        games = pd.concat(list(rows)).sort_values("seq")
        system = Elo()
        for t in {*games["winner"], *games["loser"]}:
            system.rating[t] = self.ratings.getValue((t,))[0] if self.ratings.containsKey((t,)) else system.initial
        for w, lo in zip(games["winner"], games["loser"]):
            system.update(w, lo)
        for t, r in system.rating.items():
            self.ratings.updateValue((t,), (r,))
        yield pd.DataFrame([(key[0], t, r) for t, r in sorted(system.rating.items())], columns=["system", "topic", "rating"])

    def close(self) -> None:
        pass


def elo_ratings(stream: DataFrame) -> DataFrame:
    """system, topic, rating of the topics of each micro-batch."""
    return stream.groupBy("system").transformWithStateInPandas(EloState(), "system string, topic string, rating double", "update", "none")


by_value(__name__)
