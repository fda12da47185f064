"""New messages on a stream, by a state that holds a bounded number of keys for each mailbox."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ingest import NO_ID, with_hash
from ..rules import RECENT_HASHES
from ..schemas import KEY

_OUT = "mailbox string, source_folder string, uid long, hash string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RememberedKeys(StatefulProcessor):
    """State of one mailbox: its last ``keep`` keys in order of first sight, and the key and time of its newest message.

    A batch is judged against the state before it, so repeats within a batch pass, as in a batch run. A key that is seen
    again keeps its place. Messages with an unreadable date pass and are not remembered. Rows arrive in any order: until
    its end a batch holds the lowest uid of each new key of the mailbox, so a source should bound its batches.
    """

    def __init__(self, keep: int, null_id: str) -> None:
        self.keep, self.null_id = keep, null_id

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "hash string")
        self.mark = handle.getValueState("mark", "hash string, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        recent = [row[0] for row in self.recent.get()]
        mark = self.mark.get() if self.mark.exists() else None
        known = {*recent, *([mark[0]] if mark is not None else [])}
        if self.null_id == "keep":
            known.discard(NO_ID)
        held, first_uid, newest = set(recent), {}, None
        for frame in rows:
            fresh = frame[~frame["hash"].isin(known)]
            yield fresh[["mailbox", "source_folder", "uid", "hash"]]
            done = fresh[fresh["remembered"]]
            dated = done[done["at"].notna()]
            if len(dated):
                best = dated.sort_values(["at", "uid", "hash"], ascending=[False, True, False]).iloc[0]
                newest = max(filter(None, (newest, (int(best["at"]), -int(best["uid"]), best["hash"]))))
            for digest, uid in done[~done["hash"].isin(held)].groupby("hash")["uid"].min().items():
                first_uid[digest] = min(uid, first_uid.get(digest, uid))
        if first_uid:
            last = sorted(first_uid, key=lambda digest: (first_uid[digest], digest))
            self.recent.put([(digest,) for digest in [*recent, *last][-self.keep:]])
        if newest is not None and (mark is None or newest[0] > mark[1]):
            self.mark.update((newest[2], newest[0]))

    def close(self) -> None:
        pass


def remembered_stream(messages: DataFrame, keep: int = RECENT_HASHES, null_id: str = "drop") -> DataFrame:
    """Keys ``mailbox, source_folder, uid, hash`` of the messages of a stream that were not processed before.

    Batch by batch these are the rows that ``new_messages`` gives with the state that ``advance_state`` leaves, but the
    state lives in the stream's checkpoint: ``keep`` keys and one mark for each mailbox, whatever the stream's length. Only
    header columns go to the state; join bodies by key afterwards. Start it within ``list_state``.
    """
    undated = F.coalesce("date", F.lit("")) == ""
    rows = with_hash(messages).select(
        *KEY, "hash", F.unix_micros("received_at").alias("at"), (undated | F.col("received_at").isNotNull()).alias("remembered"))
    return rows.groupBy("mailbox").transformWithStateInPandas(
        statefulProcessor=RememberedKeys(keep, null_id), outputStructType=_OUT, outputMode="Append", timeMode="None")


@contextmanager
def list_state(spark: SparkSession):
    """Streams started inside use the state store that holds lists; others keep theirs."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)
