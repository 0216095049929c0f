"""The fold as a stream: by micro-batches into a snapshot store, or by keyed state.

Both take rows that may arrive in any order and any number of times: the higher (lsn, seq) wins.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidemark.sources.store import SnapshotStore


def into_store(events: DataFrame, store: SnapshotStore, checkpoint: str, consumer: str = "stream", **options) -> StreamingQuery:
    """Applies each micro-batch of an event stream; the checkpoint keeps offsets, and a batch that the
    ledger has already is skipped, so a restart neither drops nor repeats records.

    Rows of a micro-batch have no arrival order; seq stands in for it.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        if batch_id + 1 > store.last_batch(consumer):
            store.apply_batch(batch.withColumn("arrival", F.col("seq")), batch_id + 1, consumer=consumer, **options)

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Fold(StatefulProcessor):
    """Per record key: of each slot the highest position, whether it is deleted, and its row."""

    def __init__(self, slot: list[str], columns: list[str]):
        self.slot, self.columns = slot, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getMapState("rows", "slot string", "lsn long, seq long, deleted boolean, row string")
        self.marks = handle.getValueState("mark", "lsn long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        import json

        touched = set()
        mark = before = self.marks.get()[0] if self.marks.exists() else None
        for frame in rows:
            for r in frame.sort_values("seq").to_dict("records"):
                if r["tombstone"]:
                    mark = r["lsn"] if mark is None else max(mark, r["lsn"])
                    continue
                slot = json.dumps([str(r[c]) for c in self.slot])
                held = self.rows.getValue((slot,)) if self.rows.containsKey((slot,)) else None
                if held is None or (r["lsn"], r["seq"]) > (held[0], held[1]):
                    self.rows.updateValue((slot,), (int(r["lsn"]), int(r["seq"]), r["op"] == "d", json.dumps({c: None if pd.isna(r[c]) else str(r[c]) for c in self.columns})))
                    touched.add(slot)
        if mark != before:
            self.marks.update((int(mark),))
            # rows that the tombstone has reached now and hadn't before
            touched.update(s for (s,), (lsn, _, deleted, _) in self.rows.iterator() if not deleted and lsn <= mark and (before is None or lsn > before))
        out = []
        for slot in sorted(touched):
            lsn, _, deleted, row = self.rows.getValue((slot,))
            out.append({"record_key": key[0], "slot": slot, "lsn": lsn, "deleted": bool(deleted or (mark is not None and mark >= lsn)), "row": row})
        yield pd.DataFrame(out, columns=["record_key", "slot", "lsn", "deleted", "row"])

    def close(self) -> None:
        pass


def keyed_state(events: DataFrame, slot: list[str], columns: list[str]) -> DataFrame:
    """An update stream of (record_key, slot, lsn, deleted, row as JSON text), by the arrival-independent rule:
    the slots that a trigger's rows have changed.

    State is keyed by record key, so that tombstones meet all rows they cover; it never expires, because
    a position must outlive its row. Needs the RocksDB state store.
    """
    return events.groupBy("record_key").transformWithStateInPandas(_Fold(slot, columns), "record_key string, slot string, lsn long, deleted boolean, row string", "Update", "None")
