"""Training and scoring on Structured Streaming.

foreachBatch delivers at least once.  A batch trains a copy of the model; only when
its state is stored does the model take it over.  A batch that comes again, after a
failure at any point, starts from the state before it, so that replays change nothing.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from mixlode.plans.mixture import GradientMixture, MixtureState

log = logging.getLogger("mixlode.stream")


class StateStore:
    """The states after the last `keep` batches, as files in a folder that Spark can reach.

    A state is written under another name and then renamed, so that it is there as a
    whole or not at all.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 10) -> None:
        if keep < 2:
            raise ValueError("a replay needs the state before the last: keep at least 2")
        self.jvm, self.path, self.keep = spark._jvm, path.rstrip("/"), keep
        self.fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def batches(self) -> list[int]:
        """Stored batches, in order."""
        at = self._at(self.path)
        names = [f.getPath().getName() for f in self.fs.listStatus(at)] if self.fs.exists(at) else []
        return sorted(int(n[6:-5]) for n in names if n.startswith("batch-") and n.endswith(".json"))

    def read(self, batch_id: int) -> MixtureState:
        stream = self.fs.open(self._at(f"{self.path}/batch-{batch_id}.json"))
        try:
            return MixtureState.from_json(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def before(self, batch_id: int) -> MixtureState | None:
        """The latest state of an earlier batch."""
        earlier = [b for b in self.batches() if b < batch_id]
        return self.read(earlier[-1]) if earlier else None

    def write(self, batch_id: int, state: MixtureState) -> None:
        draft, final = self._at(f"{self.path}/_draft-{uuid.uuid4().hex}"), self._at(f"{self.path}/batch-{batch_id}.json")
        out = self.fs.create(draft, True)
        try:
            out.write(bytearray(state.to_json().encode()))
        finally:
            out.close()
        self.fs.delete(final, False)
        if not self.fs.rename(draft, final):
            raise OSError(f"the state of batch {batch_id} could not be stored")
        for old in [b for b in self.batches() if b <= batch_id][: -self.keep]:
            self.fs.delete(self._at(f"{self.path}/batch-{old}.json"), False)


class OnlineMixture:
    """A model that learns from, and scores, micro-batches."""

    def __init__(self, model: GradientMixture, state_path: str | None = None) -> None:
        self.model = model
        self.initial = model.state
        self.state_path = state_path
        self.last_batch = -1
        self._before = model.state  # of last_batch

    def _start(self, store: StateStore | None, batch_id: int) -> MixtureState:
        if batch_id == self.last_batch + 1:
            return self.model.state
        if batch_id == self.last_batch:
            return self._before
        return (store.before(batch_id) or self.initial) if store else self.model.state

    def train_batch(self, df: DataFrame, batch_id: int) -> None:
        """Ascends on one micro-batch; for foreachBatch."""
        store = StateStore(df.sparkSession, self.state_path) if self.state_path else None
        start = self._start(store, batch_id)
        trial = replace(self.model, state=start, history=[], trajectory=[])
        trial.step(df)
        if store:
            store.write(batch_id, trial.state)
        self.model.state, self._before = trial.state, start
        if batch_id != self.last_batch:  # a replay is in the history already
            offset = len(self.model.history)
            self.model.history += [(offset + i, *rest) for i, *rest in trial.history]
            self.model.trajectory += trial.trajectory
        self.last_batch = batch_id

    def train(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Starts training on a stream."""
        return stream.writeStream.foreachBatch(self.train_batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def score(self, stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, soft: bool = False, **trigger) -> StreamingQuery:
        """Scores each micro-batch with the parameters current when it runs."""

        def batch(df: DataFrame, batch_id: int) -> None:
            sink(self.model.predict_soft(df) if soft else self.model.predict(df), batch_id)

        return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class ProgressLog(StreamingQueryListener):
    """Logs each micro-batch of the session's streams; add it by spark.streams.addListener."""

    def onQueryStarted(self, event) -> None:
        log.info("stream %s started", event.id)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        log.info("stream %s, batch %d: %d rows", p.id, p.batchId, p.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        log.info("stream %s ended%s", event.id, f": {event.exception}" if event.exception else "")
