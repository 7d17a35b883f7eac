"""Forests on streams: growing by micro-batch, and scoring a stream."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from copse.operators.forest import ForestModel


class OnlineForest:
    """Holds the newest model. Each micro-batch grows trees on all its rows; only the last most_trees trees stay, so the forest follows drift."""

    def __init__(self, model: ForestModel, *, trees_per_batch: int = 1, most_trees: int = 100, on_update: Callable[[ForestModel, int], None] | None = None):
        self.model, self.trees_per_batch, self.most_trees, self.on_update = model, trees_per_batch, most_trees, on_update
        self.last_batch = -1

    def update(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch. A batch that is sent again is skipped; batches of fewer than three rows grow nothing."""
        if batch_id <= self.last_batch:
            return
        self.last_batch = batch_id
        if len(batch.take(3)) < 3:
            return
        self.model = self.model.partial_fit(batch, trees=self.trees_per_batch).newest(self.most_trees)
        if self.on_update:
            self.on_update(self.model, batch_id)

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()


def score_stream(model: ForestModel, stream: DataFrame, into: str = "score") -> DataFrame:
    """The stream with a score column: stateless and narrow, so watermarks and windows compose with it."""
    return model.predict(stream, "score", into)
