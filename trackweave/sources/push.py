"""Messages to subscribers from the executors: a Python data source to write to, with one channel a session, in order of frames.

``open_channel(session_id)`` gives what takes a payload, or None where nobody listens; it runs on the executors and goes there with the write's
options. Failures are logged where they happen, and the session's next message is tried again. A task that is repeated sends its messages again: they carry their frame, by which clients
skip what they have. The driver hears counts only.
"""

from __future__ import annotations

import base64
import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

log = logging.getLogger(__name__)

Channel = Callable[[str], None]
ORDER = ("session_id", "frame_index")


@dataclass
class Sent(WriterCommitMessage):
    sent: int
    failed: int
    unheard: int


class _Push:
    def __init__(self, options: dict, columns: list[str]):
        self.opener, self.columns = options["channels"], columns

    def write(self, rows: Iterator) -> Sent:
        """Sends a task's rows; those of a session stand together, in order, if the rows were dealt by ``arranged``."""
        open_channel = cloudpickle.loads(base64.b64decode(self.opener))
        session, channel, counts = None, None, Sent(0, 0, 0)
        at, what = self.columns.index("session_id"), self.columns.index("payload")
        for row in rows:
            if session is None or row[at] != session:
                self._close(channel)
                session, channel = row[at], open_channel(row[at])
            if channel is None:
                counts.unheard += 1
                continue
            try:
                channel(row[what])
                counts.sent += 1
            except Exception:  # noqa: BLE001
                counts.failed += 1
                log.warning("a message of session %s was not sent", session, exc_info=True)
        self._close(channel)
        return counts

    @staticmethod
    def _close(channel: Channel | None) -> None:
        if (close := getattr(channel, "close", None)) is not None:
            close()

    def _told(self, messages: list[Sent | None]) -> None:
        known = [m for m in messages if m is not None]
        log.info("messages: %d sent, %d failed, %d without a subscriber", *[sum(getattr(m, n) for m in known) for n in ("sent", "failed", "unheard")])


class PushWriter(_Push, DataSourceWriter):
    def commit(self, messages: list[Sent | None]) -> None:
        self._told(messages)


class PushStreamWriter(_Push, DataSourceStreamWriter):
    def commit(self, messages: list[Sent | None], batchId: int) -> None:
        self._told(messages)

    def abort(self, messages: list[Sent | None], batchId: int) -> None:
        self._told(messages)


class PushSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "session_push"

    def writer(self, schema, overwrite: bool) -> PushWriter:
        return PushWriter(self.options, schema.names)

    def streamWriter(self, schema, overwrite: bool) -> PushStreamWriter:
        return PushStreamWriter(self.options, schema.names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PushSource)


def options(open_channel: Callable[[str], Channel | None]) -> dict[str, str]:
    """The options of a write to the data source."""
    return {"channels": base64.b64encode(cloudpickle.dumps(open_channel)).decode()}


def arranged(messages: DataFrame) -> DataFrame:
    """A session's messages in one task, in order of frames."""
    return messages.repartition("session_id").sortWithinPartitions(*[c for c in ORDER if c in messages.columns])


def push(messages: DataFrame, open_channel: Callable[[str], Channel | None]) -> None:
    """Sends messages (session_id, payload, in order of frame_index where they have it) to their sessions' subscribers."""
    register(messages.sparkSession)
    arranged(messages).write.format("session_push").options(**options(open_channel)).mode("append").save()


def push_batches(open_channel: Callable[[str], Channel | None]) -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: each batch is arranged, so that a session's messages are in order. ``writeStream.format("session_push")`` takes rows as they come."""
    return lambda batch, _: push(batch, open_channel)
