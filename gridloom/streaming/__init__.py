"""Flagging of samples as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from gridloom.operators.rfi import Flagger


def flag_stream(samples: DataFrame, flagger: Flagger, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Runs the 1-D ``flagger`` on every micro-batch of a stream of LONG rows and hands flags to ``sink(flags, batch)``.

    A batch holds whole spectra: a source that splits one between batches has its halves flagged apart. Batches come in order;
    a batch that is run again after a failure has the same number, by which an idempotent sink knows it.
    """
    writer = samples.writeStream.foreachBatch(lambda df, n: sink(flagger(df), n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
