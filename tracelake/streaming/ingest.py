"""Streams of traces into the incremental sink, and lines out of chunked text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.ordered import running
from ..sources.sinks import append_batch
from .segments import CHUNKS

MAX_LINE = 256


def append_stream(traces: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Every micro-batch through the idempotent append; a batch that is run again after a failure writes nothing twice."""
    return traces.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: append_batch(df, path) and None).trigger(availableNow=True).start()


def split_lines(buffer: str, skipping: bool, most: int = MAX_LINE) -> tuple[list[str], str, bool]:
    """Whole lines, what is left, and whether an overlong line is still being skipped up to its end."""
    *whole, left = buffer.split("\n")
    out = []
    for x in whole:
        x = x.rstrip("\r")
        if not skipping and 0 < len(x) <= most:
            out.append(x)
        skipping = False
    return (out, "", True) if skipping or len(left.rstrip("\r")) > most else (out, left, False)


def lines(chunks: DataFrame, most: int = MAX_LINE) -> DataFrame:
    """``chunks(stream, seq, text)`` to ``(stream, n, line)``: each stream in order, overlong lines dropped whole, empty ones left out.

    A line's number among the ends of lines is known from counts alone, so chunks are split where they lie. Only what a
    chunk begins and ends with is put together with its neighbours, and of that only what fits a line is gathered, however long the rest is. Rows without a stream are left out.
    """
    parts = F.split(F.coalesce("text", F.lit("")), "\n")
    df = chunks.where("stream is not null").select("stream", "seq", parts.alias("parts"), F.char_length(F.coalesce("text", F.lit(""))).alias("chars"))
    df = running(df, ["stream"], ["seq"], CHUNKS, {"ends": F.size("parts") - 1, "start": F.col("chars")})
    bare = lambda c: F.rtrim(c, F.lit("\r"))
    fits = lambda n: (n > 0) & (n <= most)
    inner = df.select("stream", "ends", F.posexplode(F.slice("parts", 2, F.greatest(F.lit(0), F.size("parts") - 2))).alias("k", "line"))
    whole = inner.select("stream", (F.col("ends") + F.col("k") + 1).alias("at"), bare(F.col("line")).alias("line")).where(fits(F.char_length("line")))
    first, last = F.get("parts", F.lit(0)), F.element_at("parts", -1)
    edge = lambda at, text, start, closed: F.struct(at.alias("at"), text.alias("text"), start.alias("start"), closed.alias("closed"))
    both = F.array_compact(F.array(edge(F.col("ends"), first, F.col("start"), F.size("parts") > 1), F.when(F.size("parts") > 1, edge(F.col("ends") + F.size("parts") - 1, last, F.col("start") + F.col("chars") - F.char_length(last), F.lit(False)))))
    edges = df.select("stream", "seq", F.explode(both).alias("e")).select("stream", "seq", "e.*")
    stop = F.when(F.char_length(bare(F.col("text"))) > 0, F.col("start") + F.char_length(bare(F.col("text"))))
    size = edges.groupBy("stream", "at").agg(F.min("start").alias("from"), F.max(stop).alias("to"), F.bool_or("closed").alias("closed"))
    size = size.where(F.col("closed") & fits(F.col("to") - F.col("from"))).drop("closed")
    pieces = edges.where("text <> ''").join(size, ["stream", "at"]).where("start < to")
    met = pieces.groupBy("stream", "at").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("p"))
    met = met.select("stream", "at", bare(F.array_join(F.transform("p", lambda x: x["text"]), "")).alias("line"))
    return running(whole.unionByName(met), ["stream"], ["at"], CHUNKS, {"n": F.lit(1)}).select("stream", "n", "line")


def lines_stream(chunks: DataFrame, most: int = MAX_LINE) -> DataFrame:
    """The same for a stream; the state is what is left of the last chunk."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        left, skipping, n = state.get if state.exists else ("", False, 0)
        got, left, skipping = split_lines(left + "".join(pd.concat(list(pdfs)).sort_values("seq")["text"]), skipping, most)
        state.update((left, skipping, n + len(got)))
        yield pd.DataFrame({"stream": key[0], "n": range(n, n + len(got)), "line": pd.Series(got, dtype=object)})

    return chunks.groupBy("stream").applyInPandasWithState(run, "stream long, n long, line string", "left string, skipping boolean, n long", "append", GroupStateTimeout.NoTimeout)
