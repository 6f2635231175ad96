"""Stateful operators on live streams of frames: regions, detokenizing, translation, keyframe deltas.

Input rows are frames (stream_id, frame_seq, ids, done, finish_reason); state is
kept by stream and dropped when the stream is done.  A stream that falls silent
is closed by a timer, if a timeout is given.  Frames of one micro-batch are put
into order; a frame that comes after a later one of an earlier batch is taken as
it comes, as the order of bytes is all there is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillwork.operators.tokenize import Detokenizer, Encoder, Vocabulary, safe_prefix


class Framed(StatefulProcessor):
    """Common part: order, end of stream, timeout."""

    STATE: str
    COLUMNS: list[str]

    def __init__(self, timeout_ms: int | None = None) -> None:
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.STATE)

    def close(self) -> None:
        pass

    def step(self, state: tuple | None, ids: list[int], done: bool, reason: str | None) -> tuple[tuple, list[tuple]]:
        """(new state, rows without the stream's id) of one frame."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        frames = pd.concat(list(rows)).sort_values("frame_seq", kind="stable")
        state = self.state.get() if self.state.exists() else None
        out, over = [], False
        for f in frames.itertuples(index=False):
            state, made = self.step(state, [int(i) for i in f.ids], bool(f.done), f.finish_reason if isinstance(f.finish_reason, str) else None)
            out += [(key[0], *m) for m in made]
            if f.done:
                over = True
                break
        if over:
            self.state.clear()
        else:
            self.state.update(state)
            if self.timeout_ms is not None:
                for at in list(self.handle.listTimers()):
                    self.handle.deleteTimer(at if isinstance(at, int) else at[0])
                self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.timeout_ms)
        yield pd.DataFrame(out, columns=["stream_id", *self.COLUMNS])

    def handleExpiredTimer(self, key, timer_values, expired) -> Iterator[pd.DataFrame]:
        out = []
        if self.state.exists():
            _, made = self.step(self.state.get(), [], True, "timeout")
            out = [(key[0], *m) for m in made]
            self.state.clear()
        yield pd.DataFrame(out, columns=["stream_id", *self.COLUMNS])


class Regions(Framed):
    """Events of delimited regions; the body kept is at most the cap."""

    STATE, COLUMNS = "inside boolean, capped boolean, body array<bigint>", ["kind", "ids", "finish_reason"]
    OUTPUT = "stream_id bigint, kind string, ids array<bigint>, finish_reason string"

    def __init__(self, start: int, end: int, cap: int = 65536, timeout_ms: int | None = None) -> None:
        super().__init__(timeout_ms)
        self.start_id, self.end_id, self.cap = start, end, cap

    def step(self, state, ids, done, reason):
        inside, capped, body = state or (False, False, [])
        body, run, out = [int(i) for i in body], [], []

        def passed() -> None:
            nonlocal run
            if run:
                out.append(("passthrough", run, None))
            run = []

        for i in ids:
            if not inside and i == self.start_id:
                passed()
                inside, capped, body = True, False, []
            elif not inside:
                run.append(i)
            elif i == self.end_id:
                if not capped:
                    out.append(("region", body, None))
                inside, capped, body = False, False, []
            elif i == self.start_id:
                out.append(("nested_start", [i], None))
            elif len(body) < self.cap:
                body.append(i)
            elif not capped:
                out.append(("overflow", list(body), None))
                capped = True
        passed()
        if done and inside:
            out.append(("truncated", body, reason))
        return (inside, capped, body), out


class Detokenized(Framed):
    """Text of each frame; an unfinished character waits for the next."""

    STATE, COLUMNS = "pending binary", ["text"]
    OUTPUT = "stream_id bigint, text string"

    def __init__(self, vocabulary: Vocabulary, timeout_ms: int | None = None) -> None:
        super().__init__(timeout_ms)
        self.vocabulary = vocabulary

    def init(self, handle):
        super().init(handle)
        self.render = Detokenizer(self.vocabulary)

    def step(self, state, ids, done, reason):
        self.render.pending = bytearray(bytes(state[0]) if state else b"")
        text = self.render.render(ids, partial=not done)
        return (bytes(self.render.pending),), [(text,)] if text else []


class Translated(Framed):
    """Ids in another vocabulary; text after the last white space waits, as later text may change its pieces."""

    STATE, COLUMNS = "pending binary, text string", ["ids"]
    OUTPUT = "stream_id bigint, ids array<bigint>"

    def __init__(self, source: Vocabulary, target: Vocabulary, encode, timeout_ms: int | None = None) -> None:
        """encode(text, encoder) -> ids; the driver's pre-tokenizer runs in columns, so a plain function is passed here."""
        super().__init__(timeout_ms)
        self.source, self.target, self.encode = source, target, encode

    def init(self, handle):
        super().init(handle)
        self.render, self.encoder = Detokenizer(self.source), Encoder(self.target)

    def step(self, state, ids, done, reason):
        pending, text = (bytes(state[0]), state[1]) if state else (b"", "")
        self.render.pending = bytearray(pending)
        text += self.render.render(ids, partial=not done)
        cut = len(text) if done else safe_prefix(text)
        made = self.encode(text[:cut], self.encoder) if cut else []
        return (bytes(self.render.pending), text[cut:]), [(made,)] if made else []


class Keyframes(Framed):
    """Quantized tensors rebuilt from residuals against the last keyframe; ids hold the residual, done frames with reason 'key' are keyframes."""

    STATE, COLUMNS = "q array<bigint>", ["q"]
    OUTPUT = "stream_id bigint, q array<bigint>"

    def __init__(self, top: int = 127, timeout_ms: int | None = None) -> None:
        super().__init__(timeout_ms)
        self.top = top

    def step(self, state, ids, done, reason):
        if not ids:
            return state or ([],), []
        if reason == "key" or state is None:
            return (ids,), [(ids,)]
        key = [int(q) for q in state[0]]
        return (key,), [([max(-self.top, min(self.top, q + d)) for q, d in zip(key, ids, strict=True)],)]


def run(frames: DataFrame, processor: Framed) -> DataFrame:
    """A processor over a streaming DataFrame of frames.  Needs the RocksDB state store."""
    mode = "ProcessingTime" if processor.timeout_ms is not None else "None"
    return frames.groupBy("stream_id").transformWithStateInPandas(processor, outputStructType=processor.OUTPUT, outputMode="Append", timeMode=mode)


ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
