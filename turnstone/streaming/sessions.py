"""Streams: session features, sentence segmentation and idle sessions as stateful processors, sliding rates, upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.udfs import split_sentences
from ..operators.trace import sliding_ratio
from ..session import ship_code

FEATURES = "session string, event_ts double, turn_count long, avg_user_utterance_s double, avg_response_ms double, last_intent string, accent_profile string"
_Features = Row(*[c.split()[0] for c in FEATURES.split(", ")])
_STATE = "turns long, heard long, heard_ms double, answered long, answered_ms double, intent string, accent string, ts double"


def _values(rows: Iterator[Row], *names: str) -> list[tuple]:
    """The named columns of a key's rows in a micro-batch."""
    got = list(rows)
    at = [got[0].__fields__.index(n) for n in names] if got else []
    return [tuple(r[i] for i in at) for r in got]


def _by_seq(row: tuple) -> tuple:
    """Orders by the first column, nulls last."""
    return row[0] is None, row[0]


def _there(x: float | None) -> bool:
    return x is not None and x == x


#: How long a session or reply lasts without news, by event time. None keeps it for good.
IDLE_MS = 24 * 3600 * 1000
#: How late a row may come, by event time. The engine drops late rows by the watermark of the batch before the last.
LATE = "10 minutes"


#: Partitions of a stream's state for each core. Each costs a task, a worker and a store's commit every micro-batch, even without rows.
STATE_PER_CORE = 2


def stateful(spark: SparkSession) -> SparkSession:
    """A session of the same application with the state store that stateful processors need; the given one stays as it is.

    Its state has as many partitions as the cores need: a task holds one key's rows at a
    time, whatever their number, so more of them would not make it smaller.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", STATE_PER_CORE * spark.sparkContext.defaultParallelism)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return own


class _Idle:
    """The event-time timer of a key: it stands at the last news plus the idle time."""

    def __init__(self, handle: StatefulProcessorHandle, idle_ms: int | None):
        self.handle, self.idle_ms = handle, idle_ms

    def move(self, before: float | None, now: float | None) -> None:
        """From the timer after ``before`` seconds to the one after ``now``."""
        if self.idle_ms is None or before == now:
            return
        if before is not None:
            self.handle.deleteTimer(self.at(before))
        if now is not None:
            self.handle.registerTimer(self.at(now))

    def at(self, ts: float) -> int:
        return int(ts * 1000) + self.idle_ms

    def over(self, last: float, ts: float) -> bool:
        return self.idle_ms is not None and ts * 1000 > last * 1000 + self.idle_ms


class SessionFold(StatefulProcessor):
    """Running sums of one session; a row each time a turn ends. Rows of a batch are folded in ``_seq`` order.

    A session without news for the idle time is over: its state goes when the watermark
    passes, and a row that comes later starts a new one, whether or not it had gone by then.
    """

    def __init__(self, idle_ms: int | None = IDLE_MS):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", _STATE)
        self.idle = _Idle(handle, self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        fresh = (0, 0, 0.0, 0, 0.0, None, None, 0.0)
        held = self.state.get()
        turns, heard, heard_ms, answered, answered_ms, intent, accent, ts = held or fresh
        before = ts if held else None
        out = []
        for _, event, at, ms, response_ms, said, spoken in sorted((tuple(v.values()) for v, in _values(rows, "row")), key=_by_seq):
            if _there(at):
                if ts and self.idle.over(ts, at):
                    turns, heard, heard_ms, answered, answered_ms, intent, accent, ts = fresh
                ts = max(ts, at)
            if event == "listen.end" and _there(ms):
                heard, heard_ms = heard + 1, heard_ms + ms
            elif event == "playback.end" and _there(response_ms):
                answered, answered_ms = answered + 1, answered_ms + response_ms
            elif event == "llm.end" and said is not None:
                intent = said
            elif event == "stt.end" and spoken is not None:
                accent = spoken
            elif event == "turn.end":
                turns += 1
                out.append(_Features(key[0], ts, turns, heard_ms / heard / 1000 if heard else None, answered_ms / answered if answered else None, intent, accent))
        self.state.update((turns, heard, heard_ms, answered, answered_ms, intent, accent, ts))
        self.idle.move(before, ts)
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def _timed(rows: DataFrame, idle_ms: int | None, late: str) -> tuple[DataFrame, str]:
    """Rows with a watermark on ``ts`` where state is to expire, and the time mode."""
    return (rows.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late), "EventTime") if idle_ms else (rows, "None")


def stream_session_features(trace: DataFrame, idle_ms: int | None = IDLE_MS, late: str = LATE) -> DataFrame:
    """The batch operator's twin over a stream of trace rows (session, event, ts, ms, response_ms, intent, accent, _seq).

    State is one row a session. With ``idle_ms``, time is event time: rows later than the
    watermark are dropped, and a session without news for that long is over (see ``SessionFold``).
    Rows of an earlier ``_seq`` that arrive in a later micro-batch are folded when they arrive.
    """
    rows = trace.where(F.col("session").isNotNull() & (F.col("session") != "") & F.col("event").isNotNull())
    # One value a row: Python takes each value of a row by itself, and a struct is one.
    rows = rows.select("session", "ts", F.struct(F.col("_seq").alias("seq"), "event", "ts", "ms", "response_ms", "intent", "accent").alias("row"))
    rows, mode = _timed(rows, idle_ms, late)
    return rows.drop("ts").groupBy("session").transformWithState(statefulProcessor=SessionFold(idle_ms), outputStructType=FEATURES, outputMode="Append", timeMode=mode)


SENTENCES = "session string, turn long, n long, sentence string"
_Sentence = Row(*[c.split()[0] for c in SENTENCES.split(", ")])


class TokenSegmenter(StatefulProcessor):
    """Sentences of a growing reply as soon as they are certain; the rest when its end arrives, or when it has been idle."""

    def __init__(self, idle_ms: int | None = IDLE_MS):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("reply", "text string, n long, ts double")
        self.idle = _Idle(handle, self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        text, n, before = self.state.get() or ("", 0, None)
        got = _values(rows, "seq", "token", "last", *(["ts"] if self.idle_ms else []))
        tokens = sorted((t for seqs, texts, *_ in got for t in zip(seqs, texts)), key=_by_seq)
        over = any(r[2] for r in got)
        now = max([r[3] for r in got if _there(r[3])] + ([] if before is None else [before]), default=None) if self.idle_ms else None
        found, rest = split_sentences((text or "") + "".join(t or "" for _, t in tokens), over)
        if not over:
            self.state.update((rest, n + len(found), now))
        elif before is not None or n or text:
            self.state.clear()
        self.idle.move(before, None if over else now)
        yield from self._rows(key, found, n)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        held = self.state.get()
        if held:
            text, n, _ = held
            self.state.clear()
            yield from self._rows(key, split_sentences(text or "", True)[0], n)

    @staticmethod
    def _rows(key, found: list[str], n: int) -> Iterator[Row]:
        yield from (_Sentence(*key, i, s) for i, s in enumerate(found, n))

    def close(self) -> None:
        pass


def pack_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens (keys, seq, token, last) of a batch as one row for equal keys: their seqs and tokens as lists, and whether one is the last."""
    for batch in batches:
        keys = [c for c in batch.schema.names if c not in ("seq", "token", "last")]
        packed = pa.Table.from_batches([batch]).group_by(keys, use_threads=False).aggregate([("seq", "list"), ("token", "list"), ("last", "any")])
        yield from packed.select([*keys, "seq_list", "token_list", "last_any"]).to_batches()


def _packed(tokens: DataFrame, keys: list[str]) -> DataFrame:
    ship_code(tokens.sparkSession)
    rows = tokens.select(*keys, F.col("_seq").cast("long").alias("seq"), "token", "last")
    lists = [T.StructField("seq", T.ArrayType(T.LongType())), T.StructField("token", T.ArrayType(T.StringType())), T.StructField("last", T.BooleanType())]
    return rows.mapInArrow(pack_tokens, T.StructType([*[rows.schema[k] for k in keys], *lists]))


def stream_segments(tokens: DataFrame, idle_ms: int | None = IDLE_MS, late: str = LATE) -> DataFrame:
    """(session, turn, n, sentence) of a stream of tokens (session, turn, _seq, token, last, and with ``idle_ms`` ts).

    A reply without news for ``idle_ms`` of event time is taken as it is: its rest is the last
    sentence. Tokens later than the watermark are dropped; later ones start a new reply.
    Tokens of a reply with the same ``ts`` that lie near each other travel as one row: to the
    watermark they are the same.
    """
    rows, mode = _timed(_packed(tokens, ["session", "turn", *(["ts"] if idle_ms else [])]), idle_ms, late)
    return rows.groupBy("session", "turn").transformWithState(statefulProcessor=TokenSegmenter(idle_ms), outputStructType=SENTENCES, outputMode="Append", timeMode=mode)


def stream_sliding_ratio(rows: DataFrame, ts: str, bad: Column, total: Column, window: str, slide: str, late: str = "10 minutes") -> DataFrame:
    """The sliding ratio with a watermark: rows that come later than ``late`` are dropped, and state goes with them."""
    return sliding_ratio(rows.withWatermark(ts, late), ts, bad, total, window, slide)


def idle_sessions(rows: DataFrame, ts: str, key: str = "session", idle: str = "1 hour", late: str | None = None) -> DataFrame:
    """(key, start, end, events): runs of events without a gap of ``idle``; batch or stream (then with a watermark)."""
    rows = rows.withWatermark(ts, late) if late else rows
    return rows.groupBy(key, F.session_window(ts, idle).alias("w")).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def upsert_parquet(path: str, key: str, order: str):
    """A foreachBatch function: last-write-wins upsert of a keyed table, kept as numbered versions so that readers never see half of one."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        if batch_id > 0:
            newest = spark.read.parquet(f"{path}/v{batch_id - 1}").join(newest.select(key), key, "left_anti").unionByName(newest)
        newest.write.mode("overwrite").parquet(f"{path}/v{batch_id}")

    return write
