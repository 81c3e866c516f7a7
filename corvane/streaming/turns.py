"""Turn events: incremental profiles and the splitter of streamed text (R1-R4, A22), for batch and streaming tables alike."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLOSE = "</think>"


def profile(events: DataFrame, turn: str = "turn_id", watermark: str | None = None) -> DataFrame:
    """For each turn its first and last time, events, most tokens, tool events, and whether it fell back."""
    if watermark:
        events = events.withWatermark("ts", watermark)
    return events.groupBy(turn).agg(
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.count(F.lit(1)).alias("events"),
        F.max("tokens").alias("tokens"),
        F.count_if(F.col("type") == "tool_event").alias("tools"),
        F.coalesce(F.bool_or(F.col("type") == "fallback"), F.lit(False)).alias("fell_back"),
    )


# The phases of a turn in their order, by type of event and stage.
PHASES = (("start", None), ("stage", "planning"), ("model_progress", None), ("stage", "running_tool"), ("tool_event", None), ("stage", "writing"), ("token", None), ("done", None))


def stages(events: DataFrame, turn: str = "turn_id", watermark: str | None = None) -> DataFrame:
    """For each turn (turn, started, ended, at, total_ms, decode_ms, tools_ms, write_ms, tokens, tools, fell_back, in_order).

    at: a map of stages to when each first came; a duration is null where one of its ends is. A turn without `done` ends with its
    last event. in_order: no event of a phase has a number (seq) below one of an earlier phase. Every part is the least, most or
    number of something, so that a stream keeps one small row a turn, whatever the order in which events arrive."""
    if watermark:
        events = events.withWatermark("ts", watermark)
    is_type = lambda name: F.col("type") == name
    named = {s: F.min(F.when(is_type("stage") & (F.col("stage") == s), F.col("ts"))) for _, s in PHASES if s}
    ends = []
    for i, (kind, stage) in enumerate(PHASES):
        own = F.when(is_type(kind) & (F.col("stage") == stage if stage else F.lit(True)), F.col("seq"))
        ends += [F.min(own).alias(f"__first{i}"), F.max(own).alias(f"__last{i}")]
    found = events.groupBy(turn).agg(
        F.min("ts").alias("started"),
        F.coalesce(F.min(F.when(is_type("done"), F.col("ts"))), F.max("ts")).alias("ended"),
        F.map_filter(F.create_map(*[x for s, first in named.items() for x in (F.lit(s), first)]), lambda _, v: v.isNotNull()).alias("at"),
        F.max(F.when(is_type("model_progress"), F.col("tokens"))).alias("tokens"),
        F.count_if(is_type("tool_event")).alias("tools"),
        F.coalesce(F.bool_or(is_type("fallback")), F.lit(False)).alias("fell_back"),
        *ends,
    )
    ordered = F.lit(True)
    for i in range(1, len(PHASES)):
        before = F.greatest(*[F.col(f"__last{k}") for k in range(i)], F.lit(None).cast("long"))
        ordered = ordered & F.coalesce(F.col(f"__first{i}") >= before, F.lit(True))
    ms = lambda a, b: (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 1000
    at = lambda s: F.try_element_at("at", F.lit(s))
    durations = {"total_ms": ms(F.col("started"), F.col("ended")), "decode_ms": ms(at("planning"), at("running_tool")), "tools_ms": ms(at("running_tool"), at("writing")), "write_ms": ms(at("writing"), F.col("ended"))}
    return found.select(turn, "started", "ended", "at", *[F.round(d, 1).alias(n) for n, d in durations.items()], "tokens", "tools", "fell_back", ordered.alias("in_order"))


def tumbling(events: DataFrame, width: str, by: str, value: str, watermark: str | None = None) -> DataFrame:
    """Counts and sums by window of event time; late rows beyond the watermark are dropped when streaming."""
    if watermark:
        events = events.withWatermark("ts", watermark)
    sums = events.groupBy(F.window("ts", width), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return sums.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), by, "n", "total")


def sessions(events: DataFrame, gap: str, by: str, watermark: str | None = None) -> DataFrame:
    """Runs of a key's events with no pause of `gap` or longer."""
    if watermark:
        events = events.withWatermark("ts", watermark)
    return events.groupBy(F.session_window("ts", gap), by).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def feed(text: str, held: str, thinking: bool) -> tuple[list[tuple[str, str]], str, bool]:
    """R3, one step: (pieces as (kind, text), what is held back, whether still thinking). Text is thought up to the closing mark,
    and the answer behind it, without line feeds right after the mark. The mark may straddle chunks, so an end of a thought
    that could begin it is held back, of 7 characters at most."""
    if not thinking:
        return [("answer", text)] if text else [], "", False
    thought, mark, rest = (held + text).partition(CLOSE)
    if mark:
        held, pieces = "", [("thinking", thought), ("answer", rest.lstrip("\n"))]
    else:
        held = next((CLOSE[:k] for k in range(len(CLOSE) - 1, 0, -1) if thought.endswith(CLOSE[:k])), "")
        pieces = [("thinking", thought.removesuffix(held))]
    return [p for p in pieces if p[1]], held, not mark


def finish(held: str, thinking: bool) -> list[tuple[str, str]]:
    """What is held back when the stream ends within a thought."""
    return [("thinking", held)] if thinking and held else []


def split_thinking(chunks: DataFrame, key: str = "turn_id", order: str = "seq", text: str = "text", final: str = "final", active: bool = True) -> DataFrame:
    """(key, seq, kind, text) of streamed chunks; state is what is held back of each key, and goes with its final chunk.
    `active`: whether a turn begins with a thought.

    For a streaming table; a key's chunks of one trigger are put in order first.
    """
    from pyspark.sql.streaming.state import GroupState

    def step(group_key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, thinking = state.get if state.exists else ("", active)
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")
        out = []
        done = False
        for seq, chunk, last in zip(rows[order], rows[text], rows[final], strict=True):
            pieces, held, thinking = feed(chunk or "", held, thinking)
            if last:
                pieces += finish(held, thinking)
                held, thinking, done = "", active, True
            out += [(*group_key, int(seq), k, t) for k, t in pieces]
        if done:
            state.remove()
        else:
            state.update((held, thinking))
        yield pd.DataFrame(out, columns=[key, order, "kind", "text"])

    return chunks.groupBy(key).applyInPandasWithState(step, f"{key} string, {order} long, kind string, text string", "held string, thinking boolean", "append", "NoTimeout")
