"""Session state by events (R6, C13, F11): ideas upserted, goals set, a profile kept, the last turns traced. One reducer for tables and streams.

Events: (session, seq, action, title, pitch, field, value, goals). Actions are save_idea, set_goals, update_profile; others are only traced.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# The goals of a session in their order; the first three count until others are set.
GOALS = ("Off the Grid", "Well-Tuned", "Off-Brand", "Llama Champion", "Sharing is Caring", "Field Notes")
TRACED, INPUT_CHARS = 12, 240
STATE = "session string, seq long, ideas array<struct<id:string,title:string,pitch:string,goals:array<string>>>, current string, goals array<string>, profile map<string,string>, trace array<struct<seq:bigint,action:string,input:string>>"


def fresh() -> dict:
    return {"ideas": {}, "current": None, "goals": None, "profile": {}, "trace": [], "seq": None}


def idea_id(session: str, seq: int) -> str:
    """A name for an idea that is the same in every run."""
    return hashlib.sha256(f"{session}:{seq}".encode()).hexdigest()[:8]


def is_another(idea: dict, title: str, pitch: str) -> bool:
    """F11."""
    return idea["title"].strip().casefold() != title.strip().casefold() or idea["pitch"].strip() != pitch.strip()


def wanted_goals(given) -> list[str]:
    """Known goals, each once, in the order given."""
    return list(dict.fromkeys(g for g in (given if given is not None else []) if g in GOALS))


def reduced(state: dict, session: str, event: dict) -> dict:
    """The state after an event. Events whose seq isn't above the last one's have been seen and change nothing."""
    if state["seq"] is not None and event["seq"] <= state["seq"]:
        return state
    state["seq"] = int(event["seq"])
    action, title, pitch = event["action"], event["title"] or "", event["pitch"] or ""
    goals = list(GOALS[:3]) if state["goals"] is None else state["goals"]
    current = state["ideas"].get(state["current"])
    if action == "save_idea":
        if current is None or is_another(current, title, pitch):
            state["current"] = idea_id(session, state["seq"])
        state["ideas"][state["current"]] = {"title": title, "pitch": pitch, "goals": goals}
    elif action == "set_goals":
        state["goals"] = wanted_goals(event["goals"])
        if current is not None:
            current["goals"] = state["goals"]
    elif action == "update_profile" and event["field"]:
        state["profile"][event["field"]] = event["value"] or ""
    shown = (pitch or event["value"] or "")[:INPUT_CHARS]
    state["trace"] = [*state["trace"], (state["seq"], action or "", shown)][-TRACED:]
    return state


def _row(session: str, state: dict) -> pd.DataFrame:
    ideas = [{"id": i, **x} for i, x in state["ideas"].items()]
    trace = [{"seq": s, "action": a, "input": i} for s, a, i in state["trace"]]
    goals = list(GOALS[:3]) if state["goals"] is None else state["goals"]
    return pd.DataFrame([[session, state["seq"], ideas, state["current"], goals, state["profile"], trace]], columns=["session", "seq", "ideas", "current", "goals", "profile", "trace"])


def _events(parts: Iterator[pd.DataFrame]) -> list[dict]:
    rows = pd.concat(list(parts)).sort_values("seq", kind="stable")
    return [{k: None if v is None or isinstance(v, float) and pd.isna(v) else v for k, v in r.items()} for r in rows.to_dict("records")]


class Sessions(StatefulProcessor):
    """Ideas and profile as map state, the trace as list state, the rest as one value, so that a turn of a long session
    reads and writes what it needs of each."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._ideas = handle.getMapState("ideas", "id string", "place int, idea string")
        self._profile = handle.getMapState("profile", "field string", "value string")
        self._trace = handle.getListState("trace", "seq long, action string, input string")
        self._rest = handle.getValueState("rest", "current string, goals string, seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = fresh()
        if self._rest.exists():
            current, goals, seq = self._rest.get()
            state |= {"current": current, "goals": None if goals is None else json.loads(goals), "seq": seq}
            kept = sorted((int(v[0]), k[0], v[1]) for k, v in self._ideas.iterator())
            state["ideas"] = {i: json.loads(x) for _, i, x in kept}
            state["profile"] = {k[0]: v[0] for k, v in self._profile.iterator()}
            state["trace"] = [(int(s), a, i) for s, a, i in self._trace.get()]
        before = {i: json.dumps(x) for i, x in state["ideas"].items()}
        for event in _events(rows):
            state = reduced(state, key[0], event)
        for place, (i, idea) in enumerate(state["ideas"].items()):
            if before.get(i) != json.dumps(idea):
                self._ideas.updateValue((i,), (place, json.dumps(idea)))
        for field, value in state["profile"].items():
            self._profile.updateValue((field,), (value,))
        self._trace.put(state["trace"])
        self._rest.update((state["current"], None if state["goals"] is None else json.dumps(state["goals"]), state["seq"]))
        yield _row(key[0], state)

    def close(self) -> None:
        pass


def session_states(events: DataFrame) -> DataFrame:
    """R6 over a table: the last state of each session."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        state = fresh()
        for event in _events(iter([rows])):
            state = reduced(state, key[0], event)
        return _row(key[0], state)

    return events.groupBy("session").applyInPandas(run, STATE)


def streamed_states(events: DataFrame) -> DataFrame:
    """R6 over a stream: after each trigger the new state of every session that had events. Needs the RocksDB state store."""
    return events.groupBy("session").transformWithStateInPandas(Sessions(), STATE, "Update", "None")
