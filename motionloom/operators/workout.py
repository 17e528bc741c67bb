"""The workout policy, the notification clock and the live normaliser on arrays of rows.

Each takes what earlier rows left behind (a small JSON-able state) and a stretch of rows as arrays, and looks for the runs
that decide: a batch episode is one stretch, a micro-batch of a stream another. How rows are cut into
stretches never changes the result.
"""

from __future__ import annotations

import hashlib

import numpy as np

from ..functions.taxonomy import CARDIO

# fixed policy values
START, CONTINUE = 0.65, 0.45
GENERAL_HOLD, STRENGTH_HOLD, END_HOLD, MIN_SET, TIMEOUT = 30.0, 3.0, 20.0, 5.0, 240.0
WORKOUT_EVENT = ["type", "session_id", "timestamp", "action", "start_timestamp", "end_timestamp", "duration_seconds", "confidence", "sets"]
NUDGE, STALL = 1e-6, 0.25
PERIODS = (1 / 5000, 0.1)


def run_starts(t: np.ndarray, run: np.ndarray, carried: float | None) -> np.ndarray:
    """Time at which the run of each row began; the first row's run began at ``carried`` if that is given."""
    new = np.ones(len(run), bool)
    new[1:] = run[1:] != run[:-1]
    began = t[np.maximum.accumulate(np.where(new, np.arange(len(run)), 0))]
    if carried is not None and len(run):
        began[: np.argmax(new[1:]) + 1 if new[1:].any() else len(run)] = carried
    return began


class Workout:
    """Events of one device's probability rows: classes in columns, some of them strength exercises."""

    def __init__(self, classes: list[str], strength: list[str] | set[str], device: str = "", state: dict | None = None):
        self.classes, self.device = classes, device
        self.strength = np.array([c in strength for c in classes])
        self.state = state or {"candidate": None, "action": None, "rested": None, "session": None}
        self.events: list[tuple] = []

    def _say(self, kind: str, at: float, **more) -> None:
        session = self.state["session"]
        values = {"type": kind, "session_id": session["id"], "timestamp": at, **more}
        self.events.append(tuple(values.get(c) for c in WORKOUT_EVENT))

    def _kind(self, a: int) -> str:
        return "cardio" if self.classes[a] in CARDIO else "set" if self.strength[a] else "activity"

    def advance(self, t: np.ndarray, p: np.ndarray, poor: np.ndarray) -> list[tuple]:
        """Events of the next rows, in order of time."""
        self.events, i = [], 0
        if p.shape[1]:
            usable = ~poor
            best = p.argmax(1)
            top, motion = p.max(1, initial=0.0) * usable, np.minimum(1.0, p.sum(1)) * usable
            strong = self.strength[best] & (top >= START)
            level = np.where(strong, top, motion)
            label = np.where(level < START, -1, np.where(strong, best, len(self.classes)))
            while i < len(t):
                i = self._act(i, t, p, motion) if self.state["action"] else self._wait(i, t, label, level, best)
        return self.events

    def _wait(self, i: int, t, label, level, best) -> int:
        """From row i on, up to the row that starts an action or ends the session; the row after it."""
        s = self.state
        t, label, level, best = t[i:], label[i:], level[i:], best[i:]
        carried = s["candidate"]["since"] if s["candidate"] and s["candidate"]["label"] == label[0] else None
        began = run_starts(t, label, carried)
        hold = np.where(label == len(self.classes), GENERAL_HOLD, STRENGTH_HOLD)
        ready = np.flatnonzero((label >= 0) & (t - began >= hold))
        over = np.flatnonzero(t - s["rested"] >= TIMEOUT) if s["rested"] is not None else ready[:0]
        if len(over) and not (len(ready) and ready[0] <= over[0]):
            self._close()
            return i + int(over[0]) + 1
        if not len(ready):
            s["candidate"] = {"label": int(label[-1]), "since": float(began[-1])} if label[-1] >= 0 else None
            return i + len(t)
        k, a = int(ready[0]), int(best[ready[0]])
        since = float(began[k])
        if s["session"] is None:
            name = hashlib.sha256(f"{self.device}|{since!r}".encode()).hexdigest()[:32]
            s["session"] = {"id": name, "start": since, "sets": 0, "active": 0.0}
            self._say("workout_started", since)
        s["action"] = {"class": a, "start": since, "low": None, "sum": float(level[k]), "rows": 1}
        s["candidate"] = None
        self._say(self._kind(a) + "_started", since, action=self.classes[a], confidence=float(level[k]))
        return i + k + 1

    def _act(self, i: int, t, p, motion) -> int:
        """From row i on, up to the row at which the running action has been low for long enough; the row after it."""
        a = self.state["action"]
        signal = p[i:, a["class"]] if self.strength[a["class"]] else motion[i:]
        low = signal < CONTINUE
        began = run_starts(t[i:], low, a["low"] if low[0] else None)
        end = np.flatnonzero(low & (t[i:] - began >= END_HOLD))
        seen = int(end[0]) + 1 if len(end) else len(low)
        a["sum"], a["rows"] = a["sum"] + float(signal[:seen].sum()), a["rows"] + seen
        if len(end):
            self._stop(float(began[end[0]]))
        else:
            a["low"] = float(began[-1]) if low[-1] else None
        return i + seen

    def _stop(self, at: float) -> None:
        s, a = self.state, self.state["action"]
        end = max(at, a["start"])
        length = end - a["start"]
        if length >= MIN_SET:
            self._say(self._kind(a["class"]) + "_ended", end, action=self.classes[a["class"]], start_timestamp=a["start"], end_timestamp=end, duration_seconds=length, confidence=a["sum"] / a["rows"])
            s["session"]["active"] += length
            s["session"]["sets"] += int(self.strength[a["class"]])
        s.update(action=None, rested=end)

    def _close(self) -> None:
        s = self.state
        w, rested = s["session"], s["rested"]
        self._say("workout_ended", rested + TIMEOUT, start_timestamp=w["start"], end_timestamp=rested, duration_seconds=w["active"], sets=w["sets"])
        s.update(candidate=None, action=None, rested=None, session=None)

    def flush(self, t: float) -> list[tuple]:
        """Events when no more rows come after time t."""
        self.events = []
        if self.state["action"]:
            self._stop(t)
        if self.state["session"] and self.state["rested"] is not None:
            self._close()
        return self.events


def clock(state: dict, count: np.ndarray, arrival: np.ndarray, rate_hz: float = 100.0) -> tuple[np.ndarray, np.ndarray]:
    """Time of the first frame and period of each notification (with ``count`` > 0 frames).

    The last frame's time is the greater of what the arrival asks for and 1 us after the frames before: with the running
    sum of the spans taken off, a running maximum.
    """
    earlier = np.concatenate(([state.get("arrival", np.nan)], arrival[:-1])) if len(arrival) else arrival
    with np.errstate(invalid="ignore"):
        gap = arrival - earlier
        observed = np.where((gap > 1e-5) & (gap / count >= PERIODS[0]) & (gap / count <= PERIODS[1]), gap / count, np.nan)
    at = np.maximum.accumulate(np.where(np.isnan(observed), -1, np.arange(len(observed))))
    period = np.where(at >= 0, observed[np.maximum(at, 0)], state.get("period", 1.0 / rate_hz)) if len(at) else observed
    span = period * (count - 1)
    total = np.cumsum(span + NUDGE)
    wish = arrival + 0.0
    if "last" not in state and len(wish):
        wish[0] += span[0]  # the first notification starts at its arrival
    last = total + np.maximum(np.maximum.accumulate(wish - total), state.get("last", -np.inf)) if len(wish) else wish
    if len(last):
        state.update(arrival=float(arrival[-1]), period=float(period[-1]), last=float(last[-1]))
    return last - span, period


def normalise(state: dict, t: np.ndarray, values: np.ndarray, hz: float = 100.0, smooth: float = 0.06) -> tuple[np.ndarray, np.ndarray]:
    """Grid times and values (rows x channels) up to the newest sample: linear between samples, then a trailing mean.

    A gap above STALL starts a new grid. The state holds the last sample, the grid's start and position, and as many
    grid values as the mean needs.
    """
    if not len(t):
        return t, values
    fresh = "t" not in state
    if not fresh:
        t, values = np.concatenate(([state["t"]], t)), np.concatenate(([state["v"]], values))
    step = np.arange(len(t)) * NUDGE
    t = np.maximum.accumulate(t - step) + step
    cuts = np.flatnonzero(np.diff(t) > STALL) + 1
    back, times, rows = int(round(smooth * hz)), [], []
    for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(t)], strict=True)):
        goes_on = n == 0 and not fresh
        start, k = (state["start"], state["k"] + 1) if goes_on else (float(t[a]), 0)
        tail = np.array(state["tail"]) if goes_on else np.zeros((0, values.shape[1]))
        last = int(np.floor((t[b - 1] - start) * hz + 1e-7))
        grid = start + np.arange(k, last + 1) / hz
        raw = np.stack([np.interp(grid, t[a:b], values[a:b, c]) for c in range(values.shape[1])], 1)
        both = np.concatenate((tail, raw))
        sums = np.concatenate((np.zeros((1, both.shape[1])), np.cumsum(both, 0)))
        at = np.arange(len(tail), len(both))
        low = np.maximum(at - back, 0)
        times.append(grid)
        rows.append((sums[at + 1] - sums[low]) / (at + 1 - low)[:, None])
        state.update(start=start, k=max(last, k - 1), tail=both[max(len(both) - back, 0) :].tolist())
    state.update(t=float(t[-1]), v=values[-1].tolist())
    return np.concatenate(times), np.concatenate(rows)
