"""Enrolment, calibration and attempts of users as a stateful stream.

Each user has typed state of a fixed size: how many reps they have enrolled, count, mean and scatter of the windows of all but the last of these, the windows of the last, which are held out, and once calibrated a profile with its threshold. So no action grows with the number of reps. State may expire. Actions are `enroll`, `calibrate`, `attempt` and `reset`; a user's actions within a batch are taken in order of `seq`."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import profiles, reps

#: Reps to fit a profile on, and the last reps, which are held out for the threshold.
FIT_REPS, HOLDOUT_REPS = 4, 2
RIDGE, SHRINK, CONSTANT = 1e-3, 0.10, 1e-12
OUT = "user string, seq long, action string, ok boolean, reason string, enroll_reps int, threshold double, part_above double, verdict string"


@dataclass(frozen=True)
class Profile:
    """Mean and inverse covariance (row by row) of the columns that vary, and the threshold."""

    kept: list[int]
    mean: list[float]
    inverse: list[float]
    threshold: float = 0.0

    def distances(self, windows: np.ndarray) -> np.ndarray:
        d, n = windows[:, self.kept] - np.asarray(self.mean), len(self.kept)
        return np.sqrt(np.maximum(0, np.einsum("ij,jk,ik->i", d, np.asarray(self.inverse).reshape(n, n), d)))

    def attempt(self, windows: np.ndarray) -> tuple[float, str]:
        part = float((self.distances(windows) > self.threshold).mean())
        return part, "REJECT" if part >= 0.5 else "ACCEPT"


#: What is kept of a user, by the names of Memory.
STATE = "count int, n long, mean array<double>, scatter array<double>, held array<array<array<double>>>, kept array<int>, centre array<double>, inverse array<double>, threshold double, at long"


class Memory:
    """What is kept of a user between actions."""

    def __init__(self) -> None:
        self.count, self.moments, self.held, self.profile = 0, None, [], None

    @classmethod
    def of(cls, state: tuple) -> Memory:
        count, n, mean, scatter, held, kept, centre, inverse, threshold, _ = state
        out = cls()
        out.count, out.held = count, [matrix(w) for w in held]
        if n:
            out.moments = n, np.array(mean, float), np.array(scatter, float).reshape(len(mean), len(mean))
        if threshold is not None:
            out.profile = Profile(list(kept), list(centre), list(inverse), threshold)
        return out

    def as_state(self, at: int = 0) -> tuple:
        n, mean, scatter = self.moments or (0, np.empty(0), np.empty(0))
        p = self.profile or Profile([], [], [], None)
        return self.count, int(n), mean.tolist(), scatter.ravel().tolist(), [w.tolist() for w in self.held], p.kept, p.mean, p.inverse, p.threshold, at

    def enroll(self, windows: np.ndarray) -> None:
        self.count += 1
        self.held.append(windows)
        if len(self.held) > HOLDOUT_REPS:
            self.moments = profiles.summed([self.held.pop(0)], self.moments)

    def fitted(self) -> Profile | None:
        """A profile of the reps but the last, which give the threshold. None if no column varies."""
        n, mean, scatter = self.moments
        kept = np.flatnonzero(np.diag(scatter) / n > CONSTANT)
        if not len(kept):
            return None
        inverse = profiles.inverted(scatter[np.ix_(kept, kept)] / max(n - 1, 1), RIDGE, SHRINK)
        made = Profile(kept.tolist(), mean[kept].tolist(), inverse.ravel().tolist())
        d = made.distances(np.concatenate(self.held))
        return replace(made, threshold=float(d.mean() + 3 * d.std()) if len(d) >= 4 else float(d.max() * 1.10))


def matrix(windows) -> np.ndarray:
    return np.array([list(w) for w in windows], float)


def act(kept: Memory, action: str, windows, fault: str | None) -> tuple:
    """(ok, reason, enroll_reps, threshold, part_above, verdict) of one action, which changes what is kept. Reasons are codes: the fault of a rep, too_few_reps, constant_features, no_profile, unknown_action."""
    if action == "reset":
        kept.__init__()
        return True, None, 0, None, None, None
    reason, told = None, (None, None)
    if action == "enroll":
        reason = fault
        if not reason:
            kept.enroll(matrix(windows))
    elif action == "calibrate":
        if kept.count < FIT_REPS + HOLDOUT_REPS:
            reason = "too_few_reps"
        else:
            kept.profile = kept.fitted() or kept.profile
            reason = None if kept.profile else "constant_features"
    elif action == "attempt":
        reason = "no_profile" if kept.profile is None else fault
        if not reason:
            told = kept.profile.attempt(matrix(windows))
    else:
        reason = "unknown_action"
    return not reason, reason, kept.count, kept.profile.threshold if kept.profile else None, *told


def run(actions: DataFrame, ttl: int = 0) -> DataFrame:
    """actions (user, seq, action, windows array<array<double>>, fault), a stream, to one row per action. State is kept until reset, or until a user was silent for `ttl` milliseconds (0: for good); such a stream needs a trigger that goes on, as Spark plans batches without data for states that may time out. Of the actions of one user in one batch, a part of the stream of a bounded size, all are held, to be taken in order."""
    columns = actions.select("user", F.col("seq").cast("long").alias("seq"), "action", F.col("windows").cast("array<array<double>>").alias("windows"), "fault")
    return _stateful(columns, lambda windows, fault: (windows, None if pd.isna(fault) else fault), ttl)


def run_reps(actions: DataFrame, ttl: int = 0) -> DataFrame:
    """actions (user, seq, action, pointer, keys), a stream of reps as they are captured: their quality is checked and their windows are made within the stream, then as run()."""

    def made(pointer, keys) -> tuple[list | None, str | None]:
        p = np.array([(e["ts"], e["x"], e["y"]) for e in (pointer if pointer is not None else ())], float).reshape(-1, 3)
        path = np.column_stack(((p[:, 0] - (p[0, 0] if len(p) else 0)) / 1000, p[:, 1:]))
        pairs = reps.completed([(e["code"], e["phase"], e["ts"]) for e in (keys if keys is not None else ())])
        told = reps.fault(path, pairs)
        return (None, told) if told else (reps.vectors(path, pairs).tolist(), None)

    pointer, keys = "array<struct<x: double, y: double, ts: double>>", "array<struct<code: string, phase: string, ts: double>>"
    columns = actions.select("user", F.col("seq").cast("long").alias("seq"), "action", F.col("pointer").cast(pointer).alias("pointer"), F.col("keys").cast(keys).alias("keys"))
    return _stateful(columns, made, ttl)


def _stateful(columns: DataFrame, made: Callable, ttl: int) -> DataFrame:
    """made: of a row's last two columns, windows and fault."""
    first, second = columns.columns[3:]
    names = [c.split()[0] for c in OUT.split(", ")]

    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=names)
            return
        now = state.getCurrentProcessingTimeMs() if ttl else 0
        kept = Memory.of(state.get) if state.exists and now - state.get[-1] <= ttl else Memory()
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        out = []
        for seq, action, a, b in zip(rows["seq"], rows["action"], rows[first], rows[second], strict=True):
            out.append((key[0], seq, action, *act(kept, action, *(made(a, b) if action in ("enroll", "attempt") else (None, None)))))
        if kept.count:
            state.update(kept.as_state(now))
            if ttl:
                state.setTimeoutDuration(ttl)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=names)

    return columns.groupBy("user").applyInPandasWithState(work, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if ttl else GroupStateTimeout.NoTimeout)
