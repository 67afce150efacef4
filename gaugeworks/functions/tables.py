"""Table functions, for SQL: key_pairs and work_items. register() names them in a session. Both work row by row, holding one event or one row at a time; the DataFrame functions of operators/manifests.py do the same without Python."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SelectedColumn


def _columns(table: AnalyzeArgument, *names: str) -> dict:
    """Types of the named columns of a TABLE argument."""
    if not table.isTable:
        raise ValueError("the first argument must be a TABLE")
    have = {f.name: f.dataType for f in table.dataType.fields}
    missing = [n for n in names if n not in have]
    if missing:
        raise ValueError(f"the table lacks {', '.join(missing)}")
    return have


class KeyPairs:
    """key_pairs(TABLE(events)): (session, code, pos, down_t, up_t) of events (session, code, pos, phase, t), by the rule of manifests.key_pairs(). It deals and sorts its table itself, takes these columns only, by session and code, and holds the event before. A null session or code is one like others; no events, no rows."""

    def __init__(self) -> None:
        self.before: tuple = None, None

    @staticmethod
    def analyze(events: AnalyzeArgument) -> AnalyzeResult:
        names = ("session", "code", "pos", "phase", "t")
        have = _columns(events, *names)
        schema = StructType()
        for name, of in (("session", "session"), ("code", "code"), ("pos", "pos"), ("down_t", "t"), ("up_t", "t")):
            schema.add(name, have[of])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("session"), PartitioningColumn("code")], orderBy=[OrderingColumn("pos")], select=[SelectedColumn(n) for n in names])

    def eval(self, e: Row) -> Iterator[tuple]:
        (phase, t), self.before = self.before, (e["phase"], e["t"])
        if e["phase"] == "up" and phase == "down":
            yield e["session"], e["code"], e["pos"], t, e["t"]


def _seed(*parts: object) -> int:
    """derive_seed() of scalars.py."""
    return int(hashlib.sha256("|".join(f"{len(str(p))}:{p}" for p in parts).encode()).hexdigest()[:8], 16)


class WorkItems:
    """work_items(TABLE(placed), per_identity, modality, attacks, master_seed): the items of manifests.work_items() from rows (identity, place) of manifests.placed(), with the attacks and their weights as a JSON object. A constant that doesn't fit is an error when the query is analysed; no rows, no items."""

    def __init__(self) -> None:
        self.limits: list[tuple[int, str]] = []

    @staticmethod
    def analyze(placed: AnalyzeArgument, per_identity: AnalyzeArgument, modality: AnalyzeArgument, attacks: AnalyzeArgument, master_seed: AnalyzeArgument) -> AnalyzeResult:
        have = _columns(placed, "identity", "place")
        for name, a, kind in (("per_identity", per_identity, int), ("modality", modality, str), ("attacks", attacks, str), ("master_seed", master_seed, int)):
            if not a.isConstantExpression or not isinstance(a.value, kind):
                raise ValueError(f"{name} must be a constant of type {kind.__name__}")
        weights = json.loads(attacks.value)
        if not isinstance(weights, dict) or not weights or not all(isinstance(w, int | float) and w >= 0 for w in weights.values()) or not sum(weights.values()):
            raise ValueError("attacks must be a JSON object of weights, not all 0")
        schema = StructType().add("sample_id", StringType()).add("identity", have["identity"]).add("sub", IntegerType()).add("counter", LongType()).add("dispatch_seed", LongType()).add("attack", StringType()).add("seed", LongType())
        return AnalyzeResult(schema)

    def eval(self, row: Row, per_identity: int, modality: str, attacks: str, master_seed: int) -> Iterator[tuple]:
        if not self.limits:
            weights, upto = sorted(json.loads(attacks).items()), 0.0
            total = sum(w for _, w in weights)
            for name, w in weights:
                upto += w / total
                self.limits.append((int(upto * 2**32), name))
        for sub in range(per_identity):
            counter = row["place"] * per_identity + sub
            drawn = _seed(master_seed, modality, "_dispatch", counter)
            attack = next((name for limit, name in self.limits[:-1] if drawn < limit), self.limits[-1][1])
            yield f"{modality}-{attack}-{counter:08d}", row["identity"], sub, counter, drawn, attack, _seed(master_seed, modality, attack, counter)


def register(spark: SparkSession) -> None:
    """Names both functions in the session."""
    spark.udtf.register("key_pairs", udtf(KeyPairs))
    spark.udtf.register("work_items", udtf(WorkItems))
