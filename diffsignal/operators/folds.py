"""Folds that cut an ordered list into groups, for keys of any size.

Where a group ends depends on its own rows alone: so each row knows where the
next group would begin if one began at it.  Rows are sorted into ranges that
split a large key; a range that lies within one key tells, for every row at
which the group that comes in may end (those of one group), which state it
passes on.  One walk over these summaries, a row a range, gives each range the
state that it starts from, and all ranges are then cut at once.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructType

from ..scratch import written

#: Rows of a range, about.
RANGE_ROWS = 500_000


def _prefix(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values)])


@dataclass(frozen=True)
class Packs:
    """A pack takes items while their sum is ``most`` and their number ``count`` at most; a larger item is alone.  Sizes are not negative."""

    most: int
    count: int | None = None

    def nexts(self, values: np.ndarray) -> np.ndarray:
        p, n = _prefix(values), len(values)
        out = np.maximum(np.searchsorted(p, p[:-1] + self.most, "right") - 1, np.arange(n) + 1)
        return np.minimum(out, np.arange(n) + self.count) if self.count else out

    def ends(self, state: tuple, values: np.ndarray) -> int:
        """How many rows an open group still takes."""
        room = int(np.searchsorted(_prefix(values), self.most - state[0], "right")) - 1
        return max(0, min(room, self.count - state[1]) if self.count else room)

    def state(self, values: np.ndarray, state: tuple | None = None) -> tuple:
        """Of a group that ``values`` begin, or continue from ``state``."""
        s, n = state or (0, 0)
        return s + int(values.sum()), n + len(values)


@dataclass(frozen=True)
class Merges:
    """A chunk takes its neighbour while it is below ``target`` or the neighbour below ``least``, and their sum ``most`` at most.  Sizes are not negative."""

    least: int
    target: int
    most: int

    def nexts(self, values: np.ndarray) -> np.ndarray:
        n, p = len(values), _prefix(values)
        large = np.append(np.flatnonzero(values >= self.least), n)
        over = np.searchsorted(p, p[:-1] + self.most, "right") - 1
        grown = np.minimum(np.maximum(np.searchsorted(p, p[:-1] + self.target, "left"), np.arange(n) + 1), n)
        return np.minimum(np.maximum(np.minimum(over, large[np.searchsorted(large, grown)]), np.arange(n) + 1), n)

    def ends(self, state: tuple, values: np.ndarray) -> int:
        p, held = _prefix(values)[:-1] + state[0], values
        stop = (p + held > self.most) | ((p >= self.target) & (held >= self.least))
        return int(np.argmax(stop)) if stop.any() else len(values)

    def state(self, values: np.ndarray, state: tuple | None = None) -> tuple:
        return ((state[0] if state else 0) + int(values.sum()),)


@dataclass(frozen=True)
class Spans:
    """A group takes what comes within ``span`` of its first value; values do not fall."""

    span: int

    def nexts(self, values: np.ndarray) -> np.ndarray:
        return np.searchsorted(values, values + self.span, "right")

    def ends(self, state: tuple, values: np.ndarray) -> int:
        return int(np.searchsorted(values, state[0] + self.span, "right"))

    def state(self, values: np.ndarray, state: tuple | None = None) -> tuple:
        return state or (int(values[0]),)


def _cut(rule, values: np.ndarray, start: int) -> list[int]:
    """Where groups begin, if one begins at ``start``."""
    nexts, out, i = rule.nexts(values), [], start
    while i < len(values):
        out.append(i)
        i = int(nexts[i])
    return out


def _segments(table: pa.Table, keys: list[str]) -> list[tuple[int, int]]:
    """Spans of equal keys in a sorted range."""
    change = np.zeros(table.num_rows, bool)
    change[:1] = True
    for k in keys:
        codes = table.column(k).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    begins = np.flatnonzero(change).tolist()
    return list(zip(begins, [*begins[1:], table.num_rows]))


def _key(table: pa.Table, keys: list[str], row: int) -> tuple:
    return tuple(table.column(k)[row].as_py() for k in keys)


def _summary(rule, keys: list[str]):
    def run(table: pa.Table) -> pa.Table:
        number = table.column("run")[0].as_py()
        table = table.sort_by("uid")
        segments = _segments(table, keys)
        values = table.column("value").to_numpy()
        a, b = segments[-1]
        says = {"first": _key(table, keys, 0), "last": _key(table, keys, table.num_rows - 1), "whole": len(segments) == 1}
        if len(segments) == 1:
            nexts = rule.nexts(values)
            passed: dict[int, tuple] = {}
            count = [0] * (len(values) + 1)
            last = list(range(len(values) + 1))
            for i in range(len(values) - 1, -1, -1):
                j = int(nexts[i])
                count[i], last[i] = count[j] + 1, last[j] if j < len(values) else i
            for i in range(int(nexts[0]) + 1):
                if i < len(values):
                    passed[i] = (rule.state(values[last[i] :]), count[i])
            says |= {"passed": passed, "prefix": values[: int(nexts[0]) + 1], "rest": rule.state(values)}
        else:
            begins = _cut(rule, values[a:b], 0)
            says["tail"] = (rule.state(values[a + begins[-1] : b]), len(begins))
        return pa.table({"run": pa.array([number], pa.int64()), "says": pa.array([pickle.dumps(says)], pa.binary())})

    return run


def _walk(rule, summaries: list[dict]) -> dict[int, tuple]:
    """For each range whose first key came in from the range before: (the open group's state, how many groups began)."""
    comes: dict[int, tuple] = {}
    carry, key = None, None
    for number, says in summaries:
        known = carry if carry is not None and key == says["first"] else None
        if known is not None:
            comes[number] = known
        if not says["whole"]:
            carry = says["tail"]
        elif known is None:
            carry = says["passed"][0]
        else:
            state, groups = known
            j = rule.ends(state, says["prefix"])
            if j in says["passed"]:
                carry = (says["passed"][j][0], groups + says["passed"][j][1])
            else:  # the group that came in goes on beyond the range
                carry = (tuple(x + y for x, y in zip(state, says["rest"])) if not isinstance(rule, Spans) else state, groups)
        key = says["last"]
    return comes


def _numbered(rule, keys: list[str], comes: dict[int, tuple], names: list[str]):
    def run(table: pa.Table) -> pa.Table:
        number = table.column("run")[0].as_py()
        table = table.sort_by("uid")
        values = table.column("value").to_numpy()
        group, first = np.zeros(len(values), np.int64), np.zeros(len(values), bool)
        for n, (a, b) in enumerate(_segments(table, keys)):
            state, before = comes.get(number, (None, 0)) if n == 0 else (None, 0)
            begins = _cut(rule, values[a:b], rule.ends(state, values[a:b]) if state is not None else 0)
            first[a:b][begins] = True
            group[a:b] = np.cumsum(first[a:b]) + before - 1
        return table.select(names).append_column("group", pa.array(group)).append_column("begins", pa.array(first))

    return run


def grouped(df: DataFrame, keys: list[str], order: list[str], value: Column, rule: Packs | Merges | Spans) -> DataFrame:
    """``df`` with ``group``, the number of each row's group in its key from 0, and ``begins``, whether it is a group's first.

    The rows of a key are taken in the ``order`` of some columns, which with the
    keys tell them apart (rows that they do not are taken in any order); a null
    value counts as 0.  A range is one task's rows, however few the keys are.
    """
    names = df.columns
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE_ROWS))
    rows = df.withColumn("value", F.coalesce(value.cast("long"), F.lit(0).cast("long")))
    rows = rows.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    rows = written(rows.withColumn("uid", F.monotonically_increasing_id()).withColumn("run", F.shiftright("uid", 33)), "sorted")
    told = rows.select(*keys, "value", "uid", "run").groupBy("run").applyInArrow(_summary(rule, keys), "run long, says binary")
    summaries = [(r["run"], pickle.loads(r["says"])) for r in written(told, "summaries").orderBy("run").collect()]
    schema = StructType([df.schema[c] for c in names]).add("group", LongType()).add("begins", BooleanType())
    return rows.groupBy("run").applyInArrow(_numbered(rule, keys, _walk(rule, summaries), names), schema)
