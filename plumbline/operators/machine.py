"""State machines over ordered events, folded by stretches.

A move takes every state to one state and adds a gain; moves in a row compose to a table of the same size. The moves of a stretch of a key (a span of
its order, such as a day) are composed on their own, so a key with very many events is split over tasks; the short list of a key's
stretches then gives the state in which each of them begins.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEP = "struct<state:int,gain:bigint>"


@dataclass
class Machine:
    """``follow[move * len(states) + state]``: the next state; ``gain``: what that step adds. The first state is the start."""

    states: list[str]
    follow: list[int]
    gain: list[int]

    @classmethod
    def of(cls, states: list[str], moves: list, rule: Callable[[object, str], tuple[str, int]]) -> Machine:
        steps = [rule(m, s) for m in moves for s in states]
        return cls(states, [states.index(to) for to, _ in steps], [gain for _, gain in steps])

    def step(self, at: Column, move: Column) -> Column:
        place = move * len(self.states) + at["state"]
        return F.struct(F.get(F.lit(self.follow), place).cast("int").alias("state"), (at["gain"] + F.get(F.lit(self.gain), place)).alias("gain")).cast(_STEP)

    def composed(self, moves: Column) -> Column:
        """The table of moves in a row: where each state ends and what it gains."""
        same = F.array(*[F.struct(F.lit(k).alias("state"), F.lit(0).alias("gain")).cast(_STEP) for k in range(len(self.states))])
        return F.aggregate(moves, same, lambda f, m: F.transform(f, lambda at: self.step(at, m)))

    def name(self, state: Column) -> Column:
        return F.get(F.lit(self.states), state)


def _stretches(events: DataFrame, machine: Machine, key: str, order: str, stretch: Column, move: Column) -> tuple[DataFrame, DataFrame]:
    """The ordered moves of every stretch, and every key's stretches in order with their tables."""
    packed = events.select(key, order, stretch.alias("stretch"), move.cast("int").alias("move")).groupBy(key, "stretch").agg(F.array_sort(F.collect_list(F.struct(order, "move"))).alias("steps"))
    tables = packed.select(key, "stretch", machine.composed(F.transform("steps", lambda s: s["move"])).alias("table"))
    return packed, tables.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("stretch", "table"))).alias("all"))


def _through(machine: Machine, at: Column, table: Column) -> Column:
    there = F.get(table, at["state"])
    return F.struct(there["state"].alias("state"), (at["gain"] + there["gain"]).alias("gain")).cast(_STEP)


def _start() -> Column:
    return F.struct(F.lit(0).alias("state"), F.lit(0).alias("gain")).cast(_STEP)


def final_states(events: DataFrame, machine: Machine, key: str, order: str, stretch: Column, move: Column) -> DataFrame:
    """``(key, state, gain)`` after all events of a key."""
    _, keys = _stretches(events, machine, key, order, stretch, move)
    last = F.aggregate("all", _start(), lambda at, s: _through(machine, at, s["table"]))
    return keys.select(key, last.alias("last")).select(key, machine.name(F.col("last.state")).alias("state"), F.col("last.gain").alias("gain"))


def stepped(events: DataFrame, machine: Machine, key: str, order: str, stretch: Column, move: Column) -> DataFrame:
    """``(key, order, came_from, state, gain)`` of every event: the states before and after it, and what its step gained."""
    packed, keys = _stretches(events, machine, key, order, stretch, move)
    before = F.aggregate("all", F.array(_start()), lambda seen, s: F.concat(seen, F.array(_through(machine, F.element_at(seen, -1), s["table"]))))
    entered = keys.select(key, F.explode(F.arrays_zip(F.col("all.stretch").alias("stretch"), F.transform(F.slice(before, 1, F.size("all")), lambda at: at["state"]).alias("entry"))).alias("e")).select(key, "e.stretch", "e.entry")
    walk = F.aggregate("steps", F.array(F.struct(F.col("entry").alias("state"), F.lit(0).alias("gain")).cast(_STEP)), lambda seen, s: F.concat(seen, F.array(machine.step(F.element_at(seen, -1), s["move"]))))
    rows = packed.join(entered, [key, "stretch"]).withColumn("walk", walk)
    each = rows.select(key, F.posexplode("steps").alias("at", "step"), "walk").select(key, F.col(f"step.{order}").alias(order), F.get("walk", F.col("at")).alias("a"), F.get("walk", F.col("at") + 1).alias("b"))
    return each.select(key, order, machine.name(F.col("a.state")).alias("came_from"), machine.name(F.col("b.state")).alias("state"), (F.col("b.gain") - F.col("a.gain")).alias("gain"))
