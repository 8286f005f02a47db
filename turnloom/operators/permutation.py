"""The order of an epoch as arithmetic: a keyed permutation of 0 .. n - 1.

A Feistel network over pairs (left, right) with left < a and right < b mixes each
half into the other by modular addition, so it is a bijection of 0 .. a*b - 1. a*b
is n or a little more; a value beyond n - 1 is sent through again until it falls
below (cycle walking). How often that happens at most is counted beforehand, over
the few values beyond n. So the row at a position, and the position of a row, are
worked out from numbers alone: no epoch is ever shuffled or sorted.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.config import DEFAULT_SEED
from turnloom.operators.examples import computed_once
from turnloom.operators.ordered import global_index, order_of

NETWORK_ROUNDS = 6
_DIGITS = 15        # hex digits of md5 that fit a non-negative bigint
_CANDIDATES = 2048  # widths looked at for the least number of values beyond n


@lru_cache(maxsize=1024)
def halves(n: int) -> tuple[int, int]:
    """``a, b`` near the square root of ``n`` with ``a * b >= n``, as little beyond it as is found."""
    root = max(1, math.isqrt(n))
    return min(((a, -(-n // a)) for a in range(max(1, root - _CANDIDATES // 2), root + _CANDIDATES // 2 + 1) if a <= max(1, n)),
               key=lambda p: (p[0] * p[1] - n, abs(p[0] - root)), default=(1, 1))


@lru_cache(maxsize=1 << 16)
def _mix(key: str, number: int, half: int) -> int:
    return int(hashlib.md5(f"{key}:{number}:{half}".encode()).hexdigest()[:_DIGITS], 16)


@dataclass(frozen=True)
class EpochOrder:
    """Permutation of 0 .. n - 1 for one epoch of one seed."""

    n: int
    epoch: int
    seed: int = DEFAULT_SEED

    @property
    def key(self) -> str:
        return f"{self.seed}:{self.epoch}"

    def once(self, x: int, back: bool = False) -> int:
        """One pass of the network over 0 .. a*b - 1, or its inverse."""
        a, b = halves(self.n)
        left, right = divmod(x, b)
        sign = -1 if back else 1
        for i in reversed(range(NETWORK_ROUNDS)) if back else range(NETWORK_ROUNDS):
            if i % 2 == 0:
                left = (left + sign * _mix(self.key, i, right)) % a
            else:
                right = (right + sign * _mix(self.key, i, left)) % b
        return left * b + right

    def walks(self) -> int:
        """Passes after the first that any value needs to fall below ``n``, either way."""
        a, b = halves(self.n)
        waiting, steps = list(range(self.n, a * b)), 0
        while waiting:      # a chain of such values is as long backwards
            waiting = [y for y in map(self.once, waiting) if y >= self.n]
            steps += 1
        return steps

    def __call__(self, x: int, back: bool = False) -> int:
        x = self.once(x, back)
        while x >= self.n:
            x = self.once(x, back)
        return x


def _once(x: Column, key: Column, n: int, back: bool) -> Column:
    a, b = halves(n)
    numbers = F.array(*[F.lit(i) for i in (reversed(range(NETWORK_ROUNDS)) if back else range(NETWORK_ROUNDS))])
    sign = -1 if back else 1

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        text = F.concat_ws(":", key, i.cast("string"), F.when(even, acc["right"]).otherwise(acc["left"]).cast("string"))
        mix = F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("bigint")
        return F.struct(
            F.when(even, F.pmod(acc["left"] + sign * (mix % a), F.lit(a).cast("bigint"))).otherwise(acc["left"]).alias("left"),
            F.when(even, acc["right"]).otherwise(F.pmod(acc["right"] + sign * (mix % b), F.lit(b).cast("bigint"))).alias("right"),
        )

    start = F.struct(F.call_function("div", x, F.lit(b)).alias("left"), F.pmod(x, F.lit(b).cast("bigint")).alias("right"))
    return F.aggregate(numbers, start, step, lambda acc: acc["left"] * F.lit(b).cast("bigint") + acc["right"])


def permuted(x: Column, epoch: Column, n: int, walks: int, seed: int = DEFAULT_SEED, back: bool = False) -> Column:
    """The row at position ``x`` of an epoch, or with ``back`` the position of row ``x``.

    ``walks`` is the largest of the epochs' ``EpochOrder.walks()``.
    """
    key = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"))
    first = _once(x, key, n, back)
    if not walks:
        return first
    again = F.array_repeat(F.lit(0), walks)
    return F.aggregate(again, first, lambda y, _: F.when(y >= n, _once(y, key, n, back)).otherwise(y))


def number_examples(examples: DataFrame, id_col: str) -> DataFrame:
    """``id_col, row``: examples numbered 0 .. n - 1 in order of id. Done once and stored; ids must be unique."""
    return global_index(examples.select(id_col), order_of(examples, id_col), name="row")


def _epochs(n: int, first_step: int, last_step: int, per_step: int, seed: int) -> tuple[range, int]:
    """Epochs that steps ``first_step .. last_step - 1`` reach into, and how often their values walk at most."""
    if per_step < 1 or not 0 <= first_step <= last_step:
        raise ValueError("per_step must be positive, and steps a range from 0 on")
    if n == 0 or first_step == last_step:
        return range(0), 0
    epochs = range(first_step * per_step // n, (last_step * per_step - 1) // n + 1)
    return epochs, max(EpochOrder(n, e, seed).walks() for e in epochs)


def examples_of_steps(index: DataFrame, n: int, id_col: str, *, first_step: int, last_step: int, per_step: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """``step, slot, epoch, id_col`` of the steps from ``first_step`` up to ``last_step`` (not included).

    ``index`` is ``number_examples`` of ``n`` examples. Rows are made for these
    steps alone, and fetched by number; nothing else of any epoch is looked at.
    """
    epochs, walks = _epochs(n, first_step, last_step, per_step, seed)
    at = F.col("at")
    wanted = index.sparkSession.range(first_step * per_step if epochs else 0, last_step * per_step if epochs else 0).select(F.col("id").alias("at"))
    wanted = wanted.select("at", F.call_function("div", at, F.lit(max(n, 1))).alias("epoch"), F.pmod(at, F.lit(max(n, 1)).cast("bigint")).alias("x"))
    placed = wanted.select("at", "epoch", permuted(F.col("x"), F.col("epoch"), max(n, 1), walks, seed).alias("row"))
    return _steps(placed.join(index.select("row", id_col), "row"), per_step, id_col)


def steps_of_examples(index: DataFrame, n: int, id_col: str, *, first_step: int, last_step: int, per_step: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """The same rows as ``examples_of_steps``, found from the examples: a scan of ``index`` without a shuffle or a join."""
    epochs, walks = _epochs(n, first_step, last_step, per_step, seed)
    if not epochs:
        return _steps(index.limit(0).select(id_col, F.col("row").alias("at"), F.col("row").alias("epoch")), per_step, id_col)
    each = index.select(id_col, "row", F.explode(F.sequence(F.lit(epochs.start).cast("bigint"), F.lit(epochs.stop - 1).cast("bigint"))).alias("epoch"))
    placed = each.select(id_col, "epoch", (F.col("epoch") * n + permuted(F.col("row"), F.col("epoch"), n, walks, seed, back=True)).alias("at"))
    inside = (F.col("at") >= first_step * per_step) & (F.col("at") < last_step * per_step)
    return _steps(computed_once(placed, ["at"]).filter(inside), per_step, id_col)


def _steps(placed: DataFrame, per_step: int, id_col: str) -> DataFrame:
    return placed.select(
        F.call_function("div", "at", F.lit(per_step)).alias("step"), F.pmod("at", F.lit(per_step).cast("bigint")).alias("slot"), "epoch", id_col)
