"""Learning-rate schedule as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnloom.config import ScheduleConfig


def learning_rate(step: Column, cfg: ScheduleConfig = ScheduleConfig()) -> Column:
    """Linear warm-up, cosine decay to ``min_lr``, then flat. ``step`` is 0-based.

    A schedule without a warm-up or without a decay leaves that branch out, so
    neither divides by zero.
    """
    floor = F.lit(float(cfg.min_lr))
    decay_steps = cfg.max_steps - cfg.warmup_steps
    if decay_steps > 0:
        progress = (step - cfg.warmup_steps) / F.lit(float(decay_steps))
        after = F.when(step >= cfg.max_steps, floor).otherwise(
            floor + (1.0 + F.cos(progress * math.pi)) * (0.5 * (cfg.lr - cfg.min_lr))
        )
    else:
        after = floor
    if cfg.warmup_steps <= 0:
        return after
    ramp = (step + 1) * (cfg.lr / cfg.warmup_steps)
    return F.when(step < cfg.warmup_steps, ramp).otherwise(after)


def scaled_rate(rate: Column, cfg: ScheduleConfig = ScheduleConfig()) -> Column:
    """Rate of the second parameter group."""
    return rate * cfg.scale


def perplexity(mean_loss: Column) -> Column:
    return F.exp(mean_loss)
