"""Frozen settings passed to the operators. Nothing here touches a session."""

from __future__ import annotations

from dataclasses import dataclass

# --- Fixed values -----------------------------------------------------------
IGNORE_INDEX = -100        # label of a token the loss does not count
PAD_TOKEN_ID = 0
PAD_LABEL = -100
PAD_MASK = 0
DEFAULT_SYSTEM_PROMPT = "You are a helpful assistant."
DEFAULT_SEED = 42
DEFAULT_EVAL_RATIO = 0.05
DEFAULT_MAX_SEQ_LEN = 1024
SCORING_MAX_SEQ_LEN = 2048
DEFAULT_MAX_TOKENS = 256
STREAM_MAX_TOKENS = 512
DEFAULT_TEMPERATURE = 0.7
LOG_EVERY = 10             # steps between two records of a run's log
EVAL_EVERY = 100           # steps after which a run pauses for an evaluation
CHECKPOINT_EVERY = 50      # ... or for a checkpoint
MICRO_BATCHES = 2          # losses that add up to the loss of a step
SCHEDULE_STEPS = 2000
WARMUP_STEPS = 50
PEAK_RATE = 2e-4
FINAL_RATE = 1e-5
SECOND_RATE_SCALE = 0.02
# ----------------------------------------------------------------------------


@dataclass(frozen=True)
class SourceSpec:
    """One corpus of a mixture. ``cap`` counts eligible rows; 0 keeps them all.

    ``column_map`` renames columns (theirs, ours) before a layout is looked for.
    ``order_by`` is the id; ids that are no whole numbers are ordered by hash.
    """

    name: str
    path: str = ""
    split: str = "train"
    cap: int = 0
    category: str = ""
    file_format: str = "parquet"
    order_by: str = "id"
    column_map: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class PrepConfig:
    """How conversations become examples."""

    max_seq_len: int = DEFAULT_MAX_SEQ_LEN
    enable_thinking: bool = False
    thinking_prompt: str = "Work through the problem step by step before giving the answer."
    fast_prompt: str = DEFAULT_SYSTEM_PROMPT
    # False accepts rows that never went through the user/assistant test.
    require_roles: bool = True
    # "train" labels the turns after the last assistant turn too; "mask" ignores them.
    trailing: str = "train"
    # True skips rows whose last assistant message is empty.
    reject_empty_target: bool = False
    # True adds ``prefix_ok``: whether the full text's ids begin with the prompt's.
    check_prefix: bool = False

    def __post_init__(self) -> None:
        if self.max_seq_len < 1:
            raise ValueError("max_seq_len must be positive")
        if self.trailing not in ("train", "mask"):
            raise ValueError("trailing must be 'train' or 'mask'")

    @property
    def system_prompt(self) -> str:
        return self.thinking_prompt if self.enable_thinking else self.fast_prompt


@dataclass(frozen=True)
class SplitConfig:
    eval_ratio: float = DEFAULT_EVAL_RATIO
    seed: int = DEFAULT_SEED


@dataclass(frozen=True)
class ScheduleConfig:
    """Warm-up and cosine decay of the learning rate."""

    max_steps: int = SCHEDULE_STEPS
    warmup_steps: int = WARMUP_STEPS
    lr: float = PEAK_RATE
    min_lr: float = FINAL_RATE
    scale: float = SECOND_RATE_SCALE


@dataclass(frozen=True)
class LogSettings:
    """What reading a run's log takes: how many micro-batch losses make a step,
    how many tokens a step counts, and after multiples of which steps a run pauses."""

    accumulation: int = MICRO_BATCHES
    tokens_per_step: int = MICRO_BATCHES * DEFAULT_MAX_SEQ_LEN
    pause_every: tuple[int, ...] = (EVAL_EVERY, CHECKPOINT_EVERY)
