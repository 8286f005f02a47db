"""Turn tables (one row per turn) to conversations (one row each)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.operators.ordered import by_column, global_index


def number_turns(
    turns: DataFrame, key: str = "conv_id", order: str = "turn", name: str = "turn"
) -> DataFrame:
    """Renumber turns 0, 1, 2, ... in their order, closing any gaps."""
    return global_index(
        turns.withColumnRenamed(order, "__order"), by_column("__order"), by=[key], name=name
    ).drop("__order")


def assemble_turns(
    turns: DataFrame,
    *,
    key: str = "conv_id",
    order: str = "turn",
    role: str = "role",
    content: str = "text",
    dense: bool = False,
) -> DataFrame:
    """``key, messages, facts`` per conversation, in one shuffle.

    ``messages`` holds every turn, however many there are, and ``facts``
    describes them. The facts are combined before the shuffle, so a plan that
    asks for them alone moves no text.

    ``dense`` says that turns are numbered 0, 1, 2, ... without gaps. That is
    checked in the facts and in the messages, and a conversation that breaks it
    fails the job. Otherwise turns are renumbered first, at the price of one
    more shuffle.
    """
    if not dense:
        turns = number_turns(turns, key, order, "__turn")
        order = "__turn"
    at, who, what = (f"`{c}`" for c in (order, role, content))

    def is_role(name: str) -> str:
        return f"({who} <=> '{name}')"

    def any_true(test: str, name: str) -> Column:
        return F.expr(f"coalesce(bool_or({test}), false) AS {name}")

    def off_beat(lead: int) -> str:
        """Breaks user, assistant, user, ... starting at turn ``lead``."""
        beat = f"CASE WHEN {at} % 2 = {lead} THEN 'user' ELSE 'assistant' END"
        return f"{at} >= {lead} AND NOT ({who} <=> {beat})"

    message = f"struct({at} AS i, {who} AS role, {what} AS content)"
    grouped = turns.groupBy(key).agg(
        F.expr(f"array_sort(collect_list({message})) AS __turns"),
        F.expr("count(*) AS __n"),
        # Numbers that are 0..n-1: by count, ends, sum and sum of squares.
        F.expr(f"count({at}) AS __numbered"), F.expr(f"min({at}) AS __lo"), F.expr(f"max({at}) AS __hi"),
        F.expr(f"sum({at}) AS __sum"), F.expr(f"sum(CAST({at} AS DECIMAL(19, 0)) * {at}) AS __squares"),
        any_true(is_role("user"), "has_user"),
        any_true(is_role("assistant"), "has_assistant"),
        any_true(is_role("system"), "has_system"),
        F.expr(f"coalesce(max(CASE WHEN {is_role('assistant')} THEN {at} END), -1L) AS last_assistant"),
        any_true(f"{who} IS NULL OR {what} IS NULL", "malformed"),
        # With a leading system turn the alternation starts behind it.
        F.expr(
            f"NOT coalesce(CASE WHEN bool_or({at} = 0 AND {is_role('system')}) THEN bool_or({off_beat(1)})"
            f" ELSE bool_or({off_beat(0)}) END, false) AS alternates"
        ),
    )
    n = "CAST(__n AS DECIMAL(19, 0))"
    wrong = f"raise_error('turns are not numbered 0..n-1 in ' || string(`{key}`))"
    checked = (
        f"CASE WHEN __numbered = __n AND __lo = 0 AND __hi = __n - 1 AND 2 * __sum = {n} * (__n - 1)"
        f" AND 6 * __squares = {n} * (__n - 1) * (2 * __n - 1) THEN __n ELSE {wrong} END AS n_messages"
    )
    return grouped.select(
        F.col(key),
        F.expr(
            "CASE WHEN transform(__turns, m -> bigint(m.i)) = sequence(0L, __n - 1)"
            " THEN transform(__turns, m -> struct(m.role AS role, m.content AS content))"
            f" ELSE {wrong} END AS messages"
        ),
        F.expr(f"struct({checked}, has_user, has_assistant, has_system, last_assistant, malformed, alternates) AS facts"),
    )
