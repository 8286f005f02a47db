"""Order-dependent work without ordering the whole table in one place.

A DataFrame has no order, so every operator here takes a ``RowOrder``: a bigint
key, a tie-break, and the bit shifts that cut the key into nested blocks. Rows
are only ever sorted inside their finest block; sums or counts per block are
combined one level up at a time. So one group may own any share of the table:
with unique keys no window holds more than 65,536 rows or block totals, the top
one included, even for ids that use all of 63 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.window import WindowSpec

from turnloom.config import DEFAULT_SEED

_HASH_DIGITS = 15  # hex digits of md5 that fit a non-negative bigint


@dataclass(frozen=True)
class RowOrder:
    """``key`` ascending, then ``tie``; ``shifts`` from the finest block up."""

    key: Column
    tie: tuple[str, ...] = ()
    shifts: tuple[int, ...] = (16, 32, 48)


def shuffle_key(*ids: str, seed: int = DEFAULT_SEED) -> Column:
    """Seeded pseudo-random bigint of a row id, the same on any cluster."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in ids])
    return F.conv(F.substring(F.md5(text), 1, _HASH_DIGITS), 16, 10).cast("bigint")


def shuffled(*ids: str, seed: int = DEFAULT_SEED) -> RowOrder:
    """Seeded shuffle of rows with unique ids. 65,536 evenly filled blocks."""
    return RowOrder(shuffle_key(*ids, seed=seed), tuple(ids), (44,))


def by_column(name: str, *tie: str, bits: int = 16) -> RowOrder:
    """Order of a whole-number column that is unique within its group, in finest blocks of ``2 ** bits`` keys."""
    return RowOrder(F.col(name).cast("bigint"), tie, tuple(range(bits, 64, 16)))


def order_of(df: DataFrame, name: str) -> RowOrder:
    """Order by a column: whole numbers by value, anything else by hash, then value."""
    return by_column(name) if isinstance(df.schema[name].dataType, T.IntegralType) else shuffled(name)


def _preceding(window: WindowSpec, sums: list[str], lags: list[str], latest: list[str]) -> dict[str, Column]:
    """Exclusive sums, previous values and last known values along a window, as ``__o`` columns."""
    before = window.rowsBetween(W.unboundedPreceding, -1)
    found = {f"__o{c}": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in sums}
    found |= {f"__o{c}": F.last(c, ignorenulls=True).over(before) for c in latest}
    found |= {f"__o{c}": F.lag(c).over(window) for c in lags}
    # Tells a previous value that is null from having no previous row.
    return found | ({"__first": F.row_number().over(window) == 1} if lags else {})


def ordered_scan(
    df: DataFrame,
    order: RowOrder,
    *,
    by: Sequence[str] = (),
    sums: Mapping[str, Column] | None = None,
    lags: Mapping[str, Column] | None = None,
    latest: Mapping[str, Column] | None = None,
    totals: Mapping[str, Column] | None = None,
    block: str | None = None,
) -> DataFrame:
    """Add running values of each ``by`` group, in ``order``.

    ``sums``: sum over the earlier rows of the group. ``lags``: value of the
    previous row. ``latest``: value of the last earlier row that has one (is not
    null). ``totals``: sum over the whole group. ``block``: name for the number of
    the finest block. The rows are shuffled once, by group and finest block, and
    stay so: grouping by both moves nothing. The input is read twice, so hand in a
    stored table or one that is cheap to derive.
    """
    sums, lags, latest, totals = dict(sums or {}), dict(lags or {}), dict(latest or {}), dict(totals or {})
    s_col = {n: f"__s{i}" for i, n in enumerate(sums)}
    l_col = {n: f"__l{i}" for i, n in enumerate(lags)}
    t_col = {n: f"__t{i}" for i, n in enumerate(totals)}
    k_col = {n: f"__a{i}" for i, n in enumerate(latest)}
    added, carried, whole, known = list(s_col.values()), list(l_col.values()), list(t_col.values()), list(k_col.values())
    group = ["__g"] if by else []
    flag = ["__first"] if carried else []

    work = df.withColumns(
        {"__k": order.key}
        | ({"__g": F.struct(*by)} if by else {})
        | {s_col[n]: e for n, e in sums.items()}
        | {t_col[n]: e for n, e in totals.items()}
        | {l_col[n]: e for n, e in lags.items()}
        | {k_col[n]: e for n, e in latest.items()}
    ).withColumn("__b0", F.shiftright("__k", order.shifts[0]))

    def rollup(table: DataFrame, block: str, newest: Column) -> DataFrame:
        return table.groupBy(*group, block).agg(
            F.count(F.lit(1)).alias("__n"),
            *[F.sum(c).alias(c) for c in added + whole],
            *[F.max_by(c, newest).alias(c) for c in carried],
            *[F.max_by(c, F.when(F.col(c).isNotNull(), newest)).alias(c) for c in known],
        )

    # Up: totals of the finest blocks, then of the blocks of blocks.
    newest = F.struct("__k", *order.tie) if order.tie else F.col("__k")
    table = rollup(work, "__b0", newest)
    levels = []
    for i in range(1, len(order.shifts)):
        step = order.shifts[i] - order.shifts[i - 1]
        table = table.withColumn(f"__b{i}", F.shiftright(f"__b{i - 1}", step))
        levels.append(table)
        table = rollup(table, f"__b{i}", F.col(f"__b{i - 1}"))

    # Down: what precedes each block, starting from the few coarsest ones.
    offsets = [f"__o{c}" for c in added + carried + known] + flag
    finals = [f"__w{c}" for c in whole]
    top = len(order.shifts) - 1
    along = W.partitionBy(*group).orderBy(f"__b{top}")
    entire = {f"__w{c}": F.sum(c).over(W.partitionBy(*group)) for c in whole}
    table = table.withColumns(_preceding(along, added, carried, known) | entire)
    table = table.select(*group, f"__b{top}", *offsets, *finals)

    def descend(inner: DataFrame, outer: DataFrame, block: str, kept: list[Column]) -> DataFrame:
        """Add what precedes the outer block to what precedes within it."""
        outer = outer.withColumnsRenamed({c: f"__up{c}" for c in offsets})
        both = inner.join(outer, group + [block], "left")
        first, up_first = F.col("__first"), F.col("__up__first")
        return both.select(
            *kept,
            *[(F.col(f"__o{c}") + F.col(f"__up__o{c}")).alias(f"__o{c}") for c in added],
            *[F.when(first, F.col(f"__up__o{c}")).otherwise(F.col(f"__o{c}")).alias(f"__o{c}") for c in carried],
            *[F.coalesce(f"__o{c}", f"__up__o{c}").alias(f"__o{c}") for c in known],
            *([(first & up_first).alias("__first")] if flag else []),
            *finals,
        )

    for i in range(top, 0, -1):
        along = W.partitionBy(*group, f"__b{i}").orderBy(f"__b{i - 1}")
        inner = levels[i - 1].withColumns(_preceding(along, added, carried, known))
        table = descend(inner, table, f"__b{i}", [F.col(c) for c in group + [f"__b{i - 1}"]])

    along = W.partitionBy(*group, "__b0").orderBy("__k", *order.tie)
    rows = work.withColumns(_preceding(along, added, carried, known))
    replaced = s_col | l_col | k_col | t_col
    kept = [c for c in df.columns if c not in replaced]
    rows = descend(rows, table, "__b0", [F.col(c) for c in [*kept, *(["__b0"] if block else [])]])
    names = s_col | l_col | k_col
    return rows.select(
        *kept,
        *([F.col("__b0").alias(block)] if block else []),
        *[F.col(f"__o{c}").alias(n) for n, c in names.items()],
        *[F.col(f"__w{c}").alias(n) for n, c in t_col.items()],
    )


def global_index(
    df: DataFrame,
    order: RowOrder,
    *,
    by: Sequence[str] = (),
    name: str = "position",
    total: str | None = None,
) -> DataFrame:
    """Add the exact 0-based position of each row, in the table or its group."""
    one = F.lit(1).cast("bigint")
    return ordered_scan(
        df, order, by=by, sums={name: one}, totals={total: one} if total else None
    )


def counted_blocks(
    rows: DataFrame, order: RowOrder, by: Sequence[str] = (), total: str | None = None
) -> DataFrame:
    """The finest blocks of each group: ``block``, its rows ``n``, the rows ``before`` it.

    ``rows`` holds the order key as ``__k``. One pass over it; the rest works on
    the counts.
    """
    block = F.shiftright("__k", order.shifts[0]).alias("block")
    counts = rows.groupBy(*by, block).agg(F.count(F.lit(1)).alias("n"))
    n, finest = F.col("n"), order.shifts[0]
    if len(order.shifts) > 1:
        blocks = RowOrder(F.col("block"), (), tuple(s - finest for s in order.shifts[1:]))
        totals = {total: n} if total else None
        return ordered_scan(counts, blocks, by=by, sums={"before": n}, totals=totals)
    group = W.partitionBy(*by)
    placed = counts.withColumn("before", F.sum("n").over(group.orderBy("block")) - n)
    return placed.withColumn(total, F.sum("n").over(group)) if total else placed


def cutoff(df: DataFrame, order: RowOrder, position: Callable[[Column], Column]) -> Column:
    """Order key of the row at a 1-based position, as a literal.

    ``position`` maps the number of rows to the position wanted. Counts keys per
    block and sorts only the block with the position; both run here and now, and
    one row comes back, so that the rows themselves never move and the plan that
    compares with the key does not count again. Null if there is no such row.
    The keys are read twice, so hand in a stored table or a cheap one.
    """
    slim = df.select(order.key.alias("__k"), *order.tie)
    rank = position(F.col("total")).cast("bigint") - F.col("before")
    found = _block_at(slim, order, rank)
    block = F.shiftright("__k", order.shifts[0])
    # A bare key where there is no tie-break: file scans can compare with that.
    key = F.struct("__k", *order.tie) if order.tie else F.col("__k")
    kind = slim.select(key.alias("key")).schema["key"].dataType
    row = None
    if found is not None:
        w = W.partitionBy(block).orderBy("__k", *order.tie)
        ranked = slim.filter(block == found["block"]).withColumn("__rn", F.row_number().over(w))
        row = ranked.filter(F.col("__rn") == found["rank"]).select(key.alias("key")).first()
    if row is None:
        return F.lit(None).cast(kind)
    if not order.tie:
        return F.lit(row["key"])
    return F.struct(*[F.lit(row["key"][f.name]).cast(f.dataType).alias(f.name) for f in kind.fields])


def _block_at(slim: DataFrame, order: RowOrder, rank: Column) -> Row | None:
    """The block in which a position falls and the position in it, worked out at once."""
    counted = counted_blocks(slim, order, total="total").select("block", "n", rank.alias("rank"))
    return counted.filter("rank BETWEEN 1 AND n").select("block", "rank").first()


def not_after(order: RowOrder, cut: Column) -> Column:
    """Whether a row comes no later than a cutoff; null if there is none.

    Without a tie-break this is a plain comparison, which file scans take over.
    """
    if order.tie:
        return F.struct(order.key.alias("__k"), *order.tie) <= cut
    return order.key <= cut


_LAST_KEY = 2**63 - 1


def total_order(order: RowOrder, df: DataFrame) -> tuple[Column, list[Column]]:
    """Key and tie of rows that may lack a key or repeat one: null keys come
    last, and what the tie leaves open is ordered by the other whole numbers of
    the row. Texts are not read for it; rows that differ in those alone may
    stand in for each other."""
    key = F.coalesce(order.key, F.lit(_LAST_KEY))
    numbers = [F.col(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)]
    return key, [order.key.isNull(), *[F.col(c) for c in order.tie], *numbers]


def first_n(df: DataFrame, order: RowOrder, n: int) -> DataFrame:
    """Exactly the first ``n`` rows, or all of them if there are fewer.

    Null keys come last; of rows with one key and tie as many are taken as are
    wanted. The block in which the count falls is found at once, from counts of
    keys; blocks before it are taken by a plain comparison, which file scans take
    over, and only that block is ranked. The input is read more than once, so
    hand in a stored table or a cheap one.
    """
    key, tie = total_order(order, df)
    rank = F.least(F.lit(n).cast("bigint"), F.col("total")) - F.col("before")
    found = _block_at(df.select(key.alias("__k")), order, rank)
    if found is None:
        return df.limit(0)
    size = 1 << order.shifts[0]
    first = found["block"] * size
    before = df.filter(order.key < F.lit(first))
    last = first + size > _LAST_KEY
    block = order.key.isNull() | (order.key >= F.lit(first)) if last else (order.key >= F.lit(first)) & (order.key < F.lit(first + size))
    w = W.partitionBy(F.shiftright(key, order.shifts[0])).orderBy(key, *tie)
    ranked = df.filter(block).withColumn("__rn", F.row_number().over(w))
    return before.unionAll(ranked.filter(F.col("__rn") <= found["rank"]).select(*[F.col(f"`{c}`") for c in df.columns]))


def last_of_each(
    df: DataFrame, keys: Sequence[str], version: Sequence[str]
) -> DataFrame:
    """One row per key: the one with the highest version columns."""
    rest = [c for c in df.columns if c not in keys]
    packed = F.max_by(F.struct(*rest), F.struct(*version)).alias("__row")
    latest = df.groupBy(*keys).agg(packed)
    return latest.select(*[F.col(c) if c in keys else F.col(f"__row.{c}") for c in df.columns])
