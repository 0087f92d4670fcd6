"""Ordered computations that stay parallel when one key holds most of the rows.

``Window.partitionBy(key).orderBy(ts)`` puts a whole series into one task. The helpers here cut each series into
pieces first and move only what a frame needs across the cuts:

* ``row_frames``   fixed ROWS frames: blocks of consecutive rows plus a halo of neighbours (exact, gaps allowed);
* ``prefix_sums``  sums over the earlier rows of a key: the totals of the pieces before, plus those inside the piece;
* ``numbered``     global row numbers and row counts per key, from per-piece counts;
* ``running_last`` last non-null value so far: one value per (key, piece) is carried into the next pieces;
* ``asof_join`` / ``nearest_join``  built on the above.

A *piece* is a range of (key, order) that holds about as many rows as any other (``pieces.piece_of``), so one hot key
or one crowded hour is cut like everything else. The only per-key windows left run over one row per (key, piece).
Where ``slice_seconds`` is given, pieces are fixed stretches of time instead: no row is sampled, which suits series on
a grid (bars, days), whose rows per stretch the calendar bounds. Key columns must not be null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .pieces import piece_of

DAY = 86400
BAR_SLICE = 30 * DAY
BLOCK_ROWS = 8192


def slice_of(ts: str | Column, seconds: int) -> Column:
    """Number of the fixed time slice a timestamp falls in."""
    return F.floor(F.unix_seconds(F.col(ts) if isinstance(ts, str) else ts) / F.lit(seconds))


def _pieces(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_seconds: int | None) -> Column:
    if slice_seconds:
        return slice_of(order[0], slice_seconds)
    return piece_of(df, [F.col(c) for c in (*keys, *order)])


def prefix_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], before: dict[str, Column],
    whole: dict[str, Column] | None = None, following: dict[str, Column] | None = None, slice_seconds: int | None = None,
) -> DataFrame:
    """Add each name in ``before``: the sum of its column over the earlier rows of the key (0 for the first).

    Each name in ``whole`` is the sum over all rows of the key, each in ``following`` the next row's value (null for the
    last). Rows are shuffled once; what crosses the cuts is one row per key and piece. ``order`` should tell rows apart:
    which of two rows that are alike in all of it comes first is left open, and such rows share a piece.
    """
    keys, whole, following = list(keys), whole or {}, following or {}
    by_key, places = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("__s")
    sliced = df.withColumn("__s", _pieces(df, keys, order, slice_seconds))
    rank = F.struct(*[F.col(c) for c in order])
    sums = {f"__b{i}": F.sum(c) for i, c in enumerate(before.values())} | {f"__w{i}": F.sum(c) for i, c in enumerate(whole.values())}
    heads = {f"__f{i}": F.min_by(F.struct(c.alias("v")), rank) for i, c in enumerate(following.values())}
    totals = sliced.groupBy(*keys, "__s").agg(*[a.alias(n) for n, a in (sums | heads).items()])
    past = places.rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *keys, "__s",
        *[F.coalesce(F.sum(f"__b{i}").over(past), F.lit(0)).alias(f"__b{i}") for i in range(len(before))],
        *[F.sum(f"__w{i}").over(by_key).alias(f"__w{i}") for i in range(len(whole))],
        *[F.lead(n).over(places).alias(n) for n in heads],
    )
    inside = Window.partitionBy(*keys, "__s").orderBy(*order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    own = {f"__o{i}": F.coalesce(F.sum(c).over(earlier), F.lit(0)) for i, c in enumerate(before.values())}
    own |= {f"__n{i}": F.lead(F.struct(c.alias("v"))).over(inside) for i, c in enumerate(following.values())}
    return (
        sliced.withColumns(own)
        .join(starts, [*keys, "__s"])
        .withColumns({n: F.col(f"__b{i}") + F.col(f"__o{i}") for i, n in enumerate(before)})
        .withColumns({n: F.col(f"__w{i}") for i, n in enumerate(whole)})
        .withColumns({n: F.coalesce(f"__n{i}", f"__f{i}")["v"] for i, n in enumerate(following)})
        .drop("__s", *sums, *heads, *own)
    )


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_seconds: int | None = None,
    following: dict[str, Column] | None = None,
) -> DataFrame:
    """Add ``__rn`` (1-based row number in the key's order) and ``__n`` (rows of the key).

    Each name in ``following`` is the next row's value of its column.
    """
    one = F.lit(1).cast("bigint")
    rows = prefix_sums(df, keys, order, {"__rn": one}, {"__n": one}, following, slice_seconds)
    return rows.withColumn("__rn", F.col("__rn") + 1)


def row_frames(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    add: Callable[[DataFrame, WindowSpec], DataFrame],
    *,
    back: int = 0,
    ahead: int = 0,
    slice_seconds: int | None = None,
    block_rows: int = BLOCK_ROWS,
    keep_number: bool = False,
) -> DataFrame:
    """Run ``add(rows, w)`` with a window ``w`` whose ROWS frames may reach ``back`` rows back and ``ahead`` rows on.

    ``add`` sees ``__rn`` and ``__n`` and must keep every row. Rows that are numbered already are not counted again.
    Stacked frames need the sum of their reaches.
    """
    keys = list(keys)
    size = max(block_rows, back + ahead + 1)
    rows = df if "__rn" in df.columns else numbered(df, keys, order, slice_seconds)
    home = F.floor((F.col("__rn") - 1) / F.lit(size))
    place = (F.col("__rn") - 1) % F.lit(size)
    copies = [home]
    if back:
        copies.append(F.when(place >= size - back, home + 1))
    if ahead:
        copies.append(F.when((place < ahead) & (home > 0), home - 1))
    rows = rows.withColumn("__h", home)
    if len(copies) > 1:
        rows = rows.withColumn("__b", F.explode(F.array_compact(F.array(*copies))))
    else:
        rows = rows.withColumn("__b", F.col("__h"))
    out = add(rows, Window.partitionBy(*keys, "__b").orderBy("__rn"))
    out = out.filter(F.col("__b") == F.col("__h")).drop("__b", "__h")
    return out if keep_number else out.drop("__rn", "__n")


def full(w: WindowSpec, n: int, value: Column) -> Column:
    """``value`` once ``n`` rows of the key have been seen, else null."""
    return F.when(F.col("__rn") >= n, value)


def running_last(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, Column],
    slice_seconds: int | None = None,
) -> DataFrame:
    """Add each name in ``values``: its last non-null value at or before the row in the key's order."""
    keys, names = list(keys), list(values)
    v, e = {n: f"__v{i}" for i, n in enumerate(names)}, {n: f"__e{i}" for i, n in enumerate(names)}
    rows = df.withColumn("__s", _pieces(df, keys, order, slice_seconds)).withColumns({v[n]: values[n] for n in names})
    rank = F.struct(*[F.col(c) for c in order])
    ends = rows.groupBy(*keys, "__s").agg(
        *[F.max_by(v[n], F.when(F.col(v[n]).isNotNull(), rank)).alias(e[n]) for n in names]
    )
    before = Window.partitionBy(*keys).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "__s", *[F.last(e[n], ignorenulls=True).over(before).alias(e[n]) for n in names])
    inside = (
        Window.partitionBy(*keys, "__s").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        rows.withColumns({v[n]: F.last(v[n], ignorenulls=True).over(inside) for n in names})
        .join(carried, [*keys, "__s"])
        .withColumns({n: F.coalesce(v[n], e[n]) for n in names})
        .drop("__s", *v.values(), *e.values())
    )


def asof_join(
    left: DataFrame,
    rights: DataFrame | Sequence[tuple[DataFrame, Sequence[str]]],
    keys: Sequence[str],
    values: Sequence[str] = (),
    *,
    left_ts: str = "ts",
    right_ts: str = "ts",
    right_time_as: str | None = None,
    slice_seconds: int | None = None,
) -> DataFrame:
    """Left join on the last right row at or before the left time, per key.

    Several right sides, given as (frame, values), are matched in the same pass. A right side holds at most one row
    per key and time. ``keys`` may be empty: a series shared by all left rows. Left rows of one instant are told apart
    by a hash, so that an instant that most rows share is cut as well.
    """
    keys = list(keys)
    sides = [(rights, values)] if isinstance(rights, DataFrame) else list(rights)
    lcols = list(left.columns)
    both = left.select(
        *keys, F.col(left_ts).alias("__ts"), F.lit(len(sides)).alias("__side"), F.xxhash64(*lcols).alias("__tie"),
        F.struct(*lcols).alias("__l"),
    )
    for i, (right, names) in enumerate(sides):
        packed = F.struct(F.col(right_ts).alias("__rts"), *[F.col(n) for n in names])
        rhs = right.select(*keys, F.col(right_ts).alias("__ts"), F.lit(i).alias("__side"), packed.alias(f"__r{i}"))
        both = both.unionByName(rhs, allowMissingColumns=True)
    found_cols = {f"__m{i}": F.col(f"__r{i}") for i in range(len(sides))}
    found = running_last(both, keys, ["__ts", "__side", "__tie"], found_cols, slice_seconds)
    out = [F.col(f"__l.{c}").alias(c) for c in lcols]
    if right_time_as:
        out.append(F.col("__m0.__rts").alias(right_time_as))
    out += [F.col(f"__m{i}.{n}").alias(n) for i, (_, names) in enumerate(sides) for n in names]
    return found.filter(F.col("__side") == len(sides)).select(*out)


def grid_asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    step_seconds: int,
    *,
    left_ts: str = "ts",
    right_ts: str = "ts",
    right_time_as: str | None = None,
) -> DataFrame:
    """As-of join with a right side whose times lie on a grid (bars, daily series), one row per key and time at most.

    Each right row is repeated over the slots up to the next one, so the match is an equality of key and slot: left rows
    are neither sorted nor numbered, and a hot key is an ordinary skewed join. What is repeated is bounded by the
    calendar. Left rows after a key's last slot take that slot.
    """
    keys = list(keys)
    slot = lambda c: F.floor(F.unix_seconds(c) / F.lit(step_seconds))
    held = {n: f"__g{i}" for i, n in enumerate(values)}
    rows = right.select(
        *keys, slot(F.col(right_ts)).alias("__s"), F.col(right_ts).alias("__rt"), *[F.col(n).alias(g) for n, g in held.items()]
    )
    by_key = Window.partitionBy(*keys).orderBy("__s")  # one row per slot
    spans = rows.withColumn("__e", F.coalesce(F.lead("__s").over(by_key) - 1, F.col("__s")))
    filled = spans.withColumn("__s", F.explode(F.sequence("__s", "__e"))).drop("__e")
    last = rows.groupBy(*keys).agg(F.max("__s").alias("__last"))
    placed = left.join(last, keys, "left").withColumn("__s", F.least(slot(F.col(left_ts)), F.col("__last")))
    out = [F.col(c) for c in left.columns]
    if right_time_as:
        out.append(F.col("__rt").alias(right_time_as))
    return placed.join(filled, [*keys, "__s"], "left").select(*out, *[F.col(g).alias(n) for n, g in held.items()])


def nearest_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_id: Sequence[str],
    value: str,
    tolerance_s: float,
    *,
    extra_keys: Sequence[str] = (),
    how: str = "left",
) -> DataFrame:
    """For every left row the right ``value`` nearest in ``ts`` within the tolerance (inclusive, ties: earlier).

    ``left_id`` (with ``keys``) identifies a left row. ``extra_keys`` are right columns that each get their own match.
    The candidates are the last right row at or before and the first one after; both come from one running pass, so a
    crowded stretch of time is neither sorted in one task nor paired row by row.
    """
    keys, left_id, extra = list(keys), list(left_id), list(extra_keys)
    us = lambda: F.unix_micros("ts")
    each = [*keys, *extra]
    sides = left.select(*keys, *left_id, us().alias("__t"))
    if extra:  # a left row asks for the extra keys that occur in its bucket of the tolerance or in one beside it
        bucket = lambda t: F.floor(t / F.lit(int(tolerance_s * 1_000_000) + 1))
        kinds = right.select(*each, bucket(us()).alias("__k")).distinct()
        b = bucket(F.col("__t"))
        sides = sides.withColumn("__k", F.explode(F.array(b - 1, b, b + 1))).join(kinds, [*keys, "__k"]).drop("__k")
    sides = sides.distinct()
    marks = sides.select(*each, "__t", F.lit(1).alias("__side"), F.xxhash64(*left_id).alias("__tie"), F.struct(*left_id).alias("__l"))
    seen = right.select(*each, us().alias("__t"), F.lit(0).alias("__side"), F.struct(us().alias("t"), F.col(value).alias("v")).alias("__r"))
    both = marks.unionByName(seen, allowMissingColumns=True)
    past = running_last(both, each, ["__t", "__side", "__tie"], {"__p": F.col("__r")})
    # the same backwards; a right row at the very time has been found already
    turned = past.withColumns({"__t": -F.col("__t"), "__side": -F.col("__side")})
    found = running_last(turned, each, ["__t", "__side", "__tie"], {"__q": F.col("__r")}).filter("__l IS NOT NULL")
    at = -F.col("__t")
    back, ahead = at - F.col("__p.t"), F.col("__q.t") - at
    near = F.when(ahead < F.coalesce(back, ahead + 1), F.struct(ahead.alias("d"), F.col("__q.v").alias("v"))).otherwise(
        F.struct(back.alias("d"), F.col("__p.v").alias("v")))
    hits = found.withColumn("__m", near).filter(F.col("__m.d") <= int(tolerance_s * 1_000_000)).select(
        *each, *[F.col(f"__l.{c}").alias(c) for c in left_id], F.col("__m.v").alias(value))
    if how == "matches":
        return hits
    return left.join(hits, [*keys, *left_id], "left")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key; Spark trims each partition with a group limit before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
