"""Cut an ordering into pieces of about equally many rows, whatever the values are.

The rows of one key, one hour or one instant may be most of a table, so fixed slices of time do not bound a task. A row
sample, sorted by (keys, order), gives the splitters; every row finds its piece by binary search among them. The
splitters are constants of the plan: a row falls into the same piece in every branch and in every retry of a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE_ROWS = 1 << 18
MOST_PIECES = 4096
PER_PIECE = 16  # sampled rows a piece


def piece_of(df: DataFrame, by: Sequence[Column], piece_rows: int | None = None) -> Column:
    """The number of the piece a row of ``df`` falls in: it never falls along ``by``, and equal ``by`` share a piece.

    There are as many pieces as ``piece_rows`` goes into the row count, MOST_PIECES at most; rows beyond make the pieces
    larger, not more. ``by`` may hold nulls. Splitters travel as JSON, which may round them: any splitters are valid.
    """
    count = df.count()
    n = min(MOST_PIECES, -(-count // (piece_rows or PIECE_ROWS)))
    if n < 2:
        return F.lit(0)
    row = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(by)])
    keys = df.select(row.alias("r"))
    share = min(1.0, PER_PIECE * n / count)
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    sample = keys.sample(share, seed=7).orderBy("r").select(F.to_json("r", exact).alias("j"))
    got = [x.j for x in sample.limit(2 * PER_PIECE * n).collect()]  # bounded by MOST_PIECES
    if not got:
        return F.lit(0)
    cuts = list(dict.fromkeys(got[len(got) * i // n] for i in range(1, n)))
    table = F.from_json(F.lit("[" + ",".join(cuts) + "]"), f"array<{keys.schema['r'].dataType.simpleString()}>", exact)
    steps = F.array(*[F.lit(1 << k) for k in range(len(cuts).bit_length() - 1, -1, -1)])
    # how many splitters are at or below the row: each step is taken where the splitter it ends on is not above
    taken = lambda at, s: F.when(F.get(table, at + s - 1) <= row, at + s).otherwise(at)
    return F.aggregate(steps, F.lit(0), taken)
