"""Ordered scans whose state is more than a sum or a last value, in parallel over chunks.

Each chunk of a key is summed up as a function from the state it is entered with to the state it is left with: a short array of
steps. Functions of ``fan`` neighbouring chunks are composed to one, and so on up; the states are then handed down the same tree.
No row holds more than ``fan`` functions, however many chunks a key has.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN = 64


def handed_down(
    chunks: DataFrame,
    keys: Sequence[str],
    state: str,
    apply: Callable[[str, str], str],
    compose: Callable[[str, str, str], str],
    start: str,
    *,
    fan: int = FAN,
) -> tuple[DataFrame, DataFrame]:
    """(starts, last): keys, chunk and the ``state`` each chunk is entered with; keys and the state behind the last chunk.

    chunks: keys, ``chunk`` (a number from 0), ``steps``; read several times, so it should be a written table. In SQL text,
    ``apply(steps, state)`` is the state left with, ``compose(f, g, first)`` the steps of first f, then g, where ``first`` is the
    steps' array that a group begins with. ``start`` is the state before the first chunk.
    """
    top = chunks.agg(F.max("chunk")).first()[0] or 0
    level, levels = chunks.select(*keys, "chunk", "steps"), []
    while True:
        children = level.groupBy(*keys, F.expr(f"chunk div {fan}").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("chunk", "steps"))).alias("children"))
        levels.append(children)
        top //= fan
        if not top:
            break
        folded = f"aggregate(slice(children, 2, size(children)), children[0].steps, (f, c) -> {compose('f', 'c.steps', 'children[0].steps')})"
        level = children.selectExpr(*keys, "chunk", f"{folded} AS steps")
    walk = f"""aggregate(children, struct({{first}} AS {state}, slice(array(struct(0L AS chunk, {{first}} AS {state})), 1, 0) AS starts), (a, c) -> struct(
        {apply('c.steps', f'a.{state}')} AS {state}, concat(a.starts, array(struct(c.chunk AS chunk, a.{state} AS {state}))) AS starts))"""
    walked = levels[-1].select(*keys, F.expr(walk.format(first=start)).alias("walk"))
    last = walked.selectExpr(*keys, f"walk.{state} AS {state}")
    starts = walked.selectExpr(*keys, "inline(walk.starts)")
    for children in reversed(levels[:-1]):
        below = children.join(starts, [*keys, "chunk"]).select(*keys, F.expr(walk.format(first=state)).alias("walk"))
        starts = below.selectExpr(*keys, "inline(walk.starts)")
    return starts, last
