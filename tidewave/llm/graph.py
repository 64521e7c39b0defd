"""Connected components of a table of links, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewave.llm.store import counted, discard, written


def _followed(hook: DataFrame) -> DataFrame:
    """(id, root): where the hooks of hook (id, root) end. Each round follows four of them at once."""
    while True:
        x = hook.withColumn("last", F.col("root"))
        for _ in range(3):
            x = x.select("id", F.col("root").alias("last"), F.col("root").alias("at")).join(hook.select(F.col("id").alias("at"), "root"), "at").select("id", "last", "root")
        x, moved = counted(x.select("id", "root", (F.col("root") != F.col("last")).alias("moved")), F.col("moved"))
        discard(hook)
        hook = x
        if not moved:
            return hook


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for each id in links (a long, b long).

    Each round hooks every vertex to its least neighbour, follows the hooks to their roots by pointer jumping, and relabels the
    links by root; it ends when no link joins two roots. No vertex's links meet in one task: minima are pre-aggregated
    and joins may be split. Null ends, loops and repeated links are ignored; no links give no rows.
    """
    links = written(links.select("a", "b").filter("a <> b").distinct())
    label = None
    while True:
        both = links.select("a", "b").union(links.select("b", "a"))
        hook = _followed(written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("root")).select("id", F.least("id", "root").alias("root"))))
        first, old = label is None, label
        if first:
            label = hook
        else:
            label = written(label.join(hook.select(F.col("id").alias("root"), F.col("root").alias("next")), "root", "left").select("id", F.coalesce("next", "root").alias("root")))
            discard(old)
        of = lambda end: hook.select(F.col("id").alias(end), F.col("root").alias(f"{end}_root"))
        above, links = links, links.join(of("a"), "a").join(of("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).filter("a <> b").distinct()
        links, apart = counted(links)
        discard(above, None if first else hook)
        if not apart:
            discard(links)
            return label.select("id", F.col("root").alias("component"))
