"""Quotation linking: messages that quote others become replies to them, and lose the quotes.

Lines that begin with quote marks are parsed to levels. Lines of one level that follow each other without a blank one are a passage; a passage's
words, normalised and joined, are hashed, so that a quotation that was wrapped anew has its original's hash, and so is each line, for quotations
of a part. Each quoted line links to the last earlier turn that has its passage, or else its line. A message replies to the turn that
most of the lines at its shallowest linked level come from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewave.llm.store import written

#: Fixed patterns: quote marks at the start of a line, a line that only introduces a quotation, and what normalising takes for a space.
MARKS, INTRODUCES, APART = r"^[ \t]*(?:>[ \t]?)+", r"(?i)^(?:on|le|am|el)\b.*(?:wrote|écrit|schrieb|escribió)[ \t]*:[ \t]*$", r"[^\p{L}\p{N}]+"
#: Turns of one conversation that are looked through in one group.
TURNS = 1 << 12


def _lines(text: Column) -> Column:
    """Lines with their levels, bodies and normalised bodies."""
    raw = F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n", -1)
    return F.transform(raw, lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[^>]", "")).alias("level"), F.regexp_replace(x, MARKS, "").alias("body"), F.trim(F.regexp_replace(F.lower(F.regexp_replace(x, MARKS, "")), APART, " ")).alias("norm")))


def _kinds(lines: Column) -> Column:
    """Of each line its level, -1 if it is blank, -2 if it only introduces the quotation that the next line begins."""
    introduces = lambda x, i: (x["level"] == 0) & x["body"].rlike(INTRODUCES) & F.coalesce(F.get(lines, i + 1)["level"] > 0, F.lit(False))
    return F.transform(lines, lambda x, i: F.when(x["norm"] == "", -1).when(introduces(x, i), -2).otherwise(x["level"]))


def _starts(kinds: Column) -> Column:
    """Places where runs of lines of one kind start."""
    return F.filter(F.sequence(F.lit(0), F.size(kinds) - 1), lambda i: (i == 0) | (F.get(kinds, i) != F.get(kinds, i - 1)))


def _runs(kinds: Column, starts: Column) -> Column:
    """(start, n, kind) of each run."""
    return F.transform(starts, lambda s, j: F.struct(s.alias("start"), (F.coalesce(F.get(starts, j + 1), F.size(kinds)) - s).alias("n"), F.get(kinds, s).alias("kind")))


def _passages(lines: Column, runs: Column) -> Column:
    """(level, passage, lines) of runs: hashes of the words of the whole run, and of each line."""
    norms = lambda r: F.transform(F.slice(lines, r["start"] + 1, r["n"]), lambda x: x["norm"])
    return F.transform(runs, lambda r: F.struct(r["kind"].alias("level"), F.xxhash64(F.array_join(norms(r), " ")).alias("passage"), F.transform(norms(r), lambda x: F.xxhash64(x)).alias("lines")))


def _origins(asks: DataFrame, has: DataFrame) -> DataFrame:
    """(conv_id, turn, key, origin): the last turn of has (conv_id, turn, key) before each of asks. Long conversations are cut into blocks of turns; what a
    block has last is carried to the later ones, so no group holds all turns of one key."""
    x = asks.withColumn("own", F.lit(False)).unionByName(has.withColumn("own", F.lit(True))).withColumn("block", F.floor(F.col("turn") / TURNS))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(F.col("own"), F.col("turn"))
    near = x.withColumn("near", F.max(own).over(before(Window.partitionBy("conv_id", "key", "block").orderBy("turn", "own"))))
    last = x.filter("own").groupBy("conv_id", "key", "block").agg(F.max("turn").alias("last"))
    blocks = x.select("conv_id", "key", "block").distinct().join(last, ["conv_id", "key", "block"], "left")
    far = blocks.withColumn("far", F.max("last").over(before(Window.partitionBy("conv_id", "key").orderBy("block")))).drop("last")
    found = near.filter("not own").join(far, ["conv_id", "key", "block"]).select("conv_id", "turn", "key", F.coalesce("near", "far").alias("origin"))
    return found.filter("origin is not null")


def link_quotes(messages: DataFrame) -> DataFrame:
    """One row per message (conv_id, turn, role, text): conv_id, turn, role, parent_turn, root_turn, depth, n_quoted, n_linked, text; in the order of
    conv_id, root_turn, depth, turn, in which each reply comes after what it replies to.

    parent_turn is the turn replied to (null: none); root_turn and depth place the message in its thread. n_quoted counts quoted lines, n_linked those that
    an earlier turn has, as lines or as part of a passage. text is without quoted lines and lines that introduce them. Lines without
    letters and digits link nothing. Where two turns have as many lines, the later is the parent. A null text has no lines and stays null; rows with
    a null conv_id or turn link with nothing. Rows that repeat a conv_id and turn keep their own text and share the links of all. No
    rows give none. Other columns are ignored.
    """
    lines = messages.withColumn("_lines", F.when(F.col("text").isNotNull(), _lines(F.col("text"))))
    has_quotes = F.contains("text", F.lit(">"))
    base = lines.select("conv_id", "turn", "role", "text", "_lines", _kinds(F.col("_lines")).alias("_kinds"))
    keyed = base.filter("conv_id is not null and turn is not null and _lines is not null").withColumn("_starts", _starts(F.col("_kinds")))
    keyed = keyed.withColumn("_runs", _runs(F.col("_kinds"), F.col("_starts")))
    of_kind = lambda x, which: x.select("conv_id", "turn", "text", "_lines", F.filter("_runs", which).alias("_runs"))
    asks = of_kind(keyed.filter(has_quotes), lambda r: r["kind"] > 0).select("conv_id", "turn", F.explode(_passages(F.col("_lines"), F.col("_runs"))).alias("x"))
    asks = written(asks.select("conv_id", "turn", "x.level", "x.passage", F.explode("x.lines").alias("line")).distinct())
    some = of_kind(keyed.join(asks.select("conv_id").distinct(), "conv_id", "left_semi"), lambda r: r["kind"] == 0).select("conv_id", "turn", _passages(F.col("_lines"), F.col("_runs")).alias("x"))
    own_keys = F.array_distinct(F.concat(F.transform("x", lambda p: p["passage"]), F.flatten(F.transform("x", lambda p: p["lines"]))))
    has = some.select("conv_id", "turn", F.explode(own_keys).alias("key")).distinct()
    origins = written(_origins(asks.select("conv_id", "turn", F.explode(F.array("line", "passage")).alias("key")).distinct(), has))
    of = lambda key: origins.select("conv_id", "turn", F.col("key").alias(key), F.col("origin").alias(f"{key}_origin"))
    found = asks.join(of("passage"), ["conv_id", "turn", "passage"], "left").join(of("line"), ["conv_id", "turn", "line"], "left")
    found = found.withColumn("origin", F.coalesce("passage_origin", "line_origin")).filter("origin is not null")
    # a line that stands in several passages of a level counts once, for the last of its origins
    found = written(found.groupBy("conv_id", "turn", "level", "line").agg(F.max("origin").alias("origin")))
    votes = found.groupBy("conv_id", "turn", "level", "origin").agg(F.count(F.lit(1)).alias("n"))
    parents = written(votes.groupBy("conv_id", "turn").agg(F.max_by("origin", F.struct(-F.col("level"), "n", "origin")).alias("parent_turn")))
    linked = found.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_linked"))
    # pointer doubling: each round halves the way to the root
    up = parents.select("conv_id", "turn", F.col("parent_turn").alias("root"), F.lit(1).alias("depth"))
    while True:
        above = up.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        moved = written(up.join(above, ["conv_id", "root"], "left").select("conv_id", "turn", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")))
        up = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            break
    place = parents.join(up, ["conv_id", "turn"]).join(linked, ["conv_id", "turn"])
    own = F.filter("_lines", lambda x, i: (x["level"] == 0) & (F.get(F.col("_kinds"), i) > -2))
    text = F.when(~has_quotes | F.col("text").isNull(), F.col("text")).otherwise(F.regexp_replace(F.array_join(F.transform(own, lambda x: x["body"]), "\n"), r"^\n+|\n+$", ""))
    n_quoted = F.when(has_quotes, F.size(F.filter("_lines", lambda x: x["level"] > 0))).otherwise(0)
    out = base.select("conv_id", "turn", "role", F.coalesce(n_quoted, F.lit(0)).alias("n_quoted"), text.alias("text")).join(place, ["conv_id", "turn"], "left")
    out = out.select("conv_id", "turn", "role", "parent_turn", F.coalesce("root", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).alias("depth"), "n_quoted", F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"), "text")
    return out.orderBy("conv_id", "root_turn", "depth", "turn")
