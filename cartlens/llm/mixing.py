"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sources share all words by weight; a target stops at `most` times the source's size and the excess goes to the
others by weight, until none is above. A document belongs to a shard by its hash. In each shard the words of a
source form a line of documents in seeded order, cut into blocks of equal words. The seats of a source, each one
word of its target, go to its lines by the highest quotients votes / (2k + 1), the votes being the line's part of
the target; this gives integer quotas per shard and source. A quota of several times the line takes every block so
often; the rest goes to blocks in seeded order, and ends within the last of them. A document takes the words of its blocks.

Block size is total / `BLOCKS`, so blocks are bounded by a parameter and the number of lines. It does not enter the
quotas: each source misses its target by at most half a word, and by one for a line that stops at `MOST` passes.

Defined results: a null text has no words and takes none; a null source is a source of its own, last in the order;
a source without words has no target; a null key is kept; repeated rows are mixed each; an empty table has an empty
result; `mixed` ignores other columns, `repeated` keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlens.llm.shared import written

#: Blocks in all, and shards.
BLOCKS = 1 << 16
SHARDS = 8
#: Pieces in which a line is summed, so that one source's line is no single task.
PIECES = 32
WEIGHTS = (5, 2, 1)
MOST = 3


def word_count(text: Column) -> Column:
    """Number of runs of characters that are no ASCII white space."""
    return F.coalesce(F.size(F.array_remove(F.split(text, r"[ \t-\r]+"), "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Filling up: sources stop in the order of most * size / weight. With the stopped ones ahead, the rest
    share what is left by weight, and the level at which that fits is the same for all.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    # one row per source; the running sums are over sources, not documents
    base = sizes.withColumn("w", cycle.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    rise = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(rise.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    share = F.sum("w").over(rise.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    filled = base.withColumns({"level": left / share, "stop": F.col("cap") / F.col("w")})
    # levels that their own source can hold fall from the first such source on
    level = F.max(F.when(F.col("level") <= F.col("stop"), F.col("level"))).over(every)
    return filled.withColumn("level", level).select(
        "source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.lit(0.0))).alias("target")
    )


def mixed(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17) -> DataFrame:
    """(key, size, source_size, target, taken, h) of every row; h is the seeded hash of the row."""
    name = F.coalesce(F.concat(F.lit("+"), F.col(source).cast("string")), F.lit("-"))
    h = F.xxhash64(F.lit(seed), F.col(key), F.col(text))
    rows = written(
        df.select(F.col(key).alias("_key"), name.alias("s"), word_count(F.col(text)).alias("size"), h.alias("h")), "mix-rows"
    ).withColumns({"shard": F.pmod("h", F.lit(SHARDS)).cast("int"), "u": F.shiftrightunsigned("h", 8)})
    rows = rows.withColumn("piece", F.pmod("u", F.lit(PIECES)).cast("int"))
    pieces = written(rows.groupBy("s", "shard", "piece").agg(F.sum("size").alias("words")), "mix-pieces")
    sizes = pieces.groupBy("s").agg(F.sum("words").alias("source_size"))
    plain = F.when(F.col("s") != "-", F.substring("s", 2, 2**31 - 1))
    aims = targets(sizes.withColumn("source", plain).select("source", "source_size"))
    aims = aims.select(F.coalesce(F.concat(F.lit("+"), "source"), F.lit("-")).alias("s"), "source_size", "target")
    total = pieces.agg(F.sum("words")).first()[0] or 0
    block = max(1, total // BLOCKS)

    lines = pieces.groupBy("s", "shard").agg(F.sum("words").alias("words")).where("words > 0")
    votes = lines.join(aims, "s").withColumn("vote", F.col("target") * F.col("words") / F.col("source_size")).where("vote > 0")
    taken = written(_quotas(votes), "mix-quotas")
    marks = written(_selected(taken, block, seed), "mix-blocks")

    # the line of a source in a shard: pieces one after the other, then documents in seeded order
    line = Window.partitionBy("s", "shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select("s", "shard", "piece", F.coalesce(F.sum("words").over(line), F.lit(0)).alias("start"))
    inside = Window.partitionBy("s", "shard", "piece").orderBy("u", "_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(starts, ["s", "shard", "piece"]).withColumn(
        "a", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    )
    placed = placed.join(aims, "s").join(taken.select("s", "shard", "whole"), ["s", "shard"], "left")
    for end, at in (("low", F.col("a")), ("high", F.col("a") + F.col("size"))):
        number = F.floor(F.greatest(at - 1, F.lit(0)) / block)
        here = marks.select("s", "shard", F.col("block").alias("_b"), "ahead", "part")
        placed = placed.withColumn("_b", number).join(here, ["s", "shard", "_b"], "left")
        reached = F.col("ahead") + F.least(at - F.col("_b") * block, F.col("part"))
        placed = placed.withColumn(end, F.coalesce(reached, F.lit(0))).drop("_b", "ahead", "part")
    words = F.coalesce(F.col("whole"), F.lit(0)) * F.col("size") + F.col("high") - F.col("low")
    return placed.select(F.col("_key").alias(key), "size", "source_size", "target", words.cast("long").alias("taken"), "h")


def _quotas(votes: DataFrame) -> DataFrame:
    """(s, shard, words, whole, rest): words by highest quotients, as whole passes over the line and further words."""
    source = Window.partitionBy("s")
    # votes sum to the target, so a quota is within the number of lines of its votes; only these seats are dealt one by one
    seats = votes.withColumn("n", F.count(F.lit(1)).over(source))
    seats = seats.withColumn("sure", F.greatest(F.floor("vote") - F.col("n"), F.lit(0)))
    seats = seats.withColumn("open", F.round("target") - F.sum("sure").over(source))
    tried = seats.withColumn("k", F.explode(F.sequence("sure", F.floor("vote") + F.col("n"))))
    rank = F.row_number().over(source.orderBy((F.col("vote") / (2 * F.col("k") + 1)).desc(), "shard", "k"))
    won = tried.withColumn("won", (rank <= F.col("open")).cast("long"))
    got = won.groupBy("s", "shard", "words", "sure").agg(F.sum("won").alias("won"))
    got = got.withColumn("quota", F.least(F.col("sure") + F.col("won"), MOST * F.col("words")))
    return got.select("s", "shard", "words", F.floor(F.col("quota") / F.col("words")).alias("whole"), (F.col("quota") % F.col("words")).alias("rest"))


def _selected(quotas: DataFrame, block: int, seed: int) -> DataFrame:
    """(s, shard, block, part, ahead): the words taken once more of each block, from its start, and those of the blocks ahead of it."""
    each = quotas.where("rest > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("words") / block) - 1)))
    line = Window.partitionBy("s", "shard")
    drawn = line.orderBy(F.xxhash64(F.lit(seed), "s", "shard", "block"), "block").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("size", F.least(F.lit(block), F.col("words") - F.col("block") * block))
    left = F.col("rest") - F.coalesce(F.sum("size").over(drawn), F.lit(0))
    each = each.withColumn("part", F.greatest(F.least("size", left), F.lit(0)))
    ahead = F.sum("part").over(line.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    return each.select("s", "shard", "block", "part", F.coalesce(ahead, F.lit(0)).alias("ahead"))


def repeated(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17) -> DataFrame:
    """The mix as rows of `df`: each document as often as the mix takes its words, the fraction by a seeded draw.

    On average every source has the words the mix takes of it; documents stay whole.
    """
    found = mixed(df, key, text, source, seed)
    draw = F.shiftrightunsigned("h", 12) / F.lit(float(1 << 52))
    times = F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + draw).cast("int")
    often = found.groupBy(F.col(key).alias("_k"), F.col("h").alias("_h")).agg(F.sum(times).alias("_all"), F.count(F.lit(1)).alias("_rows"))
    # rows that repeat a document share its copies; the first of them takes what does not divide
    h = F.xxhash64(F.lit(seed), F.col(key), F.col(text))
    joined = df.withColumn("_h2", h).join(often, (F.col("_h2") == F.col("_h")) & F.col(key).eqNullSafe(F.col("_k")))
    copies = F.sequence(F.lit(1), F.floor(F.col("_all") / F.col("_rows")).cast("int"))
    return joined.where(F.col("_all") >= F.col("_rows")).withColumn("_copy", F.explode(copies)).select(*df.columns)
