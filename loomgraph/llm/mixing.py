"""Temperature mixing of sources, realised as budgeted block permutations.

A source of token share p gets a weight in proportion to p ** a.  The exponent
is bisected in [0, 1]: it is the least flat mixture's, 1, where a target is out of
reach, else it meets a target entropy without repeating any source more often
than a limit allows.  A source's quota, weight times budget, buys whole passes
over its documents and the beginning of one more: documents are dealt to blocks
by a hash, blocks are permuted anew for each source and pass, and the last pass
takes whole blocks in its own order and stops inside a block, at the document at
which the quota is used up.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm import common

BLOCKS_BITS = 10
#: Sources that are broadcast at most; beyond it Spark shuffles.
BROADCAST_SOURCES = 100_000
ENTROPY_GAIN, MOST_REPEATS = 0.3, 4.0


def n_tokens(text: Column) -> Column:
    """Words and an end."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + 1


def exponent(stats: DataFrame, budget: int | None = None, entropy_gain: float = ENTROPY_GAIN, most_repeats: float = MOST_REPEATS, rounds: int = 6, ways: int = 16) -> tuple[float, float, int]:
    """(exponent, sum of p ** exponent, budget) for ``stats`` (source, tokens).

    The target entropy lies ``entropy_gain`` of the way from that of the shares to
    that of equal weights.  Four bisections at a time: each round adds up all
    sources for ``ways`` - 1 exponents between the bounds, in one aggregation.
    """
    total, n = stats.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    if not n:
        return 1.0, 1.0, budget or 0
    budget = total if budget is None else budget
    p = F.col("tokens") / F.lit(float(total))

    def at(exponents: list[float]) -> dict[float, tuple[float, float, float]]:
        """Exponent to (entropy, most repeats, sum)."""
        grid = stats.select(p.alias("p"), "tokens", F.explode(F.array(*map(F.lit, exponents))).alias("a"))
        w = F.pow("p", "a")
        sums = grid.groupBy("a").agg(F.sum(w).alias("z"), F.sum(w * F.log("p")).alias("l"), F.max(w / F.col("tokens")).alias("r")).collect()
        return {x.a: (math.log(x.z) - x.a * x.l / x.z, x.r / x.z * budget, x.z) for x in sums}

    low, high = 0.0, 1.0
    ends = at([0.0, 1.0])
    target = ends[1.0][0] + entropy_gain * (math.log(n) - ends[1.0][0])
    # Entropy and repeats both fall as the exponent grows: the least exponent that is under both bounds is sought.
    over = lambda v: v[0] > target or v[1] > most_repeats
    if over(ends[1.0]):
        low = high
    elif not over(ends[0.0]):
        high = low
    for _ in range(rounds if low < high else 0):
        grid = [low + (high - low) * i / ways for i in range(1, ways)]
        values = at(grid)
        low, high = max([low, *(a for a in grid if over(values[a]))]), min([high, *(a for a in grid if not over(values[a]))])
    return high, at([high])[high][2], budget


def place(block: Column, source: Column, epoch: Column) -> Column:
    """A block's place in a pass over a source: a permutation of all blocks for each (source, epoch)."""
    n = F.lit(1 << BLOCKS_BITS)
    odd = F.pmod(F.xxhash64(F.lit(7), source, epoch), F.lit(1 << BLOCKS_BITS - 1)) * 2 + 1
    return F.pmod(block * odd + F.pmod(F.xxhash64(F.lit(8), source, epoch), n), n).cast("int")


def ending(parts: DataFrame, quotas: DataFrame, by: list[str], name: str) -> DataFrame:
    """Of ``parts`` (source, ``by``, tokens) the one in which a source's ``rest`` runs out, as (source, ``name``, before).

    ``quotas`` (source, rest, before) says how many tokens lie before all of ``parts``.
    """
    order = Window.partitionBy("source").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    found = parts.withColumn("own", F.coalesce(F.sum("tokens").over(order), F.lit(0))).join(quotas, "source").withColumn("before", F.col("before") + F.col("own"))
    return found.filter("before < rest").groupBy("source").agg(F.max(F.struct(*by, "before")).alias("last")).select("source", *(F.col(f"last.{k}").alias(f"{name}_{k}") for k in by), F.col("last.before").alias("before"))


def passes(docs: DataFrame, budget: int | None = None, entropy_gain: float = ENTROPY_GAIN, most_repeats: float = MOST_REPEATS, seed: int = 1, text: str = "text") -> DataFrame:
    """All columns of ``docs`` (doc_id, source, text) and mix_tokens, mix_weight, mix_copies, mix_hash.

    A null source is a source of its own (the empty name), a null or empty text has
    one token, its end, a text of any length counts whole; rows repeated in full share a hash and are taken or left
    together, which may pass a quota by their tokens; an empty table gives no rows;
    input columns of the added names are replaced.
    """
    docs = docs.drop("mix_tokens", "mix_weight", "mix_copies", "mix_hash", "mix_source")
    h = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col(text))
    sized = docs.withColumns({"mix_tokens": n_tokens(F.col(text)), "mix_hash": h, "mix_source": F.coalesce("source", F.lit(""))})
    blocks = common.cut(sized.groupBy(F.col("mix_source").alias("source"), own_block(F.col("mix_hash")).alias("block")).agg(F.sum("mix_tokens").alias("tokens")))
    stats = blocks.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    a, z, budget = exponent(stats, budget, entropy_gain, most_repeats)
    total = F.lit(float(stats.agg(F.sum("tokens")).first()[0] or 1))
    weight = F.pow(F.col("tokens") / total, F.lit(a)) / F.lit(z)
    quotas = stats.select("source", weight.alias("weight"), F.floor(weight * budget / F.col("tokens")).cast("int").alias("whole"), (F.floor(weight * budget) % F.col("tokens")).alias("rest"))
    few = quotas.count() <= BROADCAST_SOURCES
    hinted = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    # The block in which the last pass ends, the part of it, then the document: each window has at most 2 ** BLOCKS_BITS
    # rows of a source, but the last, which has one part in 2 ** (2 * BLOCKS_BITS) of a source's documents.
    placed = blocks.join(hinted(quotas.select("source", "whole")), "source").select("source", place(F.col("block"), F.col("source"), F.col("whole")).alias("place"), "tokens")
    last = common.cut(ending(placed, quotas.select("source", "rest", F.lit(0).alias("before")), ["place"], "end"))
    ends = quotas.join(last, "source").select("source", "whole", "rest", "before", "end_place")
    mine = sized.select(F.col("mix_source").alias("source"), "mix_hash", "mix_tokens").join(hinted(ends), "source")
    mine = mine.filter(place(own_block(F.col("mix_hash")), F.col("source"), F.col("whole")) == F.col("end_place")).select("source", "mix_hash", F.shiftright("mix_hash", 64 - 2 * BLOCKS_BITS).alias("part"), "mix_tokens")
    mine = common.cut(mine.groupBy("source", "part", "mix_hash").agg(F.sum("mix_tokens").alias("tokens")))
    parts = ending(mine.groupBy("source", "part").agg(F.sum("tokens").alias("tokens")), ends.select("source", "rest", "before"), ["part"], "end").withColumnRenamed("end_part", "part")
    inside = mine.join(hinted(parts.select("source", "part")), ["source", "part"])
    cuts = ending(inside, parts.join(ends.select("source", "rest"), "source").select("source", "rest", "before"), ["mix_hash"], "end")
    plan = quotas.join(ends.select("source", "end_place"), "source", "left").join(cuts.select("source", F.col("end_mix_hash").alias("cut")), "source", "left")
    plan = common.cut(plan.select(F.col("source").alias("mix_source"), F.col("weight").alias("mix_weight"), "whole", "end_place", "cut"))
    at = place(own_block(F.col("mix_hash")), F.col("mix_source"), F.col("whole"))
    taken = (at < F.col("end_place")) | (at == F.col("end_place")) & (F.col("mix_hash") <= F.col("cut"))
    copies = F.col("whole") + F.coalesce(taken.cast("int"), F.lit(0))
    return sized.join(hinted(plan), "mix_source").withColumn("mix_copies", copies).drop("mix_source", "whole", "end_place", "cut")


def own_block(h: Column) -> Column:
    """A document's block, from 0, by the first bits of its hash."""
    return F.shiftright(h, 64 - BLOCKS_BITS) + (1 << BLOCKS_BITS - 1)


def schedule(docs: DataFrame, **options) -> DataFrame:
    """A row for each time that a document is used: all columns of ``docs``, the columns of ``passes`` but mix_copies, mix_epoch, and mix_block, its block's place in that pass.

    In each pass over a source blocks have places of their own, all of them permuted; the order of use is
    by mix_epoch, mix_block, mix_hash.  Null sources, empty texts, repeated rows and empty tables: as in ``passes``.
    """
    used = passes(docs, **options).filter("mix_copies > 0").withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.col("mix_copies") - 1)))
    return used.withColumn("mix_block", place(own_block(F.col("mix_hash")), F.coalesce("source", F.lit("")), F.col("mix_epoch"))).drop("mix_copies")
