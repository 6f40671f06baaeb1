"""Mixing sources to target weights by Sainte-Lague apportionment.

Words are dealt in blocks of BLOCK_WORDS. The sources get their integer
quotas of blocks by highest quotients (target / 1, / 3, / 5, ...), and each
source's quota goes to groups of its shards and on to the shards the same way. Within a shard the documents
lie on a line in seeded order, twice in a row; the line is cut into blocks,
and the quota is a run of blocks from a seeded start, around the end. So no
document is taken a second time before all others of the shard are taken
once, and no block list has to be made: what a document gives is the overlap
of its two places with the run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakespark.llm.common import fresh, join_small, settle, word_count

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
CEILING = 2.0
BLOCK_WORDS = 16
#: A shard has about so many words; it is ordered by one task.
SHARD_WORDS = 1 << 18
#: A source's quota goes to groups of so many shards first, so a task ranks quotients of one group.
GROUP_SHARDS = 4096
#: Beyond about so many shards in all they grow instead: ordering one is a sort, which spills.
MOST_SHARDS = 1 << 17
SEED = 11


def source_targets(sources: DataFrame, weights=WEIGHTS, budget: float = BUDGET, ceiling: float = CEILING) -> DataFrame:
    """Adds ``target`` to (source, source_size), one row for each source.

    Weights repeat over the sources by code point, null last. A target is
    weight * level, or ceiling * size where that is less; the level is the one
    at which the targets add up to budget * all words. In order of
    ceiling * size / weight the sources at their ceiling come first, so the
    level is found by cumulative sums. With no words at all, targets are 0.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    index = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (index + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(ceiling))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = (
        sources.withColumn("weight", weight)
        .withColumn("cap", cap)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("place", F.row_number().over(by_ratio))
        .withColumn("level", (F.sum("source_size").over(Window.partitionBy()) * budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    )
    free = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))
    level = F.min(free).over(Window.partitionBy())["level"]
    return ranked.withColumn("level", level).withColumn("target", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap"))).select("source", "source_size", "target")


def apportion(parties: DataFrame, group: list[str], key: list[str], votes: str, seats: Column) -> DataFrame:
    """Sainte-Lague: adds ``quota`` to each party, highest quotients first.

    ``seats`` (a long, equal within ``group``) are dealt within each group; a
    tie goes to the smaller key. With n parties and S seats a quota is within
    share * (1 -+ n / 2S) -+ 1/2, so only the quotients in that range are
    made and ranked: about 4 n of them, however many seats there are.
    """
    within = Window.partitionBy(*group)
    share = F.col("_seats") * F.col(votes) / F.col("_votes")
    slack = F.col("_n") / (F.col("_seats") * 2.0)
    some = (F.col("_seats") > 0) & (F.col("_votes") > 0)
    ranged = (
        parties.withColumns({"_seats": seats.cast("long"), "_votes": F.sum(votes).over(within).cast("double"), "_n": F.count("*").over(within)})
        .withColumn("_low", F.when(some, F.greatest(F.lit(0), F.floor(share * (1 - slack) - 0.5))).otherwise(0).cast("long"))
        .withColumn("_high", F.when(some, F.least(F.col("_seats"), F.ceil(share * (1 + slack) + 0.5))).otherwise(0).cast("long"))
        .withColumn("_left", F.col("_seats") - F.sum("_low").over(within))
    )
    seat = F.explode_outer(F.when(F.col("_high") > F.col("_low"), F.sequence("_low", F.col("_high") - 1)))
    order = Window.partitionBy(*group).orderBy(F.col("_quotient").desc_nulls_last(), *[F.col(k).asc_nulls_last() for k in key], "_seat")
    dealt = ranged.withColumn("_seat", seat).withColumn("_quotient", F.col(votes) / (F.col("_seat") * 2.0 + 1)).withColumn("_won", F.col("_seat").isNotNull() & (F.row_number().over(order) <= F.col("_left")))
    return dealt.groupBy(*parties.columns, "_low").agg(F.sum(F.col("_won").cast("long")).alias("_extra")).withColumn("quota", F.col("_low") + F.col("_extra")).drop("_low", "_extra")


def _overlap(start: Column, stop: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.lit(0), F.least(stop, high) - F.greatest(start, low))


def _row_hashes(id_col: str, text_col: str) -> tuple[Column, Column]:
    """A row's hash in its shard's order, and one of its text."""
    return F.xxhash64(F.lit(SEED + 1), F.col(f"`{id_col}`")), F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))


def _shard(order: Column, digest: Column, shards: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(SEED), order, digest), shards)


BY_SOURCE = ["none", "source"]


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, budget: float, ceiling: float, block: int, shard_words: int, group_shards: int) -> tuple[DataFrame, DataFrame, Window]:
    """Each row with its shard, place and ``taken`` words; the sources; and the order of a shard's rows."""
    order, digest = _row_hashes(id_col, text_col)
    sized = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"), order.alias("order"), digest.alias("digest"))
    sized = settle(sized.withColumns({"none": F.col("source").isNull(), "source": F.coalesce("source", F.lit(""))}), "sized")
    sums = settle(sized.groupBy(*BY_SOURCE).agg(F.sum("size").alias("source_size")), "sources")
    named = F.when(~F.col("none"), F.col("source"))
    sources = source_targets(sums.select(named.alias("source"), "source_size"), weights, budget, ceiling)
    total = F.sum("source_size").over(Window.partitionBy())
    sources = sources.withColumns({"seats": F.round(total * budget / block).cast("long"), "shard_words": F.greatest(F.lit(float(shard_words)), total / MOST_SHARDS)})
    sources = apportion(sources, [], ["source"], "target", F.col("seats"))
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.col("shard_words"))).cast("long")
    sources = settle(sources.select(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("source"), "source_size", "target", F.col("quota").alias("source_quota"), shards.alias("shards")), "targets")
    dealt = join_small(sized, sources, BY_SOURCE).withColumn("shard", _shard(F.col("order"), F.col("digest"), F.col("shards")))
    by_shard, by_group = [*BY_SOURCE, "shard"], [*BY_SOURCE, "shard_group"]
    shards = dealt.groupBy(*by_shard).agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"))
    shards = settle(shards.withColumn("shard_group", F.floor(F.col("shard") / group_shards).cast("long")), "shard_sizes")
    groups = shards.groupBy(*by_group).agg(F.sum("shard_size").alias("group_size"), F.first("source_quota").alias("source_quota"))
    groups = apportion(groups, BY_SOURCE, by_group, "group_size", F.col("source_quota")).withColumnRenamed("quota", "group_quota")
    shards = shards.join(groups.select(*by_group, "group_quota"), by_group)
    shards = settle(apportion(shards, by_group, by_shard, "shard_size", F.col("group_quota")).select(*by_shard, "quota"), "shards")
    line_order = Window.partitionBy(*by_shard).orderBy("order", "digest", F.col("id").asc_nulls_last())
    line = dealt.withColumns({"stop": F.sum("size").over(line_order.rowsBetween(Window.unboundedPreceding, 0)), "length": F.sum("size").over(Window.partitionBy(*by_shard))})
    placed = join_small(line, shards, by_shard)
    start, stop, length, b = F.col("stop") - F.col("size"), F.col("stop"), F.col("length"), F.lit(block)
    blocks = F.greatest(F.lit(1), F.ceil(length * 2 / block)).cast("long")
    placed = placed.withColumns({"blocks": blocks, "quota": F.least("quota", blocks)}).withColumn("first", F.pmod(F.xxhash64(F.lit(SEED + 2), *by_shard), F.col("blocks")))
    low, high = F.col("first") * b, F.least(F.col("first") + F.col("quota"), F.col("blocks")) * b
    around = F.greatest(F.lit(0), F.col("first") + F.col("quota") - F.col("blocks")) * b
    taken = sum((_overlap(start + shift, stop + shift, x, y) for shift in (F.lit(0), length) for x, y in ((low, high), (F.lit(0), around))), F.lit(0))
    return placed.withColumn("taken", taken.cast("long")), sources, line_order


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, budget: float = BUDGET, ceiling: float = CEILING, block: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, group_shards: int = GROUP_SHARDS) -> DataFrame:
    """One row for each input row: identifier, size, source_size, target, taken.

    ``size`` is the number of words, 0 for null or empty text; such rows are
    taken 0 words of. A null source is a source of its own, last in order.
    Repeated identifiers are separate rows. Row order, and so the result,
    depends only on the rows and the seed. Extra columns are ignored, and an
    empty table gives an empty result.
    """
    placed, _, _ = _placed(docs, id_col, text_col, source_col, weights, budget, ceiling, block, shard_words, group_shards)
    return placed.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def repeat_mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, budget: float = BUDGET, ceiling: float = CEILING, block: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, group_shards: int = GROUP_SHARDS) -> DataFrame:
    """``docs`` with each row 0, 1 or 2 times, as often as mix takes its words, to the nearest.

    Along a shard's line that number changes at a few places only, the ends of
    the run. So documents meet the places of their shard, a row for each of
    MOST_SHARDS or so, and are not shuffled. All columns stay as they were,
    whatever their names; rows equal in identifier, text and source share one
    decision. Rows of no words go, and an empty table stays empty.
    """
    placed, sources, order = _placed(docs, id_col, text_col, source_col, weights, budget, ceiling, block, shard_words, group_shards)
    often = placed.where("size > 0").withColumn("times", F.floor(F.col("taken") / F.col("size") + 0.5).cast("int"))
    turns = often.withColumn("before", F.lag("times").over(order)).where("before is null or before <> times")
    by_shard = [*BY_SOURCE, "shard"]
    turn = F.struct(F.struct("order", "digest").alias("place"), F.col("times"))
    turns = settle(turns.groupBy(*by_shard).agg(F.sort_array(F.collect_list(turn)).alias("turns")), "turns")  # some five for each shard
    names = dict(zip([*by_shard, "order", "digest", "turns", "shards", "times", "copy"], fresh(docs, "_none", "_source", "_shard", "_order", "_digest", "_turns", "_shards", "_times", "_copy"), strict=True))
    own, source = dict(zip(("order", "digest"), _row_hashes(id_col, text_col), strict=True)), F.col(f"`{source_col}`").cast("string")
    tagged = docs.where(F.coalesce(F.col(f"`{text_col}`").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    tagged = tagged.withColumns({names["none"]: source.isNull(), names["source"]: F.coalesce(source, F.lit("")), names["order"]: own["order"], names["digest"]: own["digest"]})
    rename = lambda f: f.withColumnsRenamed({c: names[c] for c in f.columns})
    tagged = join_small(tagged, rename(sources.select(*BY_SOURCE, "shards")), [names[c] for c in BY_SOURCE])
    tagged = tagged.withColumn(names["shard"], _shard(F.col(names["order"]), F.col(names["digest"]), F.col(names["shards"])))
    met = join_small(tagged, rename(turns), [names[c] for c in by_shard])
    place = F.struct(F.col(names["order"]).alias("order"), F.col(names["digest"]).alias("digest"))
    last = F.try_element_at(F.filter(names["turns"], lambda t: t["place"] <= place), F.lit(-1))["times"]
    every = [F.col(f"`{c}`") for c in docs.columns]
    wanted = met.withColumn(names["times"], last).where(F.col(names["times"]) > 0)
    return wanted.select(*every, F.explode(F.sequence(F.lit(1), F.col(names["times"]))).alias(names["copy"])).drop(names["copy"])
