"""Mix sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets are shares of the corpus by weight, capped at a number of epochs of each source. Documents
are dealt to shards and laid end to end in a seeded order; every (source, shard) is a run of
blocks of ``block`` words. Blocks go to sources, and each source's blocks to its shards, by the
highest quotients w / (2q + 1). A shard then takes its quota of blocks from a seeded start,
going round at most ``epochs`` times; what that cuts is taken from the source's other shards. The shards of a
source follow from its own documents and words, so a small one is not thinned out by a large corpus. Only sizes and counts are shuffled; the last step is
arithmetic on one row per document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
DOCS_PER_SHARD = 20_000
BLOCKS_PER_SHARD = 256  # at least, on average; a source of fewer blocks is one shard


def _hash(*parts) -> Column:
    return F.md5(F.concat_ws(",", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def sized(docs: DataFrame) -> DataFrame:
    """Add ``size``, the words of the text (0 for null), and ``_mark``, which tells apart texts of one doc_id."""
    return docs.withColumns({"size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"),
                             "_mark": F.xxhash64(F.coalesce("text", F.lit("")))})


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, epochs: float) -> DataFrame:
    """(source, source_size, target): ``share`` of all words dealt by weight, none above ``epochs`` of its source.

    Sources in code point order, null last, take the weights in turn. Sources fill in order of
    cap / weight, so the level at which the rest is shared is one running sum and no loop.
    The windows run over one row per source.
    """
    ordered = W.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
         .withColumn("_place", F.row_number().over(ordered) - 1)
         .withColumn("_w", F.element_at(cycle, (F.col("_place") % len(weights) + 1).cast("int")))
         .withColumn("_cap", F.col("source_size") * F.lit(float(epochs))))
    filling = W.orderBy(F.col("_cap") / F.col("_w"), "_place")
    every = W.partitionBy()
    s = (s.withColumn("_full", F.coalesce(F.sum("_cap").over(filling.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
         .withColumn("_left", F.sum("_w").over(filling.rowsBetween(W.currentRow, W.unboundedFollowing)))
         .withColumn("_all", F.sum("source_size").over(every) * F.lit(float(share))))
    level = (F.col("_all") - F.col("_full")) / F.col("_left")
    s = s.withColumn("_level", F.when(level * F.col("_w") <= F.col("_cap"), level))
    s = s.withColumn("_level", F.max("_level").over(every))  # falls from the first source that does not fill
    shared = F.col("_level") * F.col("_w")
    return s.select("source", "source_size", F.when(F.col("_level").isNull() | (shared > F.col("_cap")), F.col("_cap")).otherwise(shared).alias("target"))


def apportion(parties: DataFrame, within: Sequence[str], weight: str, seats: str, order: Sequence[str]) -> DataFrame:
    """Add ``quota``: ``seats`` (a column, equal within a group) dealt by the highest quotients weight / (2q + 1).

    A party's seats lie within n / (2 seats) of its exact share in relative terms; those below that
    range are given at once and only the quotients inside it are ranked. Ties go by ``order``.
    """
    within = list(within)
    group = W.partitionBy(*within)
    p = parties.withColumn("_exact", F.when(F.sum(weight).over(group) > 0, F.col(seats) * F.col(weight) / F.sum(weight).over(group)).otherwise(F.lit(0.0)))
    slack = F.count(F.lit(1)).over(group) / (2 * F.greatest(F.col(seats), F.lit(1)))
    p = (p.withColumn("_low", F.greatest(F.lit(0), F.floor(F.col("_exact") * (1 - slack)) - 1).cast("long"))
         .withColumn("_high", F.when(F.col(weight) > 0, F.ceil(F.col("_exact") * (1 + slack)) + 2).otherwise(F.lit(0)).cast("long")))
    p = p.withColumn("_rest", F.col(seats) - F.sum("_low").over(group))
    bids = p.filter(F.col("_high") > F.col("_low")).withColumn("_q", F.explode(F.sequence(F.col("_low"), F.col("_high") - 1)))
    ranked = bids.withColumn("_rank", F.row_number().over(
        W.partitionBy(*within).orderBy(F.desc(F.col(weight) / (2 * F.col("_q") + 1)), *order, "_q")))
    won = (ranked.filter(F.col("_rank") <= F.col("_rest")).groupBy(*within, *order).agg(F.count(F.lit(1)).alias("_won")))
    keys = list(dict.fromkeys([*within, *order]))
    return (p.join(won, keys, "left").withColumn("quota", F.col("_low") + F.coalesce("_won", F.lit(0)))
            .drop("_exact", "_low", "_high", "_rest", "_won"))


def mix(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, epochs: int = 2,
        block: int = 64, seed: int = 42) -> DataFrame:
    """``sizes`` (see ``sized``) with source_size, target, taken, and the words taken as runs.

    ``runs`` lists (from, to) word ranges of the document, one for each time a run of chosen blocks
    meets it; ``taken`` is their length and never above ``epochs`` x size. A null source is a source
    of its own; a null or empty text has size 0 and takes nothing. Rows that repeat a doc_id are
    laid out as rows of their own; equal rows are interchangeable. Extra columns are kept, if their names
    are not those of the result; ``mixed_documents`` packs a caller's columns so that no name clashes.
    """
    spark = sizes.sparkSession
    keyed = sizes.withColumns({"_named": F.col("source").isNotNull(), "_source": F.coalesce("source", F.lit(""))})
    base = stored(spark, keyed, "sized")  # texts are counted once
    by_source = base.groupBy("_named", "_source").agg(F.count(F.lit(1)).alias("_docs"), F.sum("size").alias("_words"))
    by_source = stored(spark, by_source, "sources")  # its size is known now, so Spark decides how to join it
    shards = F.least(F.ceil(F.col("_docs") / DOCS_PER_SHARD), F.floor(F.col("_words") / (BLOCKS_PER_SHARD * block)))
    shard = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "_mark"), F.greatest(F.lit(1), shards))
    base = base.join(by_source, ["_named", "_source"]).withColumn("_shard", shard).drop("_docs", "_words")

    slim = base.select("source", "size", "_named", "_source", "_shard")
    targets = (source_targets(slim, weights, share, epochs)
               .withColumn("_named", F.col("source").isNotNull()).withColumn("_source", F.coalesce("source", F.lit(""))).drop("source"))
    every = W.partitionBy()
    seats = targets.withColumn("_seats", F.round(F.sum("target").over(every) / block).cast("long"))
    seats = apportion(seats, [], "target", "_seats", ["_named", "_source"]).drop("_seats").withColumnRenamed("quota", "_blocks")
    cells = slim.groupBy("_named", "_source", "_shard").agg(F.sum("size").alias("_cell"))
    cells = apportion(cells.join(seats, ["_named", "_source"]), ["_named", "_source"], "_cell", "_blocks", ["_shard"])
    # What a shard cannot give at ``epochs`` goes to the shards of its source that have room, in order.
    source, cap = W.partitionBy("_named", "_source"), F.col("_cell") * epochs
    cells = cells.withColumn("_length", F.least(F.col("quota") * block, cap))
    short = F.sum(F.col("quota") * block - F.col("_length")).over(source)
    before = F.coalesce(F.sum(cap - F.col("_length")).over(source.orderBy("_shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumns({"_short": short, "_before": before})
    cells = cells.withColumn("_length", F.col("_length") + F.greatest(F.lit(0), F.least(cap - F.col("_length"), F.col("_short") - F.col("_before"))))
    cells = cells.drop("_short", "_before")
    cells = stored(spark, cells, "cells")  # its size is known now, so Spark decides how to join it

    laid = W.partitionBy("_named", "_source", "_shard").orderBy(_hash(seed, F.col("doc_id")), "doc_id", "_mark")
    placed = base.withColumn("_end", F.sum("size").over(laid.rowsBetween(W.unboundedPreceding, W.currentRow)))
    placed = placed.join(cells, ["_named", "_source", "_shard"])

    # The cell is a ring of words; the quota is a run on it from a seeded block, as if laid out epochs + 1 times.
    blocks = F.greatest(F.lit(1), F.ceil(F.col("_cell") / block))
    draw = F.conv(F.substring(_hash(seed, "start", F.col("_named"), F.col("_source"), F.col("_shard")), 1, 12), 16, 10).cast("long")
    placed = placed.withColumn("_from", F.pmod(draw, blocks) * block).withColumn("_to", F.col("_from") + F.col("_length"))
    runs = F.filter(F.transform(F.sequence(F.lit(0), F.lit(epochs)), lambda k: F.struct(
        F.greatest(F.col("_from") - (F.col("_end") - F.col("size") + k * F.col("_cell")), F.lit(0)).cast("long").alias("from"),
        F.least(F.col("_to") - (F.col("_end") - F.col("size") + k * F.col("_cell")), F.col("size")).cast("long").alias("to"))),
        lambda r: r["from"] < r["to"])
    taken = F.aggregate("runs", F.lit(0).cast("long"), lambda acc, r: acc + r["to"] - r["from"])
    return (placed.withColumn("runs", runs).withColumn("taken", taken)
            .drop("_named", "_source", "_shard", "_mark", "_end", "_cell", "_blocks", "quota", "_length", "_from", "_to"))


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix as documents: a row for each run taken; a part of a text is its words joined by one space.

    Columns of any name are carried unchanged but for text and n_chars.
    """
    columns = docs.columns
    packed = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in columns if c != "text"]).alias("_row"))
    # Only sizes are laid end to end and sorted; the runs then meet the texts by a number stored with each row, whose
    # side of the join is the one that is hashed, so no task sorts or holds texts.
    base = stored(docs.sparkSession, sized(packed).withColumn("_at", F.monotonically_increasing_id()), "texts")
    runs = mix(base.drop("text", "_row"), **settings).filter(F.size("runs") > 0).select("_at", "runs")
    m = base.join(runs.hint("shuffle_hash"), "_at").withColumn("_run", F.explode("runs"))
    whole = (F.col("_run.from") == 0) & (F.col("_run.to") == F.col("size"))
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"))
    part = F.array_join(F.slice(words, (F.col("_run.from") + 1).cast("int"), (F.col("_run.to") - F.col("_run.from")).cast("int")), " ")
    m = m.withColumn("_text", F.when(whole, F.col("text")).otherwise(part)).withColumn("_whole", whole)
    given = lambda c: F.col("_row").getField(c)
    made = {"text": F.col("_text"), "n_chars": F.when(F.col("_whole"), given("n_chars")).otherwise(F.length("_text")).cast("long")}
    return m.select(*[(made[c] if c in made else given(c)).alias(c) for c in columns])
