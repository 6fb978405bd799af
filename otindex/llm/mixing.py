"""Mix sources to target weights: exact block quotas, dealt to output shards by a splitting tree.

Documents fall into blocks of their source by a hash, so the blocks of a source, one after the other,
are a random permutation of it. A source's target is so many whole passes over its blocks and a
beginning of one more; that makes an exact number of blocks per source, its quota. A tree over the
output shards halves the shards again and again and draws, for every half, how many blocks of each
source fall into it: a multivariate hypergeometric draw, as if all blocks were shuffled and dealt.
The leaves hold the quota of each source in each shard. A source's permuted blocks are then cut at
these quotas, so shards draw disjoint blocks and together exactly the quotas, and every shard is
shuffled on its own.

Everything is a DataFrame expression. Only numbers (a few totals) reach the driver; a document finds
its shards in its own row from its hash and one small row per source.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from otindex.session import SALTS, materialize, with_positions

#: Words of a block, and words of an output shard where their number is not given.
BLOCK_WORDS, SHARD_WORDS = 1 << 16, 1 << 22

#: Entries of the table of sources (sources times shards) up to which it is broadcast.
BROADCAST_ENTRIES = 1 << 21

#: Blocks whose running sizes are added up in one task.
GROUP_BLOCKS = 4096

#: Columns of the result besides those of the documents.
ADDED = ("size", "source_size", "target", "copies")

#: A prime above any number of blocks, so that multiplying by it permutes them.
_PRIME = (1 << 61) - 1

_WORD = r"[^\x20\x09-\x0D]+"


# --- random numbers ---------------------------------------------------------------------------


def uniform(*parts) -> Column:
    """A number in (0, 1) that is fixed by its parts."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 12).cast("double") + 0.5) / F.lit(float(1 << 52))


def log_factorial(n: Column) -> Column:
    """ln(n!) by Stirling's series, started far enough up to be exact to 1e-11 or so."""
    x = n.cast("double") + 10.0
    series = x * F.ln(x) - x + 0.5 * F.ln(6.283185307179586 * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0))) - 1 / (1680 * F.pow(x, F.lit(7.0)))
    for k in range(1, 11):
        series = series - F.ln(n.cast("double") + float(k))
    return series


def hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` out of ``total`` are among the ``good`` ones, by inversion at ``u``.

    Probabilities are added up from 9 standard deviations below the mean, or the least value.
    """
    low = F.greatest(F.lit(0).cast("long"), draws - (total - good))
    high = F.least(good, draws)
    share = F.coalesce(F.try_divide(good.cast("double"), total), F.lit(0.0))
    mean = draws * share
    spread = 9 * F.sqrt(F.greatest(F.lit(0.0), mean * (1 - share))) + 2
    first = F.greatest(low, F.floor(mean - spread).cast("long"))
    last = F.least(high, F.ceil(mean + spread).cast("long"))
    bad = total - good

    def chosen(n, k):
        return log_factorial(n) - log_factorial(k) - log_factorial(n - k)

    start = F.exp(chosen(good, first) + chosen(bad, draws - first) - chosen(total, draws))
    state = F.struct(F.lit(0.0).alias("sum"), start.alias("p"), F.lit(None).cast("long").alias("found"))

    def step(s, x):
        reached = s["sum"] + s["p"]
        ratio = (good - x).cast("double") * (draws - x) / ((x + 1).cast("double") * (bad - draws + x + 1))
        found = F.when(s["found"].isNotNull(), s["found"]).when(reached >= u, x)
        return F.struct(reached.alias("sum"), (s["p"] * F.coalesce(ratio, F.lit(0.0))).alias("p"), found.alias("found"))

    return F.when(high <= low, low).otherwise(
        F.aggregate(F.sequence(first, last), state, step, lambda s: F.coalesce(s["found"], last))
    )


# --- targets ----------------------------------------------------------------------------------


def targets(sources: DataFrame, most: float) -> DataFrame:
    """``target`` per row of ``(size, weight)``: shares of all sizes, at most ``most`` times a size.

    What lies above is shared again by weight among the others until none is above. Every round is
    one aggregation of the table and ends with one number.
    """
    level, closed = 0.0, -1
    cap = F.col("size") * float(most)
    while True:
        above = cap < F.lit(level) * F.col("weight")
        row = sources.agg(
            F.count_if(above).alias("closed"), F.sum("size").alias("all"),
            F.sum(F.when(above, cap).otherwise(0.0)).alias("taken"),
            F.sum(F.when(above, 0.0).otherwise(F.col("weight").cast("double"))).alias("weight"),
        ).first()
        if row["closed"] == closed or not row["weight"]:
            break
        closed, level = row["closed"], (row["all"] - row["taken"]) / row["weight"]
    return sources.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))


# --- the tree -----------------------------------------------------------------------------------


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """``(pos, stops)`` from ``(pos, quota)``: the place in a source's blocks where each shard ends.

    A node is one row with the quotas of all sources as an array, which suits thousands of sources; a
    level of the tree draws the left half of every node. Shards get equal numbers of blocks, give or
    take one.
    """
    ordered = F.array_sort(F.collect_list(F.struct("pos", "quota")))
    nodes = quotas.agg(ordered.alias("_all"), F.sum("quota").alias("total")).where("total is not null").select(
        F.lit(0).alias("lo"), F.lit(shards).alias("hi"), F.col("_all.pos").alias("pos"), F.col("_all.quota").alias("quotas"), "total"
    )
    width, level = shards, 0
    while width > 1:
        node = nodes.withColumn("mid", F.expr("int((lo + hi) div 2)")).withColumn(
            "wanted", F.expr(f"bigint(total * mid div {shards}) - bigint(total * lo div {shards})")
        )
        seeded = F.transform("quotas", lambda q, i: F.struct(q.alias("q"), uniform(F.lit(seed), F.col("lo"), F.col("hi"), i).alias("u")))
        left = F.aggregate(seeded, _draws_state(), _draw_source, lambda s: s["out"])
        # a node of one shard stays as it is
        node = node.withColumn("_left", F.when(F.col("hi") - F.col("lo") > 1, left))
        whole = F.struct("lo", "hi", "quotas")
        halves = (
            F.struct("lo", F.col("mid").alias("hi"), F.col("_left").alias("quotas")),
            F.struct(F.col("mid").alias("lo"), "hi", F.zip_with("quotas", "_left", lambda q, x: q - x).alias("quotas")),
        )
        nodes = node.select("pos", "total", F.inline(F.when(F.col("_left").isNull(), F.array(whole)).otherwise(F.array(*halves))))
        level, width = level + 1, -(-width // 2)
        if level % 4 == 0:
            nodes = materialize(nodes)
    leaves = nodes.select(F.col("lo").alias("shard"), F.inline(F.arrays_zip("pos", F.col("quotas").alias("quota"))))
    stop = F.sum("quota").over(Window.partitionBy("pos").orderBy("shard"))
    stops = F.array_sort(F.collect_list(F.struct("shard", "stop")))
    return leaves.select("pos", "shard", stop.alias("stop")).groupBy("pos").agg(stops.alias("_s")).select("pos", F.col("_s.stop").alias("stops"))


def _draws_state() -> Column:
    """Before the first source: all blocks of the node, those wanted for the left, and no draws yet."""
    total = F.aggregate("quotas", F.lit(0).cast("long"), lambda s, q: s + q)
    return F.struct(total.alias("total"), F.col("wanted").alias("draws"), F.array().cast("array<bigint>").alias("out"))


def _draw_source(s: Column, e: Column) -> Column:
    """The draw of one source, given those of the sources before; an array of one holds it while it is used."""

    def after(x):
        return F.struct((s["total"] - e["q"]).alias("total"), (s["draws"] - x).alias("draws"), F.concat(s["out"], F.array(x)).alias("out"))

    return F.transform(F.array(hypergeometric(s["total"], e["q"], s["draws"], e["u"])), after)[0]


# --- documents ------------------------------------------------------------------------------------


def _attach(rows: DataFrame, sources: DataFrame, entries: int) -> DataFrame:
    """Join the small row of its source to every row; a large table of sources is joined on a salt."""
    if entries <= BROADCAST_ENTRIES:
        return rows.join(F.broadcast(sources), "_key")
    salted = rows.withColumn("_salt", F.pmod("_h", F.lit(SALTS)))
    copies = sources.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).cast("long"))
    return salted.join(copies, ["_key", "_salt"]).drop("_salt")


def _beginnings(stats: DataFrame, sources: DataFrame, count: int) -> DataFrame:
    """``(_key, edge, last)``: the pass that a source begins takes blocks below ``edge``, and of block
    ``edge`` the rows whose hashes are in ``last``, so that its words come near to ``rest``."""
    rows = _attach(stats.where("_size > 0"), sources.where("rest > 0").select("_key", "blocks", "rest"), count)
    rows = rows.withColumn("_block", F.pmod("_h", F.col("blocks")))
    sizes = rows.groupBy("_key", "_block").agg(F.sum("_size").alias("words"), F.max("rest").alias("rest"))
    group = F.expr(f"_block div {GROUP_BLOCKS}")
    sizes = materialize(sizes.withColumn("_group", group))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    groups = sizes.groupBy("_key", "_group").agg(F.sum("words").alias("_of_group")).withColumn(
        "_before", F.coalesce(F.sum("_of_group").over(before.partitionBy("_key").orderBy("_group")), F.lit(0))
    )
    inside = F.coalesce(F.sum("words").over(before.partitionBy("_key", "_group").orderBy("_block")), F.lit(0))
    placed = sizes.withColumn("_inside", inside).join(groups, ["_key", "_group"]).withColumn("start", F.col("_before") + F.col("_inside"))
    edges = materialize(
        placed.where("start < rest and rest <= start + words").select("_key", F.col("_block").alias("edge"), (F.col("rest") - F.col("start")).alias("left"))
    )
    # the rows of one block per source, equal ones added up, by hash: each that still fits is taken, and perhaps one more
    within = _attach(rows.select("_key", "_h", "_block", "_size"), edges, count).where("_block = edge")
    within = within.groupBy("_key", "_h").agg(F.sum("_size").alias("words"), F.max("left").alias("left"))
    nothing = F.struct(F.lit(None).cast("long").alias("words"), F.lit(None).cast("long").alias("_h"))
    state = F.struct(F.max("left").alias("left"), F.array().cast("array<bigint>").alias("out"), nothing.alias("least"))

    def take(s, e):
        fits = e["words"] <= s["left"]
        smaller = ~fits & (s["least"]["words"].isNull() | (e["words"] < s["least"]["words"]))
        return F.struct(
            F.when(fits, s["left"] - e["words"]).otherwise(s["left"]).alias("left"),
            F.when(fits, F.concat(s["out"], F.array(e["_h"]))).otherwise(s["out"]).alias("out"),
            F.when(smaller, F.struct(e["words"].alias("words"), e["_h"].alias("_h"))).otherwise(s["least"]).alias("least"),
        )

    def nearest(s):
        # one more, the least that did not fit, if that comes nearer
        closer = F.coalesce(s["least"]["words"] - s["left"] < s["left"], F.lit(False))
        return F.when(closer, F.concat(s["out"], F.array(s["least"]["_h"]))).otherwise(s["out"])

    ordered = F.array_sort(F.collect_list(F.struct("_h", "words")))
    taken = within.groupBy("_key").agg(F.aggregate(ordered, state, take, nearest).alias("last"))
    return edges.select("_key", "edge").join(taken, "_key", "left")


def _shard(place: Column) -> Column:
    """The shard whose range of places holds ``place``: a binary search in ``stops``."""
    state = F.struct(F.lit(0).alias("low"), F.size("stops").alias("high"))

    def halve(s, _):
        mid = F.floor((s["low"] + s["high"]) / 2).cast("int")
        after = F.get("stops", mid) <= place
        go = s["low"] < s["high"]
        return F.struct(F.when(go & after, mid + 1).otherwise(s["low"]).alias("low"), F.when(go & ~after, mid).otherwise(s["high"]).alias("high"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size("stops") + 1.0)).cast("int"))
    return F.aggregate(steps, state, halve, lambda s: s["low"])


def mix(
    documents: DataFrame, weights: Sequence[float] = (1, 2, 3), most: int = 3, shards: int | None = None, seed: int = 42,
    block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """Every row of (doc_id, text, source) with how often, and into which output shards, the mix takes it.

    Adds ``size`` (words of the text, 0 for null), ``source_size``, ``target`` (words wanted from the
    source) and ``copies``, an array with one shard number per time that the row is taken; input
    columns of these names, letter case aside, are replaced. Sources by code point, null last, have
    the ``weights`` in turn, and share the words of all documents up to ``most`` times their own.
    ``shards`` defaults to one for every ``shard_words`` words. Rows of one id, text and source are
    equal: they go the same way, together. Empty texts are taken as often as their place in the
    permutation says, and add nothing. The same rows always give the same result, in any layout.
    """
    taken = [c for c in documents.columns if c.lower() in ADDED]
    sized = documents.drop(*taken).select(
        "*",
        F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", "text", "source").alias("_h"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("_key"),
    )
    stats = materialize(sized.select("_key", F.col("source").cast("string").alias("source"), F.col("size").alias("_size"), "_h"))
    sources = stats.groupBy("_key").agg(F.first("source").alias("source"), F.sum("_size").alias("size"))
    turn = F.pmod("pos", F.lit(len(weights))).cast("int")
    sources = with_positions(sources, F.col("source").asc_nulls_last()).withColumn("weight", F.get(F.lit(list(map(float, weights))), turn))
    sources = targets(materialize(sources), most)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / block_words)).cast("long")
    passes = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("size"))), F.lit(0)).cast("long")
    sources = materialize(
        sources.withColumn("blocks", blocks).withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("size"))
    )
    total, count = sources.agg(F.sum("size"), F.count("*")).first()
    shards = shards or max(1, -(-(total or 0) // shard_words))
    begun = sources.join(_beginnings(stats, sources, count), "_key", "left")
    begun = begun.withColumn("quota", F.col("passes") * F.col("blocks") + F.coalesce(F.col("edge") + 1, F.lit(0)))
    begun = materialize(begun)
    stops = split_quotas(begun.select("pos", "quota"), shards, seed)
    plan = materialize(begun.join(stops, "pos").select(
        "_key", F.col("size").alias("source_size"), "target", "blocks", "passes", "edge", "last", "quota", "stops"
    ))
    block = F.pmod("_h", F.col("blocks"))
    inside = (block < F.col("edge")) | ((block == F.col("edge")) & F.array_contains("last", F.col("_h")))
    here = F.filter(F.sequence(F.lit(0), F.lit(most)), lambda k: (k < F.col("passes")) | ((k == F.col("passes")) & F.coalesce(inside, F.lit(False))))
    factor, shift = F.pmod(F.lit(_PRIME), F.col("quota")), F.pmod(F.xxhash64(F.lit(seed), "_key"), F.col("quota"))
    copies = F.transform(here, lambda k: _shard(F.pmod((k * F.col("blocks") + block) * factor + shift, F.col("quota"))))
    return _attach(sized, plan, count * shards).withColumn("copies", F.when(F.col("quota") > 0, copies).otherwise(F.array().cast("array<int>"))).drop(
        "_h", "_key", "blocks", "passes", "edge", "last", "quota", "stops"
    )


def draw(mixed: DataFrame, seed: int = 42) -> DataFrame:
    """One row per copy of the result of :func:`mix`, with ``shard`` in place of ``copies``.

    A shard lies in one partition, in random order; its size is bounded by the number of shards.
    """
    rows = mixed.select("*", F.posexplode("copies").alias("_copy", "shard")).drop("copies")
    order = F.xxhash64(F.lit(seed), "shard", "_copy", "doc_id", "text")
    return rows.withColumn("_order", order).repartition("shard").sortWithinPartitions("shard", "_order").drop("_order", "_copy")
