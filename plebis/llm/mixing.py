"""Operator 1: mixing sources to target weights.

Every source is cut into blocks of documents by a hash.  A source's target in
words becomes an exact quota of block draws: whole passes over the source, then as
many of its blocks as the rest of the target takes.  A splitting tree hands the
quotas to the output shards: at each node the left half of the draws gets a
multivariate-hypergeometric share of every source's quota.  The shards' quotas then
choose the blocks.  In a whole pass each shard owns a disjoint range of the permuted
blocks; in the last pass the permuted blocks are divided between the shards in
proportion to their quotas, and each shard draws its quota from its own stretch in
its own permutation.  Blocks have different sizes, so the drawn ones are taken in
turn up to the target, then those that no shard has drawn; the last is cut between
documents.  Within itself each shard is shuffled by a hash.

Only the per-source and per-block tables meet in windows: one row a source, and a
block for some thousand documents of a source, 64 blocks a source at least, so that the
quotas choose among blocks in small sources too and a source with a third of all rows
spreads over as many keys as it has blocks.  Of the block that a target cuts only a
slice of its hashes meets in one task.

Defined results.  Null text has size 0; null is a source of its own and sorts
last.  Rows with equal source, key and text are decided alike.  An empty table
gives an empty plan.  Extra columns pass through ``mix`` untouched, whatever
their names; words are never cut out of a document: it is drawn whole or not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plebis.llm.common import WORD, durable, let

#: Above so many rows the block plan is joined by shuffle instead of broadcast.
BROADCAST_ROWS = 100_000
#: What is left of a target is filled from the next documents that fit, until
#: these hold so many times the words left; the first that still fit are drawn.
REACH = 4


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _block_key(docs: DataFrame, key: str, text: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), docs[key], docs[text])


def source_targets(
    per_source: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """Targets in words for rows (source, source_size).

    Sources in code-point order, null last, take ``weights`` in turn and share
    ``share`` times all words.  No target passes ``most`` times its source; what
    is above goes to the others by weight.  That fixed point is one water level
    L with target = min(most * size, L * weight), found by a running sum over
    sources in the order in which they fill up.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    filling = Window.orderBy("fills_at", "nth").rowsBetween(Window.unboundedPreceding, -1)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = (
        per_source.withColumn("nth", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(cycle, (F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int")))
        .withColumn("ceiling", F.col("source_size") * F.lit(float(most)))
        .withColumn("fills_at", F.col("ceiling") / F.col("weight"))
    )
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(
        F.sum("ceiling").over(filling), F.lit(0.0)
    )
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filling), F.lit(0.0))
    levelled = ranked.withColumn("level", left / open_weight).withColumn(
        "water", F.max(F.when(F.col("fills_at") > F.col("level"), F.col("level"))).over(everything)
    )
    target = F.least("ceiling", F.coalesce(F.col("water") * F.col("weight"), F.col("ceiling")))
    return levelled.select("source", "source_size", "nth", "weight", target.alias("target"))


def hypergeometric(population: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """One hypergeometric variate by inversion of ``u`` in (0, 1), as an expression.

    Weights are built up from a start nine standard deviations below the mode,
    beyond which they are under the resolution of a double.
    """
    given = F.struct(
        population.alias("population"), marked.alias("marked"), drawn.alias("drawn"), u.alias("u"),
        population.cast("double").alias("pop"), marked.cast("double").alias("k"), drawn.cast("double").alias("n"),
    )

    def around(v: Column) -> Column:
        share = v["k"] / F.greatest(v["pop"], F.lit(1.0))
        spread = F.sqrt(v["n"] * share * (1 - share) * (v["pop"] - v["n"]) / F.greatest(v["pop"] - 1, F.lit(1.0)))
        mode = F.floor((v["n"] + 1) * (v["k"] + 1) / (v["pop"] + 2)).cast("long")
        return F.struct(mode.alias("mode"), (F.ceil(spread * 9) + 9).cast("long").alias("reach"))

    def bounds(v: Column, m: Column) -> Column:
        low = F.greatest(F.greatest(F.lit(0), v["drawn"] + v["marked"] - v["population"]), m["mode"] - m["reach"])
        high = F.least(F.least(v["marked"], v["drawn"]), m["mode"] + m["reach"])
        return F.struct(low.cast("long").alias("low"), high.cast("long").alias("high"))

    def steps(b: Column) -> Column:
        return F.when(b["high"] > b["low"], F.sequence(b["low"], b["high"] - 1)).otherwise(F.array().cast("array<long>"))

    def ratio(v: Column, x: Column) -> Column:
        return (v["k"] - x) * (v["n"] - x) / ((x + 1) * (v["pop"] - v["k"] - v["n"] + x + 1))

    def total(v: Column, s: Column) -> Column:
        return F.aggregate(
            s,
            F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("t")),
            lambda a, x: let(a["w"] * ratio(v, x), lambda w: F.struct(w.alias("w"), (a["t"] + w).alias("t"))),
            lambda a: a["t"],
        )

    def found(v: Column, b: Column, s: Column, t: Column) -> Column:
        return F.aggregate(
            s,
            F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("c"), b["low"].alias("x"), (v["u"] * t).alias("goal")),
            lambda a, x: F.when(a["c"] >= a["goal"], a).otherwise(
                let(
                    a["w"] * ratio(v, x),
                    lambda w: F.struct(w.alias("w"), (a["c"] + w).alias("c"), (x + 1).cast("long").alias("x"), a["goal"].alias("goal")),
                )
            ),
            lambda a: a["x"],
        )

    # Each value is named once: written out where it is used, one level of the tree
    # would be an expression of thousands of nodes, which the driver holds many times.
    inverted = lambda v, b: let(steps(b), lambda s: let(total(v, s), lambda t: found(v, b, s, t)))
    return let(given, lambda v: let(around(v), lambda m: let(bounds(v, m), lambda b: inverted(v, b))))


def split_quotas(quotas: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """Rows (nth, quota), one a source, to rows (shard, nth, n_draws).

    The tree halves the shards; ``n_shards`` is rounded up to a power of two.
    The vector of quotas has one entry a source, as the weights themselves have.
    """
    root = quotas.agg(F.sort_array(F.collect_list(F.struct("nth", "quota"))).alias("q")).select(
        F.lit(1).cast("long").alias("node"), F.transform("q", lambda s: s["quota"]).alias("q")
    )
    levels = max(0, n_shards - 1).bit_length()
    nodes = root.where(F.size("q") > 0)
    for _ in range(levels):
        total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x)
        odd_to_left = F.pmod(F.xxhash64(F.lit(seed), "node"), F.lit(2))
        staged = nodes.withColumn("total", total).withColumn(
            "drawn", F.floor((F.col("total") + odd_to_left) / 2).cast("long")
        )

        def step(acc: Column, i: Column) -> Column:
            draw = F.pmod(F.xxhash64(F.lit(seed), F.col("node"), i), F.lit(1 << 52))

            def taken(k: Column, x: Column) -> Column:
                return F.struct(
                    (acc["pop"] - k).alias("pop"), (acc["left"] - x).alias("left"), F.array_append(acc["out"], x).alias("out")
                )

            return let(
                F.get("q", i),
                lambda k: let(hypergeometric(acc["pop"], k, acc["left"], (draw + 0.5) / float(1 << 52)), lambda x: taken(k, x)),
            )

        halves = staged.withColumn(
            "taken",
            F.aggregate(
                F.sequence(F.lit(0), F.size("q") - 1),
                F.struct(
                    F.col("total").alias("pop"), F.col("drawn").alias("left"), F.array().cast("array<long>").alias("out")
                ),
                step,
                lambda a: a["out"],
            ),
        ).withColumn("rest", F.zip_with("q", "taken", lambda a, b: a - b))
        nodes = halves.select(
            F.explode(
                F.array(
                    F.struct((F.col("node") * 2).alias("node"), F.col("taken").alias("q")),
                    F.struct((F.col("node") * 2 + 1).alias("node"), F.col("rest").alias("q")),
                )
            ).alias("half")
        ).select("half.node", "half.q")
    return nodes.select((F.col("node") - (1 << levels)).cast("int").alias("shard"), F.posexplode("q")).select(
        "shard", (F.col("pos") + 1).alias("nth"), F.col("col").alias("n_draws")
    )


def _fillers(others: Column, left: Column) -> Column:
    """Of (h, words, block) in order, the (block, h) of those that fit into what is still left."""
    return F.aggregate(
        others,
        F.struct(left.cast("double").alias("left"), F.array().cast("array<struct<block:long,h:long>>").alias("out")),
        lambda a, x: F.when(
            x["words"] <= a["left"],
            F.struct(
                (a["left"] - x["words"]).cast("double").alias("left"),
                F.array_append(a["out"], F.struct(x["block"].alias("block"), x["h"].alias("h"))).alias("out"),
            ),
        ).otherwise(a),
        lambda a: a["out"],
    )


#: Documents a block, and the bounds of a source's blocks.
BLOCK_DOCS, LEAST_BLOCKS, MOST_BLOCKS = 1024, 64, 1 << 16


def source_blocks(sized: DataFrame, n_blocks: int | None = None) -> DataFrame:
    """Rows (of, n_blocks), one a source, by the source's own size."""
    own = F.least(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.lit(LEAST_BLOCKS)), F.lit(MOST_BLOCKS)).cast("long")
    return sized.groupBy(F.col("source").alias("of")).agg((own if n_blocks is None else F.max(F.lit(n_blocks).cast("long"))).alias("n_blocks"))


def _blocked(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """docs with columns source and h, and the block that h falls in: one row a source
    is broadcast, as the quotas of all sources stand in one row anyway."""
    both = docs.join(F.broadcast(blocks), F.col("source").eqNullSafe(F.col("of")))
    return both.withColumn("block", F.pmod("h", "n_blocks")).drop("of", "n_blocks")


def shards_for(count: int) -> int:
    """Output shards: 64 at least, then one for some hundred thousand documents."""
    return 1 << min(14, max(6, (count >> 17).bit_length()))


def block_plan(
    sized: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    n_shards: int = 64,
    seed: int = 7,
) -> DataFrame:
    """Rows (source, size, h, block) to one row a block: its source's size and target,
    and ``draws``, the (pass, shard, cut, fillers) under which documents with
    h <= cut or h among the fillers go out once each."""
    blocks = (
        sized.groupBy("source", "block")
        .agg(F.sum("size").alias("words"))
        .transform(durable)
    )
    targets = source_targets(
        blocks.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most
    )
    by_source = Window.partitionBy("nth")
    preceding = lambda *by: by_source.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    rest_of = lambda before: F.col("target") - F.col("passes") * F.col("source_size") - before
    sum_before = lambda window: F.coalesce(F.sum("words").over(window), F.lit(0))
    permuted = (
        blocks.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .select("source", "block", "words", "source_size", "target", "nth")
        .withColumn("place", F.xxhash64(F.lit(seed + 1), "source", "block"))
        .withColumn("at", F.row_number().over(by_source.orderBy("place", "block")) - 1)
        .withColumn("of", F.count("*").over(by_source))
        .withColumn(
            "passes",
            F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"),
        )
        .withColumn("wanted", (rest_of(sum_before(preceding("place", "block"))) > 0).cast("long"))
        .transform(durable)
    )

    # The tree: quotas of block draws, split between the shards.
    per_source = permuted.groupBy("nth").agg(
        (F.max("passes") * F.max("of")).alias("full"), F.sum("wanted").alias("last"), F.max("of").alias("of")
    )
    leaves = split_quotas(per_source.select("nth", (F.col("full") + F.col("last")).alias("quota")), n_shards, seed)
    by_shard = Window.partitionBy("nth").orderBy("shard")
    ranges = (
        leaves.withColumn("end", F.sum("n_draws").over(by_shard)).where("n_draws > 0")
        .withColumn("start", F.col("end") - F.col("n_draws"))
        .join(per_source, "nth").transform(durable)
    )
    seats = ranges.where(F.col("start") < F.col("full")).select(
        "nth", "shard", F.explode(F.sequence("start", F.least("end", "full") - 1)).alias("seat")
    )
    # Stretches of the last pass, no shorter than their shard's quota.
    low = F.greatest("start", "full") - F.col("full")
    stretches = (
        ranges.where(F.col("end") > F.col("full"))
        .select(
            "nth", "shard", (F.col("end") - F.col("full") - low).alias("own"),
            F.floor(F.col("of") * low / F.col("last")).alias("a"), F.floor(F.col("of") * (F.col("end") - F.col("full")) / F.col("last")).alias("b"),
        )
        .select("nth", F.col("shard").alias("last_shard"), "own", F.explode(F.sequence("a", F.col("b") - 1)).alias("at"))
    )
    own_order = Window.partitionBy("nth", "last_shard").orderBy(F.xxhash64(F.lit(seed + 3), "last_shard", "block"), "block")
    turn = ("undrawn", F.when(F.col("undrawn") == 0, F.col("last_shard")), F.when(F.col("undrawn") == 0, F.col("nth_drawn")), "place", "block")
    placed = (
        permuted.join(stretches, ["nth", "at"], "left")
        .withColumn("last_shard", F.coalesce("last_shard", F.lit(0)))
        .withColumn("nth_drawn", F.row_number().over(own_order))
        .withColumn("undrawn", (F.col("nth_drawn") > F.coalesce("own", F.lit(0))).cast("int"))
        .withColumn("turn", F.row_number().over(by_source.orderBy(*turn)))
        .withColumn("rest", rest_of(sum_before(preceding("turn"))))
        .withColumn("whole", F.col("words") <= F.col("rest"))
        .withColumn("partly", (F.col("rest") > 0) & (F.col("words") > F.col("rest")))
        .transform(durable)
    )

    # The one block of a source that its target cuts: whole documents in hash
    # order while they fit.  The slice of hashes in which that ends comes first.
    cut_blocks = placed.where("partly").select(F.col("source").alias("s"), F.col("block").alias("b"), "rest")
    hashes = (
        sized.join(F.broadcast(cut_blocks), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
        .groupBy("s", "b", "rest", F.shiftright("h", 52).alias("slice"), "h")
        .agg(F.sum("size").alias("words"))
        .transform(durable)
    )
    in_slices = Window.partitionBy("s").orderBy("slice")
    slices = (
        hashes.groupBy("s", "slice").agg(F.sum("words").alias("slice_words"), F.max("rest").alias("r"))
        .withColumn("so_far", F.sum("slice_words").over(in_slices))
        .where(F.col("so_far") > F.col("r"))
        .groupBy(F.col("s").alias("cs")).agg(F.min(F.struct("slice", (F.col("so_far") - F.col("slice_words")).alias("below"))).alias("cut"))
        .select("cs", F.col("cut.slice").alias("cut_slice"), F.col("cut.below").alias("below"))
    )
    so_far = Window.partitionBy("s").orderBy("h")
    cuts = (
        hashes.join(slices, F.col("s").eqNullSafe(F.col("cs")) & (F.col("slice") == F.col("cut_slice")))
        .withColumn("fits", F.col("below") + F.sum("words").over(so_far) <= F.col("rest"))
        .groupBy("s", "b")
        .agg(
            F.coalesce(F.max(F.when(F.col("fits"), F.col("h"))), F.shiftleft(F.max("cut_slice").cast("long"), 52) - 1).alias("cut"),
            (F.max("rest") - F.max("below") - F.coalesce(F.sum(F.when(F.col("fits"), F.col("words"))), F.lit(0))).alias("left"),
        )
        .transform(durable)
    )
    # Then, from the rest of that block and on through the source's later ones,
    # documents that still fit into what is left.
    later = placed.where("not whole").select(F.col("source").alias("ls"), F.col("block").alias("lb"), F.col("turn").cast("long").alias("turn"), "partly").transform(durable)
    fitting = (
        sized.join(F.broadcast(cuts), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") <= F.col("left")))
        .join(F.broadcast(later) if later.count() <= BROADCAST_ROWS else later, F.col("source").eqNullSafe(F.col("ls")) & (F.col("block") == F.col("lb")))
        .where(~F.col("partly") | (F.col("h") > F.col("cut")))
        .groupBy("s", "b", "left", "turn", "block", "h")
        .agg(F.sum("size").alias("words"))
        .where((F.col("words") > 0) & (F.col("words") <= F.col("left")))
        .transform(durable)
    )
    earlier = Window.partitionBy("s").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    zone = (
        fitting.groupBy("s", "left", "turn").agg(F.sum("words").alias("words"))
        .withColumn("earlier", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
        .where(F.col("earlier") < REACH * F.col("left"))
        .select(F.col("s").alias("zs"), F.col("turn").alias("zt"))
    )
    filled = (
        fitting.join(zone, F.col("s").eqNullSafe(F.col("zs")) & (F.col("turn") == F.col("zt")), "left_semi")
        .withColumn("drawn_before", F.coalesce(F.sum("words").over(Window.partitionBy("s").orderBy("turn", "h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .where(F.col("drawn_before") < REACH * F.col("left"))
        .groupBy("s", "b", "left")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "h", "words", "block"))).alias("others"))
        .select("s", "b", F.explode(_fillers(F.col("others"), F.col("left"))).alias("f"))
        .groupBy(F.col("s").alias("fs"), F.col("b").alias("cut_block"), F.col("f.block").alias("fb"))
        .agg(F.collect_list("f.h").alias("fillers"))
    )

    # In a whole pass the k-th draw of a source is the block at place k.
    full = placed.where("passes > 0").select("source", "block", "nth", "at", "of", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("pass"))
    full = full.withColumn("seat", F.col("pass") * F.col("of") + F.col("at")).join(seats, ["nth", "seat"]).select(
        "source", "block", F.lit(False).alias("last"), "pass", "shard"
    )
    rest = placed.where("whole and rest > 0 or partly").select(
        "source", "block", F.col("partly").alias("last"), F.col("passes").alias("pass"), F.col("last_shard").cast("int").alias("shard")
    )
    seated = full.unionByName(rest)
    all_of_it, nothing = F.lit((1 << 63) - 1), F.array().cast("array<long>")
    last = F.col("last")
    seated = seated.join(cuts.select("s", "b", "cut"), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left").select(
        F.col("source").alias("s"),
        F.col("block").alias("b"),
        "last",
        F.struct("pass", "shard", F.when(last, F.coalesce("cut", F.lit(-(1 << 63)))).otherwise(all_of_it).alias("cut"), nothing.alias("fillers")).alias("draw"),
    ).transform(durable)
    # Fillers of whatever block go out with the cut block's last draw.
    more = filled.join(seated.where("last"), F.col("fs").eqNullSafe(F.col("s")) & (F.col("cut_block") == F.col("b"))).select(
        "s", F.col("fb").alias("b"), "last", F.struct("draw.pass", "draw.shard", F.lit(-(1 << 63)).alias("cut"), "fillers").alias("draw")
    )
    seated = seated.unionByName(more)
    per_block = seated.groupBy("s", "b").agg(F.sort_array(F.collect_list("draw")).alias("draws"))
    return placed.join(
        per_block, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left"
    ).select("source", "block", "source_size", "target", "draws")


def _with_plan(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """docs has columns row, source, h, block; adds source_size, target and its own draws."""
    plan = plan.transform(durable)
    small = plan.count() <= BROADCAST_ROWS  # one row a source and block
    side = plan.select(F.col("source").alias("s"), F.col("block").alias("b"), "source_size", "target", "draws")
    both = docs.join(
        F.broadcast(side) if small else side,
        F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")),
    )
    own = F.filter(F.coalesce("draws", F.array().cast(plan.schema["draws"].dataType)), lambda d: (F.col("h") <= d["cut"]) | F.array_contains(d["fillers"], F.col("h")))
    return both.drop("s", "b", "block").withColumn("draws", own)


def place_of(pass_: Column, h: Column, seed: int = 7) -> Column:
    """Where a draw stands among those of its shard: the local shuffle."""
    return F.xxhash64(F.lit(seed), pass_, h)


def plan_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, n_blocks: int | None = None, **options
) -> DataFrame:
    """One row a document: key, source, size, source_size, target, draws."""
    sized = docs.select(
        docs[key].alias("key"),
        docs[source].alias("source"),
        n_words(docs[text]).alias("size"),
        _block_key(docs, key, text, seed).alias("h"),
    ).transform(durable)
    count = sized.count()
    sized = _blocked(sized, source_blocks(sized, n_blocks).transform(durable))
    return _with_plan(sized, block_plan(sized, seed=seed, **{"n_shards": shards_for(count)} | options))


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, n_blocks: int | None = None,
    n_shards: int | None = None, **options,
) -> DataFrame:
    """The mixture itself: every drawn copy of every row, with all its columns,
    dealt to its shard and shuffled within it."""
    row = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        docs[source].alias("source"),
        _block_key(docs, key, text, seed).alias("h"),
    )
    sized = docs.select(
        docs[source].alias("source"), n_words(docs[text]).alias("size"), _block_key(docs, key, text, seed).alias("h")
    ).transform(durable)
    count = sized.count()
    blocks = source_blocks(sized, n_blocks).transform(durable)
    plan = block_plan(_blocked(sized, blocks), seed=seed, n_shards=n_shards or shards_for(count), **options)
    drawn = _with_plan(_blocked(row, blocks), plan).select("row", "h", F.explode("draws").alias("draw"))
    return (
        drawn.select("row", F.col("draw.shard").alias("shard"), place_of(F.col("draw.pass"), F.col("h"), seed).alias("at"))
        .repartition("shard")
        .sortWithinPartitions("shard", "at")
        .select("row.*")
    )


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    from plebis.llm.common import table

    plan = plan_documents(table(spark, sf_dir, "documents"))
    of_draws = lambda made: F.array_join(F.transform("draws", lambda d: made(d).cast("string")), ",")
    return plan.select(
        F.col("key").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.size("draws") * F.col("size")).cast("long").alias("taken"),
        F.size("draws").alias("copies"),
        of_draws(lambda d: d["shard"]).alias("shards"),
        of_draws(lambda d: place_of(d["pass"], F.col("h"))).alias("places"),
    )
