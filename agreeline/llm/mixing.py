"""Mixing sources to target weights, with DataFrame functions only.

Targets are water-filled: each source's share of all words follows its weight, up to a number of
passes over the source. A source's documents are permuted by hash and fall into permuted blocks; a
target becomes full passes over all blocks, a number of leading blocks, and part of the next one.
A splitting tree deals the block quotas of all sources to output shards: every node halves its
blocks, drawing how many of each source go left from the multivariate hypergeometric distribution,
group of sources by group, then source by source. The counts at the leaves are exact: they add up to each source's quota and differ
by one block at most between shards. Each shard then takes the next blocks of each source, so
shards share no block, and its documents are shuffled by hash within the shard.

Rows are told apart by a hash of all that the mix reads and a turn among rows that are equal in it.
Which of equal rows has which turn makes no difference, so turns are given out within the tasks that
hold the rows, after an offset for each task; rows that are all alike meet nowhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, cut, fresh, n_words

#: Bits of the permutation: blocks use the leading ones, steps inside a block the next ones.
BITS = 24
#: Most leading bits for blocks of a source, and for steps of a block.
BLOCK_BITS = 12
#: Documents of a block or step that the number of bits aims at.
PER_BLOCK = 64
#: Draws inside a step that close in on the target.
REFINE = 4
WEIGHTS = (5.0, 2.0, 1.0)
#: Sources, or groups of sources, whose counts one row of the splitting tree has.
FAN = 256
#: Most tasks for the draws of a level.
MOST_TASKS = 1000


def bits_for(rows: Column, most: int) -> Column:
    """Bits that split so many rows into groups of about PER_BLOCK."""
    return F.least(F.lit(most), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(rows, F.lit(1)) / PER_BLOCK)))).cast("int")


def running(rows: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """``rows`` with, by name, the sum of each column over the rows before, in an order that has no ties.

    Rows are dealt to tasks by ranges of the order. Each task adds up its own rows, from the sums of the
    tasks before it, so what meets in one task is a row for each of them."""
    own, own2, *before = fresh(rows, "part", "part2", *(f"{name}_before" for name in sums))
    rows = cut(rows.repartitionByRange(*order).withColumn(own, F.spark_partition_id()))
    earlier = Window.orderBy(own2).rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(own).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    tasks = rows.groupBy(F.col(own).alias(own2)).agg(*[F.sum(c).alias(b) for b, c in zip(before, sums.values(), strict=True)])
    tasks = tasks.select(own2, *[F.coalesce(F.sum(b).over(earlier), F.lit(0)).alias(b) for b in before])
    out = rows.withColumns({name: F.coalesce(F.sum(c).over(within), F.lit(0)) for name, c in sums.items()})
    out = out.join(bounded(tasks), F.col(own) == F.col(own2))
    return out.withColumns({name: F.col(name) + F.col(b) for name, b in zip(sums, before, strict=True)}).drop(own, own2, *before)


def in_order(source: str = "src") -> list[Column]:
    """Sources by code point, null last."""
    return [F.col(source).isNull(), F.col(source)]


def water_fill(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, passes: float = 3.0) -> DataFrame:
    """``sources`` (src, docs, source_size) with weight and target (double).

    Sources take the weights in turn, by code point, null last. Targets are level * weight, or
    passes * source_size where that is less; the level is such that they add up to all sizes. That
    is where resharing the excess by weight ends. Sources, however many, are added up in ranges.
    """
    turn = F.pmod(F.col("turn"), F.lit(len(weights))).cast("int")
    out = running(sources, in_order(), turn=F.lit(1))
    out = out.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1)).drop("turn")
    out = out.withColumns({"cap": passes * F.col("source_size"), "ratio": passes * F.col("source_size") / F.col("weight")})
    out = cut(running(out, [F.col("ratio"), *in_order()], capped=F.col("cap"), used=F.col("weight")))
    size, weight = out.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(size) - F.col("capped")) / (F.lit(weight) - F.col("used"))
    # the first level, by ratio, that a source's cap doesn't stop
    first = out.filter(level <= F.col("ratio")).agg(F.min(F.struct("ratio", F.col("src").isNull().alias("null"), "src", level.alias("level")))["level"]).first()[0]
    return out.withColumn("target", F.least("cap", F.coalesce(F.lit(first).cast("double"), F.col("ratio")) * F.col("weight"))).drop("cap", "ratio", "capped", "used")


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) that follows from the seed and the parts."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 52)) / float(1 << 52)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row."""
    return F.transform(F.array(value), body)[0]


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` blocks out of ``total`` are among the ``marked``, for the uniform u.

    The probabilities, as ratios to the mode's, are walked from the mode down to the least count that
    can occur, or 14 standard deviations, for their sum, then up again to where the sum passes u.
    """
    low, high = F.greatest(F.lit(0), drawn + marked - total), F.least(marked, drawn)
    n, k, m = (x.cast("double") for x in (total, marked, drawn))
    spread = (14 * F.sqrt(F.greatest(F.lit(1.0), m * k / n * (1 - k / n))) + 4).cast("long")
    mode = F.least(high, F.greatest(low, F.floor((m + 1) * (k + 1) / (n + 2)).cast("long")))

    def chosen(c: Column) -> Column:
        mode, start, end = c["mode"], c["start"], c["end"]
        up = lambda x: (k - x) * (m - x) / ((x + 1) * (n - k - m + x + 1))  # noqa: E731  p(x + 1) / p(x)
        none = F.array().cast("array<bigint>")
        walk = lambda over, ratio: F.aggregate(
            over,
            F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum")),
            lambda a, x: (lambda p: F.struct(p.alias("p"), (a["sum"] + p).alias("sum")))(a["p"] * ratio(x.cast("double"))),
        )
        below = walk(F.when(mode > start, F.sequence(mode - 1, start, F.lit(-1))).otherwise(none), lambda x: 1 / up(x))
        above = walk(F.when(mode < end, F.sequence(mode, end - 1)).otherwise(none), up)

        def climb(b: Column) -> Column:
            aim = u * (b["b"]["sum"] + 1 + b["a"])
            step = lambda a, x: F.struct(
                (a["p"] * up(x.cast("double"))).alias("p"), (a["sum"] + a["p"]).alias("sum"), (a["n"] + F.when(a["sum"] + a["p"] <= aim, 1).otherwise(0)).alias("n")
            )
            return F.aggregate(F.when(start < end, F.sequence(start, end - 1)).otherwise(none), F.struct(b["b"]["p"].alias("p"), F.lit(0.0).alias("sum"), F.lit(0).alias("n")), step)["n"]

        return F.least(end, start + let(F.struct(below.alias("b"), above["sum"].alias("a")), climb))

    bounds = F.struct(mode.alias("mode"), F.greatest(low, mode - spread).alias("start"), F.least(high, mode + spread).alias("end"))
    return F.when(total <= 0, 0).otherwise(let(bounds, chosen)).cast("long")


def drawn_left(counts: Column, total: Column, drawn: Column, uniform_of: Callable[[Column], Column]) -> Column:
    """How many of each of ``counts``, which add up to ``total``, are among ``drawn``: one after the other,
    hypergeometric given what the earlier ones have taken. ``uniform_of`` gives the uniform of the i-th, from 1."""

    def step(a: Column, s: Column) -> Column:
        k = hypergeometric(a["n"], s["x"], a["m"], uniform_of(s["i"]))
        return let(k, lambda k: F.struct((a["n"] - s["x"]).alias("n"), (a["m"] - k).alias("m"), F.concat(a["l"], F.array(k)).alias("l")))

    start = F.struct(total.alias("n"), drawn.alias("m"), F.array().cast("array<bigint>").alias("l"))
    return F.aggregate(F.zip_with(counts, F.sequence(F.lit(1), F.size(counts)), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), start, step)["l"]


def splitting_tree(quotas: DataFrame, depth: int, seed: int = 17) -> DataFrame:
    """(src, shard, first, blocks) from ``quotas`` (src, quota): 2**depth shards, whose block counts
    of each source add up to its quota; ``first`` is the place of the shard's first block.

    A row has the counts of FAN sources in a node. Where there are more, their sums make up rows of a
    tier above, and so on up to one row for each node. What goes left is drawn from the top tier down:
    of the groups in a row first, then, with each group's share of the draw, of what is in the group.
    That draws from the same distribution as one source after the other, and no row grows with the sources.
    """
    sources = cut(running(quotas.withColumn("quota", F.col("quota").cast("long")), in_order(), place=F.lit(1)))
    group = lambda x: F.floor(F.col(x) / FAN).cast("long").alias("g")
    listed = F.sort_array(F.collect_list(F.struct("place", "src", "quota"))).alias("sources")
    node = sources.groupBy(group("place")).agg(listed).select("g", "sources", F.transform("sources", lambda x: x["quota"]).alias("c"), F.lit(0).alias("node"))
    node, n, tiers = cut(node), sources.count(), 0
    while FAN ** (tiers + 1) < n:
        tiers += 1
    whole = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    for level in range(depth):
        rows = [node]
        for _ in range(tiers):
            held = F.transform(F.sort_array(F.collect_list(F.struct("g", whole("c").alias("c")))), lambda x: x["c"])
            rows.append(rows[-1].groupBy("node", group("g")).agg(held.alias("c")))
        top = rows[-1].withColumn("total", whole("c"))
        # an odd block goes left or right by chance
        half = (F.col("total") + F.when(uniform(seed, F.lit(level), F.col("node")) < 0.5, 1).otherwise(0)) / 2
        split = top.withColumn("half", half.cast("long"))
        for tier in range(tiers, -1, -1):
            index = lambda i: (F.col("g") * FAN + i).cast("int")
            chance = lambda i, tier=tier, index=index: uniform(seed + 1 + tier, F.lit(level), F.col("node"), index(i))
            # few bytes but long walks: tasks by number of rows, eight or so in each
            tasks = min(MOST_TASKS, 1 + 2**level * n // (8 * FAN ** (tier + 1)))
            split = split.repartition(tasks, "node", "g")
            split = cut(split.withColumn("l", drawn_left(F.col("c"), F.col("total"), F.col("half"), chance)))
            if tier:
                share = split.select(F.col("node").alias("n2"), "g", F.posexplode("l").alias("at", "half")).select("n2", (F.col("g") * FAN + F.col("at")).alias("g2"), "half")
                below = rows[tier - 1].withColumn("total", whole("c"))
                split = below.join(share, (F.col("node") == F.col("n2")) & (F.col("g") == F.col("g2"))).drop("n2", "g2")
        left, right = F.col("l"), F.zip_with("c", "l", lambda x, y: x - y)
        side = F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), left.alias("c")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("c"))))
        node = split.select("g", "sources", side.alias("x")).select("g", "sources", "x.c", "x.node")
    leaf = node.select(F.col("node").alias("shard"), F.explode(F.arrays_zip("sources", "c")).alias("x")).select("x.sources.src", "shard", F.col("x.c").alias("blocks"))
    order = Window.partitionBy("src").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return leaf.withColumn("first", F.coalesce(F.sum("blocks").over(order), F.lit(0)))


def identity(key: str, source: str, text: str, seed: int) -> Column:
    """A hash of what the mix reads of a row."""
    return F.xxhash64(F.lit(seed), F.col(key).isNull(), F.col(key), F.col(source).isNull(), F.col(source), F.col(text).isNull(), F.col(text))


def with_turns(rows: DataFrame, row: str, turn: str) -> DataFrame:
    """``rows``, which must be written already, with a number from 0 on among those of equal ``row``. Each
    task numbers its own rows, from the number of those in the tasks before it."""
    own, row2, own2, before = fresh(rows, "part", "row2", "part2", "before")
    rows = rows.withColumn(own, F.spark_partition_id())
    rows = cut(rows)
    counts = rows.groupBy(F.col(row).alias(row2), F.col(own).alias(own2)).agg(F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy(row2).orderBy(own2).rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(row2, own2, F.coalesce(earlier, F.lit(0)).alias(before))
    place = F.row_number().over(Window.partitionBy(row, own).orderBy(row))
    out = rows.withColumn(turn, place).join(counts, (F.col(row) == F.col(row2)) & (F.col(own) == F.col(own2)))
    return out.withColumn(turn, (F.col(turn) - 1 + F.col(before)).cast("long")).drop(own, row2, own2, before)


def mix(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, passes: float = 3.0, depth: int = 4, seed: int = 17,
    key: str = "doc_id", source: str = "source", text: str = "text",
) -> DataFrame:
    """(key, src, size, source_size, target, copies, shards, row, turn, equals) of every row.

    * size: words of the whole text (null: 0), however long. source_size, target: of its source.
    * copies: how often the mix takes the document, at most ``passes`` rounded up and never more
      than passes times its words; shards: the output shard of each copy, in order.
    * row, turn: which row it is, for ``draw``: equal rows (equals of them) have the turns from 0 on.
    * A null source is a source of its own. Sources without words have target 0 and no copies;
      a document without words is taken with its block and adds nothing.
    * Rows that repeat, or share a key or have none, are rows of their own, taken or left each by
      itself. Reruns agree. An empty table gives none. Other columns, whatever their names, are ignored.

    Only numbers are shuffled. A source's documents meet nowhere: their words are added up by block
    and step, both of bounded number, and only the rows of the last step of a source are ranked.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(source).alias("src"), n_words(text).alias("size"), identity(key, source, text, seed).alias("row"))
    part = F.pmod(F.xxhash64(F.lit(seed), "row", "turn"), F.lit(1 << BITS)).cast("int")
    rows = cut(with_turns(cut(rows), "row", "turn").withColumn("at", part))
    sources = rows.groupBy("src").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size"))
    sources = water_fill(sources, weights, passes).withColumn("bits", bits_for(F.col("docs"), BLOCK_BITS))
    full = F.when(F.col("source_size") > 0, F.floor(F.round(F.col("target") / F.col("source_size"), 9))).otherwise(0).cast("int")
    sources = cut(sources.withColumn("full", full).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("full") * F.col("source_size"))))

    names = sources.select(F.col("src").alias("s"), "bits", "full", "rest", "source_size", "target")
    rows = rows.join(bounded(names), F.col("src").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("block", (F.col("at") / F.pow(F.lit(2), BITS - F.col("bits"))).cast("int"))

    # the leading blocks that fit into the rest, and the one it ends in
    blocks = cut(rows.groupBy("src", "block", "bits", "full", "rest").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")))
    run = Window.partitionBy("src").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
    blocks = blocks.withColumns({
        "whole": (F.col("before") + F.col("words") <= F.col("rest")) & (F.col("rest") > 0),
        "part": (F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")),
        "steps": bits_for(F.col("n"), BITS - BLOCK_BITS), "left": F.col("rest") - F.col("before"),
    })

    # inside that block: the steps that fit, then documents of the step it ends in
    ends = blocks.filter("part").select(F.col("src").alias("s"), F.col("block").alias("b"), "steps", "left")
    inside = rows.select("row", "turn", "src", "block", "bits", "size", "at").join(bounded(ends), F.col("src").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    low = F.col("at") - F.col("block") * F.pow(F.lit(2), BITS - F.col("bits"))
    inside = cut(inside.withColumn("step", (low / F.pow(F.lit(2), BITS - F.col("bits") - F.col("steps"))).cast("int")).drop("s", "b"))
    steps = inside.groupBy("src", "step", "left").agg(F.sum("size").alias("words"))
    run = Window.partitionBy("src").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("b4", F.coalesce(F.sum("words").over(run), F.lit(0))).select(
        F.col("src").alias("s"), F.col("step").alias("st"), (F.col("b4") + F.col("words") <= F.col("left")).alias("fits"), (F.col("left") - F.col("b4")).alias("need")
    )
    inside = inside.join(bounded(steps), F.col("src").eqNullSafe(F.col("s")) & (F.col("step") == F.col("st"))).drop("s", "st")
    last = inside.filter(~F.col("fits") & (F.col("need") > 0)).withColumns({"taken": F.lit(False), "open": F.col("need")})
    for again in range(REFINE):
        # of those not taken that still fit, the first ones by hash whose sum fits
        can = ~F.col("taken") & (F.col("size") <= F.col("open")) & (F.col("size") > 0)
        order = Window.partitionBy("src").orderBy(F.when(can, 0).otherwise(1), F.xxhash64(F.lit(seed + again), "at"), F.desc("size"), "row", "turn")
        sums = F.sum(F.when(can, F.col("size")).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
        last = last.withColumn("now", can & (sums <= F.col("open")))
        got = F.sum(F.when(F.col("now"), F.col("size")).otherwise(0)).over(Window.partitionBy("src"))
        last = last.withColumns({"open": F.col("open") - got, "taken": F.col("taken") | F.col("now")})
    # the one document that brings the sum nearer to the target than it is without it
    near = ~F.col("taken") & (F.col("size") > 0) & (F.col("size") < 2 * F.col("open"))
    order = Window.partitionBy("src").orderBy(F.when(near, F.abs(F.col("size") - F.col("open"))).otherwise(F.lit(float("inf"))), "at", "row", "turn")
    last = last.withColumn("taken", F.col("taken") | (near & (F.row_number().over(order) == 1)))
    chosen = inside.filter("fits").select("row", "turn").union(last.filter("taken").select("row", "turn"))
    picked = chosen.select(F.col("row").alias("pr"), F.col("turn").alias("pt"), F.lit(True).alias("picked"))

    # the quota of each source in blocks, dealt to shards by the tree
    each = F.col("full") + F.when(F.col("whole") | F.col("part"), 1).otherwise(0)
    quotas = blocks.groupBy("src").agg(F.sum(each).cast("int").alias("quota"))
    dealt = splitting_tree(quotas, depth, seed)
    shares = dealt.groupBy(F.col("src").alias("s")).agg(F.sort_array(F.collect_list(F.struct("first", "shard", "blocks"))).alias("deal"))
    place = Window.partitionBy("src").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumns({"copies": each, "place": F.coalesce(F.sum(each).over(place), F.lit(0))}).join(bounded(shares), F.col("src").eqNullSafe(F.col("s")))
    number = F.when(F.col("copies") > 0, F.sequence(F.col("place"), F.col("place") + F.col("copies") - 1)).otherwise(F.array().cast("array<bigint>"))
    shard = lambda i: F.element_at(F.filter("deal", lambda d: (d["first"] <= i) & (i < d["first"] + d["blocks"])), 1)["shard"]
    blocks = blocks.select(F.col("src").alias("s"), F.col("block").alias("b"), "whole", "part", F.transform(number, shard).alias("deals"))

    out = rows.join(bounded(blocks), F.col("src").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    out = out.join(bounded(picked), (F.col("row") == F.col("pr")) & (F.col("turn") == F.col("pt")), "left")
    more = F.col("whole") | (F.col("part") & F.col("picked").isNotNull())
    out = out.withColumn("copies", F.col("full") + F.when(more, 1).otherwise(0))
    several = bounded(rows.filter("turn > 0").groupBy(F.col("row").alias("er")).agg((F.max("turn") + 1).alias("equals")))
    out = out.join(several, F.col("row") == F.col("er"), "left")
    return out.select(
        F.col("id").alias(key), "src", "size", "source_size", "target", "copies", F.slice("deals", F.lit(1), F.col("copies")).alias("shards"), "row", "turn", F.coalesce("equals", F.lit(1)).alias("equals")
    )


def draw(docs: DataFrame, plan: DataFrame, seed: int = 17, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mixed documents: each row of ``docs`` as often as its row of the plan says, shard by shard, in an
    order by hash within the shard. The columns are those of ``docs``, whatever their names. ``plan`` is
    what ``mix`` made of the same rows with the same seed; rows without copies don't appear."""
    names = docs.columns
    row, turn, copy, shard, r, t, shards = fresh(docs, "row", "turn", "copy", "shard", "r", "t", "shards")
    plan = cut(plan.filter("copies > 0").select(F.col("row").alias(r), F.col("turn").alias(t), "equals", F.col("shards").alias(shards)))
    given = docs.withColumn(row, identity(key, source, text, seed))
    same = F.col(row) == F.col(r)
    out = given.join(bounded(plan.filter("equals = 1").select(r, shards)), same).drop(r)
    # only rows that others equal need their turn
    equal = plan.filter("equals > 1").drop("equals")
    repeated = equal.select(r).distinct()
    if not repeated.isEmpty():
        again = with_turns(given.join(bounded(repeated), same, "left_semi"), row, turn)
        out = out.unionByName(again.join(bounded(equal), same & (F.col(turn) == F.col(t))).drop(r, t, turn))
    out = out.select(*[F.col(f"`{c}`") for c in names], row, F.posexplode(shards).alias(copy, shard))
    spread = F.pmod(F.xxhash64(F.lit(seed), row, copy), F.lit(64))  # shards are dealt out in 64 parts each
    return out.repartition(shard, spread).sortWithinPartitions(shard, F.xxhash64(F.lit(seed + 1), row, copy)).select(*[F.col(f"`{c}`") for c in names])
