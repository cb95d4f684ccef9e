"""Whole-cluster resampling with hashed draws, intervals, p values and verdicts."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agreeline.functions.hashes import by_length, numerals
from agreeline.sources.shared import bounded, cut, cut_spread, is_small, ship

from .measures import DIGITS
from .robust import total_order

#: Cumulative probabilities of Poisson(1) for counts 0 to 8. Fixed values.
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998980)
LEAST_DRAWS = 1000
#: A stratum of fewer clusters gives no reliable interval.
LEAST_CLUSTERS = 10
#: Clusters of a stratum that a task holds, hashes that are made at once, strata whose sums a task holds, and clusters in a row.
HELD, TURNS, HELD_STRATA, PACKED = 16_000_000, 32_768, 200, 65_536


def seed_of(master: int, stratum: str) -> int:
    """The seed of a stratum: the first 32 bits of the hash of master:stratum."""
    return int(hashlib.sha256(f"{master}:{stratum}".encode()).hexdigest()[:8], 16)


def check_draws(draws: int, least: int = LEAST_DRAWS) -> int:
    if draws < least:
        raise ValueError(f"{draws} draws; at least {least} are asked for")
    return draws


def stratum_seed(master: int, stratum: Column) -> Column:
    """``seed_of`` as a Spark expression."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(master).cast("string"), stratum).cast("binary"), 256), 1, 8), 16, 10).cast("long")


def indexed(cells: DataFrame, stratum: str, key: str, seed: int) -> DataFrame:
    """Cells, written once, with a dense index ``_i`` in their stratum and the stratum's size ``_g`` and seed
    ``_seed``. Strata whose seeds are equal fail. Few cells are ranked by a window, many ones by ranges."""
    cells = cut_spread(cells)
    sizes = cut(cells.groupBy(F.col(stratum).alias("_st")).agg(F.count(F.lit(1)).alias("_g")).withColumn("_seed", stratum_seed(seed, F.col("_st"))))
    n, different = sizes.agg(F.count(F.lit(1)), F.count_distinct("_seed")).first()
    if n != different:
        raise ValueError("the seeds of strata aren't pairwise distinct")
    if is_small(cells):
        ranked = cells.withColumn("_i", F.row_number().over(Window.partitionBy(stratum).orderBy(key)) - 1)
    else:
        ranked = total_order(cells, [key], "_i", [stratum]).withColumn("_i", F.col("_i") - 1)
    return cut_spread(ranked.join(bounded(sizes), F.col(stratum).eqNullSafe(F.col("_st"))).drop("_st"))


def _values(columns, sums: list[str]) -> np.ndarray:
    """The columns to add up, a row each, nulls as 0: whole numbers stay whole."""
    found = [pc.fill_null(columns[c], 0).to_numpy(zero_copy_only=False) for c in sums]
    return np.stack([v if v.dtype == np.float64 else v.astype(np.int64) for v in found]) if found else np.zeros((0, len(columns[0])), np.int64)


def _sum_fields(cells: DataFrame, stratum: str, sums: list[str]) -> tuple[str, str]:
    """The schema of rounds' sums, and the name of the kind of the sums: long, or double if a column is."""
    whole = all(cells.schema[c].dataType.typeName() in ("byte", "short", "integer", "long") for c in sums)
    kind = "long" if whole else "double"
    fields = ["b int", f"`{stratum}` {cells.schema[stratum].dataType.simpleString()}", *(f"`{c}` {kind}" for c in sums), "_g long"]
    return ", ".join(fields), kind


def bootstrap_sums(cells: DataFrame, stratum: str, key: str, sums: list[str], draws: int, seed: int, size: str | None = None, least: int = LEAST_DRAWS) -> DataFrame:
    """(b, stratum, sums): in each of ``draws`` rounds as many clusters as the stratum has, drawn with
    replacement by hash, four draws from each. With ``size``, a column of that name has the stratum's number of
    clusters. Fewer than ``least`` draws fail; null sums count as 0.

    Clusters are packed: a row has the sums of up to ``PACKED`` of them as bytes, and is sent once to each of a fixed
    number of tasks, which share the rounds of all strata evenly. A task holds one stratum at a time, draws, and
    adds up what it draws. Only a stratum of more than ``HELD`` clusters is cut, and drawn anew for each part.
    """
    check_draws(draws, least)
    own = indexed(cells, stratum, key, seed)
    tasks = min(draws, 2 * max(8, own.sparkSession.sparkContext.defaultParallelism))
    schema, kind = _sum_fields(own, stratum, sums)
    names, turns_held, exact = ["b", stratum, *sums, "_g"], TURNS, np.int64 if kind == "long" else np.float64

    def draw(batches):
        for name, g, own_seed, task, low, n, columns in _parts(batches, len(sums)):
            rounds, turns = range(task, draws, tasks), -(-g // 4)
            out = np.zeros((len(rounds), len(sums)), exact)
            for turn in range(0, turns, turns_held):
                for first, tails in numerals(turn, min(turn + turns_held, turns)):
                    last = 4 * (first + len(tails.texts) - 1)
                    for row, hashes in tails.md5([f"{own_seed}:{b}:".encode() for b in rounds], turns_held):
                        for k, h in enumerate(hashes):
                            h = h if last + k < g else h[:, :-1]  # of the last hash, only as many as are left
                            at = (h - h // np.uint32(g) * np.uint32(g) if g < 1 << 32 else h).astype(np.int64)
                            if n < g:
                                at -= low
                                others = (at < 0) | (at >= n)
                                at[others] = 0
                            for i, v in enumerate(columns):
                                drawn = v.take(at)
                                if n < g:
                                    drawn[others] = 0
                                out[row : row + len(h), i] += drawn.sum(1, dtype=exact)
            found = [pa.array([*rounds], pa.int32()), pa.repeat(name, len(rounds)), *[pa.array(x) for x in out.T], pa.array([g] * len(rounds), pa.int64())]
            yield pa.RecordBatch.from_arrays(found, names)

    ship(own.sparkSession)
    sent = _packed(own, stratum, sums).withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    dealt = sent.repartitionById(tasks, "_t").sortWithinPartitions("_t", stratum, "_c", "_b")
    found = dealt.select(stratum, "_g", "_seed", "_t", "_c", "_low", "_n", *[f"_v{i}" for i in range(len(sums))], "_kinds").mapInArrow(draw, schema)
    return found.groupBy("b", stratum).agg(*[F.sum(c).alias(c) for c in sums], *([F.max("_g").alias(size)] if size else []))


def _packed(own: DataFrame, stratum: str, sums: list[str]) -> DataFrame:
    """The cells of ``indexed``, those of up to ``PACKED`` following indexes in a row: its part ``_c`` of the stratum,
    the part's first index ``_low``, the block ``_b`` of the part, the number of cells ``_n``, and each of the sums as the
    bytes ``_v0``, ``_v1``, ... of the shortest numbers that hold it, whose kinds are in ``_kinds``."""
    part, size = HELD, min(PACKED, HELD)
    named = [f"_v{i}" for i in range(len(sums))]
    kind = own.schema[stratum].dataType.simpleString()
    schema = f"`{stratum}` {kind}, _g long, _seed long, _c long, _low long, _b long, _n long, {''.join(f'{v} binary, ' for v in named)}_kinds string"

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("_i")
        short = [_shortest(v) for v in _values(table, sums)]
        first = {c: table[c][:1] for c in (stratum, "_g", "_seed", "_c", "_b")}
        low = pa.array([first["_c"][0].as_py() * part], pa.int64())
        columns = [*[first[c] for c in (stratum, "_g", "_seed", "_c")], low, first["_b"], pa.array([len(table)], pa.int64())]
        return pa.table([*columns, *[pa.array([v.tobytes()]) for v in short], pa.array([",".join(v.dtype.str for v in short)])], [stratum, "_g", "_seed", "_c", "_low", "_b", "_n", *named, "_kinds"])

    places = {"_c": F.floor(F.col("_i") / part), "_b": F.floor(F.pmod(F.col("_i"), F.lit(part)) / size)}
    return own.select(stratum, "_i", "_g", "_seed", *sums).withColumns(places).groupBy(stratum, "_c", "_b").applyInArrow(pack, schema)


def _shortest(v: np.ndarray) -> np.ndarray:
    """Whole numbers as the shortest kind that holds all of them."""
    if v.dtype == np.float64 or not len(v):
        return v
    low, high = int(v.min()), int(v.max())
    return v.astype(next(k for k in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(k).min <= low and high <= np.iinfo(k).max))


def _parts(batches, n_sums: int):
    """The parts of ``_packed`` whose rows follow one another: stratum, its size and seed, the task, the part's
    first index and number of cells, and its columns."""
    held, last = [], None

    def whole():
        kinds = [k.split(",") for *_, k in held]
        columns = [np.concatenate([np.frombuffer(row[1 + i], k[i]) for row, k in zip(held, kinds, strict=True)]) for i in range(n_sums)]
        name, g, seed, task, _, low = last
        return name, g, seed, task, low, sum(row[0] for row in held), columns

    for batch in batches:
        for r in range(batch.num_rows):
            name, *numbers = [batch.column(i)[r] for i in range(6)]
            this = (name, *[x.as_py() for x in numbers])
            if this != last:
                if held:
                    yield whole()
                held, last = [], this
            held.append((batch.column(6)[r].as_py(), *[batch.column(7 + i)[r].as_buffer() for i in range(n_sums)], batch.column(7 + n_sums)[r].as_py()))
    if held:
        yield whole()


def poisson_sums(cells: DataFrame, stratum: str, key: str, sums: list[str], draws: int, seed: int, size: str | None = None, least: int = LEAST_DRAWS) -> DataFrame:
    """The same with Poisson weights by cluster and round: no index and no join. A task adds up all rounds of
    the clusters that it reads in one array for each stratum, many clusters at a time."""
    check_draws(draws, least)
    cells = cut_spread(cells)
    tasks = 2 * max(8, cells.sparkSession.sparkContext.defaultParallelism)
    schema, kind = _sum_fields(cells, stratum, sums)
    given = cells.select(F.col(stratum), stratum_seed(seed, F.col(stratum)).alias("_seed"), F.col(key).cast("string").alias("_key"), *sums)
    given = given.repartition(tasks, "_seed", "_key")  # their rounds are spread with the clusters
    limits = [np.uint64(math.ceil(p * 2**52)) for p in POISSON]
    most, at_once, names, exact = HELD_STRATA, TURNS, ["b", stratum, *sums, "_g"], np.int64 if kind == "long" else np.float64

    def weigh(batches):
        held: dict = {}  # by stratum: sums of all rounds, number of clusters, and clusters to be weighed

        def add(s):
            total, _, keys, values = held[s]
            own = np.concatenate(values, 1)
            for places, tails in by_length(keys):
                some = own[:, places].T
                for b, h in tails.md5([f"{s[1]}:{b}".encode() for b in range(draws)], at_once):
                    drawn = (h[0].astype(np.uint64) << np.uint64(20)) | (h[1] >> np.uint32(12))
                    times = np.zeros(drawn.shape, np.uint8)
                    for limit in limits:
                        times += drawn >= limit
                    total[b : b + len(times)] += times.astype(np.int64) @ some
            keys.clear()
            values.clear()

        def rows():
            for s, (total, n, keys, _) in held.items():
                if keys:
                    add(s)
                found = [pa.array(range(draws), pa.int32()), pa.array([s[0]] * draws, kind_of_stratum), *[pa.array(x) for x in total.T], pa.array([n] * draws, pa.int64())]
                yield pa.RecordBatch.from_arrays(found, names)
            held.clear()

        for batch in batches:
            kind_of_stratum, values = batch.schema.field(stratum).type, _values(batch, sums)
            where: dict = {}
            for i, s in enumerate(zip(batch[stratum].to_pylist(), batch["_seed"].to_pylist(), strict=True)):
                where.setdefault(s, []).append(i)
            keys = batch["_key"].to_pylist()
            for s, places in where.items():
                total, n, waiting, their = held.get(s, (np.zeros((draws, len(sums)), exact), 0, [], []))
                waiting += [b"" if keys[i] is None else f":{keys[i]}".encode() for i in places]
                their.append(values[:, places])
                held[s] = (total, n + len(places), waiting, their)
                if len(waiting) >= at_once:
                    add(s)
            if len(held) > most:
                yield from rows()
        yield from rows()

    ship(cells.sparkSession)
    found = given.mapInArrow(weigh, schema)
    return found.groupBy("b", stratum).agg(*[F.sum(c).alias(c) for c in sums], *([F.sum("_g").alias(size)] if size else []))


#: How rounds are drawn: clusters one by one, or Poisson weights of them.
SCHEMES = {"drawn": bootstrap_sums, "poisson": poisson_sums}


def resampled_sums(cells: DataFrame, stratum: str, key: str, sums: list[str], draws: int, seed: int, scheme: str, size: str | None = None, least: int = LEAST_DRAWS) -> DataFrame:
    """Sums of each round by the scheme that the caller names, whatever the number of cells."""
    return SCHEMES[scheme](cells, stratum, key, sums, draws, seed, size, least)


def interval(replicates: DataFrame, by: list[str], value: str, observed: str | None = None, size: str | None = None) -> DataFrame:
    """low and high (2.5 and 97.5 %), p two-sided, and with ``observed``, a column that holds the observed
    value, p_opposite: twice the share of replicates on the other side of 0 than the observed value (0
    counts as both). With ``size``, the least of that column, too."""
    v = F.col(value)
    share = lambda c: F.avg(c.cast("double"))
    aggs = [
        F.count(v).alias("n_rounds"), F.round(F.percentile(v, F.lit(0.025)), DIGITS).alias("low"), F.round(F.percentile(v, F.lit(0.975)), DIGITS).alias("high"),
        F.round(F.least(F.lit(1.0), 2 * F.least(share(v > 0), share(v < 0))), DIGITS).alias("p"),
    ]
    if observed:
        against = F.when(F.max(observed) >= 0, share(v <= 0)).when(F.max(observed) < 0, share(v >= 0))
        aggs += [F.round(F.max(observed), DIGITS).alias("observed"), F.round(F.least(F.lit(1.0), 2 * against), DIGITS).alias("p_opposite")]
    if size:
        aggs.append(F.min(size).alias(size))
    return replicates.groupBy(*by).agg(*aggs) if by else replicates.agg(*aggs)


def benjamini_hochberg(p_values: DataFrame, name: str, p: str, m: int) -> DataFrame:
    """Adds p_bh: p * m / rank, made monotone from the largest, at most 1. One row per test, few of them;
    a number of tests other than the declared m fails."""
    p_values = cut(p_values)
    if (n := p_values.count()) != m:
        raise ValueError(f"{n} tests where {m} were declared")
    up = Window.orderBy(p, name)
    down = Window.orderBy(F.desc(p), F.desc(name)).rowsBetween(Window.unboundedPreceding, 0)
    ranked = p_values.withColumn("_r", F.row_number().over(up)).withColumn("_x", F.col(p) * m / F.col("_r"))
    return ranked.withColumn("p_bh", F.round(F.least(F.lit(1.0), F.min("_x").over(down)), DIGITS)).drop("_r", "_x")


def enough(n_clusters: Column) -> Column:
    return F.coalesce(n_clusters >= LEAST_CLUSTERS, F.lit(False))


def conclusion(n_clusters: Column) -> Column:
    """``inconclusive`` where the smallest stratum has too few clusters."""
    return F.when(enough(n_clusters), "estimated").otherwise("inconclusive")


def away(low: Column, high: Column) -> Column:
    """Whether an interval lies on one side of 0."""
    return F.coalesce((low > 0) | (high < 0), F.lit(False))


def sign_flip(gap: Column, ratio: Column) -> Column:
    """Whether the absolute and the relative gap have different signs; a missing ratio counts as a flip."""
    return F.coalesce(F.signum(gap) != F.signum(ratio), F.lit(True))


def verdict(low: Column, high: Column, reliable: Column) -> Column:
    return F.when(~reliable | low.isNull(), "inconclusive").when(low > 0, "gap_above_0").when(high < 0, "gap_below_0").otherwise("consistent_with_0")
