"""Exact top-k search by inner product, pruned by multi-resolution segment statistics.

Since |q - x|^2 = |q|^2 + |x|^2 - 2 <q, x>, a lower bound of the distance is an upper bound of the
inner product. Inside a segment of length L with means m and deviations s, the inner product is at
most L * (m_q * m_x + s_q * s_x). Vectors are turned first by an orthogonal matrix that decorrelates
the candidates, which changes no product, so leading segments hold most of what differs. From one
resolution to the next segments get shorter, at last down to single components in front, and only
pairs whose sum of bounds can still reach the query's k-th best score go on. What survives all
resolutions gets its exact product, of whole numbers.

The same statistics prune whole groups. Candidates lie in groups of like ones, each with the ranges of
its members' statistics; a query first meets its own group, which gives it k scores to beat, and then
goes only to groups whose ranges can reach them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ship

#: Resolutions, coarse to fine: the share of leading components that are segments of their own, and
#: into how many segments the others fall.
RESOLUTIONS = ((0.0, 4), (0.0, 16), (0.5, 8), (0.75, 4))
#: Queries that a task gathers, candidates of a group; queries and candidates that a task compares at
#: once; and pairs whose exact products it takes at once.
QUERY_BLOCK, GROUP, ROWS, TILE, PAIRS = 8192, 32_768, 1024, 2048, 1 << 16
#: Groups grow rather than have ranges of more than about twice so many numbers, which the driver holds.
MOST_NUMBERS = 1 << 22
#: Of a group's ranges: leading components that are segments of their own, and segments of the others.
HEAD, TAIL = 16, 4
#: Queries whose groups a task names at once.
ROUTED = 64
#: Candidates of a tile, those of the highest coarse bounds, that raise the k-th best score first.
FIRST = 16
#: Widest vectors that are turned; others keep their components as they are.
TURNED = 1024
#: The score of a place that nothing holds yet.
LOW = np.iinfo(np.int64).min


def segments(x: np.ndarray, alone: float, n: int) -> np.ndarray:
    """For each row, the means and deviations of segments, scaled so that their products add up to the
    bound: the first share ``alone`` of the components one by one, the others in n segments."""
    head = int(alone * x.shape[1])
    parts = np.array_split(x[:, head:], min(n, max(1, x.shape[1] - head)), axis=1)
    mean = np.stack([p.mean(1) * np.sqrt(p.shape[1]) if p.shape[1] else np.zeros(len(x)) for p in parts], 1)
    dev = np.stack([np.sqrt(np.maximum(0, ((p - p.mean(1, keepdims=True)) ** 2).sum(1))) if p.shape[1] else np.zeros(len(x)) for p in parts], 1)
    return np.concatenate([x[:, :head], mean, dev], 1)


def turn(x: np.ndarray, axes: np.ndarray | None) -> np.ndarray:
    return x if axes is None else x @ axes


def axes_of(moments: np.ndarray) -> np.ndarray | None:
    """The axes along which vectors of these second moments vary most, those first; None for none."""
    if len(moments) < 2 or not np.isfinite(moments).all():
        return None
    return np.linalg.eigh(moments)[1][:, ::-1]


def matrix(column: pa.ChunkedArray | pa.Array, width: int, fill: float = 0, kind: type = np.float64) -> np.ndarray:
    """A column of lists as rows, the missing ends filled."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = flat if isinstance(flat, pa.Array) else pa.concat_arrays(flat.chunks)
    size = np.diff(flat.offsets.to_numpy())
    out = np.full((len(flat), width), fill, kind)
    out[np.arange(width) < size[:, None]] = flat.flatten().to_numpy(zero_copy_only=False)
    return out


class Search:
    """The k best candidates so far of some queries."""

    def __init__(self, q_row: np.ndarray, q: np.ndarray, tops: np.ndarray, exact: type):
        self.q_row, self.q, self.k, self.exact = q_row, q.astype(exact), tops.shape[1], exact
        self.floor = np.sort(tops, 1)  # ascending
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.products = 0

    def add(self, i: np.ndarray, j: np.ndarray, x_row: np.ndarray, x: np.ndarray) -> None:
        """Exact products of the pairs (query i, candidate j); a row is no candidate of its own."""
        other = self.q_row[i] != x_row[j]
        i, j = i[other], j[other]
        score = np.empty(len(i), np.int64)
        for at in range(0, len(i), PAIRS):
            part = slice(at, at + PAIRS)
            score[part] = np.einsum("ij,ij->i", self.q[i[part]], x[j[part]].astype(self.exact, copy=False))
        self.products += len(i)
        keep = score >= self.floor[i, 0]
        i, j, score = i[keep], j[keep], score[keep]
        self.found.append((i, j, score))
        order = np.lexsort((-score, i))  # the k best new ones of each query join its best
        a, s = i[order], score[order]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        new = np.full((len(self.q), self.k), LOW, np.int64)
        new[a[place < self.k], place[place < self.k]] = s[place < self.k]
        self.floor = np.sort(np.concatenate([self.floor, new], 1), 1)[:, -self.k :]


class Held:
    """Candidates, ready for searches: in order of id, with the statistics of every resolution."""

    def __init__(self, x_row: np.ndarray, x_id: np.ndarray, x: np.ndarray, axes: np.ndarray | None, peak: float):
        order = np.argsort(x_id, kind="stable")
        self.row, self.id, self.x, self.axes = x_row[order], x_id[order], x[order], axes
        self.exact = np.float64 if max(1.0, peak) ** 2 * max(1, x.shape[1]) < 2**53 else np.int64
        self.segments = [segments(turn(self.x, axes), *r) for r in RESOLUTIONS]
        self.error = 1e-9 * np.linalg.norm(x, axis=1).max(initial=0)

    def best(self, q_row: np.ndarray, q: np.ndarray, tops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query's row, candidate's id, score) of the k best candidates of each query, ties to the smaller
        id, but for those below the k-th best score that is known already, and how many exact products
        that took. Rows tell apart what shares an id; a query's own row is left out."""
        out, products, k = [], 0, tops.shape[1]
        q_turned = turn(q, self.axes)
        for start in range(0, len(q), ROWS):
            mine = slice(start, start + ROWS)
            q_seg, slack = [segments(q_turned[mine], *r) for r in RESOLUTIONS], self.error * np.linalg.norm(q[mine], axis=1) + 1e-6
            s = Search(q_row[mine], q[mine], tops[mine], self.exact)
            for at in range(0, len(self.x), TILE):
                self.compare(s, q_seg, slack, at)
            products += s.products
            i, j, score = (np.concatenate(v) for v in zip(*s.found, strict=True)) if s.found else (np.zeros(0, np.int64),) * 3
            keep = score >= s.floor[i, 0]
            i, j, score = i[keep], j[keep], score[keep]
            order = np.lexsort((self.id[j], -score, i))
            i, j, score = i[order], j[order], score[order]
            top = np.arange(len(i)) - np.searchsorted(i, i) < k
            out.append((s.q_row[i[top]], self.id[j[top]], score[top]))
        found = [np.concatenate(v) for v in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return found[0], found[1], found[2], products

    def compare(self, s: Search, q_seg: list[np.ndarray], slack: np.ndarray, at: int) -> None:
        """One tile of candidates, coarse to fine."""
        tile = slice(at, at + TILE)
        live = np.ones((len(q_seg[0]), len(self.segments[0][tile])), bool)
        for level, (a, b) in enumerate(zip(q_seg, self.segments, strict=True)):
            rows, cols = np.flatnonzero(live.any(1)), np.flatnonzero(live.any(0))
            if not len(rows):
                break
            bound = np.where(live[np.ix_(rows, cols)], a[rows] @ b[at + cols].T, -np.inf)
            if level in (0, len(q_seg) - 1):  # those of the highest bounds first: they raise the rest's bar
                seeds = min(FIRST, len(cols))
                first = np.argpartition(-bound, seeds - 1, axis=1)[:, :seeds]
                i, c = np.nonzero(np.take_along_axis(bound, first, 1) > -np.inf)
                s.add(rows[i], at + cols[first[i, c]], self.row, self.x)
                np.put_along_axis(bound, first, -np.inf, 1)
            live[np.ix_(rows, cols)] = bound >= (s.floor[rows, 0] - slack[rows])[:, None]
        i, j = np.nonzero(live)
        s.add(i, at + j, self.row, self.x)

    def ranges(self) -> np.ndarray:
        """What bounds a query's product with any of the candidates, see ``reach``."""
        x = turn(self.x, self.axes)
        centre = x.mean(0)
        means, devs = whole(x - centre)
        return np.concatenate([centre, means.max(0), means.min(0), devs.max(0)])


def whole(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The means and deviations that a group's ranges are of, those of what its members differ from their
    centre by."""
    head = min(HEAD, x.shape[1])
    stats = np.concatenate([x[:, :head], segments(x[:, head:], 0.0, TAIL)], 1)
    n = (stats.shape[1] - head) // 2
    return stats[:, : head + n], stats[:, head + n :]


def reach(q: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    """For each turned query and each group's ranges, a bound of the products with the group's members."""
    means, devs = whole(q)
    return np.concatenate([q, np.maximum(means, 0), np.minimum(means, 0), devs], 1) @ ranges.T


def best(q_row: np.ndarray, q: np.ndarray, x_row: np.ndarray, x_id: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """``Held.best`` of candidates in their own axes, with nothing known."""
    peak = max(float(np.abs(q).max(initial=0)), float(np.abs(x).max(initial=0)))
    held = Held(x_row, x_id, x, axes_of(x.T @ x) if len(x) and x.shape[1] <= TURNED else None, peak)
    return held.best(q_row, q, np.full((len(q), k), LOW, np.int64))


def wider(total: np.ndarray | None, width: int) -> np.ndarray | None:
    """Sums of vectors and of their outer products, for vectors of more components; None beyond ``TURNED``."""
    if total is None or width > TURNED:
        return None
    out = np.zeros((width + 1, width))
    out[: total.shape[0], : total.shape[1]] = total
    return out


def survey(vectors: DataFrame) -> tuple[int, int, float, np.ndarray | None, np.ndarray]:
    """How many vectors "v" there are, how wide and how large they are at most, their axes, and their mean
    in these axes, in one pass. What comes to the driver is eight matrices of at most ``TURNED`` columns,
    whatever the number of vectors."""
    schema = "n long, width int, peak double, total binary"

    def row(n, width, peak, total):
        return pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "width": pa.array([width], pa.int32()), "peak": pa.array([peak], pa.float64()), "total": pa.array([None if total is None else total.tobytes()], pa.binary())})

    def part(batches):
        n, width, peak, total = 0, 0, 0.0, np.zeros((1, 0))
        for b in batches:
            if not b.num_rows:
                continue
            width = max(width, int(np.diff(b.column(0).offsets.to_numpy()).max()))
            x, total = matrix(b.column(0), width), wider(total, width)
            n, peak = n + len(x), max(peak, float(np.abs(x).max(initial=0)))
            if total is not None:
                total += np.concatenate([x.sum(0, keepdims=True), x.T @ x])
        yield row(n, width, peak, total)

    def added(rows):
        n, width, peak, total = 0, 0, 0.0, np.zeros((1, 0))
        for n1, width1, peak1, sums in rows:
            n, width, peak, total = n + n1, max(width, width1), max(peak, peak1), wider(total, max(width, width1))
            if total is not None and sums is not None:
                total += wider(np.frombuffer(sums).reshape(width1 + 1, width1), width)
        return n, width, peak, total

    parts = vectors.select("v").mapInArrow(part, schema).repartition(8, F.spark_partition_id())
    rows = parts.mapInArrow(lambda batches: iter([row(*added(r.values() for b in batches for r in b.to_pylist()))]), schema)
    n, width, peak, total = added(rows.toLocalIterator())
    axes = None if total is None else axes_of(total[1:])
    if total is None or not np.isfinite(total[0]).all():
        return n, width, peak, axes, np.zeros(width)
    return n, width, peak, axes, turn(total[0] / max(1, n), axes)


def grouped(vectors: DataFrame, n: int, axes: np.ndarray | None, centre: np.ndarray, kind: str) -> tuple[DataFrame, int]:
    """The vectors with a group "g" each, and the number of groups: like ones lie on the same side of the
    centre in the leading axes; what is too large for one group is dealt into several by hash."""
    most = max(GROUP, -(-n // (MOST_NUMBERS // (len(centre) + 3 * (HEAD + TAIL)) or 1)))
    bits = min(len(centre), max(3, (-(-n // most) - 1).bit_length()))
    lead, middle = None if axes is None else axes[:, :bits].copy(), centre[:bits]
    width = len(centre)

    def sides(batches):
        for b in batches:
            x = matrix(b.column("v"), width)
            over = (x[:, :bits] if lead is None else x @ lead) > middle
            yield b.append_column("cell", pa.array((over @ (1 << np.arange(bits))).astype(np.int32)))

    placed = cut(vectors.mapInArrow(sides, f"row long, id long, v array<{kind}>, q boolean, cell int"))
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).orderBy("cell").collect()  # a power of two of them, at most twice the wanted groups
    starts, groups = [], 0
    for r in cells:
        parts = -(-r.n // most)
        starts.append((r.cell, groups, parts))
        groups += parts
    of = F.broadcast(placed.sparkSession.createDataFrame(starts, "cell int, start int, parts int"))
    g = F.col("start") + F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
    return placed.join(of, "cell").select("row", "id", "v", "q", g.alias("g")), groups


#: What a task says: answers of queries, or its group's ranges.
ANSWER = "g int, query_row long, vec_id long, score long, ranges array<double>"


def meet(batches, axes: np.ndarray | None, width: int, k: int, peak: float):
    """A group's candidates, then the queries sent to it, a bounded number at a time."""
    parts, asked, held, g = [], [], None, 0

    def hold() -> Held:
        t = pa.Table.from_batches(parts)
        return Held(t.column("row").to_numpy(), t.column("id").to_numpy(), matrix(t.column("v"), width), axes, peak)

    def say(row, vec, score, ranges) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()))
        columns = ([g] * len(row), row, vec, score, ranges)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["g", "query_row", "vec_id", "score", "ranges"])

    def answers():
        t = pa.Table.from_batches(asked)
        for at in range(0, len(t), QUERY_BLOCK):
            some = t.slice(at, QUERY_BLOCK)
            row, vec, score, _ = held.best(some.column("row").to_numpy(), matrix(some.column("v"), width), matrix(some.column("tops"), k, LOW, np.int64))
            yield say(row, vec, score, [None] * len(row))

    for b in batches:
        if not b.num_rows:
            continue
        g = b.column("g")[0].as_py()
        mine = int((b.column("side").to_numpy() == 0).sum())
        if mine:
            parts.append(b.slice(0, mine))
        if mine < b.num_rows:
            held = held or hold()
            asked.append(b.slice(mine))
            if sum(a.num_rows for a in asked) >= QUERY_BLOCK:
                yield from answers()
                asked = []
    if parts:
        held = held or hold()
        if asked:
            yield from answers()
        yield say([None], [None], [None], [held.ranges()])


def route(batches, axes: np.ndarray | None, width: int, k: int, peak: float, groups: np.ndarray, ranges: np.ndarray):
    """Queries with the groups, but for their own, whose ranges can reach their k-th best score."""
    error = 1e-9 * peak * max(1, width) ** 0.5
    for b in batches:
        for at in range(0, b.num_rows, ROUTED):
            some = b.slice(at, ROUTED)
            q, tops = matrix(some.column("v"), width), np.sort(matrix(some.column("tops"), k, LOW, np.int64), 1)
            slack = error * np.linalg.norm(q, axis=1) + 1e-6
            live = reach(turn(q, axes), ranges) >= (tops[:, 0] - slack)[:, None]
            live &= groups != some.column("g").to_numpy()[:, None]
            ends = np.concatenate([[0], live.sum(1).cumsum()]).astype(np.int32)
            to = pa.ListArray.from_arrays(pa.array(ends), pa.array(groups[np.nonzero(live)[1]].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([some.column("row"), some.column("v"), some.column("tops"), to], ["row", "v", "tops", "gs"])


def exact_top_k(vectors: DataFrame, is_query, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query by the inner product of
    vectors of floor(scale * component), ties to the smaller id.

    Rows with a null id, a null vector, or null, infinite or NaN components take no part; shorter
    vectors, however short, count as padded with zeros. A row is its own query's candidate never; other
    rows that repeat its id are, and each query row that repeats an id has its own k best. With fewer
    than k candidates all are returned; an empty table gives an empty result. Other columns, whatever
    their names, are ignored.

    Candidates are shuffled once for each of two passes, in groups of bounded size; queries go to their
    own group first, then to the groups that can still hold one of their k best, in batches, so a task
    holds one group and one batch of queries.
    """
    spark = vectors.sparkSession
    ship(spark)
    x = F.col(vector)
    fine = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    floors = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double"))
    good = vectors.filter(F.col(key).isNotNull() & x.isNotNull() & fine)
    good = good.select(F.col(key).cast("long").alias("id"), floors.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    n, width, peak, axes, centre = survey(good)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    kind = next(t for t, top in (("smallint", 2**15), ("int", 2**31), ("double", float("inf"))) if peak < top)
    good = good.withColumn("v", F.col("v").cast(f"array<{kind}>"))
    held, groups = grouped(good.select(F.monotonically_increasing_id().alias("row"), "id", "v", "q"), n, axes, centre, kind)

    plan = spark.sparkContext.broadcast((axes, width, k, peak))
    columns = ("row", "id", "v", "tops", "g", "side")

    def met(asked: DataFrame) -> DataFrame:
        """Answers of queries in the groups "g" that they are sent to, and each group's ranges."""
        there = held.withColumns({"tops": F.lit(None).cast("array<long>"), "side": F.lit(0)}).select(*columns)
        sent = asked.withColumns({"id": F.lit(None).cast("long"), "side": F.lit(1)}).select(*columns)
        both = there.unionByName(sent).repartitionById(groups, F.col("g")).sortWithinPartitions("side")
        return both.mapInArrow(lambda batches: meet(batches, *plan.value), ANSWER)

    own = held.filter("q").withColumn("tops", F.array().cast("array<long>"))
    first = cut(met(own))
    boxes = first.filter("ranges IS NOT NULL").select("g", "ranges").toArrow()  # one row a group
    tops = first.filter("ranges IS NULL").groupBy("query_row").agg(F.collect_list("score").alias("tops"))
    asked = held.filter("q").join(tops, F.col("row") == F.col("query_row"), "left").select("row", "v", "g", F.coalesce("tops", F.array()).alias("tops"))
    ranges = spark.sparkContext.broadcast((boxes.column("g").to_numpy(), matrix(boxes.column("ranges"), len(boxes.column("ranges")[0]))))
    sent = asked.mapInArrow(lambda batches: route(batches, *plan.value, *ranges.value), f"row long, v array<{kind}>, tops array<long>, gs array<int>")
    second = met(sent.select("row", "v", "tops", F.explode("gs").alias("g")))
    found = first.unionByName(second).filter("ranges IS NULL").select("query_row", "vec_id", "score")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    found = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    names = held.filter("q").select("row", F.col("id").alias("query_id"))
    return found.join(names, F.col("query_row") == F.col("row")).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
