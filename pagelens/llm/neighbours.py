"""Approximate nearest neighbours through learned partitions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow import map_batches
from .storage import written

#: Vectors that the neighbour graph, the classifier and the number of routed parts are fitted on at most.
SAMPLE = 8192
GRAPH_NEIGHBOURS = 10
HIDDEN = 64
EPOCHS = 40
#: Sample vectors a partition needs at least; with SAMPLE it bounds the number of partitions (256).
PART_SAMPLE = 32
#: Every so manieth vector of the sample only measures what share of its neighbours the routing finds.
MEASURES = 8
#: Queries are routed to as many partitions as find this share of the measured neighbours.
RECALL = 0.94
#: Rows of one block of candidates, and of queries, that a task compares at most, and cells of their product at once.
BLOCK_ROWS = 1 << 16
LEAST_BLOCK = 1 << 10
BLOCK_QUERIES = 1 << 15
CELLS = 1 << 22


def usable(vector: str = "embedding") -> Column:
    """Not null, without null, NaN or infinite components, and not zero everywhere."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    """A column of lists of d numbers as rows."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([np.empty((0, d))] + [c.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d) for c in parts])


def neighbour_graph(x: np.ndarray, k: int = GRAPH_NEIGHBOURS) -> np.ndarray:
    """The k nearest of each row, block by block."""
    k = min(k, len(x) - 1)
    norms = (x * x).sum(1)
    out = []
    for i in range(0, len(x), 512):
        d = norms[None, :] - 2 * x[i : i + 512] @ x.T
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        out.append(np.argpartition(d, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def balanced_parts(graph: np.ndarray, x: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """A part for each node, all of nearly equal size, with few graph edges between parts.

    Halves are split by their main direction as a start; then, round by round, each node asks for the
    part that most of its neighbours are in, and those that gain most move while there is room.
    """
    n = len(x)
    part = np.zeros(n, int)
    order = [np.arange(n)]
    while len(order) < parts:
        order.sort(key=len)
        rows = order.pop()
        centred = x[rows] - x[rows].mean(0)
        axis = np.linalg.svd(centred[np.linspace(0, len(rows) - 1, min(len(rows), 512)).astype(int)], full_matrices=False)[2][0]
        ranked = rows[np.argsort(centred @ axis, kind="stable")]
        order += [ranked[: len(ranked) // 2], ranked[len(ranked) // 2 :]]
    for p, rows in enumerate(order):
        part[rows] = p
    room = int(np.ceil(n / parts * 1.1))
    both = np.concatenate([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])])
    ends = np.concatenate([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()])
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        np.add.at(votes, (ends, part[both]), 1)
        gain = votes.max(1) - votes[np.arange(n), part]
        sizes = np.bincount(part, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            to = int(votes[i].argmax())
            if sizes[to] < room:
                sizes[part[i]] -= 1
                sizes[to] += 1
                part[i] = to
                moved += 1
        if not moved:
            break
    return part


@dataclass(frozen=True)
class Router:
    """A classifier of one hidden layer: vector -> log-probabilities of the parts."""

    shift: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @property
    def parts(self) -> int:
        return len(self.b2)

    def scores(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            z = np.nan_to_num((x - self.shift) / self.scale)
        return np.maximum(np.clip(z, -1e3, 1e3) @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def fit_router(x: np.ndarray, parts: int) -> Router:
    """Partitions the neighbour graph of the sample and learns to tell the parts from the vectors."""
    d = x.shape[1] if x.size else 1
    if parts < 2 or len(x) < 4 * parts:
        return Router(np.zeros(d), 1.0, np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    shift = x.mean(0)
    scale = float((x - shift).std()) or 1.0
    graph = neighbour_graph(x)
    y = balanced_parts(graph, x, parts)
    # what a part's neighbourhood holds is a better target than the part alone
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), y[graph].ravel()), 0.5 / graph.shape[1])
    target[np.arange(len(x)), y] += 0.5
    z = (x - shift) / scale
    rng = np.random.default_rng(7)
    w = [rng.normal(0, np.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
            h = np.maximum(z[rows] @ w[0] + w[1], 0)
            s = h @ w[2] + w[3]
            p = np.exp(s - s.max(1, keepdims=True))
            g = (p / p.sum(1, keepdims=True) - target[rows]) / len(rows)
            back = (g @ w[2].T) * (h > 0)
            t += 1
            for k, grad in enumerate((z[rows].T @ back, back.sum(0), h.T @ g, g.sum(0))):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                w[k] = w[k] - 3e-3 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Router(shift, scale, *w)


def parts_for(n_rows: int, sample: int) -> int:
    """Partitions of a table: a power of two near half the root of its rows, as far as the sample supports it."""
    wanted = max(4.0, np.sqrt(n_rows) / 2)
    return 1 << int(np.clip(np.round(np.log2(wanted)), 0, np.log2(max(1, sample // PART_SAMPLE))))


def routed_parts(router: Router, known: np.ndarray, measured: np.ndarray, k: int, recall: float = RECALL) -> int:
    """To how many parts queries go: so many that, of the k nearest known vectors of the measured ones, the wanted share lies there."""
    if router.parts < 2 or not len(measured) or len(known) <= k:
        return router.parts
    home = router.scores(known).argmax(1)
    place = np.argsort(np.argsort(-router.scores(measured), axis=1, kind="stable"), axis=1)
    needed = []
    for i in range(0, len(measured), 256):
        q = measured[i : i + 256]
        d = (q * q).sum(1)[:, None] + (known * known).sum(1)[None, :] - 2 * q @ known.T
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        needed.append(np.take_along_axis(place[i : i + 256], home[near], axis=1).ravel())
    needed = np.sort(np.concatenate(needed))
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1


def nearest_in_block(q: np.ndarray, q_rows: np.ndarray, x: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, candidate place, distance) of each query's k nearest but its own row, ties to the smaller id.

    A matrix product finds those that can be among them, with room for its rounding; their distances
    are then taken from the differences themselves.
    """
    xx = (x * x).sum(1)
    step = max(1, CELLS // max(1, len(x)))
    out = [_nearest(q[i : i + step], q_rows[i : i + step], x, xx, rows, ids, k, i) for i in range(0, len(q), step)]
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, int), np.empty(0, int), np.empty(0))


def _nearest(q, q_rows, x, xx, rows, ids, k, start):
    with np.errstate(all="ignore"):
        qq = (q * q).sum(1)
        rough = qq[:, None] + xx[None, :] - 2 * q @ x.T
    own = q_rows[:, None] == rows[None, :]
    rough[own] = np.inf
    edge = np.partition(rough, k - 1, axis=1)[:, k - 1 : k] if len(x) > k else np.full((len(q), 1), np.inf)
    with np.errstate(all="ignore"):
        slack = 1e-12 * (qq[:, None] + xx.max(initial=0.0)) + 1e-300
        row, col = np.nonzero(~(rough > edge + slack) & ~own)
    dist = np.empty(len(row))
    for a in range(0, len(row), 1 << 15):
        diff = q[row[a : a + (1 << 15)]] - x[col[a : a + (1 << 15)]]
        dist[a : a + (1 << 15)] = np.sqrt((diff * diff).sum(1))
    order = np.lexsort((ids[col], dist, row))
    row, col, dist = row[order], col[order], dist[order]
    first = np.searchsorted(row, np.arange(len(q)))
    keep = np.arange(len(row)) - first[row] < k
    return row[keep] + start, col[keep], dist[keep]


@dataclass(frozen=True)
class Index:
    """The fitted router and to how many of its parts queries go."""

    router: Router
    routed: int


def fit_index(sample: np.ndarray, n_rows: int, k: int = 10, parts: int | None = None, recall: float = RECALL) -> Index:
    """From distinct vectors of a sample of a table of n_rows rows; every MEASURES-th of them isn't fitted but measures the routing."""
    x = np.unique(sample, axis=0)
    x = x[np.random.default_rng(3).permutation(len(x))]
    measured = np.arange(len(x)) % MEASURES == 0
    parts = parts_for(n_rows, len(x)) if parts is None else parts
    router = fit_router(x[~measured], parts)
    return Index(router, routed_parts(router, x[~measured], x[measured], k, recall))


def search(vectors: DataFrame, every: int = 100, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", parts: int | None = None, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id `every` divides, among all other rows.

    A classifier fitted on at most SAMPLE vectors puts every row into one partition and routes each query
    to its most probable partitions. Their number grows with the root of the rows (parts_for), and a
    query goes to as many as find `recall` of the neighbours of vectors that were not fitted: few where the
    vectors cluster, most where they have no structure. A query that finds fewer than k there is compared
    with all. A partition's candidates and queries are cut into blocks of bounded size, so that a large
    one, as of copies of one vector, is spread over tasks; a candidate is sent once for each block of
    queries of its own partition, and each task keeps k per query.

    score is the Euclidean distance in double precision, ties go to the smaller id. Null or zero vectors
    and those with null, NaN or infinite components take no part, nor do null ids, nor vectors of another
    length than most (of equally frequent lengths the smallest counts). Every row is a candidate and every
    row with such an id a query, so rows of the same id find each other; fewer candidates than k give
    fewer rows; further columns are left out; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    clean = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    clean = clean.where(F.col("id").isNotNull() & usable("v"))
    most = clean.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    d, n_rows = (most["d"], most["n"]) if most else (1, 0)
    clean = clean.where(F.size("v") == d)
    some = clean.select("v") if n_rows <= SAMPLE else clean.select("v").sample(1.1 * SAMPLE / n_rows, 7)
    index = fit_index(_matrix(some.limit(SAMPLE).toArrow()["v"], d), n_rows, k, parts, recall)
    parts, routed = index.router.parts, index.routed
    router = spark.sparkContext.broadcast(index.router)

    def route(batches):
        for batch in batches:
            s = router.value.scores(_matrix(batch.column("v"), d))
            asks = batch.column("id").to_numpy() % every == 0
            ranked = np.argsort(-s[asks], axis=1, kind="stable")[:, :routed].astype(np.int32)
            to = iter(ranked)
            yield pa.record_batch(
                [*batch.columns, pa.array(s.argmax(1), pa.int32()), pa.array([next(to) if a else None for a in asks], pa.list_(pa.int32()))],
                names=["row", "id", "v", "part", "routed"],
            )

    numbered = clean.select(F.monotonically_increasing_id().alias("row"), "id", "v")
    indexed = written(map_batches(numbered, route, "row long, id long, v array<double>, part int, routed array<int>"))
    asked = indexed.where("routed is not null").select("row", "id", "v", "routed")
    held = {r["part"]: r["n"] for r in indexed.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row for each partition
    block = int(np.clip(2 * n_rows // parts, LEAST_BLOCK, BLOCK_ROWS))
    blocks = F.element_at(F.array(*[F.lit(max(1, -(-held.get(p, 0) // block))) for p in range(parts)]), F.col("part") + 1)

    def compare(queries: DataFrame) -> DataFrame:
        """Of queries(row, id, v, part) and the candidates of their parts, block by block."""
        come = {r["part"]: r["n"] for r in queries.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row for each partition
        q_blocks = F.element_at(F.array(*[F.lit(-(-come.get(p, 0) // BLOCK_QUERIES)) for p in range(parts)]), F.col("part") + 1)
        each = lambda n: F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)))
        spread = lambda n: F.pmod(F.xxhash64("row"), n).cast("int")
        left = queries.select("row", "id", "v", "part", spread(q_blocks).alias("q_block"), each(blocks).alias("block"))
        right = indexed.select("row", "id", "v", "part", spread(blocks).alias("block"), each(q_blocks).alias("q_block"))

        def task(q: pa.Table, x: pa.Table) -> pa.Table:
            q_rows, q_ids, rows, ids = (t[c].to_numpy() for t in (q, x) for c in ("row", "id"))
            a, b, dist = nearest_in_block(_matrix(q["v"], d), q_rows, _matrix(x["v"], d), rows, ids, k)
            return pa.table({"q_row": q_rows[a], "query_id": q_ids[a], "vec_id": ids[b], "score": dist})

        keys = ["part", "block", "q_block"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(task, "q_row long, query_id long, vec_id long, score double")

    found = written(compare(asked.select("row", "id", "v", F.explode("routed").alias("part"))))
    if routed < parts:
        full = found.groupBy(F.col("q_row").alias("row")).agg(F.count("*").alias("n")).where(F.col("n") >= k)
        short = asked.join(full, "row", "left_anti").select("row", "id", "v")
        if not short.isEmpty():
            everywhere = written(compare(short.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))))
            found = found.join(full.select(F.col("row").alias("q_row")), "q_row", "left_semi").unionByName(everywhere)
    best = Window.partitionBy("q_row").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
