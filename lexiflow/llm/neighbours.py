"""Nearest neighbours by learned partitions.

Fit, on a bounded sample: the neighbour graph of the sample is cut into parts of
nearly equal size (each vector moves to the part that holds most of its
neighbours, as long as that part has room); a softmax classifier learns, for a
vector, how its neighbours spread over the parts; and the number of parts that
a search opens is the smallest with which held-out sample vectors find
``TARGET`` of their true neighbours in the sample.

Index: every vector goes to its most probable part, and a part is split into
chunks of bounded size, so a part that a third of all vectors fall into is many
tasks.  Search: a query goes to every chunk of its most probable parts, where
all inner products are computed in double precision; the best of each chunk
are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .vectors import stacked, usable

#: Vectors that the index is fitted on, parts, neighbours of the graph, share of true neighbours aimed at.
SAMPLE, PARTS, DEGREE, TARGET = 6000, 16, 10, 0.97
#: Rows of a chunk, queries that meet a chunk in one task, queries multiplied at once.
CHUNK, QUERIES, AT_ONCE = 8192, 4096, 256


def _nearest(q: np.ndarray, x: np.ndarray, k: int, same: bool) -> np.ndarray:
    out = []
    for at in range(0, len(q), 256):
        s = q[at:at + 256] @ x.T
        if same:
            s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
        out.append(np.argpartition(-s, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Halving along the widest direction, then moves toward the neighbours
    within a part size of at most 1.1 times the mean."""
    label = np.zeros(len(x), np.int64)
    for level in range(int(math.log2(parts))):
        for p in range(1 << level):
            at = np.flatnonzero(label == p)
            if len(at) < 2:
                continue
            c = x[at] - x[at].mean(0)
            v = rng.normal(size=x.shape[1])
            for _ in range(20):
                v = c.T @ (c @ v)
                v /= np.linalg.norm(v) or 1.0
            order = at[np.argsort(c @ v, kind="stable")]
            label[order[len(at) // 2:]] += 1 << level
    room = math.ceil(1.1 * len(x) / parts)
    for _ in range(8):
        votes = np.zeros((len(x), parts))
        for k in range(graph.shape[1]):
            np.add.at(votes, (np.arange(len(x)), label[graph[:, k]]), 1)
            np.add.at(votes, (graph[:, k], label), 1)
        want = votes.argmax(1)
        gain = votes.max(1) - votes[np.arange(len(x)), label]
        size = np.bincount(label, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[want[i]] < room:
                size[label[i]] -= 1
                size[want[i]] += 1
                label[i] = want[i]
                moved += 1
        if moved < len(x) // 200:
            break
    return label


class Router:
    """Softmax classifier over the parts."""

    def __init__(self, dim: int, parts: int):
        self.w, self.b, self.probes = np.zeros((dim, parts)), np.zeros(parts), parts

    def scores(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w + self.b

    def train(self, x: np.ndarray, target: np.ndarray, rounds: int = 300) -> None:
        """Adam on the cross entropy with soft targets."""
        state = [np.zeros_like(p) for p in (self.w, self.w, self.b, self.b)]
        for t in range(1, rounds + 1):
            z = self.scores(x)
            p = np.exp(z - z.max(1, keepdims=True))
            d = (p / p.sum(1, keepdims=True) - target) / len(x)
            for k, (param, g) in enumerate(((self.w, x.T @ d + 1e-5 * self.w), (self.b, d.sum(0)))):
                m, v = state[2 * k], state[2 * k + 1]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                param -= 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)


def fit_router(x: np.ndarray, parts: int = PARTS, k: int = 20, target: float = TARGET) -> Router:
    """On at most SAMPLE vectors, in the driver.  With few vectors every part
    is opened, which is an exact search."""
    rng = np.random.default_rng(0)
    router = Router(x.shape[1], parts)
    if len(x) < 8 * parts:
        return router
    scale = np.linalg.norm(x, axis=1).mean()
    x = x / scale
    graph = _nearest(x, x, min(DEGREE, len(x) - 1), True)
    label = balanced_parts(x, graph, parts, rng)
    soft = np.zeros((len(x), parts))
    for j in range(graph.shape[1]):
        np.add.at(soft, (np.arange(len(x)), label[graph[:, j]]), 1 / (graph.shape[1] + 1))
    np.add.at(soft, (np.arange(len(x)), label), 1 / (graph.shape[1] + 1))
    held = rng.permutation(len(x))[:len(x) // 8]
    rest = np.setdiff1d(np.arange(len(x)), held)
    router.train(x[rest], soft[rest])
    router.w /= scale
    x = x * scale
    true = rest[_nearest(x[held], x[rest], min(k, len(rest)), False)]
    part = router.scores(x).argmax(1)
    order = np.argsort(-router.scores(x[held]), axis=1, kind="stable")
    place = np.argsort(order, axis=1)                           # of each part among a query's parts
    needed = np.take_along_axis(place, part[true], axis=1) + 1    # parts to open to see each neighbour
    found = [(needed <= p).mean() for p in range(1, parts + 1)]
    router.probes = next((p for p, f in enumerate(found, 1) if f >= target), parts)
    return router


def _route(batches: Iterator[pd.DataFrame], routers, every: int) -> Iterator[pd.DataFrame]:
    made = routers.value
    for b in batches:
        for dim, same in b.groupby(b["v"].map(len)):
            x = stacked(same["v"].to_numpy())
            r = made.get(dim)
            z = r.scores(x) if r else np.zeros((len(x), 1))
            order = np.argsort(-z, axis=1, kind="stable").astype(np.int32)
            query = (same["vec_id"] % every == 0).to_numpy()
            yield pd.DataFrame({"vec_id": same["vec_id"], "dim": dim, "part": order[:, 0],
                                "probes": [o.tolist() if q else None for o, q in zip(order, query, strict=True)],
                                "first": r.probes if r else 1,
                                "v": [row.tobytes() for row in x]})


def _best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
    """The k best of x for each query: by score, then the smaller id."""
    for at in range(0, len(q), AT_ONCE):
        s = q[at:at + AT_ONCE] @ x.T
        s[q_ids[at:at + AT_ONCE, None] == ids[None]] = -np.inf
        edge = np.partition(s, len(ids) - min(k, len(ids)), axis=1)[:, len(ids) - min(k, len(ids))]
        slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(edge), edge, 0)))
        for row, limit, i in zip(s, edge - slack, range(at, at + len(s)), strict=True):
            c = np.flatnonzero((row >= limit) & np.isfinite(row))
            score = (q[i] * x[c]).sum(1)          # in one fixed order of addition: equal vectors tie exactly
            first = np.lexsort((ids[c], -score))[:k]
            yield pd.DataFrame({"query_id": q_ids[i], "vec_id": ids[c][first], "score": score[first]})


def _search(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    empty = pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
    if not len(left) or not len(right):
        return empty
    def matrix(f):
        return np.frombuffer(b"".join(f["v"]), np.float64).reshape(len(f), -1)

    found = list(_best(left["vec_id"].to_numpy(np.int64), matrix(left), right["vec_id"].to_numpy(np.int64), matrix(right), k))
    return pd.concat(found) if found else empty


def search(table: DataFrame, every: int = 20, k: int = 20, parts: int = PARTS, sample: int = SAMPLE,
           id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by
    ``every`` its ``k`` nearest by inner product among all rows but those with
    its own id, ties to the smaller id.

    Vectors that are null, zero or hold null or non-finite components and rows
    with a null id take no part; vectors of different lengths never meet.  Of
    rows that share an id each is a candidate, and the query is made once.
    Other columns are left out; an empty table gives an empty result."""
    spark = table.sparkSession
    t = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    t = t.filter(usable(F.col("v")) & F.col("vec_id").isNotNull())
    # by hash; a first cut at twice the sample keeps what tasks send to the driver bounded as well
    place = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
    limit = min(1 << 30, math.ceil(2 * sample / max(1, t.count()) * (1 << 30)))
    chosen = t.filter(place < limit).orderBy(place, "vec_id").limit(sample).toPandas()
    routers = {dim: fit_router(stacked(same["v"].to_numpy()), parts, k) for dim, same in chosen.groupby(chosen["v"].map(len))}
    sent = spark.sparkContext.broadcast(routers)
    index = materialize(t.mapInPandas(lambda b: _route(b, sent, every),
                                      "vec_id long, dim int, part int, probes array<int>, first int, v binary"), "vector-index")
    sizes = index.groupBy("dim", "part").agg(F.count_distinct("vec_id").alias("ids"), F.count(F.lit(1)).alias("n")).collect()
    # (at most ``parts`` per length); a query opens its ``probes`` most probable parts, and further ones until
    # they hold k other ids
    asked = index.filter("probes IS NOT NULL").dropDuplicates(["vec_id"])
    held = F.lit(0)
    for r in sizes:
        held = F.when((F.col("dim") == r["dim"]) & (F.col("_x") == r["part"]), r["ids"]).otherwise(held)
    opened = asked.select("vec_id", "dim", "v", "first", F.posexplode("probes").alias("_i", "_x"))
    before = Window.partitionBy("vec_id").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    opened = opened.withColumn("_held", F.coalesce(F.sum(held).over(before), F.lit(0)))
    probed = opened.filter((F.col("_i") < F.col("first")) | (F.col("_held") <= k)).select("vec_id", "dim", F.col("_x").alias("part"), "v")
    queried = {(r["dim"], r["part"]): r["n"] for r in probed.groupBy("dim", "part").agg(F.count(F.lit(1)).alias("n")).collect()}
    row_chunks, query_chunks = F.lit(1), F.lit(1)
    for r in sizes:
        here = (F.col("dim") == r["dim"]) & (F.col("part") == r["part"])
        row_chunks = F.when(here, math.ceil(r["n"] / CHUNK)).otherwise(row_chunks)
        query_chunks = F.when(here, max(1, math.ceil(queried.get((r["dim"], r["part"]), 0) / QUERIES))).otherwise(query_chunks)
    own = F.xxhash64("vec_id")
    key = ["dim", "part", "rc", "qc"]
    each = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    rows = index.select("dim", "part", F.pmod(own, row_chunks).cast("int").alias("rc"), "vec_id", "v",
                        each(query_chunks).alias("qc")).select(*key, "vec_id", "v")
    asks = probed.select("dim", "part", F.pmod(own, query_chunks).cast("int").alias("qc"), "vec_id", "v",
                         each(row_chunks).alias("rc")).select(*key, "vec_id", "v")
    found = asks.groupBy(*key).cogroup(rows.groupBy(*key)).applyInPandas(
        lambda a, b: _search(a, b, k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
                 .select("query_id", "rank", "vec_id", "score"))
