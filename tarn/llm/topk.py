"""Exact top-k search by inner product, with a table of pivots that rules candidates out.

Every vector's distances to PIVOTS pivots, and to the origin, are computed once. For a query q and a
candidate x, the triangle inequality gives d(q, x) >= |d(q, p) - d(x, p)| for
each pivot p; the largest of these bounds gives <q, x> <= (|q|^2 + |x|^2 -
bound^2) / 2.

Candidates are dealt into cells by their nearest pivot, then by rings of the distance to
it, so that a cell covers a short interval of every distance and is ruled out, or not, as one. A query first
searches the cell it stands in; the k-th best score there is its threshold. It
is then sent only to cells whose bound reaches the threshold, and a cell is not copied for
blocks of queries that all rule it out. In a cell, chunks of candidates are taken by falling bound, the threshold
rises after each, and what is left below it is never evaluated, so results are exact.

Sizes: a cell holds about CELL rows and a block of queries about QUERIES; larger ones are dealt in
parts by a hash of the row, also where all vectors are equal. What reaches the driver is
PIVOT_POOL vectors, from which the pivots are chosen, and counts. Tables that are broadcast have at most SMALL rows, by
their count; larger ones are joined by a merge.

Scores are exact at every size: in doubles where all products and sums are integers below 2^52;
elsewhere doubles with a bound of their error choose the candidates that Python's integers then compare. A score beyond
the range of a long is given as the nearest long; its rank follows the exact score.

Defined results: vectors that are null or hold a null or non-finite component, and rows
without an id, take no part. Vectors meet only vectors of the same number of components. A query's own row is
left out, other rows with its id are not; each row of a repeated query id is a
query. Empty vectors score 0 with each other. Ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, in_batches

PIVOTS = 32
PIVOT_POOL = 512
QUERIES = 4096
CELL = 4096
CHUNK = 256
RINGS = 64
STATS = 512
SMALL = 50_000
TRIAL = 1 << 18
SCALE = 256
_LONG = 2**63

_VECTOR = "row long, vec_id long, is_query boolean, dim int, x array<double>, near array<float>, home int, dist float, size double"
_HIT = "struct<rank_key:binary,score:long,vec_id:long,row:long>"


def choose_pivots(pool: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """The origin and distinct vectors that lie far from one another: each next one is farthest from those before."""
    pool = np.unique(np.asarray(pool, np.float64), axis=0)
    chosen, far = [np.zeros(pool.shape[1])], np.full(len(pool), np.inf)
    with np.errstate(over="ignore", invalid="ignore"):
        while len(chosen) < min(count, len(pool)) + 1:
            at = int(np.argmax(far))
            chosen.append(pool[at])
            far = np.fmin(far, ((pool - pool[at]) ** 2).sum(1))
            far[at] = -1
    return np.array(chosen)


def pivot_distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distance of every vector to every pivot."""
    with np.errstate(over="ignore"):
        return np.stack([np.sqrt(((vectors - p) ** 2).sum(1)).astype(np.float32) for p in pivots], 1)


def integers(x: np.ndarray) -> list[int]:
    """floor(256 * x) of doubles as Python integers."""
    return [math.floor(c * SCALE) if abs(c) < 2.0**52 else int(c) * SCALE for c in x.tolist()]


def rank_key(score: int) -> bytes:
    """Bytes that order as the integers do."""
    size = (abs(score).bit_length() + 7) // 8
    body = size.to_bytes(2, "big") + abs(score).to_bytes(size, "big")
    return b"\1" + body if score >= 0 else b"\0" + bytes(255 - b for b in body)


@dataclass
class Vectors:
    """Rows of one dimension, and what is computed of them once."""

    row: np.ndarray
    ids: np.ndarray
    x: np.ndarray
    near: np.ndarray
    scaled: np.ndarray = field(init=False)
    size: np.ndarray = field(init=False)
    high: np.ndarray = field(init=False)

    def __post_init__(self):
        with np.errstate(over="ignore", invalid="ignore"):
            self.scaled = np.floor(self.x * SCALE)
            self.size = (self.scaled**2).sum(1)
        self.high = np.abs(self.scaled).max(1) if self.x.shape[1] else np.zeros(len(self.x))

    def take(self, rows: np.ndarray) -> Vectors:
        return Vectors(self.row[rows], self.ids[rows], self.x[rows], self.near[rows])

    @staticmethod
    def of(t: pa.Table) -> Vectors:
        return Vectors(np.asarray(t.column("row")), np.asarray(t.column("vec_id")), _matrix(t, "x", np.float64), _matrix(t, "near", np.float32))


def _matrix(t: pa.Table, name: str, kind) -> np.ndarray:
    """A column of lists of one length."""
    flat = np.concatenate([np.zeros(0, kind), *(np.asarray(c.flatten(), kind) for c in t.column(name).chunks)])
    return flat.reshape(t.num_rows, len(flat) // t.num_rows if t.num_rows else 0)


def best_possible(size: np.ndarray, near: np.ndarray, most: np.ndarray, low: np.ndarray, high: np.ndarray | None = None) -> np.ndarray:
    """Per query and group of candidates, a score that none in the group exceeds; ``low`` and ``high`` bound the group's distances
    to the pivots (one candidate's own, if there is no ``high``), ``most`` its squared lengths."""
    bound = np.zeros((len(near), len(low)), np.float32)
    with np.errstate(over="ignore", invalid="ignore"):
        for p in range(near.shape[1]):
            own = near[:, p, None]
            apart = np.abs(own - low[None, :, p]) if high is None else np.maximum(own - high[None, :, p], low[None, :, p] - own)
            np.maximum(bound, apart, out=bound)
        rounded = 2.0**-22 * (near.max(1, initial=0)[:, None] + (low if high is None else high).max(1, initial=0)[None, :])
        bound = np.maximum(bound - rounded, 0, dtype=np.float64)
        bound[~np.isfinite(bound)] = 0
        both = size[:, None] + most[None, :]
        return (both - bound**2) / 2 + 1e-9 * both + 1


class Search:
    """The k best candidates of some queries, over as many groups of candidates as it is shown."""

    def __init__(self, queries: Vectors, k: int, threshold: np.ndarray | None = None):
        self.queries, self.k = queries, k
        self.threshold = np.full(len(queries.row), -np.inf) if threshold is None else threshold.copy()
        self.score = np.full((len(queries.row), k), -np.inf)
        self.at = np.full((len(queries.row), k, 2), -1, np.int64)
        self.wide: dict[int, list[tuple[int, int, int]]] = {}
        self.evaluated = np.zeros(len(queries.row), np.int64)
        self.bounded = self.spared = 0

    def show(self, cell: Vectors) -> None:
        """Search a cell, its chunks by falling bound."""
        q = self.queries
        order = np.argsort(cell.near[:, 1:].min(1), kind="stable") if cell.near.shape[1] > 1 else np.arange(len(cell.row))
        chunks = [cell.take(order[a : a + CHUNK]) for a in range(0, len(order), CHUNK)]
        low, high = np.array([c.near.min(0) for c in chunks]), np.array([c.near.max(0) for c in chunks])
        bound = best_possible(q.size, q.near, np.array([c.size.max() for c in chunks]), low, high)
        turn = np.argsort(-bound, axis=1, kind="stable")
        every = np.arange(len(q.row))
        for step in range(len(chunks)):
            mine = turn[:, step]
            alive = ~(bound[every, mine] < self.threshold)
            if not alive.any():
                break
            for c in np.unique(mine[alive]):
                self._evaluate(np.flatnonzero(alive & (mine == c)), chunks[c])

    def _evaluate(self, who: np.ndarray, chunk: Vectors) -> None:
        """Score what a chunk's own bounds leave; where they left nearly all so far, taking them costs more than scoring."""
        q, dim = self.queries, max(1, chunk.x.shape[1])
        near = chunk.row[None, :] != q.row[who, None]
        if self.bounded < TRIAL or self.spared * 4 > self.bounded:
            near &= ~(best_possible(q.size[who], q.near[who], chunk.size, chunk.near) < self.threshold[who, None])
            self.bounded += near.size
            self.spared += near.size - int(near.sum())
            who, near = who[near.any(1)], near[near.any(1)]
        if not len(who):
            return
        self.evaluated[who] += near.sum(1)
        with np.errstate(over="ignore"):
            plain_q, plain_x = (high**2 * dim < 2.0**52 for high in (q.high[who], chunk.high))
        fast, cols = np.flatnonzero(plain_q), np.flatnonzero(plain_x)
        if len(fast) and len(cols):
            scores = q.scaled[who[fast]] @ chunk.scaled[cols].T
            scores[~near[np.ix_(fast, cols)]] = -np.inf
            self._merge(who[fast], scores, chunk.ids[cols], chunk.row[cols])
        if len(fast) < len(who) or len(cols) < len(chunk.row):
            for i, k in enumerate(who):
                rest = np.flatnonzero(near[i] & ~plain_x if plain_q[i] else near[i])
                if len(rest):
                    self._exactly(int(k), chunk.take(rest))

    def _merge(self, who: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        k = self.k
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k] if scores.shape[1] > k else np.full(len(who), -np.inf)
        least = np.maximum(least, self.threshold[who])
        i, j = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        i_all = np.concatenate([i, np.repeat(np.arange(len(who)), k)])
        score = np.concatenate([scores[i, j], self.score[who].ravel()])
        at = np.concatenate([np.stack([ids[j], rows[j]], 1), self.at[who].reshape(-1, 2)])
        order = np.lexsort((at[:, 1], at[:, 0], -score, i_all))
        i_all = i_all[order]
        rank = np.arange(len(order)) - np.searchsorted(i_all, i_all, side="left")
        kept = order[rank < k]
        self.score[who], self.at[who] = score[kept].reshape(len(who), k), at[kept].reshape(len(who), k, 2)
        self.threshold[who] = np.maximum(self.threshold[who], self.score[who, k - 1])

    def _exactly(self, k: int, chunk: Vectors) -> None:
        """Candidates of a query by Python's integers, as far as doubles cannot tell them apart."""
        q = self.queries
        with np.errstate(over="ignore", invalid="ignore"):
            about = chunk.scaled @ q.scaled[k]
            error = (chunk.x.shape[1] + 2) * 2.0**-51 * np.sqrt(chunk.size) * np.sqrt(q.size[k])
            sure = np.sort(about - error)[::-1]
            least = sure[self.k - 1] if len(sure) >= self.k and np.isfinite(sure).all() else -np.inf
            rows = np.flatnonzero(~(about + error < max(least, self.threshold[k])))
        own = integers(q.x[k])
        held = self.wide.get(k, [])
        for r in rows:
            held.append((-sum(a * b for a, b in zip(own, integers(chunk.x[r]), strict=True)), int(chunk.ids[r]), int(chunk.row[r])))
        self.wide[k] = sorted(held)[: self.k]
        if len(self.wide[k]) == self.k:
            self.threshold[k] = max(self.threshold[k], _below(-self.wide[k][-1][0]))

    def hits(self, i: int) -> list[dict]:
        """A query's best candidates, best first."""
        some = [(-int(s), int(a[0]), int(a[1])) for s, a in zip(self.score[i], self.at[i], strict=True) if s > -np.inf] + self.wide.get(i, [])
        return [{"rank_key": rank_key(-s), "score": max(-_LONG, min(_LONG - 1, -s)), "vec_id": v, "row": r} for s, v, r in sorted(some)[: self.k]]


def _below(score: int) -> float:
    """A double that is not above an integer."""
    try:
        return math.nextafter(float(score), -math.inf)
    except OverflowError:
        return -math.inf if score < 0 else 1.7e308


_HITS = pa.list_(pa.struct([("rank_key", pa.binary()), ("score", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64())]))
_FOUND = "row long, vec_id long, threshold double, evaluated long, hits array<" + _HIT + ">"


def _found(search: Search) -> pa.Table:
    q = search.queries
    columns = [pa.array(q.row, pa.int64()), pa.array(q.ids, pa.int64()), pa.array(search.threshold, pa.float64()), pa.array(search.evaluated, pa.int64()), pa.array([search.hits(i) for i in range(len(q.row))], _HITS)]
    return pa.table(columns, names=["row", "vec_id", "threshold", "evaluated", "hits"])


def _at_home(k: int):
    """The search of a cell by the queries that stand in it, a part of them at a time."""

    def run(cell: pa.Table) -> pa.Table:
        vectors = Vectors.of(cell)
        asked = np.flatnonzero(np.asarray(cell.column("is_query")))
        out = []
        for at in range(0, len(asked), QUERIES):
            search = Search(vectors.take(asked[at : at + QUERIES]), k)
            search.show(vectors)
            out.append(_found(search))
        return pa.concat_tables(out) if out else _found(Search(vectors.take(asked), k))

    return run


def _elsewhere(k: int):
    """The search of a cell by the queries of a block that do not rule it out."""

    def run(queries: pa.Table, cell: pa.Table) -> pa.Table:
        search = Search(Vectors.of(queries), k, np.asarray(queries.column("threshold")))
        if cell.num_rows and queries.num_rows:
            search.show(Vectors.of(cell))
        return _found(search)

    return run


def _alive(key: tuple, queries: pa.Table, cells: pa.Table) -> pa.Table:
    """Pairs of a query and a cell other than its own whose bound reaches the query's threshold."""
    rows, names = [np.zeros(0, np.int64)], [pa.array([], pa.string())]
    for dim in set(queries.column("dim").unique().to_pylist()) & set(cells.column("dim").unique().to_pylist()):
        own, others = (t.filter(pa.array(np.asarray(t.column("dim")) == dim)).combine_chunks() for t in (queries, cells))
        near, low, high = _matrix(own, "near", np.float32), _matrix(others, "low", np.float32), _matrix(others, "high", np.float32)
        bound = best_possible(np.asarray(own.column("size")), near, np.asarray(others.column("most")), low, high)
        number = {cell: j for j, cell in enumerate(others.column("cell").to_pylist())}
        home = np.array([number.get(cell, -1) for cell in own.column("cell").to_pylist()], np.int64)
        i, j = np.nonzero(~(bound < np.asarray(own.column("threshold"))[:, None]) & (home[:, None] != np.arange(len(number))[None, :]))
        rows.append(np.asarray(own.column("row"))[i])
        names += others.column("cell").take(pa.array(j)).chunks
    rows = np.concatenate(rows)
    return pa.table({"block": pa.array([key[0].as_py()] * len(rows), pa.string()), "row": pa.array(rows, pa.int64()), "target": pa.concat_arrays(names)})


def _with_table(pivots: dict[int, np.ndarray]):
    """Vectors with their distances to the pivots of their dimension, and the nearest pivot."""
    names = [c.split()[0] for c in _VECTOR.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                n = part.num_rows
                x = np.floor(np.asarray(part.column("x").flatten(), np.float64).reshape(n, dim) * SCALE)
                near = pivot_distances(x, pivots.get(int(dim), np.zeros((1, dim))))
                home = near[:, 1:].argmin(1) if near.shape[1] > 1 else np.zeros(n, int)
                dist = near[np.arange(n), home + 1] if near.shape[1] > 1 else near[:, 0]
                wide = near.shape[1]
                listed = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * wide, pa.int32()), pa.array(near.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:5]), listed, pa.array(home, pa.int32()), pa.array(dist, pa.float32()), pa.array((x**2).sum(1))], names)

    return run


def _small(df: DataFrame, rows: int) -> DataFrame:
    """A table for a join: broadcast if it has few rows, else merged."""
    return F.broadcast(df) if rows <= SMALL else df.hint("merge")


def _dealt(df: DataFrame, keys: list[str], most: int, name: str) -> DataFrame:
    """``df`` with a part for each row, so that keys and part have about ``most`` rows at the most."""
    counts = cut(df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / most).alias("parts")), "topk-counts")
    part = F.pmod(F.xxhash64("row"), F.col("parts"))
    return df.join(_small(counts, counts.count()), keys).withColumn(name, part).drop("parts")


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per query and cell it searched: row, vec_id, threshold, evaluated (candidates that were scored) and hits."""
    spark = vectors.sparkSession
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"), is_query.alias("is_query"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & finite)
    rows = cut(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.coalesce("is_query", F.lit(False)).alias("is_query"), F.size("x").alias("dim"), "x"), "topk-rows")
    pool: dict[int, list] = {}
    for r in rows.select("x", "dim").orderBy(F.xxhash64("x"), "vec_id").limit(PIVOT_POOL).collect():
        pool.setdefault(r.dim, []).append(r.x)
    with np.errstate(over="ignore"):
        pivots = {dim: choose_pivots(np.floor(np.array(v, np.float64) * SCALE)) for dim, v in pool.items() if dim}
    table = cut(in_batches(rows, _with_table(pivots), _VECTOR), "topk-table")
    discard(rows)
    marks = [i / RINGS for i in range(1, RINGS)]
    rings = cut(table.groupBy("dim", "home").agg(F.least(F.lit(RINGS), F.ceil(F.count(F.lit(1)) / CELL)).alias("rings"), F.percentile_approx("dist", marks, 1000).alias("marks")), "topk-rings")
    ring = F.floor(F.size(F.filter("marks", lambda m: m < F.col("dist"))) * F.col("rings") / RINGS)
    ringed = table.join(_small(rings, rings.count()), ["dim", "home"]).withColumn("ring", ring).drop("rings", "marks")
    dealt = _dealt(ringed, ["dim", "home", "ring"], CELL, "part")
    dealt = dealt.withColumn("cell", F.concat_ws("/", "dim", "home", "ring", "part")).drop("ring", "part")
    cells = cut(dealt, "topk-cells")
    discard(table, rings)
    home = cut(cells.groupBy("cell").applyInArrow(_at_home(k), _FOUND), "topk-home")
    asked = cells.where("is_query").join(home.select("row", "threshold").hint("merge"), "row")
    total = asked.count()
    groups = min(PIVOTS, max(1, -(-total // QUERIES)))
    asked = _dealt(asked.withColumn("group", F.floor(F.col("home") * groups / PIVOTS)), ["dim", "group"], QUERIES, "part")
    asked = cut(asked.withColumn("block", F.concat_ws("/", "dim", "group", "part")), "topk-asked")
    wide = PIVOTS + 1
    edge = lambda f: F.array(*[f(F.get("near", F.lit(p))) for p in range(wide)])
    kept = lambda name: F.filter(name, lambda c: c.isNotNull())
    stats = cells.groupBy("dim", "cell").agg(edge(F.min).alias("low"), edge(F.max).alias("high"), F.max("size").alias("most"))
    stats = cut(stats.select("dim", "cell", kept("low").alias("low"), kept("high").alias("high"), "most"), "topk-stats")
    blocks = cut(asked.select("dim", "block").distinct(), "topk-blocks")
    parts = max(1, -(-stats.count() // STATS))
    part = F.pmod(F.xxhash64("cell"), F.lit(parts)).alias("part")
    left = asked.select("block", "dim", "row", "cell", "near", "size", "threshold", F.explode(F.expr(f"sequence(0L, {parts - 1}L)")).alias("part"))
    right = stats.withColumn("part", part).join(_small(blocks, blocks.count()), "dim")
    alive = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(_alive, "block string, row long, target string")
    alive = cut(alive, "topk-alive")
    sent = alive.join(asked.select("row", "vec_id", "x", "near", "threshold").hint("merge"), "row")
    pairs = alive.select(F.col("block").alias("of_block"), "target").distinct()
    shown = cells.select(F.col("cell").alias("target"), "row", "vec_id", "x", "near").join(pairs.hint("merge"), "target").withColumnRenamed("target", "of_cell")
    away = sent.groupBy("block", "target").cogroup(shown.groupBy("of_block", "of_cell")).applyInArrow(_elsewhere(k), _FOUND)
    return home.unionByName(away)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per query its k best other rows: query_id, rank, vec_id, score."""
    found = search(vectors, is_query, k, id_col, vector_col)
    hits = found.select(F.col("row").alias("q_row"), F.col("vec_id").alias("query_id"), F.explode("hits").alias("h")).select("q_row", "query_id", "h.*")
    place = F.row_number().over(Window.partitionBy("q_row").orderBy(F.desc("rank_key"), "vec_id", "row"))
    return hits.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
