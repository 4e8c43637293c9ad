"""Approximate nearest neighbours over balanced posting lists.

Centroids are fitted on a bounded sample (`sample` vectors, by hash of vec_id) by k-means that splits every
cluster holding more than its share, so lists stay balanced; there is at most a list for every 16 vectors of the
sample. Every vector is indexed: it goes to the list of its nearest centroid and, if it lies near a boundary,
also to each further centroid whose distance is within `1 + replicate` times the nearest one's, unless a
centroid already chosen is nearer to that centroid than the vector is (relative neighbourhood rule), up to
`copies` lists.

Centroids are searched by an in-memory graph: each has edges to its nearest centroids, thinned by the same
rule, plus a path through all of them so that every one is reachable; a search keeps the best `beam` found.
Distance-ratio pruning then selects a query's lists: those whose centroid's distance is within `1 + prune` times
the nearest one's, and further ones, nearest first, until they hold enough rows for k other vectors. prune is
calibrated: the smallest ratio that finds `recall` of the k nearest, in the whole table and by brute force, of
`held` vectors of the sample.

Lists are dealt into bins of about bin_bytes, neighbouring lists together, with at least MIN_BINS so that the
work spreads; a list beyond a bin's size is divided by id into bins of its own. A bin's rows are held by one
task, which then streams the queries that chose any of its lists (in several tasks beyond query_rows of them),
compares each with the rows of its lists in blocks by matrix products, and emits its best k. Products only find
candidates: what may be among the best is scored by one formula for each pair, so equal vectors have equal scores.

Vectors that are null, empty, zero, of another dimension than most, or that hold null or non-finite components
take no part, neither as queries nor as candidates; nor do null ids. Rows with the query's id are no candidates;
of rows that share another id the nearest counts. Ties go to the smaller vec_id. Fewer than k candidates: all
there are. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import require, staged

SAMPLE = 16_384
LIST_SIZE = 128
COPIES = 4
REPLICATE = 0.05
RECALL = 0.96
HELD = 256
MIN_BINS = 16
BIN_BYTES = 32 << 20
QUERY_ROWS = 1 << 16
#: Products may differ from the score by so much.
_SLACK = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def balanced_centroids(x: np.ndarray, lists: int, seed: int = 0, rounds: int = 8) -> np.ndarray:
    """Unit centroids of unit vectors x: k-means from a sample; then clusters of more than twice their
    share are split in two until none is."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[: max(1, min(lists, len(x)))]].copy()
    for _ in range(rounds):
        own = _nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1)
        c[norm > 1e-12] = sums[norm > 1e-12] / norm[norm > 1e-12, None]
    most = 2 * max(1, len(x) // max(1, len(c)))
    for _ in range(4):
        own = _nearest(x, c)
        counts = np.bincount(own, minlength=len(c))
        more = []
        for k in np.nonzero(counts > most)[0]:
            part = x[own == k]
            a, b = part[0], part[int(np.argmin(part @ part[0]))]
            for _ in range(4):
                side = part @ a >= part @ b
                if side.all() or not side.any():
                    break
                a, b = (m / max(1e-12, np.linalg.norm(m)) for m in (part[side].mean(axis=0), part[~side].mean(axis=0)))
            if not np.allclose(a, b):
                c[k] = a
                more.append(b)
        if not more:
            break
        c = np.concatenate([c, np.array(more)])
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmax(x[k : k + 4096] @ c.T, axis=1) for k in range(0, len(x), 4096)])


class Graph:
    """Centroids and their navigable graph."""

    def __init__(self, c: np.ndarray, degree: int = 24) -> None:
        self.c = c
        gram = c @ c.T
        order = np.argsort(-gram, axis=1, kind="stable")
        self.edges: list[list[int]] = []
        for i in range(len(c)):
            kept: list[int] = []
            for j in order[i][: 4 * degree].tolist():
                if j != i and len(kept) < degree and all(gram[j, m] < gram[j, i] for m in kept):
                    kept.append(j)
            kept += [j for j in order[i][: degree // 2].tolist() if j != i and j not in kept]
            self.edges.append(kept)
        for i in range(1, len(c)):  # a path through all: no centroid is out of reach
            for a, b in ((i - 1, i), (i, i - 1)):
                if b not in self.edges[a]:
                    self.edges[a].append(b)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, distances) of the best `beam` that a best-first walk finds, nearest first."""
        seen = {0}
        d0 = float(1 - self.c[0] @ q)
        todo, best = [(d0, 0)], [(-d0, 0)]
        while todo:
            d, i = heapq.heappop(todo)
            if len(best) >= beam and d > -best[0][0]:
                break
            new = [j for j in self.edges[i] if j not in seen]
            if not new:
                continue
            seen.update(new)
            for dj, j in zip((1 - self.c[new] @ q).tolist(), new, strict=True):
                if len(best) < beam or dj < -best[0][0]:
                    heapq.heappush(todo, (dj, j))
                    heapq.heappush(best, (-dj, j))
                    if len(best) > beam:
                        heapq.heappop(best)
        found = sorted((-d, i) for d, i in best)
        return np.array([i for _, i in found], np.int64), np.sqrt(np.maximum(0.0, 2 * np.array([d for d, _ in found])))

    def lists_of_vector(self, v: np.ndarray, copies: int, replicate: float) -> list[int]:
        ids, dist = self.search(v, 4 * copies)
        kept: list[int] = []
        for i, d in zip(ids.tolist(), dist.tolist(), strict=True):
            if kept and (len(kept) >= copies or d > dist[0] * (1 + replicate)):
                break
            if all(np.linalg.norm(self.c[i] - self.c[j]) > d for j in kept):
                kept.append(i)
        return kept

    def lists_of_query(self, q: np.ndarray, prune: float, rows: np.ndarray | None = None, least: int = 0) -> list[int]:
        """Lists within the ratio; then further ones until they hold `least` of rows (the size of each list)."""
        beam = min(64, len(self.c))
        while True:
            ids, dist = self.search(q, beam)
            n = int(np.searchsorted(dist, dist[0] * (1 + prune) + 1e-9, "right"))
            if rows is not None:
                n = max(n, int(np.searchsorted(np.cumsum(rows[ids]), least)) + 1)
            if n < len(ids) or beam >= len(self.c):
                return ids[:n].tolist()
            beam = min(4 * beam, len(self.c))

    def order(self) -> np.ndarray:
        """All centroids, near ones close together: halved along the widest direction, again and again."""
        out, todo = [], [np.arange(len(self.c))]
        while todo:
            part = todo.pop()
            if len(part) <= 2:
                out += part.tolist()
                continue
            x = self.c[part] - self.c[part].mean(axis=0)
            along = x @ np.linalg.eigh(x.T @ x)[1][:, -1]
            part = part[np.argsort(along, kind="stable")]
            todo += [part[len(part) // 2 :], part[: len(part) // 2]]
        return np.array(out)


class Index:
    """What a search needs besides the lists: the graph and the calibrated pruning ratio."""

    def __init__(self, graph: Graph, prune: float, copies: int, replicate: float, dimension: int) -> None:
        self.graph, self.prune, self.copies, self.replicate, self.dimension = graph, prune, copies, replicate, dimension


def calibrate(graph: Graph, x: np.ndarray, near: list[np.ndarray], recall: float, copies: int, replicate: float) -> float:
    """The smallest pruning ratio by which the unit vectors x find `recall` of their nearest (unit vectors)."""
    needed = []
    for v, found in zip(x, near, strict=True):
        dist = np.sqrt(np.maximum(0.0, 2 - 2 * graph.c @ v))
        needed += [dist[graph.lists_of_vector(u, copies, replicate)].min() / max(dist.min(), 1e-9) - 1 for u in found]
    return float(np.quantile(needed, recall, method="higher")) + 1e-9 if needed else 0.0


def nearest(vectors: DataFrame, ids: np.ndarray, x: np.ndarray, k: int) -> list[np.ndarray]:
    """The k nearest of all of vectors (id, v) to each of the unit vectors x, by brute force: each task keeps
    the best of the few that are asked for."""
    held = vectors.sparkSession.sparkContext.broadcast((ids, x))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = held.value
        score, best = np.full((len(q), 0), -9.0), np.zeros((len(q), 0, x.shape[1]))
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                v = unit(_matrix(part.column(1)))
                s = q @ v.T
                s[own[:, None] == part.column(0).to_numpy()] = -9.0
                top = np.argsort(-s, axis=1)[:, :k]
                score = np.concatenate([score, np.take_along_axis(s, top, 1)], 1)
                best = np.concatenate([best, v[top]], 1)
                top = np.argsort(-score, axis=1)[:, :k]
                score, best = np.take_along_axis(score, top, 1), np.take_along_axis(best, top[:, :, None], 1)
        r, c = np.nonzero(score > -5)
        yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(score[r, c]), pa.array(list(best[r, c]), pa.list_(pa.float64()))], names=["q", "score", "v"])

    top = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
    found = vectors.where(F.size("v") == x.shape[1]).mapInArrow(scan, "q int, score double, v array<double>").withColumn("rank", top).where(F.col("rank") <= k)
    out: list[list] = [[] for _ in x]
    for r in found.collect():  # k rows for each vector asked for
        out[r["q"]].append(r["v"])
    return [np.array(v) for v in out]


def vectors_of(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """id, v (array of double): the rows that can take part."""
    require(df, id_col, vector)
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))


def _matrix(column, dimension: int | None = None) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def fit(vectors: DataFrame, *, k: int, sample: int = SAMPLE, list_size: int = LIST_SIZE, copies: int = COPIES, replicate: float = REPLICATE, recall: float = RECALL, held: int = HELD, seed: int = 0) -> Index | None:
    """Learn centroids, graph and pruning ratio from at most `sample` of vectors (id, v)."""
    n = vectors.count()
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow() if n else None
    if not n:
        return None
    sizes = np.array([len(x) for x in rows["v"]])
    dimension = int(np.bincount(sizes).argmax())
    fit_ = np.nonzero(sizes == dimension)[0]
    x = unit(_matrix(rows["v"].take(fit_)))
    lists = int(np.clip(np.ceil(n / list_size), 1, max(1, len(x) // 16)))
    graph = Graph(balanced_centroids(x, lists, seed))
    at = np.random.default_rng(seed + 1).permutation(len(x))[:held]
    near = nearest(vectors, rows["id"].take(fit_[at]).to_numpy(), x[at], k)
    return Index(graph, calibrate(graph, x[at], near, recall, copies, replicate), copies, replicate, dimension)


class Bins:
    """Where the rows of each list lie: bins [first, first + parts)."""

    def __init__(self, order: np.ndarray, rows: np.ndarray, most: int) -> None:
        self.rows, self.first, self.parts = rows, np.zeros(len(rows), np.int64), np.maximum(1, -(-rows // most))
        at, held = 0, 0
        for i in order.tolist():
            if held and (held + rows[i] > most or self.parts[i] > 1):
                at, held = at + 1, 0
            self.first[i] = at
            if self.parts[i] > 1:
                at += int(self.parts[i])
            else:
                held += int(rows[i])
        self.n = at + (held > 0)


class _Bin:
    """A bin's rows by list and id, and the best of them for queries."""

    def __init__(self, lists: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        by = np.lexsort((ids, lists))
        self.lists, self.ids, self.v = lists[by], ids[by], v[by]
        self.norm = np.linalg.norm(self.v, axis=1)
        self.begin = np.nonzero(np.concatenate([[True], self.lists[1:] != self.lists[:-1]]))[0]
        self.end = np.append(self.begin[1:], len(by))
        new = np.concatenate([[True], (self.ids[1:] != self.ids[:-1]) | (self.lists[1:] != self.lists[:-1])])
        self.repeats = int(np.diff(np.append(np.nonzero(new)[0], len(by))).max())  # rows of one id in a list, at most

    def best(self, qids: np.ndarray, q: np.ndarray, chosen: list[np.ndarray], k: int) -> pa.RecordBatch:
        need = (k + 1) * self.repeats
        norm = np.linalg.norm(q, axis=1)
        wants = np.zeros((len(q), len(self.begin)), bool)
        names = self.lists[self.begin]
        for r, c in enumerate(chosen):
            wants[r] = np.isin(names, c)
        rows, cols, scores = [], [], []
        for j, (a, b) in enumerate(zip(self.begin.tolist(), self.end.tolist(), strict=True)):
            who = np.nonzero(wants[:, j])[0]
            for at in range(0, len(who), 64):
                r = who[at : at + 64]
                s = (q[r] @ self.v[a:b].T) / (norm[r, None] * self.norm[a:b])
                least = np.partition(s, -need, axis=1)[:, -need] if b - a > need else np.full(len(r), -2.0)
                x, y = np.nonzero(s >= least[:, None] - _SLACK)
                rows.append(r[x])
                cols.append(y + a)
                scores.append(s[x, y])
        if not rows:
            return _result([], [], [])
        row, col, score = map(np.concatenate, (rows, cols, scores))
        other = self.ids[col] != qids[row]
        row, col, score = row[other], col[other], score[other]
        by = np.lexsort((-score, self.ids[col], row))  # an id once for each query, by its nearest row
        row, col, score = row[by], col[by], score[by]
        once = np.concatenate([[True], (row[1:] != row[:-1]) | (self.ids[col[1:]] != self.ids[col[:-1]])])[: len(row)]
        row, col, score = _leading(row[once], col[once], score[once], np.zeros(once.sum(), np.int64), k, _SLACK)
        exact = np.concatenate([(q[row[at : at + 65536]] * self.v[col[at : at + 65536]]).sum(axis=1) for at in range(0, len(row), 65536)] or [np.zeros(0)]) / (norm[row] * self.norm[col])
        row, col, exact = _leading(row, col, exact, self.ids[col], k, None)
        return _result(qids[row], self.ids[col], exact)


def _leading(row: np.ndarray, col: np.ndarray, score: np.ndarray, tie: np.ndarray, k: int, slack: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the k largest scores, ties by `tie`; with slack all that come within it of the k-th."""
    by = np.lexsort((tie, -score, row))
    row, col, score = row[by], col[by], score[by]
    begin = np.searchsorted(row, row)
    place = np.arange(len(row)) - begin
    if slack is None:
        keep = place < k
    else:
        size = np.searchsorted(row, row, "right") - begin
        keep = score >= score[begin + np.minimum(k, size) - 1] - slack
    return row[keep], col[keep], score[keep]


def _result(query, vec, score) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.float64())], names=["query_id", "vec_id", "score"])


_CELLS = ["cell", "kind", "id", "lists", "v"]


def search(vectors: DataFrame, queries: DataFrame, k: int, index: Index | None, *, bin_bytes: int = BIN_BYTES, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score for each row of queries (id, v) against all of vectors (id, v)."""
    spark = vectors.sparkSession
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    held = spark.sparkContext.broadcast(index)
    right = F.size("v") == index.dimension

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i = held.value
        for b in batches:
            rows, lists = [], []
            for r, v in enumerate(_matrix(b.column(1))):
                got = i.graph.lists_of_vector(v / np.linalg.norm(v), i.copies, i.replicate)
                rows += [r] * len(got)
                lists += got
            part = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), part.column(0), part.column(1)], names=["list", "id", "v"])

    posted = staged(vectors.where(right).mapInArrow(post, "list int, id long, v array<double>"), "ann-lists")
    rows = np.zeros(len(index.graph.c), np.int64)
    for r in posted.groupBy("list").agg(F.count("*").alias("n")).collect():  # a row a list: at most sample / 16
        rows[r["list"]] = r["n"]
    most = int(min(bin_bytes // (8 * index.dimension), -(-int(rows.sum()) // MIN_BINS))) or 1
    bins = spark.sparkContext.broadcast(Bins(index.graph.order(), rows, most))
    asked = queries.where(right)
    copies = max(1, -(-asked.count() // query_rows))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = bins.value
        for b in batches:
            lists, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            cell = where.first[lists] + (mixed % where.parts[lists].astype(np.uint64)).astype(np.int64)
            for c in range(copies):
                one = pa.array(lists.reshape(-1, 1).tolist(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(cell * copies + c), pa.array(np.zeros(len(ids), np.int32)), b.column(1), one, b.column(2)], names=_CELLS)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, where = held.value, bins.value
        for b in batches:
            rows, cells, chosen = [], [], []
            ids = b.column(0).to_numpy()
            for r, v in enumerate(_matrix(b.column(1))):
                lists = np.array(i.graph.lists_of_query(v / np.linalg.norm(v), i.prune, where.rows, i.copies * (k + 1)))
                of = np.repeat(lists, where.parts[lists])
                cell = np.concatenate([np.arange(where.first[x], where.first[x] + where.parts[x]) for x in lists])
                for c in np.unique(cell).tolist():
                    rows.append(r)
                    cells.append(c * copies + int(ids[r]) // 2 % copies)
                    chosen.append(of[cell == c].tolist())
            part = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(np.ones(len(rows), np.int32)), part.column(0), pa.array(chosen, pa.list_(pa.int32())), part.column(1)], names=_CELLS)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, made = None, [], None
        for whole in batches:
            cell, kind = whole.column(0).to_numpy(), whole.column(1).to_numpy()
            cuts = np.nonzero((cell[1:] != cell[:-1]) | (kind[1:] != kind[:-1]))[0] + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cell)], strict=True):
                if a == b:
                    continue
                if cell[a] != at:
                    at, parts, made = cell[a], [], None
                part = whole.slice(a, b - a)
                if kind[a] == 0:
                    parts.append((part.column(3).flatten().to_numpy(), part.column(2).to_numpy(), _matrix(part.column(4))))
                elif parts:
                    made = made or _Bin(*map(np.concatenate, zip(*parts, strict=True)))
                    for j in range(0, part.num_rows, 512):
                        q = part.slice(j, 512)
                        yield made.best(q.column(2).to_numpy(), _matrix(q.column(4)), [x.values.to_numpy() for x in q.column(3)], k)

    kind = "cell long, kind int, id long, lists array<int>, v array<double>"
    cells = posted.mapInArrow(deal, kind).union(asked.mapInArrow(ask, kind))
    found = cells.repartition("cell").sortWithinPartitions("cell", "kind", "id").mapInArrow(compare, "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
