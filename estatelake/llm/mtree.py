"""Exact top-k search by inner product in an M-tree that is stored as a table of pages.

A largest inner product is a smallest distance once every vector x gets one more coordinate, the root of M^2 - |x|^2 with M the
largest norm, and the query gets 0 there: d^2 = |q|^2 + M^2 - 2 q.x. Distances are metric, so the triangle inequality prunes.

The tree has three levels. Routing objects (a bounded sample of distinct vectors) take the vectors nearest to them; what one
takes is cut into pages of vectors that lie at about the same distance from it. A page keeps a routing object of its own, its
covering radius, its distance from the parent, and for each entry the stored distance from the page's object. A search takes
pages in the order of their lower bounds, computes the distance to a page's object only if the stored parent distance leaves
hope, computes entries only if their stored distances do, and ends at the first bound above the k-th best so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatelake.llm.common import stored

PAGE = 256
GROUP = 16_384  # vectors of one routing object that are laid out together; a hot one is dealt to several groups


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as long; null for a null or empty vector or one with null or non-finite components."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when((F.size(vector) > 0) & good, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(column, size: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().values if isinstance(column, pa.ChunkedArray) else column.flatten()).reshape(-1, size)


def _lifted(vectors: np.ndarray, norm2: float) -> np.ndarray:
    x = vectors.astype(np.float64)
    rest = np.sqrt(np.maximum(norm2 - (x * x).sum(axis=1), 0))
    return np.concatenate([x, rest[:, None]], axis=1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def build(vectors: DataFrame, objects: int = 256) -> tuple[DataFrame, dict]:
    """Pages of the tree over (row, id, vector of long, all of one size), and what a search needs to know of the root.

    At most ``objects`` distinct vectors, those of the smallest hashes, become routing objects; they and the number of vectors
    each takes are all that reaches the driver.
    """
    top = vectors.groupBy("vector").agg(F.min("row").alias("row"), F.min("id").alias("id")).orderBy(F.xxhash64("vector"), "row").limit(objects).collect()
    if not top:
        return None, {}
    norm2 = float(vectors.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))).first()[0])
    size = len(top[0].vector)
    roots = np.array([r.vector for r in top], np.int64)
    lifted = _lifted(roots, norm2)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _distances(_lifted(_matrix(batch["vector"], size), norm2), lifted)
                parent = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(parent.astype(np.int32)), pa.array(d[np.arange(len(d)), parent])], [*batch.schema.names, "parent", "far"]
                )

    placed = stored(vectors.select("row", "id", "vector").mapInArrow(nearest, "row long, id long, vector array<long>, parent int, far double"))
    taken = placed.groupBy("parent").agg(F.count("*").alias("n")).select("parent", F.ceil(F.col("n") / GROUP).cast("int").alias("groups"))
    dealt = placed.join(F.broadcast(taken), "parent").withColumn("part", F.pmod(F.xxhash64("row"), F.col("groups")).cast("int"))

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            parents = batch["parent"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(parents)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if waiting and waiting[0]["parent"][0].as_py() != parents[a]:
                    yield from _pages(waiting, size, norm2, lifted)
                    waiting = []
                for at in range(a, b, PAGE):  # a full page goes out at once, the rest waits for the next batch
                    waiting.append(batch.slice(at, min(PAGE, b - at)))
                    if sum(w.num_rows for w in waiting) >= PAGE:
                        yield from _pages(waiting, size, norm2, lifted)
                        waiting = []
        if waiting:
            yield from _pages(waiting, size, norm2, lifted)

    tree = stored(
        dealt.repartition("parent", "part").sortWithinPartitions("parent", "far").select("row", "id", "vector", "parent", "far")
        .mapInArrow(pages, "parent int, parent_distance double, radius double, object binary, rows binary, ids binary, vectors binary, distances binary")
    )
    return tree, {"size": size, "norm2": norm2, "roots": roots, "rows": np.array([r.row for r in top]), "ids": np.array([r.id for r in top])}


def _pages(parts: list[pa.RecordBatch], size: int, norm2: float, roots: np.ndarray) -> Iterator[pa.RecordBatch]:
    t = pa.Table.from_batches(parts)
    vectors = _matrix(t["vector"], size)
    points, parent = _lifted(vectors, norm2), t["parent"][0].as_py()
    middle = points[_distances(points, points.mean(axis=0)[None])[:, 0].argmin()]
    far = _distances(points, middle[None])[:, 0]
    up = _distances(middle[None], roots[parent][None])[0, 0]
    values = [parent, up, far.max(), middle.tobytes(), t["row"].to_numpy().tobytes(), t["id"].to_numpy().tobytes(), vectors.tobytes(), far.tobytes()]
    names = ["parent", "parent_distance", "radius", "object", "rows", "ids", "vectors", "distances"]
    kinds = [pa.int32(), pa.float64(), pa.float64(), *[pa.binary()] * 5]
    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)


class _Best:
    """The k best so far of one query: score, then the smaller id, then the smaller row."""

    def __init__(self, k: int) -> None:
        self.k, self.found = k, np.empty((3, 0), np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if self.found.shape[1] == self.k:
            worth = scores >= self.found[0, -1]
            scores, ids, rows = scores[worth], ids[worth], rows[worth]
            if not len(scores):
                return
        both = np.concatenate([self.found, np.stack([scores, ids, rows])], axis=1)
        self.found = both[:, np.lexsort((both[2], both[1], -both[0]))[: self.k]]

    def reach(self, query2: float, norm2: float) -> float:
        """Distance of the k-th best; what lies farther can't be one of the k. A little is added for rounding."""
        if self.found.shape[1] < self.k:
            return np.inf
        return float(np.sqrt(max(query2 + norm2 - 2.0 * float(self.found[0, -1]), 0.0))) * (1 + 1e-9) + 1e-6


def _search(tree: list[dict], root: dict, queries: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(index of the query, its best of these pages)."""
    size, norm2 = root["size"], root["norm2"]
    q = np.concatenate([queries.astype(np.float64), np.zeros((len(queries), 1))], axis=1)
    to_roots = _distances(q, _lifted(root["roots"], norm2))
    objects = np.stack([np.frombuffer(p["object"], np.float64) for p in tree])
    parent, up, radius = (np.array([p[c] for p in tree]) for c in ("parent", "parent_distance", "radius"))
    rows, ids = ([np.frombuffer(p[c], np.int64) for p in tree] for c in ("rows", "ids"))
    vectors, stored_far = [np.frombuffer(p["vectors"], np.int64).reshape(-1, size) for p in tree], [np.frombuffer(p["distances"], np.float64) for p in tree]
    small = norm2 < 2**52  # then every product is a whole number that a double holds
    work = [v.astype(np.float64) for v in vectors] if small else vectors
    for i in range(len(queries)):
        query2, mine = float(q[i] @ q[i]), queries[i].astype(np.float64) if small else queries[i]
        best, seeds = _Best(k), root["rows"] != own[i]
        sample = _Best(k)  # real rows as well, but they come again in their pages, so they only set the first reach
        sample.add((root["roots"][seeds] @ queries[i]), root["ids"][seeds], root["rows"][seeds])
        first = reach = sample.reach(query2, norm2)
        hope = np.flatnonzero(np.abs(to_roots[i, parent] - up) - radius <= reach)
        if not len(hope):
            continue
        far = _distances(q[i][None], objects[hope])[0]
        bound = far - radius[hope]
        for j in np.argsort(bound):
            if bound[j] > reach:
                break
            page = hope[j]
            near = np.flatnonzero((np.abs(far[j] - stored_far[page]) <= reach) & (rows[page] != own[i]))
            if len(near):
                scores = work[page][near] @ mine
                best.add(np.rint(scores).astype(np.int64) if small else scores, ids[page][near], rows[page][near])
                reach = min(first, best.reach(query2, norm2))
        yield i, best.found


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, objects: int = 256, block: int = 32_768) -> DataFrame:
    """(query_row, query_id, id, score, rank) of the k largest inner products of each query with all vectors but itself.

    ``vectors`` and ``queries`` have row (unique), id and vector (long components without nulls, as ``quantised`` gives);
    rows with a null id or vector take no part, vectors of unlike size are never compared. Ties go to the smaller id, then the
    smaller row; a query with fewer than k other vectors gets all of them. Queries go round in blocks of at most ``block``
    vectors, which bounds what a task is sent; each block meets all pages.
    """
    spark = vectors.sparkSession
    schema = "query_row long, query_id long, id long, score long, row long"
    good = "id IS NOT NULL AND vector IS NOT NULL"
    sizes = [r[0] for r in vectors.where(good).select(F.size("vector")).distinct().collect()]
    found = spark.createDataFrame([], schema)
    for size in sizes:
        same = F.size("vector") == size
        tree, root = build(vectors.where(good).where(same), objects)
        asked = stored(queries.where(good).where(same).select("row", "id", "vector"))
        blocks = max(1, -(-asked.count() // block))
        for b in range(blocks):
            rows = asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).collect()
            if rows:
                found = found.union(_block(tree, root, rows, k, schema))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "id", "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_row", "query_id", "id", "score", "rank")


def _block(tree: DataFrame, root: dict, rows: list, k: int, schema: str) -> DataFrame:
    own, ids, vectors = np.array([r.row for r in rows]), np.array([r.id for r in rows]), np.array([r.vector for r in rows], np.int64)
    sent = tree.sparkSession.sparkContext.broadcast((root, own, ids, vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, own, ids, vectors = sent.value
        for batch in batches:
            pages = batch.to_pylist()
            found = [(i, f) for i, f in _search(pages, root, vectors, own, k)] if pages else []
            if found:
                at = np.repeat([i for i, _ in found], [f.shape[1] for _, f in found])
                scores, other, other_rows = np.concatenate([f for _, f in found], axis=1)
                columns = [own[at], ids[at], other, scores, other_rows]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_row", "query_id", "id", "score", "row"])

    return tree.repartition(tree.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, schema)
