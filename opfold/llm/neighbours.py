"""Approximate nearest neighbours by a forest of random-projection trees.

Fit. The trees' hyperplanes come from a bounded sample of the distinct vectors
(``sample_rows``, taken by hash); every vector is then routed to one leaf of
each tree, and the leaves' sizes are counted over all of them. The sample
bounds the number of leaves, not what is searched.

Search. One priority queue, shared by all trees, holds branches by the least
margin on their path; leaves are taken until they hold ``search_rows`` rows,
or more: the true neighbours of up to ``probes`` queries (by hash) are found by
brute force, and the search is widened, up to the whole table, until it finds
the share ``recall`` of them. A table of any size is thus searched as far as
its own structure asks.
Query and vectors meet at (leaf, slice): a leaf of more than ``slice_rows``
rows is split over tasks and the query goes to each slice. There the exact
cosine in double precision ranks the candidates.

Scale. Equal vectors are folded into one class before anything else, with only
the k + 1 smallest ids (more can never be among the k nearest), so a vector
that a third of all rows share is one row of the index and one query. Vectors
move once per tree; queries once per leaf taken; the forest has a size bound by
its parameters, whatever the number of rows, and so have the leaves that a
query is sent to; leaves grow instead. The brute force reads each class once.

Rows whose vector is null, zero, or holds a null or non-finite component, whose
length is not the table's commonest, or whose id is null take no part. Rows
that repeat an id count once (the least vector). Ties go to the smaller id. An
empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opfold.llm.common import written

TREES, LEAF_ROWS, SEARCH_ROWS, SAMPLE_ROWS, SLICE_ROWS = 32, 64, 32_000, 20_000, 8192
#: Share of the probes' true neighbours that the search has to find (0.9 is required; the rest is for the error of a sample), probes, leaves of a tree.
RECALL, PROBES, TREE_LEAVES = 0.95, 256, 1024


class Forest:
    """Hyperplanes of all trees; children are nodes, or leaves as ~leaf."""

    def __init__(self, sample: np.ndarray, trees: int, leaf: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.normals: list[np.ndarray] = []
        self.cuts: list[float] = []
        self.children: list[list[int]] = []
        self.roots: list[int] = []
        self.leaves = 0

        def grow(rows: np.ndarray) -> int:
            if len(rows) > leaf:
                normal = rng.standard_normal(sample.shape[1])
                a, b = sample[rng.choice(rows, 2, replace=False)]
                if (a != b).any():
                    normal = a - b
                normal /= np.linalg.norm(normal)
                at = sample[rows] @ normal
                cut = float(np.median(at))
                left, right = rows[at < cut], rows[at >= cut]
                if len(left) and len(right):
                    node = len(self.cuts)
                    self.normals.append(normal)
                    self.cuts.append(cut)
                    self.children.append([0, 0])
                    self.children[node] = [grow(left), grow(right)]
                    return node
            self.leaves += 1
            return ~(self.leaves - 1)

        for _ in range(trees):
            self.roots.append(grow(np.arange(len(sample))))
        self.plane = np.array(self.normals) if self.normals else np.zeros((0, sample.shape[1]))
        self.cut, self.child = np.array(self.cuts), np.array(self.children, np.int64).reshape(-1, 2)
        del self.normals, self.cuts, self.children

    def route(self, unit: np.ndarray) -> np.ndarray:
        """The leaf of every row in every tree."""
        out = np.empty((len(unit), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            at = np.full(len(unit), root)
            while (inner := np.flatnonzero(at >= 0)).size:
                nodes = at[inner]
                side = ((unit[inner] * self.plane[nodes]).sum(axis=1) >= self.cut[nodes]).astype(int)
                at[inner] = self.child[nodes, side]
            out[:, t] = ~at
        return out

    def search(self, unit: np.ndarray, sizes: np.ndarray, rows: int) -> list[int]:
        """Leaves by their least margin, from all trees together, until they hold ``rows``."""
        margin = (self.plane @ unit - self.cut).tolist()
        queue, found, got = [(-np.inf, root) for root in self.roots], [], 0
        heapq.heapify(queue)
        while queue and got < rows:
            far, node = heapq.heappop(queue)
            if node < 0:
                if sizes[~node]:
                    found.append(~node)
                    got += int(sizes[~node])
                continue
            m = margin[node]
            left, right = self.child[node].tolist()
            heapq.heappush(queue, (max(far, m), left))
            heapq.heappush(queue, (max(far, -m), right))
        return found


    def far(self, unit: np.ndarray) -> np.ndarray:
        """The least margin at which ``search`` reaches each leaf."""
        margin = self.plane @ unit - self.cut
        out = np.empty(self.leaves)
        at, level = np.array(self.roots), np.full(len(self.roots), -np.inf)
        while len(at):
            end = at < 0
            out[~at[end]] = level[end]
            at, level = at[~end], level[~end]
            m = margin[at]
            at, level = self.child[at].T.ravel(), np.concatenate([np.maximum(level, m), np.maximum(level, -m)])
        return out

    def rows_needed(self, unit: np.ndarray, sizes: np.ndarray, found_in: np.ndarray) -> np.ndarray:
        """For rows given by their leaves (one a tree): the least ``rows`` with which ``search`` meets each."""
        far = self.far(unit)
        taken = np.flatnonzero(sizes)
        # of leaves equally far any may come last: then the fewest rows are left out if it is the smallest
        order = taken[np.lexsort((-sizes[taken], far[taken]))]
        held = np.concatenate([[0], np.cumsum(sizes[order])])
        return held[np.maximum(np.searchsorted(far[order], far[found_in].min(axis=1), "right") - 1, 0)] + 1


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def unit_rows(m: np.ndarray) -> np.ndarray:
    scale = np.abs(m).max(axis=1, keepdims=True)
    m = m / scale
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, summed in one order wherever a pair meets."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v of the rows that take part, an id once. Vectors of float stay so: they move at half the size, and become double where they are compared."""
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    v = F.col("embedding").cast(f"array<{kind}>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(F.forall("v", lambda x: x.isNotNull()))
    rows = rows.filter(F.forall("v", lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).select("n")
    return rows.join(F.broadcast(length), F.size("v") == F.col("n"), "left_semi").groupBy("vec_id").agg(F.min(F.transform("v", lambda x: x + F.lit(0.0).cast(kind))).alias("v"))


def rows_for_recall(classes: DataFrame, queries: DataFrame, forest: Forest, sizes: np.ndarray, k: int, recall: float, probes: int) -> int:
    """The least rows a query with which the search finds the share ``recall`` of the true neighbours of the probes."""
    asked = queries.groupBy("rep").agg(F.any_value("v").alias("v")).orderBy(F.xxhash64("rep", F.lit("probe")), "rep").limit(probes).select("v").toArrow().column(0).combine_chunks()
    own = matrix(asked)
    if not len(own):
        return 0
    shared = classes.sparkSession.sparkContext.broadcast(own)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k + 1 nearest classes (the probe's own among them) of a task's, for every probe."""
        qs = unit_rows(shared.value)
        score, rep, v = np.full((len(qs), 0), 0.0), np.zeros((len(qs), 0), np.int64), np.zeros((len(qs), 0, qs.shape[1]))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                vs = matrix(part.column(1))
                near = qs @ unit_rows(vs).T
                top = np.argpartition(-near, min(k, near.shape[1] - 1), axis=1)[:, : k + 1]
                score, rep, v = np.concatenate([score, np.take_along_axis(near, top, 1)], 1), np.concatenate([rep, part.column(0).to_numpy()[top]], 1), np.concatenate([v, vs[top]], 1)
                best = np.argsort(-score, axis=1, kind="stable")[:, : k + 1]
                score, rep, v = np.take_along_axis(score, best, 1), np.take_along_axis(rep, best, 1), np.take_along_axis(v, best[:, :, None], 1)
        n = score.shape[1]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(qs)), n)), pa.array(score.ravel()), pa.array(rep.ravel()), pa.array(list(v.reshape(-1, qs.shape[1])), pa.list_(pa.float64()))], names=["probe", "score", "rep", "v"])

    ranked = classes.select("rep", "v").mapInArrow(scan, "probe long, score double, rep long, v array<double>")
    true = ranked.withColumn("__n", F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "rep"))).filter(F.col("__n") <= k + 1).select("probe", "v").toArrow().combine_chunks()
    leaves, probe = forest.route(unit_rows(matrix(true.column("v").combine_chunks()))), true.column("probe").to_numpy()
    units = unit_rows(own)
    need = [x for q in range(len(units)) for x in np.sort(forest.rows_needed(units[q], sizes, leaves[probe == q]))[1:].tolist()]  # the first is its own class
    return int(np.sort(need)[min(len(need) - 1, int(np.ceil(recall * len(need))))]) if need else 0


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, trees: int = TREES, leaf_rows: int = LEAF_ROWS, search_rows: int = SEARCH_ROWS, sample_rows: int = SAMPLE_ROWS, slice_rows: int = SLICE_ROWS, recall: float = RECALL, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose id is divisible by ``every``.

    ``search_rows`` is the least that is searched; ``recall``, measured on ``probes`` queries, may ask for more.
    """
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    rows = written(usable(vectors), "vectors")
    kind = dict(rows.dtypes)["v"]
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    classes = written(rows.withColumn("__n", first).filter(F.col("__n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "v", "ids"), "classes")
    total = classes.count()
    if not total:
        return spark.createDataFrame([], out)
    sample = classes.orderBy(F.xxhash64("rep"), "rep").limit(sample_rows).select("v").toArrow().column(0).combine_chunks()
    points = unit_rows(matrix(sample))
    forest = Forest(points, trees, max(1, leaf_rows * len(points) // total, len(points) // TREE_LEAVES))
    shared = spark.sparkContext.broadcast(forest)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                leaves = f.route(unit_rows(matrix(part.column(1))))
                rows_of = pa.array(np.repeat(np.arange(part.num_rows), leaves.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(leaves.ravel()), *(part.column(c).take(rows_of) for c in range(3))], names=["leaf", "rep", "v", "ids"])

    index = classes.mapInArrow(route, f"leaf long, rep long, v {kind}, ids array<long>")
    counted = {r.leaf: r.n for r in classes.select("rep", "v", F.array().cast("array<long>").alias("ids")).mapInArrow(route, index.schema).groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    sizes = np.zeros(forest.leaves, np.int64)  # as many as the forest has leaves, a bounded number
    sizes[list(counted)] = list(counted.values())
    queries = rows.filter(F.col("vec_id") % every == 0).join(classes.select("rep", "v"), "v").select("vec_id", "rep", "v")
    queries = written(queries, "queries")
    search_rows = max(search_rows, rows_for_recall(classes, queries, forest, sizes, k, recall, probes))
    slices = np.maximum(1, -(-sizes // slice_rows))
    plan = spark.sparkContext.broadcast((sizes, slices))
    base = np.concatenate([[0], np.cumsum(slices)])
    cells = spark.sparkContext.broadcast(base)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A leaf's rows go to its slices by id."""
        _, many = plan.value
        for batch in route(batches):
            leaf, rep = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cell = cells.value[leaf] + (rep * np.int64(0x9E3779B1) & np.int64(0x7FFFFFFF)) % many[leaf]
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.ones(len(leaf), np.int32)), *batch.columns[1:]], names=["cell", "kind", "rep", "v", "ids"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A query goes to every slice of every leaf that the search takes."""
        f, (own_sizes, many) = shared.value, plan.value
        for batch in batches:
            units = unit_rows(matrix(batch.column(1)))
            for at in range(0, len(units), 64):
                cell, row = [], []
                for k_row, u in enumerate(units[at : at + 64], at):
                    for leaf in f.search(u, own_sizes, search_rows):
                        cell += range(int(cells.value[leaf]), int(cells.value[leaf] + many[leaf]))
                    row += [k_row] * (len(cell) - len(row))
                take = pa.array(np.array(row, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(cell, np.int64)), pa.array(np.zeros(len(cell), np.int32)), batch.column(0).take(take), batch.column(1).take(take), pa.nulls(len(cell), pa.list_(pa.int64()))], names=["cell", "kind", "rep", "v", "ids"])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by cell, its queries first: the k + 1 nearest classes of each batch of its vectors."""
        here, ids, qs = None, np.zeros(0, np.int64), np.zeros((0, 1))
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, kind, rep, vs = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), matrix(batch.column(3))
            edges = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (kind[1:] != kind[:-1])]))
            got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(cell)], strict=True):
                if cell[a] != here:
                    here, ids, qs = cell[a], np.zeros(0, np.int64), np.zeros((0, vs.shape[1]))
                if kind[a] == 0:
                    ids, qs = np.concatenate([ids, rep[a:b]]), np.concatenate([qs, vs[a:b]])
                    continue
                unit_v = unit_rows(vs[a:b])
                for at in range(0, len(ids), 256):
                    near = unit_rows(qs[at : at + 256]) @ unit_v.T
                    most = min(2 * (k + 1), b - a)
                    top = np.argpartition(-near, most - 1, axis=1)[:, :most]
                    q = np.repeat(np.arange(at, at + len(near)), most)
                    v = a + top.ravel()
                    exact = cosine(qs[q], vs[v])
                    order = np.lexsort((rep[v], -exact, q))
                    q, v, exact = q[order], v[order], exact[order]
                    keep = (np.arange(len(q)) % most) <= k
                    got.append((ids[q[keep]], v[keep], exact[keep]))
            if got:
                take = pa.array(np.concatenate([g[1] for g in got]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([g[0] for g in got])), batch.column(2).take(take), pa.array(np.concatenate([g[2] for g in got])), batch.column(4).take(take)], names=["query", "rep", "score", "ids"])

    moving = f"cell long, kind int, rep long, v {kind}, ids array<long>"
    met = classes.mapInArrow(place, moving).unionByName(queries.groupBy("rep").agg(F.any_value("v").alias("v")).mapInArrow(probe, moving))
    ranked = met.repartition("cell").sortWithinPartitions("cell", "kind").mapInArrow(rank, "query long, rep long, score double, ids array<long>")
    best = ranked.groupBy("query", "rep").agg(F.max("score").alias("score"), F.any_value("ids").alias("ids"))
    best = best.withColumn("__n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "rep"))).filter(F.col("__n") <= k + 1)
    items = F.flatten(F.transform(F.collect_list(F.struct("score", "ids")), lambda c: F.transform(c["ids"], lambda i: F.struct((-c["score"]).alias("far"), i.alias("id")))))
    listed = best.groupBy("query").agg(F.array_sort(items).alias("items"))
    own = queries.select("vec_id", "rep").join(listed, queries.rep == listed.query)
    picked = F.slice(F.filter("items", lambda x: x["id"] != F.col("vec_id")), 1, k)
    return own.select(F.col("vec_id").alias("query_id"), F.posexplode(picked).alias("pos", "x")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.far")).alias("score"))
