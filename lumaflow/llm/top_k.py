"""Exact inner-product top-k by dual-tree search over cover trees.

Queries and candidates are indexed together: a bounded sample gives pivots, the top level of both sides' trees;
every vector goes to its nearest pivot, and what a pivot holds is cut into blocks of bounded size. Each block is
one cover tree (levels by halving radii), built once and written with its centre, covering radius and largest norm.

Block pairs are compared by those figures alone, no vector is copied for it. Every query block first searches the
candidate block whose centre promises most; the kth scores found there prune the other block pairs, and only
what is left is searched. Inside a pair the two trees are walked down together from their roots: a node pair goes if
  <q, p> <= <cq, cp> + rq |cp| + rp |cq| + rq rp,   <q, p> <= |q| |p|
is below the worst kth score of the query node. Results are merged by one grouped top-k.

Scores are exact integers: products that doubles hold exactly are made by them, others by 64-bit or Python's integers.

Defined results: vectors that are null, hold a null or a non-finite component (also after scaling) take no part;
shorter vectors count as filled up with zeros; scores beyond 64 bits count as the nearest 64-bit integer; ties go to the
smaller id; repeated ids are candidates each; fewer candidates than k give all of them; a query never matches rows
of its own id; query rows of one id with different vectors are queries each, equal ones are one; no rows give none.

Where vectors have no clusters (random directions in many dimensions) no bound can prune, and all pairs of the stated
query set and the candidates are compared, block by block.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumaflow.llm.common import discard, lean, small_batches, stash

LEAF, QUERY_LEAF, AT_ONCE = 128, 32, 2048
BLOCK_ROWS, BLOCKS_AT_ONCE = 8192, 4096
PIVOTS, PIVOT_SAMPLE = 64, 2048
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def norms(v: np.ndarray) -> np.ndarray:
    """Lengths of rows, without overflow on the way."""
    most = np.abs(v).max(1, initial=0.0)
    unit = v / np.where(most > 0, most, 1.0)[:, None]
    return most * np.sqrt(np.einsum("ij,ij->i", unit, unit))


def exact_scores(q: np.ndarray, p: np.ndarray, most: float) -> np.ndarray:
    """Inner products of rows of whole numbers, each exact, as doubles (if all are below 2**53) or as integers clamped
    to 64 bits; `most` bounds the product of two rows' lengths, and with it every partial sum."""
    if most < 2.0**53:
        return q @ p.T
    if most < 2.0**62:
        return q.astype(np.int64) @ p.astype(np.int64).T
    whole = lambda v: np.array([[int(x) for x in row] for row in v], object).reshape(v.shape)
    return np.clip(whole(q) @ whole(p).T, LEAST, MOST).astype(np.int64)


class CoverTree:
    """Nodes in arrays; the points lie in tree order, so a node is a range of rows. Its centre is its first row.
    Children's separation halves by level."""

    def __init__(self, points: np.ndarray, leaf: int, ids: np.ndarray | None = None):
        self.points = points.astype(np.float64)
        order = np.arange(len(points)) if ids is None else np.argsort(ids, kind="stable")
        self.low: list[int] = []
        self.high: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        placed: list[np.ndarray] = []
        self.filled = 0
        if len(points):
            self._build(order, leaf, placed)
        self.order = np.concatenate(placed) if placed else order
        self.points = self.points[self.order]
        self.norm = norms(self.points)
        self.most = [float(self.norm[a:b].max()) for a, b in zip(self.low, self.high, strict=True)]
        self._seal()

    def _seal(self) -> None:
        self.low, self.high = np.array(self.low, np.int64), np.array(self.high, np.int64)
        self.radius, self.most = np.array(self.radius, np.float64), np.array(self.most, np.float64)
        self.n_kids = np.array([len(c) for c in self.children], np.int64)
        self.kids = np.array([x for c in self.children for x in c], np.int64)
        self.first_kid = np.cumsum(self.n_kids) - self.n_kids

    def open(self, nodes: np.ndarray, which: np.ndarray) -> np.ndarray:
        """The nodes, with the children of those marked in `which` in their place."""
        n = self.n_kids[nodes[which]]
        at = np.repeat(self.first_kid[nodes[which]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.concatenate([nodes[~which], self.kids[at]])

    def _distances(self, rows: np.ndarray, centre: int) -> np.ndarray:
        return norms(self.points[rows] - self.points[centre])

    def _build(self, rows: np.ndarray, leaf: int, placed: list[np.ndarray]) -> int:
        node = len(self.low)
        far = self._distances(rows, int(rows[0]))
        radius = float(far.max())
        self.low.append(self.filled)
        self.high.append(self.filled + len(rows))
        self.radius.append(radius)
        self.children.append([])
        # cover the node by centres further apart than half its radius (farthest-first); each row goes to the nearest
        near, owner, centres = far, np.zeros(len(rows), np.int64), [0]
        if len(rows) > leaf:
            while near.max() > radius / 2 and len(centres) < 16:
                pick = int(near.argmax())
                own = self._distances(rows, int(rows[pick]))
                closer = own < near
                owner[closer], near = len(centres), np.minimum(near, own)
                centres.append(pick)
        parts = []
        for k, c in enumerate(centres):
            inside = np.flatnonzero(owner == k)
            if len(inside):
                parts.append(rows[np.concatenate([[c], inside[inside != c]])] if owner[c] == k else rows[inside])
        if len(parts) < 2:
            placed.append(rows)
            self.filled += len(rows)
            return node
        self.children[node] = [self._build(p, leaf, placed) for p in parts]
        return node

    def dump(self, **more: np.ndarray) -> bytes:
        """The tree and arrays by row (in the order the points came) as bytes; whole numbers take the least width that holds them."""
        most = np.abs(self.points).max(initial=0.0)
        kind = next((k for k in (np.int8, np.int16, np.int32) if most <= np.iinfo(k).max), np.float64)
        out = io.BytesIO()
        np.savez(out, points=self.points.astype(kind), low=self.low, high=self.high, radius=self.radius, most=self.most, norm=self.norm, kids=self.kids, n_kids=self.n_kids, first_kid=self.first_kid, **{k: x[self.order] for k, x in more.items()})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> tuple[CoverTree, dict[str, np.ndarray]]:
        """The tree, and the arrays by row in tree order."""
        own = dict(np.load(io.BytesIO(raw), allow_pickle=False))
        out = cls.__new__(cls)
        out.points = own.pop("points").astype(np.float64)
        for name in ("low", "high", "radius", "most", "norm", "kids", "n_kids", "first_kid"):
            setattr(out, name, own.pop(name))
        return out, own


def upper_bound(product: np.ndarray, ra, na, rb, nb, most) -> np.ndarray:
    """Bound of all inner products of two balls, given that of their centres (lengths na, nb) and of the largest lengths' product."""
    with np.errstate(all="ignore"):
        ball = product + ra * nb + rb * na + ra * rb
        bound = np.minimum(np.where(np.isnan(ball), np.inf, ball), np.where(np.isnan(most), np.inf, most))
        return bound + 1e-9 * np.where(np.isnan(most), np.inf, np.abs(most)) + 1e-6  # more than rounding can take away


class DualTreeSearch:
    """Both trees walked down together. `least`: scores by query (in tree order) that a result must at least reach."""

    def __init__(self, queries, query_ids: np.ndarray, points, ids: np.ndarray, k: int, least: np.ndarray | None = None):
        left = queries if isinstance(queries, CoverTree) else CoverTree(queries, QUERY_LEAF)
        right = points if isinstance(points, CoverTree) else CoverTree(points, LEAF, ids)
        self.left, self.right, self.k = left, right, k
        self.query_ids = query_ids if left is queries else query_ids[left.order]
        self.ids = ids if right is points else ids[right.order]
        n = len(left.points)
        self.scores = np.full((n, k), LEAST, np.int64)
        self.found = np.full((n, k), MOST, np.int64)
        self.full = np.zeros((n, k), bool)
        self.worst = np.full(n, -np.inf) if least is None else least.astype(np.float64)
        self.compared = 0

    def run(self) -> None:
        if len(self.left.points) and len(self.right.points):
            self._descend(0, np.zeros(1, np.int64))

    def _bounds(self, a: int, nodes: np.ndarray) -> np.ndarray:
        """Bounds of a query node with candidate nodes."""
        left, right = self.left, self.right
        ca, cb = left.low[a], right.low[nodes]
        with np.errstate(all="ignore"):
            return upper_bound(right.points[cb] @ left.points[ca], left.radius[a], left.norm[ca], right.radius[nodes], right.norm[cb], left.most[a] * right.most[nodes])

    def _left_over(self, a: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The candidate nodes that the worst kth score of a query node does not rule out, and their bounds."""
        bounds = self._bounds(a, nodes)
        stay = bounds >= self.worst[self.left.low[a] : self.left.high[a]].min()
        return nodes[stay], bounds[stay]

    def _descend(self, a: int, nodes: np.ndarray) -> None:
        """A query node with the candidate nodes that its parents left over; the wider side is opened first."""
        left, right = self.left, self.right
        leaf = not left.n_kids[a]
        while True:
            nodes, bounds = self._left_over(a, nodes)
            wide = (right.n_kids[nodes] > 0) & (leaf | (right.radius[nodes] >= left.radius[a]))
            if not wide.any():
                break
            nodes = right.open(nodes, wide)
        if not len(nodes):
            return
        if leaf:
            self._leaves(a, nodes, bounds)
        else:
            first = left.first_kid[a]
            for kid in left.kids[first : first + left.n_kids[a]].tolist():
                self._descend(kid, nodes)

    def _own_bounds(self, rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Bounds of single queries with candidate nodes."""
        left, right = self.left, self.right
        with np.errstate(all="ignore"):
            centre = left.points[rows] @ right.points[right.low[nodes]].T
            return upper_bound(centre, 0.0, left.norm[rows][:, None], right.radius[nodes], right.norm[right.low[nodes]], left.norm[rows][:, None] * right.most[nodes])

    def _leaves(self, a: int, nodes: np.ndarray, bounds: np.ndarray) -> None:
        """A query group against candidate leaves: each query that has no kth score yet looks into the leaf that
        promises it most, then all leaves follow, best bound first, some AT_ONCE rows at a time."""
        order = np.argsort(-bounds, kind="stable")
        nodes, bounds = nodes[order], bounds[order]
        rows = np.arange(self.left.low[a], self.left.high[a])
        done = np.full(len(rows), -1)
        new = np.flatnonzero(np.isneginf(self.worst[rows]))
        if len(new):
            done[new] = self._own_bounds(rows[new], nodes).argmax(1)
            for i in np.unique(done[new]).tolist():
                self._base(rows[done == i], nodes[i : i + 1], np.full((done == i).sum(), -1))
        portion = np.cumsum(self.right.high[nodes] - self.right.low[nodes]) // AT_ONCE
        cut = np.flatnonzero(np.diff(portion, prepend=-1))
        for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(nodes)], strict=True):
            if bounds[i] < self.worst[rows].min():
                return
            self._base(rows, nodes[i:j], np.where((done >= i) & (done < j), done - i, -1))

    def _base(self, rows: np.ndarray, nodes: np.ndarray, done: np.ndarray) -> None:
        """Queries against candidate leaves; done: the place in `nodes` of the one that a query has looked into (-1: none)."""
        left, right, k = self.left, self.right, self.k
        fits = self._own_bounds(rows, nodes) >= self.worst[rows][:, None]
        fits[done >= 0, done[done >= 0]] = False
        some, use = fits.any(1), np.flatnonzero(fits.any(0))
        rows, done = rows[some], done[some]
        if not len(rows):
            return
        n = right.high[nodes[use]] - right.low[nodes[use]]
        p = np.repeat(right.low[nodes[use]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        score = exact_scores(left.points[rows], right.points[p], left.norm[rows].max() * right.most[nodes[use]].max())
        self.compared += score.size
        ids = self.ids[p]
        with np.errstate(all="ignore"):
            at, place = np.nonzero(score >= self.worst[rows][:, None])
        other = (self.query_ids[rows][at] != ids[place]) & (done[at] != np.repeat(use, n)[place])
        at, place = at[other], place[other]
        if not len(at):
            return
        begin = np.flatnonzero(np.diff(at, prepend=-1))
        for i, j in zip(begin.tolist(), [*begin[1:].tolist(), len(at)], strict=True):
            row, hit = rows[at[i]], place[i:j]
            had = self.full[row]
            new, who = np.concatenate([self.scores[row][had], score[at[i], hit].astype(np.int64)]), np.concatenate([self.found[row][had], ids[hit]])
            best = np.lexsort((who, ~new))[:k]  # ~new falls as new grows, without overflow
            n = len(best)
            self.scores[row, :n], self.found[row, :n], self.full[row, :n] = new[best], who[best], True
            if n == k:
                self.worst[row] = max(self.worst[row], float(self.scores[row, -1]))


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """id and v: floor(scale * component) as doubles (every double from 2**53 on is a whole number)."""
    scaled = F.transform(F.col(vector_col), lambda x: x.cast("double") * F.lit(scale))
    sound = F.col(vector_col).isNotNull() & F.forall(scaled, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    floor = F.transform(scaled, lambda x: F.when(F.abs(x) < F.lit(2.0**53), F.floor(x).cast("double")).otherwise(x))
    return df.where(sound & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), floor.alias("v"))


def dense(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy()
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to n rows, each the farthest from those before."""
    chosen = [0]
    far = norms(sample - sample[0])
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, norms(sample - sample[chosen[-1]]))
    return sample[chosen]


def nearest(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre each row is nearest to."""
    return np.stack([norms(v - c) for c in centres], 1).argmin(1)


TREES = "asks boolean, block long, n long, centre binary, radius double, norm double, most double, tree binary"


def trees(queries: DataFrame, points: DataFrame, block_rows: int) -> DataFrame:
    """One row by block: its cover tree and the figures that bound it."""
    n, width = points.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("w")).first()
    width = max(width, queries.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0])
    drawn = points.where(F.pmod(F.xxhash64("v"), F.lit(max(1, n // PIVOT_SAMPLE))) == 0).limit(2 * PIVOT_SAMPLE).select("v").toArrow()
    sample = dense(drawn["v"], width)
    centres = pivots(sample, min(PIVOTS, -(-n // block_rows))) if len(sample) else np.zeros((1, width))
    both = small_batches(queries).select("id", "v", F.xxhash64("v").alias("hash"), F.lit(True).alias("asks")).unionByName(points.select("id", "v", F.lit(0).cast("long").alias("hash"), F.lit(False).alias("asks")))

    def assign(batches):
        for batch in batches:
            cell = nearest(dense(batch.column(1), width), centres)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64())], [*batch.schema.names, "cell"])

    rows = stash(both.mapInArrow(lean(assign), "id long, v array<double>, hash long, asks boolean, cell long"), "topk-rows")
    sizes = rows.groupBy("asks", "cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks"))  # at most 2 * PIVOTS rows
    block = F.col("cell") * (1 << 40) + F.pmod(F.xxhash64("id", "v"), F.col("blocks"))
    dealt = rows.join(F.broadcast(sizes), ["asks", "cell"]).select("asks", block.alias("block"), "id", "hash", "v")

    def build(table: pa.Table) -> pa.Table:
        asks, ids = table["asks"][0].as_py(), table["id"].to_numpy()
        tree = CoverTree(dense(table["v"], width), QUERY_LEAF if asks else LEAF, ids)
        raw = tree.dump(ids=ids, hashes=table["hash"].to_numpy())
        one = [asks, table["block"][0].as_py(), len(ids), tree.points[0].tobytes(), float(tree.radius[0]), float(tree.norm[0]), float(tree.most[0]), raw]
        return pa.table({f.split()[0]: [x] for f, x in zip(TREES.split(", "), one, strict=True)})

    made = stash(dealt.groupBy("asks", "block").applyInArrow(build, TREES), "topk-trees")
    discard(rows)
    return made


def block_pairs(made: DataFrame) -> DataFrame:
    """q, p, bound, first: all pairs of a query block and a candidate block by their figures; first: the most promising one of q."""
    figures = made.drop("tree", "n")
    n = {r["asks"]: r["n"] for r in made.groupBy("asks").agg(F.count(F.lit(1)).alias("n")).collect()}
    down, across = (-(-n.get(side, 0) // BLOCKS_AT_ONCE) or 1 for side in (True, False))
    of = lambda m: F.pmod(F.xxhash64("block"), F.lit(m))
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    left = figures.where("asks").select("*", of(down).alias("i"), every(across).alias("j"))
    right = figures.where("not asks").select("*", every(down).alias("i"), of(across).alias("j"))

    def compare(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy(zero_copy_only=False).astype(bool)
        c = np.stack([np.frombuffer(x) for x in table["centre"].to_pylist()])
        block, radius, norm, most = (table[x].to_numpy() for x in ("block", "radius", "norm", "most"))
        parts = []
        for i in np.flatnonzero(asks).tolist():
            with np.errstate(all="ignore"):
                product = c[~asks] @ c[i]
                bound = upper_bound(product, radius[i], norm[i], radius[~asks], norm[~asks], most[i] * most[~asks])
            parts.append(pa.table({"q": np.full(len(bound), block[i]), "p": block[~asks], "bound": bound, "promise": np.nan_to_num(product)}))
        return pa.concat_tables(parts) if parts else pa.table({"q": pa.array([], pa.int64()), "p": pa.array([], pa.int64()), "bound": pa.array([], pa.float64()), "promise": pa.array([], pa.float64())})

    met = left.unionByName(right).groupBy("i", "j").applyInArrow(compare, "q long, p long, bound double, promise double")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("promise"), "p"))
    return stash(met.withColumn("first", place == 1).drop("promise"), "topk-pairs", few=True)


RESULTS = "query_id long, query_hash long, vec_id long, score long"


def top_k(
    queries: DataFrame,
    candidates: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 64.0,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score over floor(scale * component) vectors."""
    asked, points = whole_vectors(queries, id_col, vector_col, scale).distinct(), whole_vectors(candidates, id_col, vector_col, scale)
    made = trees(asked, points, block_rows)
    pairs = block_pairs(made)
    indexed = lambda side, name: made.where(F.col("asks") == side).select(F.col("block").alias(name), F.col("tree").alias(f"tree_{name}"))

    def search(batch: pa.RecordBatch, i: int, least: np.ndarray | None = None) -> tuple[DualTreeSearch, np.ndarray]:
        at = lambda name: batch.column(batch.schema.get_field_index(name))[i].as_py()
        (left, asks), (right, own) = CoverTree.load(at("tree_q")), CoverTree.load(at("tree_p"))
        found = DualTreeSearch(left, asks["ids"], right, own["ids"], k, least)
        found.run()
        return found, asks["hashes"]

    def results(found: DualTreeSearch, hashes: np.ndarray) -> list[np.ndarray]:
        row, place = np.nonzero(found.full)
        return [found.query_ids[row], hashes[row], found.found[row, place], found.scores[row, place]]

    def first_search(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                found, hashes = search(batch, i)
                flat = results(found, hashes)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([float(found.worst.min())]), pa.array([found.worst.tobytes()], pa.binary()), pa.array([found.compared]), *[pa.array([x.tolist()], pa.list_(pa.int64())) for x in flat]], ["q", "least", "worst", "compared", "query_id", "query_hash", "vec_id", "score"])

    first = pairs.where("first").join(indexed(True, "q"), "q").join(indexed(False, "p"), "p").select("q", "tree_q", "tree_p")
    first = stash(first.mapInArrow(lean(first_search), "q long, least double, worst binary, compared long, query_id array<long>, query_hash array<long>, vec_id array<long>, score array<long>"), "topk-first")

    def next_search(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                worst = np.frombuffer(batch.column(batch.schema.get_field_index("worst"))[i].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in results(*search(batch, i, worst))], [x.split()[0] for x in RESULTS.split(", ")])

    left = pairs.where("not first").join(first.select("q", "least", "worst"), "q").where("bound >= least").drop("least", "bound", "first")
    left = left.join(indexed(True, "q"), "q").join(indexed(False, "p"), "p").select("worst", "tree_q", "tree_p")
    names = [x.split()[0] for x in RESULTS.split(", ")]
    started = first.select(F.explode(F.arrays_zip(*names)).alias("r")).select("r.*")
    best = Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id")
    merged = left.mapInArrow(lean(next_search), RESULTS).unionByName(started).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return merged.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT q.vec_id AS query_id, p.vec_id, CAST(list_dot_product(q.v, p.v) AS BIGINT) AS score
  FROM v q JOIN v p ON q.vec_id % 20 = 0 AND p.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
