"""Most similar vectors for every vector (problem 3): collision counting over sorted single-projection arrays."""

from __future__ import annotations

from collections.abc import Iterator
from math import erfc, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import HOT_SHARE, keyed_join, materialize

BRACKETS = str.maketrans("[](){}<>,;|", " " * 11)


def _decode(blob: bytes | None, text: str | None, dim: int) -> np.ndarray | None:
    """The blob's vector if it is valid, else the text's, else None; valid: ``dim`` finite values, not all zero."""
    if blob is not None and len(blob) == 4 * dim:
        v = np.frombuffer(blob, "<f4").astype(np.float64)
        if np.isfinite(v).all() and v.any():
            return v
    if text is not None:
        parts = text.translate(BRACKETS).split()
        if len(parts) == dim:
            try:
                v = np.array([float(x) for x in parts])
            except ValueError:
                return None
            if np.isfinite(v).all() and v.any():
                return v
    return None


def unit_vectors(facts: DataFrame, dim: int = 32) -> DataFrame:
    """(doc_id, vec, key): the unit vector of each valid fact that has one, as float32 bytes.

    Of the rows of an id the highest version is valid (then the latest updated_at, then the lowest doc_id); rows with
    null id or doc_id have no identity and are left out. The blob counts if it has ``dim`` finite little-endian float32
    values that are not all zero, else the text (numbers in any brackets, parted by commas, semicolons, bars or
    blanks) on the same terms. key is equal for vectors of equal direction (to six decimals). An empty input
    gives no rows.
    """
    latest = Window.partitionBy("id").orderBy(F.desc("version"), F.desc("updated_at"), "doc_id")
    rows = (
        facts.where(F.col("id").isNotNull() & F.col("doc_id").isNotNull())
        .select("id", "version", "updated_at", "doc_id", "embedding_blob", F.col("embedding").alias("txt"))
        .withColumn("rank", F.row_number().over(latest))
        .where("rank = 1")
        .select(F.col("doc_id").cast("long").alias("doc_id"), "embedding_blob", "txt")
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, u = _decode_all(b.column(1), b.column(2), dim)
            if not len(kept):
                continue
            u /= np.abs(u).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
            u /= np.linalg.norm(u, axis=1, keepdims=True)
            keys = (np.round(u, 6) + 0.0).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(kept)), _binary(u.astype("<f4")), _binary(keys)], names=["doc_id", "vec", "key"]
            )

    return rows.mapInArrow(decode, "doc_id long, vec binary, key binary").withColumn("key", F.md5("key"))


def _decode_all(blobs: pa.Array, texts: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, vectors) of all rows that _decode() has a vector for; blobs of the right size are read as one buffer."""
    sized = pc.fill_null(pc.equal(pc.binary_length(blobs), 4 * dim), False)
    rows = np.flatnonzero(sized.to_numpy(zero_copy_only=False))
    whole = pa.concat_arrays([blobs.filter(sized)])
    v = np.zeros((0, dim))
    if len(rows):
        first = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset]
        v = np.frombuffer(whole.buffers()[2], "<f4", count=len(rows) * dim, offset=int(first)).reshape(-1, dim).astype(np.float64)
    good = np.isfinite(v).all(axis=1) & v.any(axis=1)
    rows, v = rows[good], v[good]
    left = np.setdiff1d(np.arange(len(blobs)), rows)
    read = [(i, x) for i, t in zip(left, texts.take(pa.array(left)).to_pylist()) if t is not None and (x := _decode(None, t, dim)) is not None]
    if read:
        rows, v = np.concatenate([rows, [i for i, _ in read]]), np.concatenate([v, [x for _, x in read]])
    return rows, v


def _binary(v: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values of one buffer."""
    v = np.ascontiguousarray(v)
    offsets = np.arange(len(v) + 1, dtype=np.int32) * (v.shape[1] * v.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(offsets), pa.py_buffer(v)])


# ln of the upper tail of the normal distribution, tabulated.
_DEVIATIONS = np.linspace(0, 8, 4001)
_LN_TAIL = np.log([0.5 * erfc(x / sqrt(2)) for x in _DEVIATIONS])


def axes_of(sample: np.ndarray, trees: int, dim: int, seed: int, levels: int = 64) -> np.ndarray:
    """(trees, levels, dim): unit axes to split along, those of a tree orthogonal as long as there are dimensions left.

    The first tree's are the sample's principal axes, by spread: the wider the projections lie apart, the fewer near
    vectors a split parts. The others' are random.
    """
    rng = np.random.default_rng(seed)
    out = np.zeros((trees, levels, dim))
    for t in range(trees):
        for at in range(0, levels, dim):
            basis = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
            if t == at == 0 and len(sample) > dim:
                basis = np.linalg.eigh(np.cov(sample.T))[1].T[::-1]
            out[t, at : at + dim] = basis[: levels - at]
    return out


def fit_splits(sample: np.ndarray, axes: np.ndarray, level: int, depth: int) -> np.ndarray:
    """The splits of the ``depth`` levels below a node at ``level``, as a heap: each node at the median of its sample rows'
    projections on the level's axis, NaN (no split) where fewer than two rows are left."""
    heap = np.full(2**depth - 1, np.nan)
    node = np.zeros(len(sample), dtype=np.int64)
    for d in range(depth):
        h = sample @ axes[level + d]
        order = np.lexsort((h, node))
        first = 2**d - 1
        bounds = np.searchsorted(node[order], np.arange(first, 2 * first + 2))
        for k in range(2**d):
            part = h[order[bounds[k] : bounds[k + 1]]]
            if len(part) > 1:
                heap[first + k] = part[len(part) // 2]
        node = 2 * node + 1 + (h >= np.nan_to_num(heap[node]))
    return heap


def descend(u: np.ndarray, axes: np.ndarray, node: np.ndarray, heaps: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The node that each vector comes to from ``node`` by the splits of row ``which`` of ``heaps`` (-1: none)."""
    h = u @ axes.T
    node, at, live = node.copy(), np.zeros(len(u), dtype=np.int64), np.flatnonzero(which >= 0)
    while live.size:
        split = heaps[which[live], at[live]]
        live, split = live[~np.isnan(split)], split[~np.isnan(split)]
        right = h[live, _level(node[live])] >= split
        node[live] = 2 * node[live] + right
        at[live] = 2 * at[live] + 1 + right
        live = live[at[live] < heaps.shape[1]]
    return node


def spread_out(
    u: np.ndarray, axes: np.ndarray, need: np.ndarray, node: np.ndarray, home: np.ndarray, chance: np.ndarray, heaps: np.ndarray, which: np.ndarray, least: np.ndarray | float
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, node, whether it is the home, ln chance): the nodes below ``node`` in which a vector's window may hold its neighbours.

    A neighbour at distance ``need`` lies beyond a split of distance g with the chance of a normal deviate above
    g * sqrt(dim) / need; as the axes are orthogonal these chances multiply, and nodes are followed while the product is
    at least ``least``. So a query-centred window is wide where it crosses one split and narrow where it crosses many.
    """
    h = u @ axes.T
    scale = sqrt(u.shape[1]) / np.maximum(need, 1e-6)
    floor = np.broadcast_to(np.log(least), len(u))
    row, at = np.arange(len(u)), np.zeros(len(u), dtype=np.int64)
    node, home, chance, which = node.copy(), home.copy(), chance.copy(), which.copy()
    done: list[tuple] = []
    while row.size:
        split = np.where(which >= 0, heaps[which, np.minimum(at, heaps.shape[1] - 1)], np.nan) if heaps.shape[0] else np.full(len(row), np.nan)
        stop = np.isnan(split) | (at >= heaps.shape[1])
        done.append((row[stop], node[stop], home[stop], chance[stop]))
        row, at, node, home, chance, which, split = (x[~stop] for x in (row, at, node, home, chance, which, split))
        gap = h[row, _level(node)] - split
        right = gap >= 0
        across = chance + np.interp(np.abs(gap) * scale[row], _DEVIATIONS, _LN_TAIL)
        both = across >= floor[row]
        node, at = (np.concatenate([2 * x + c + right, 2 * x[both] + c + ~right[both]]) for x, c in ((node, 0), (at, 1)))
        row, which = (np.concatenate([x, x[both]]) for x in (row, which))
        home, chance = np.concatenate([home, np.zeros(int(both.sum()), dtype=bool)]), np.concatenate([chance, across[both]])
    return tuple(np.concatenate(x) for x in zip(*done)) if done else (row, node, home, chance)  # type: ignore[return-value]


def _level(node: np.ndarray) -> np.ndarray:
    """The level of nodes numbered as a heap from 1."""
    return np.frexp(node.astype(np.float64))[1] - 1


def collisions(
    data: np.ndarray, queries: np.ndarray, k: int, radius: float, seed: int, m: int = 16, share: float = 0.5
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, data row, cosine) of verified near vectors, up to ``k`` of each query and all within ``radius``.

    Each of ``m`` random projections keeps the data's values as a sorted array. A query's window around its own value
    is found in it by bisection and widened by virtual rehashing, from half the radius to the whole; a data row
    that lies in the windows of at least ``share`` of the projections is verified by its true cosine. Data and queries
    are taken in the order of the first projection, so that a block of queries only touches the rows in its windows there.
    Queries that have k rows within a radius are done at that radius.
    """
    rng = np.random.default_rng(seed)
    axes = np.linalg.qr(rng.standard_normal((max(m, data.shape[1]), data.shape[1])))[0][:m].astype(np.float32)
    axes /= np.linalg.norm(axes, axis=1, keepdims=True)
    by_first = np.argsort(data @ axes[0], kind="stable")
    data = data[by_first]
    hd, hq = data @ axes.T, queries @ axes.T
    rank_type = np.uint16 if len(data) < 2**16 - 1 else np.uint32
    ranks, ordered = [], []
    for j in range(m):
        order = np.argsort(hd[:, j], kind="stable")
        rank = np.empty(len(data), dtype=rank_type)
        rank[order] = np.arange(len(data), dtype=rank_type)
        ranks.append(rank)
        ordered.append(hd[order, j])
    need = int(np.ceil(share * m))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    live = np.argsort(hq[:, 0], kind="stable")
    for r in (radius / 2, radius):
        half = 1.3 * r / np.sqrt(data.shape[1])
        rest = []
        step = max(1, min(256, 4_000_000 // max(1, len(data))))
        for start in range(0, len(live), step):
            q = live[start : start + step]
            lo = np.stack([np.searchsorted(ordered[j], hq[q, j] - half, "left") for j in range(m)])
            hi = np.stack([np.searchsorted(ordered[j], hq[q, j] + half, "right") for j in range(m)])
            a, b = int(lo[0].min()), int(hi[0].max())
            count = np.zeros((len(q), b - a), dtype=np.uint8)
            for j in range(m):
                low, width = lo[j].astype(rank_type), (hi[j] - lo[j]).astype(rank_type)
                count += (ranks[j][None, a:b] - low[:, None]) < width[:, None]
            row, col = np.nonzero(count >= need)
            col += a
            cos = np.einsum("ij,ij->i", queries[q[row]], data[col], dtype=np.float64) if len(row) else np.zeros(0)
            near = cos >= 1 - r * r / 2
            row, col, cos = row[near], col[near], cos[near]
            done = np.bincount(row, minlength=len(q)) > k  # the query itself may be among them
            last = done[row] | (r == radius)
            found.append((q[row[last]], by_first[col[last]], cos[last]))
            rest.append(q[~done])
        live = np.concatenate(rest) if rest else live[:0]
    return tuple(np.concatenate(x) for x in zip(*found))  # type: ignore[return-value]


def _matrix(vecs: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), "<f4").reshape(-1, dim)


ROUTED = "tree int, node long, home boolean, chance double, a long, vec binary, need double"


def _depth(n: int, leaf_rows: int, most: int) -> int:
    """The levels that part ``n`` vectors into leaves of ``leaf_rows``, at least 1 and at most ``most``."""
    return int(min(most, max(1, np.ceil(np.log2(max(1, n) / leaf_rows)))))


class Leaves:
    """Trees of median splits over the vectors of a table, fitted stage by stage so that every leaf is small.

    A stage splits all nodes with over twice ``leaf_rows`` vectors by up to eight levels, each by the medians of a sample
    of at most about ``sample_rows`` of its own vectors: the root's on the driver, the others' on the executors. So the
    last levels are fitted as well as the first, whatever the number of vectors. A stage's splits are given to all tasks if they are of
    at most 4096 nodes (8 MB); more of them meet the vectors in a join, four levels a stage.
    """

    def __init__(self, points: DataFrame, n: int, leaf_rows: int, trees: int, dim: int, sample_rows: int, seed: int):
        self.dim, self.seed, self.sample_rows, self.leaf_rows = dim, seed, sample_rows, leaf_rows
        sample = _matrix(points.where(self._chosen(F.lit(n), 0)).select("vec").toPandas()["vec"], dim).astype(np.float64)
        self.axes = axes_of(sample, trees, dim, seed)
        depth = _depth(n, leaf_rows, 8)
        heaps = np.stack([fit_splits(sample, self.axes[t], 0, depth) for t in range(trees)])
        roots = {(t, 1): t for t in range(trees)}
        self.stages: list = [(roots, heaps)]
        seeds = F.explode(F.array(*[F.lit(t) for t in range(trees)]))
        none = F.lit(None).cast("double")
        self.start = lambda p: p.select(seeds.alias("tree"), F.lit(1).cast("long").alias("node"), F.lit(True).alias("home"), F.lit(0.0).alias("chance"), "a", "vec", (F.col("need") if "need" in p.columns else none).alias("need"))
        self.homes = self._stage(self.start(points), 0, None)
        while len(self.stages) < 12:
            self.homes = materialize(self.homes, "leaves")
            counts = self.homes.groupBy("tree", "node").agg(F.count("*").alias("n")).where(F.col("n") > 2 * leaf_rows)
            counts = materialize(counts.where(F.col("node") < 2**55), "counts")
            nodes = counts.limit(HOT_SHARE + 1).count()
            if not nodes:
                break
            self._fit(counts, nodes <= HOT_SHARE)
            self.homes = self._stage(self.homes, len(self.stages) - 1, None)

    def _chosen(self, n: Column, stage: int) -> Column:
        share = F.least(F.lit(1.0), F.lit(float(self.sample_rows)) / F.greatest(n, F.lit(1)))
        return F.pmod(F.xxhash64("a", F.lit(stage)), F.lit(1 << 20)) < share * (1 << 20)

    def _fit(self, counts: DataFrame, small: bool) -> None:
        dim, axes, leaf_rows, most = self.dim, self.axes, self.leaf_rows, 8 if small else 4
        rows = self.homes.join(F.broadcast(counts) if small else counts, ["tree", "node"])
        rows = rows.where(self._chosen(F.col("n"), len(self.stages))).select("tree", "node", "n", "vec")

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            tree, node, n = (int(pdf[c].iloc[0]) for c in ("tree", "node", "n"))
            heap = np.full(2**most - 1, np.nan)
            own = fit_splits(_matrix(pdf["vec"], dim).astype(np.float64), axes[tree], node.bit_length() - 1, _depth(n, leaf_rows, most))
            heap[: len(own)] = own
            return pd.DataFrame({"tree": [tree], "node": [node], "heap": [heap.tolist()]})

        fitted = materialize(rows.groupBy("tree", "node").applyInPandas(fit, "tree int, node long, heap array<double>"), "splits")
        if small:
            rows = fitted.collect()
            self.stages.append(({(r["tree"], r["node"]): i for i, r in enumerate(rows)}, np.array([r["heap"] for r in rows], dtype=np.float64)))
        else:
            self.stages.append(fitted)

    def _stage(self, rows: DataFrame, stage: int, least: tuple[float, float] | None, need_most: float = 0.0) -> DataFrame:
        """``rows`` brought down by the splits of a stage: to their own nodes, or with ``least`` to all in their windows."""
        fitted, dim, axes = self.stages[stage], self.dim, self.axes
        joined = isinstance(fitted, DataFrame)
        if joined:
            rows = rows.join(fitted, ["tree", "node"], "left")
        places, heaps = ({}, None) if joined else fitted

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in batches:
                for at in range(0, len(whole), 4096):
                    pdf = whole.iloc[at : at + 4096]
                    for tree, part in pdf.groupby("tree"):
                        u, node = _matrix(part["vec"], dim).astype(np.float64), part["node"].to_numpy()
                        if joined:
                            has = part["heap"].notna().to_numpy()
                            own = np.stack(part["heap"][has]).astype(np.float64) if has.any() else np.zeros((0, 1))
                            which = np.where(has, np.cumsum(has) - 1, -1)
                        else:
                            own, which = heaps, np.array([places.get((tree, x), -1) for x in node.tolist()])
                        if least is None:
                            yield part.drop(columns="heap", errors="ignore").assign(node=descend(u, axes[tree], node, own, which))
                        else:
                            need = part["need"].to_numpy()
                            floor = np.where(need < need_most, least[1], least[0])
                            row, node, home, chance = spread_out(
                                u, axes[tree], need, node, part["home"].to_numpy(), part["chance"].to_numpy(), own, which, floor
                            )
                            order = np.argsort(row, kind="stable")  # the rows of a vector stay together
                            row, node, home, chance = row[order], node[order], home[order], chance[order]
                            yield part.drop(columns="heap", errors="ignore").iloc[row].assign(node=node, home=home, chance=chance)

        return rows.mapInPandas(run, ROUTED)

    def asked(self, points: DataFrame, least: float, crowded: float, most: float) -> DataFrame:
        """The leaves that the window of each point (a, vec, need) meets with a chance of ``least``, or of ``crowded`` where its need is
        below ``most``, its own (home) among them."""
        rows = self.start(points)
        for stage in range(len(self.stages)):
            rows = self._stage(rows, stage, (least, crowded), most)
        return rows

    def bundled(self, asked: DataFrame) -> DataFrame:
        """Rows of asked() put together by bundles of leaves: (tree, bundle, own, nodes, a, vec), so that a vector is shipped once for the
        leaves of a bundle, not once for each. own is the vector's own leaf, if that is in the bundle, else -1.

        A bundle is a subtree of up to 16 leaves, of fewer where there are few leaves for each core.
        """
        spark = asked.sparkSession
        leaves = self.homes.select("tree", "node").distinct().count()
        bits = int(np.clip(np.log2(max(1.0, leaves / (4 * spark.sparkContext.defaultParallelism))), 0, 4))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                node, home = pdf["node"].to_numpy(), pdf["home"].to_numpy()
                level = _level(node)
                key = pd.DataFrame({"tree": pdf["tree"].to_numpy(), "a": pdf["a"].to_numpy(), "bundle": node >> np.minimum(bits, level)})
                group = key.groupby(["tree", "a", "bundle"], sort=False).ngroup().to_numpy()
                order = np.argsort(group, kind="stable")
                first = np.flatnonzero(np.append(True, np.diff(group[order]) > 0)) if len(order) else order
                own = np.full(len(first), -1)
                own[group[home]] = node[home]
                away = np.split(np.where(home, -1, node)[order], first[1:]) if len(order) else []
                at = order[first]
                yield pd.DataFrame(
                    {
                        "tree": key["tree"].to_numpy()[at],
                        "bundle": key["bundle"].to_numpy()[at],
                        "own": own,
                        "nodes": [x[x >= 0] for x in away],
                        "a": key["a"].to_numpy()[at],
                        "vec": pdf["vec"].to_numpy()[at],
                    }
                )

        return asked.mapInPandas(run, "tree int, bundle long, own long, nodes array<long>, a long, vec binary")


def similar_classes(
    points: DataFrame,
    k: int = 5,
    min_similarity: float = 0.95,
    dim: int = 32,
    sample_rows: int = 65_536,
    leaf_rows: int = 1024,
    trees: int = 1,
    least: float = 0.03,
    crowded: float = 0.01,
    seed: int = 7,
) -> DataFrame:
    """(a, b, cosine): of each point the up to ``k`` nearest other points with cosine >= ``min_similarity``, ties by the lowest b.

    Cosines are rounded to six decimals, so that copies of any length are equal whatever their rounding.

    ``points`` has a (unique bigint) and vec (unit float32 bytes) and should be materialised. In the first round each query
    meets its own leaf; in the second its window has the width of what it still needs - the distance of its k-th neighbour
    so far, or the whole radius - and it meets every other leaf that holds a neighbour with a chance of ``least``, or of
    ``crowded`` where its own leaf held k near ones, so at most 1 / ``crowded`` leaves. So in a crowded place windows are small, and elsewhere leaves are. Within a leaf
    collisions() counts and verifies; what either of two vectors finds counts for both. The result is approximate; recall
    is measured in the tests, and more ``trees`` raise it.
    """
    n = points.count()
    leaves = Leaves(points, n, leaf_rows, trees, dim, sample_rows, seed)
    radius = float(np.sqrt(2 - 2 * min_similarity))

    none = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "cosine": pd.Series(dtype="float64")})

    def near(data: np.ndarray, b: np.ndarray, queries: np.ndarray, a: np.ndarray) -> pd.DataFrame:
        q, d, cos = collisions(data, queries, k, radius, seed + 1)
        out = pd.DataFrame({"a": a[q], "b": b[d], "cosine": np.round(cos, 6)})
        out = out[out["a"] != out["b"]]
        return out.sort_values(["a", "cosine", "b"], ascending=[True, False, True]).groupby("a").head(k) if len(out) else none

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        u, a = _matrix(pdf["vec"], dim), pdf["a"].to_numpy()
        return near(u, a, u, a)

    def search_bundle(pdf: pd.DataFrame) -> pd.DataFrame:
        u, a, own = _matrix(pdf["vec"], dim), pdf["a"].to_numpy(), pdf["own"].to_numpy()
        size = pdf["nodes"].map(len).to_numpy()
        row, node = np.repeat(np.arange(len(pdf)), size), np.concatenate(list(pdf["nodes"])) if size.sum() else np.zeros(0, dtype=np.int64)
        found = [none]
        for leaf in np.unique(own[own >= 0]):
            data, asked = np.flatnonzero(own == leaf), row[node == leaf]
            if len(asked):
                found.append(near(u[data], a[data], u[asked], a[asked]))
        return pd.concat(found)

    pairs = "a long, b long, cosine double"
    rows = leaves.homes.select("tree", "node", "a", "vec")
    first = materialize(rows.groupBy("tree", "node").applyInPandas(search, pairs), "near")
    best = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    kth = first.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k)
    kth = materialize(kth.select("a", F.col("cosine").alias("kth")), "kth")  # of known size, so that a small one is broadcast
    need = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.coalesce(F.col("kth"), F.lit(min_similarity)))).alias("need")
    asked = points.select("a", "vec").join(kth, "a", "left").select("a", "vec", need)
    second = leaves.bundled(leaves.asked(asked, least, crowded, radius - 1e-9))
    second = second.groupBy("tree", "bundle").applyInPandas(search_bundle, pairs)
    both = materialize(first.unionByName(second), "near")
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))
    both = both.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    return both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")


def similar_facts(facts: DataFrame, k: int = 5, min_similarity: float = 0.95, dim: int = 32, **options) -> DataFrame:
    """(doc_id, neighbour, cosine): of each valid fact the up to ``k`` most similar others from ``min_similarity`` on.

    Vectors and validity are those of unit_vectors(). Facts of equal direction are one class: classes are searched by
    similar_classes(), then each member gets the members of its own class (cosine 1) and of the near classes, by
    cosine and then the lowest doc_id, of which a class need only keep its k + 1 lowest. So copies cost no pairs,
    whatever their share. An empty input gives no rows.
    """
    units = materialize(unit_vectors(facts, dim), "units")
    low = Window.partitionBy("key").orderBy("doc_id")
    lowest = units.withColumn("rank", F.row_number().over(low)).where(F.col("rank") <= k + 1)
    sizes = units.groupBy("key").agg(F.count("*").alias("size"), F.min("doc_id").alias("a"))
    firsts = lowest.groupBy("key").agg(
        F.sort_array(F.collect_list("doc_id")).alias("ids"), F.max(F.when(F.col("rank") == 1, F.col("vec"))).alias("vec")
    )
    classes = materialize(firsts.join(sizes, "key"), "classes")
    near = similar_classes(classes.select("a", "vec"), k, min_similarity, dim, **options)
    others = (
        near.join(classes.select(F.col("a").alias("b"), F.col("ids").alias("of_b")), "b")
        .groupBy("a")
        .agg(F.collect_list(F.struct((-F.col("cosine")).alias("order"), F.col("of_b"))).alias("near"))
    )
    listed = classes.join(others, "a", "left").where((F.col("size") > 1) | F.col("near").isNotNull())
    pair = lambda order, x: F.struct(order.alias("order"), x.alias("id"))
    beside = F.flatten(F.transform("near", lambda c: F.transform(c["of_b"], lambda x: pair(c["order"], x))))
    none = F.array().cast("array<struct<order:double,id:bigint>>")
    listed = listed.select(
        "key",
        "size",
        F.array_sort(F.concat(F.transform("ids", lambda x: pair(F.lit(-1.0), x)), F.coalesce(beside, none))).alias("cands"),
    )
    listed = materialize(listed, "cands")
    total = units.count()
    members = keyed_join(units.select("key", "doc_id"), listed, "key", "size", total)
    top = F.slice(F.filter("cands", lambda c: c["id"] != F.col("doc_id")), 1, k)
    return members.select("doc_id", F.explode(top).alias("c")).select(
        "doc_id", F.col("c.id").alias("neighbour"), (-F.col("c.order")).alias("cosine")
    )


def similar_pairs(facts: DataFrame, k: int = 5, min_similarity: float = 0.95, dim: int = 32, **options) -> DataFrame:
    """(doc_id_a, doc_id_b), smaller first: pairs of which one is among the ``k`` most similar of the other."""
    found = similar_facts(facts, k, min_similarity, dim, **options)
    return found.select(
        F.least("doc_id", "neighbour").alias("doc_id_a"), F.greatest("doc_id", "neighbour").alias("doc_id_b")
    ).distinct()


def recall(facts: DataFrame, k: int = 5, min_similarity: float = 0.95, dim: int = 32, every: int = 100, block: int = 4096, **options) -> DataFrame:
    """(asked, near, found, recall): how many of the exact neighbours of a query set similar_facts() finds.

    The query set is every fact whose doc_id is divisible by ``every``; in blocks of ``block`` vectors (0.5 MB each, by doc_id) it is
    held against all facts by brute force. Neighbours are those of similar_facts(): the ``k`` of greatest cosine, from
    ``min_similarity`` on, ties by the lowest doc_id. recall is 1 where there is nothing to find.
    """
    units = materialize(unit_vectors(facts, dim), "units")
    spark = units.sparkSession
    queries = materialize(units.where(F.col("doc_id") % every == 0).select("doc_id", "vec"), "queries")
    asked, parts, last = queries.count(), [], None
    while True:
        rest = queries if last is None else queries.where(F.col("doc_id") > last)
        rows = rest.orderBy("doc_id").limit(block).collect()
        if not rows:
            break
        last = rows[-1]["doc_id"]
        ids, q = np.array([r["doc_id"] for r in rows]), np.frombuffer(b"".join(r["vec"] for r in rows), "<f4").reshape(-1, dim)

        def scan(batches: Iterator[pd.DataFrame], ids: np.ndarray = ids, q: np.ndarray = q) -> Iterator[pd.DataFrame]:
            for whole in batches:
                for at in range(0, len(whole), 4096):
                    pdf = whole.iloc[at : at + 4096]
                    own, v = pdf["doc_id"].to_numpy(), _matrix(pdf["vec"], dim)
                    row, col = np.nonzero(q @ v.T >= min_similarity - 1e-4)
                    cos = np.round(np.einsum("ij,ij->i", q[row], v[col], dtype=np.float64), 6)
                    keep = (cos >= min_similarity) & (ids[row] != own[col])
                    yield pd.DataFrame({"doc_id": ids[row[keep]], "neighbour": own[col[keep]], "cosine": cos[keep]})

        parts.append(units.select("doc_id", "vec").mapInPandas(scan, "doc_id long, neighbour long, cosine double"))
    empty = spark.createDataFrame([], "doc_id long, neighbour long, cosine double")
    exact = parts[0] if parts else empty
    for p in parts[1:]:
        exact = exact.unionByName(p)
    best = Window.partitionBy("doc_id").orderBy(F.desc("cosine"), "neighbour")
    exact = exact.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("doc_id", "neighbour")
    got = similar_facts(facts, k, min_similarity, dim, **options).select("doc_id", "neighbour", F.lit(1).alias("hit"))
    both = exact.join(got, ["doc_id", "neighbour"], "left").agg(F.count("*").alias("near"), F.count("hit").alias("found"))
    return both.select(F.lit(asked).cast("long").alias("asked"), "near", "found", F.when(F.col("near") == 0, 1.0).otherwise(F.col("found") / F.col("near")).alias("recall"))
