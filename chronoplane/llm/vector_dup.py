"""Embedding near-duplicates: spherical k-means cells with an exact border bound, and blocked cosine products.

Equal vectors of a label are collapsed first, so copies cost nothing. Centroids are fitted on a bounded sample; every
vector is put into the cell of its nearest centroid. Cells of a label are dealt into blocks of bounded size, a block
meets every other of its label, and within two blocks cells meet: for u in a's cell and v in b's,
(u - v).(a - b) <= |u - v| * |a - b|, so with x = (u.a - u.b) / |a - b| and y = (v.b - v.a) / |a - b| only vectors
with x + y <= the distance of two unit vectors at the threshold can be linked. Both sides are sorted by these and each
stretch of u meets the beginning of v. No link can be missed.

A block is written once to the shared folder, and tasks that compare two blocks read both there: vectors are shuffled
once, however many others they may be near to. Products are taken in single precision; pairs that its error could
decide are taken again in double precision. Before that, the product of the first components and of the lengths of the
rest, which is no smaller than the cosine, leaves out nearly all pairs of spread vectors. A task returns, for each vector that has links, their number and the
vector that stands for those they reach there: no pairs leave it.
"""

from __future__ import annotations

import io
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, connected_components, materialize
from .warc import _system

THRESHOLD = 0.93
SAMPLE = 40_000  # vectors the centroids are fitted on, at most about this many
CELLS = 1_024
PER_CELL = 1_024
ITERATIONS = 12
BLOCK = 65_536  # vectors of a block
NUMBERS = 1 << 22  # components of the vectors of a block
TILE = (256, 2_048)  # vectors multiplied at a time
DENSE = 64  # where more than one of so many pairs may be linked, whole vectors are multiplied
TASKS = 2_000  # that compare two blocks

Centroids = dict[int, np.ndarray]


def units(x: np.ndarray) -> np.ndarray:
    """The unit vectors, in double precision, of the rows of a matrix."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True) + 0.0
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rows_of(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: the numbers of the vectors that have it, and these as the rows of a matrix; null is not a number."""
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == dim)
        yield at, values[starts[at][:, None] + np.arange(dim)].astype(np.float64)


def packed_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, shared: Callable[[], Centroids] | None = None, raws: bool = True) -> DataFrame:
    """(id, label, dim, home, print binary, raw binary): print and raw null for vectors that link with nothing.

    raw holds doubles, or floats where those hold the same values; home is the nearest centroid.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared() if shared else {}
        for batch in batches:
            n, labels = batch.num_rows, batch.column(2).to_pylist()
            dims, home = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int32)
            prints, packed = [None] * n, [None] * n
            labelled = ~batch.column(2).is_null().to_numpy(zero_copy_only=False)
            for at, x in rows_of(batch.column(1)):
                good = np.isfinite(x).all(axis=1) & x.any(axis=1) & labelled[at]
                at, x = at[good], x[good]
                if not len(at):
                    continue
                dim = x.shape[1]
                u = units(x)
                dims[at] = dim
                if dim in centroids:  # others are too rare for the sample: one cell
                    home[at] = (u @ centroids[dim].T).argmax(axis=1)
                data = u.tobytes()
                for k, i in enumerate(at.tolist()):
                    prints[i] = xxhash.xxh3_128_digest(data[8 * dim * k : 8 * dim * (k + 1)] + labels[i].encode())
                if raws:
                    with np.errstate(over="ignore"):
                        short = x.astype(np.float32)
                    exact = (short == x).all(axis=1).tolist()
                    short, data = short.tobytes(), x.tobytes()
                    for k, i in enumerate(at.tolist()):
                        packed[i] = short[4 * dim * k : 4 * dim * (k + 1)] if exact[k] else data[8 * dim * k : 8 * dim * (k + 1)]
            columns = [batch.column(0), batch.column(2), pa.array(dims), pa.array(home), pa.array(prints, pa.binary())]
            names = ["id", "label", "dim", "home", "print"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(packed, pa.binary())] if raws else columns, names=[*names, "raw"] if raws else names)

    chosen = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    return chosen.mapInArrow(run, "id long, label string, dim int, home int, print binary" + (", raw binary" if raws else ""))


def matrix(raws: list[bytes], dim: int) -> np.ndarray:
    """Packed vectors as rows: floats if all are."""
    if all(len(r) == 4 * dim for r in raws):
        return np.frombuffer(b"".join(raws), dtype=np.float32).reshape(-1, dim)
    return np.stack([np.frombuffer(r, dtype=np.float32 if len(r) == 4 * dim else np.float64).astype(np.float64) for r in raws])


def spherical_k_means(x: np.ndarray, k: int, iterations: int = ITERATIONS, seed: int = 7) -> np.ndarray:
    """Unit centroids (k or fewer, n) of unit vectors; an empty cell is refilled with the worst placed vector."""
    random = np.random.default_rng(seed)
    centroids = x[random.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(iterations):
        near = x @ centroids.T
        cell = near.argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, x)
        empty = np.flatnonzero(np.bincount(cell, minlength=len(centroids)) == 0)
        if len(empty):
            worst = np.argsort(near.max(axis=1), kind="stable")[: len(empty)]
            sums[empty[: len(worst)]] = x[worst]
        norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centroids = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centroids)
    return centroids


def fitted_cells(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, n: int, cells: int, sample: int, per_cell: int) -> Centroids:
    """Centroids for each dimension that occurs in a sample of about ``sample`` of the n vectors, by a hash of their ids."""
    step = max(1, n // sample)
    chosen = vectors.filter(F.pmod(F.xxhash64(F.lit(9), F.col(id_col).cast("long")), F.lit(step)) == 0)
    rows = packed_vectors(chosen, id_col, vector_col, label_col).filter("print is not null").select("dim", "raw").limit(2 * sample).collect()
    by_dim: dict[int, dict[bytes, None]] = {}
    for r in rows:
        by_dim.setdefault(r["dim"], {})[bytes(r["raw"])] = None
    k = max(1, min(cells, n // per_cell))
    return {d: spherical_k_means(units(matrix(list(v), d)), k) for d, v in by_dim.items()}


class Block:
    """Vectors of a label, ordered by their cells."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, copies: np.ndarray, home: np.ndarray):
        order = np.argsort(home, kind="stable")
        self.x, self.ids, self.copies, self.home = x[order], ids[order], copies[order], home[order]
        u = units(self.x)
        self.short = u.astype(np.float32)
        front = max(1, 3 * u.shape[1] // 8 - 1)
        self.outline = np.concatenate([u[:, :front], np.sqrt((u[:, front:] ** 2).sum(axis=1, keepdims=True))], axis=1).astype(np.float32)
        at = np.flatnonzero(np.r_[True, self.home[1:] != self.home[:-1]])
        self.cells = [(int(self.home[s]), s, e) for s, e in zip(at.tolist(), [*at[1:].tolist(), len(ids)])]

    def save(self, name: str) -> None:
        held, (fs, path) = io.BytesIO(), _system(name)
        np.savez(held, x=self.x, ids=self.ids, copies=self.copies, home=self.home)
        part = f"{path}.{TaskContext.get().taskAttemptId()}"
        with fs.open_output_stream(part, compression=None) as out:
            out.write(held.getbuffer())
        fs.move(part, path)

    @staticmethod
    def load(name: str) -> Block:
        fs, path = _system(name)
        with fs.open_input_stream(path, compression=None) as data, np.load(io.BytesIO(data.read())) as held:
            return Block(held["x"], held["ids"], held["copies"], held["home"])


class Links:
    """Links between vectors of two blocks, or of one: how many each has, and what stands for those they reach."""

    def __init__(self, a: Block, b: Block, threshold: float):
        self.a, self.b, self.threshold = a, b, threshold
        self.shift = 0 if a is b else len(a.ids)  # b's vectors are nodes after a's
        self.copies = a.copies if a is b else np.r_[a.copies, b.copies]
        self.links, self.parent = np.zeros(len(self.copies), dtype=np.int64), np.arange(len(self.copies))
        self.margin = (a.x.shape[1] + 16) * 2.0**-22  # beyond the error of a product in single precision

    def roots(self, nodes: np.ndarray) -> np.ndarray:
        out = self.parent[nodes]
        while True:
            further = self.parent[out]
            if (further == out).all():
                break
            out = further
        self.parent[nodes] = out
        return out

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        for p, r in np.unique(np.stack([x, y], axis=1)[x != y], axis=0).tolist():
            p, r = self.root(p), self.root(r)
            self.parent[max(p, r)] = min(p, r)

    def multiply(self, left: np.ndarray, right: np.ndarray) -> None:
        """Vectors of a (numbers) with those of b; a vector does not meet itself, nor two of one list twice."""
        same, (height, width) = left is right, TILE
        low, high = self.threshold - self.margin, self.threshold + self.margin
        for r in range(0, len(right), width):
            v = right[r : r + width]
            y = self.b.outline[v]
            for s in range(0, min(len(left), r + width) if same else len(left), height):
                u = left[s : s + height]
                bound = self.a.outline[u] @ y.T
                hits = np.flatnonzero(bound.ravel() >= low)
                if len(hits) * DENSE <= bound.size:
                    if len(hits):
                        i, j = np.divmod(hits, len(v))
                        self.pairs(u[i], v[j], same)
                    continue
                cosines = self.a.short[u] @ self.b.short[v].T
                near = cosines >= low
                if same:
                    near &= u[:, None] < v[None, :]
                i, j = np.nonzero(near & (cosines <= high))
                near[i, j] = self.decided(u[i], v[j])
                self.add(u, v, near)

    def decided(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether pairs (x of a, y of b) are linked, by one fixed order of summation."""
        parts = [slice(k, k + 4_096) for k in range(0, len(x), 4_096)]
        return np.concatenate([np.zeros(0, dtype=bool), *((units(self.a.x[x[k]]) * units(self.b.x[y[k]])).sum(axis=1) >= self.threshold for k in parts)])

    def pairs(self, x: np.ndarray, y: np.ndarray, same: bool) -> None:
        cosines = np.einsum("ij,ij->i", self.a.short[x], self.b.short[y])
        near = cosines >= self.threshold - self.margin
        if same:
            near &= x < y
        if not near.any():
            return
        x, y, doubtful = x[near], y[near], cosines[near] <= self.threshold + self.margin
        linked = ~doubtful
        linked[doubtful] = self.decided(x[doubtful], y[doubtful])
        x, y = x[linked], y[linked] + self.shift
        np.add.at(self.links, x, self.copies[y])
        np.add.at(self.links, y, self.copies[x])
        self.join(self.roots(x), self.roots(y))

    def add(self, u: np.ndarray, v: np.ndarray, near: np.ndarray) -> None:
        rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        if not len(rows):
            return
        link = near[np.ix_(rows, columns)]
        x, y = u[rows], v[columns] + self.shift
        np.add.at(self.links, x, link @ self.copies[y])
        np.add.at(self.links, y, self.copies[x] @ link)
        before = [self.roots(x), self.roots(y)]
        low, most = [n.copy() for n in before], len(self.parent)
        while True:
            left = np.minimum(low[0], np.where(link, low[1][None, :], most).min(axis=1))
            right = np.minimum(low[1], np.where(link, left[:, None], most).min(axis=0))
            if (left == low[0]).all() and (right == low[1]).all():
                break
            low = [left, right]
        self.join(np.concatenate(before), np.concatenate(low))

    def found(self) -> pd.DataFrame:
        linked = np.flatnonzero(self.links)
        ids = self.a.ids if self.a is self.b else np.r_[self.a.ids, self.b.ids]
        return pd.DataFrame({"id": ids[linked], "links": self.links[linked], "root": ids[self.roots(linked)]})


def compare(a: Block, b: Block, centroids: np.ndarray | None, threshold: float, prune: int = 1_024) -> pd.DataFrame:
    """Links of the vectors of two blocks, or within one: (id, links, root)."""
    out = Links(a, b, threshold)
    cells = min(len(a.ids) / len(a.cells), len(b.ids) / len(b.cells))
    if centroids is None or cells < prune or len(a.cells) * len(b.cells) == 1:  # products of such small cells cost less than choosing
        every = np.arange(len(a.ids))
        out.multiply(every, every if a is b else np.arange(len(b.ids)))
        return out.found()
    far = math.sqrt(2 - 2 * threshold) + 1e-3
    names = [np.array([c for c, _, _ in side.cells]) for side in (a, b)]
    to_b, to_a = a.short @ centroids[names[1]].T.astype(np.float32), b.short @ centroids[names[0]].T.astype(np.float32)
    own = [np.concatenate([side.short[s:e] @ centroids[c].astype(np.float32) for c, s, e in side.cells]) for side in (a, b)]
    for k, (c, s, e) in enumerate(a.cells):
        for m, (d, t, f) in enumerate(b.cells):
            if c == d:
                numbers = np.arange(s, e)
                out.multiply(numbers, numbers if a is b else np.arange(t, f))
            elif a is not b or c < d:
                apart = float(np.sqrt(((centroids[c] - centroids[d]) ** 2).sum())) or 1e-9
                x, y = (own[0][s:e] - to_b[s:e, m]) / apart, (own[1][t:f] - to_a[t:f, k]) / apart
                u, v = np.flatnonzero(x <= far - y.min()), np.flatnonzero(y <= far - x.min())
                u, v = u[np.argsort(x[u])], v[np.argsort(y[v])]
                most = np.searchsorted(y[v], far - x[u], side="right")
                for g in range(0, len(u), 128):
                    if not most[g]:
                        break
                    out.multiply(s + u[g : g + 128], t + v[: most[g]])
    return out.found()


def near_vectors(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    cells: int = CELLS,
    sample: int = SAMPLE,
    per_cell: int = PER_CELL,
    block: int = BLOCK,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each vector.

    Vectors of equal, non-null label and equal length are linked when their cosine in double precision is at least the
    threshold. Null, zero and empty vectors and vectors with null or non-finite components link with nothing and are
    components of their own, as are rows without a label. Repeated vectors link with each other like any others. An
    empty table gives an empty one; other columns are ignored.
    """
    spark = vectors.sparkSession
    named = (id_col, vector_col, label_col)
    # At most ``cells`` centroids for each length of vectors.
    shared = spark.sparkContext.broadcast(fitted_cells(vectors, *named, vectors.count(), cells, sample, per_cell))
    packed = lambda raws: packed_vectors(vectors, *named, lambda: shared.value, raws)
    result = "id long, links long, root long"
    with Scratch(spark, "vectors") as own:
        signed = materialize(packed(False), "vectors-signed")
        groups = signed.filter("print is not null").groupBy("print").agg(F.min("id").alias("first"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("label", "dim", "home")))
        classes = materialize(groups, "vectors-classes")
        sizes = classes.groupBy("label", "dim", "home").agg(F.count("*").alias("n"))
        order, keys = Window.partitionBy("label", "dim").orderBy("home"), ["label", "dim"]
        most = F.greatest(F.lit(1), F.least(F.lit(block), (F.lit(NUMBERS) / F.col("dim")).cast("int")))
        # Small cells share blocks; a large one is dealt over blocks of its own. Numbers of blocks may have gaps.
        sizes = sizes.withColumn("size", most).withColumn("parts", F.ceil(F.col("n") / F.col("size")).cast("int"))
        sizes = sizes.withColumn("large", F.coalesce(F.sum(F.when(F.col("parts") > 1, F.col("parts"))).over(order), F.lit(0)))
        small = F.coalesce(F.sum(F.when(F.col("parts") == 1, F.col("n"))).over(order), F.lit(0))
        sizes = sizes.withColumn("block", F.when(F.col("parts") > 1, -F.col("large")).otherwise(F.floor((small - 1) / F.col("size"))).cast("long"))
        plan = own.keep(sizes.select(*keys, "home", "block", "parts"), "plan")
        blocks = plan.select(*keys, F.explode(F.sequence("block", F.col("block") + F.col("parts") - 1)).alias("block")).distinct()
        alone = Window.partitionBy(*keys)
        blocks = own.keep(blocks.withColumn("blocks", F.count("*").over(alone)), "blocks")
        plan = plan.join(blocks.select(*keys, "blocks").distinct(), keys)
        folder = f"{own.folder}/blocks"
        fs, path = _system(folder)
        fs.create_dir(path, recursive=True)

        def name(label: str, dim: int, number: int) -> str:
            return f"{folder}/{xxhash.xxh3_128_hexdigest(label.encode())}-{dim}-{number}.npz"

        def inside(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            label, dim, number, blocks = key
            pdf = pdf.drop_duplicates(["id", "print"])
            one = Block(matrix(pdf["raw"].tolist(), dim), *(pdf[c].to_numpy() for c in ("id", "copies", "home")))
            del pdf
            if blocks > 1:
                one.save(name(label, dim, number))
            return compare(one, one, shared.value.get(dim), threshold)

        many = own.keep(classes.filter("copies > 1").select("print", "first", "copies"), "many")
        heads = packed(True).filter("print is not null").join(many, "print", "left").filter("first is null or id = first").withColumn("copies", F.coalesce("copies", F.lit(1)))
        placed = heads.select("id", "print", "raw", "copies", *keys, "home").join(plan, [*keys, "home"])
        dealt = placed.withColumn("block", F.col("block") + F.pmod(F.xxhash64(F.lit(11), "id"), F.col("parts"))).drop("parts")
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        by_block = [*keys, "block", "blocks"]
        dealt = dealt.repartition(tasks, *by_block)
        found = [materialize(dealt.groupBy(*by_block).applyInPandas(inside, result), "vectors-links")]

        def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for label, dim, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    links = compare(Block.load(name(label, dim, a)), Block.load(name(label, dim, b)), shared.value.get(dim), threshold)
                    if len(links):
                        yield pa.RecordBatch.from_pandas(links, preserve_index=False)

        several = blocks.filter("blocks > 1").select(*keys, "block")
        pairs = own.keep(several.withColumnRenamed("block", "a").join(several.withColumnRenamed("block", "b"), keys).filter("a < b").select(*keys, "a", "b"), "pairs")
        if n := pairs.count():
            met = pairs.repartition(min(n, TASKS), *keys, "a", "b").mapInArrow(between, result)
            found.append(materialize(met, "vectors-links"))
    found = found[0] if len(found) == 1 else found[0].union(found[1])
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    components = connected_components(found.select(F.col("id").alias("src"), F.col("root").alias("dst")), "vectors-components")
    of_class = classes.join(links.withColumnRenamed("id", "first"), "first", "left").join(components.select(F.col("node").alias("first"), "component"), "first", "left")
    of_class = of_class.select("print", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "first").alias("component_id"))
    out = signed.select("id", "print").join(of_class, "print", "left")
    return out.select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
