"""MinHash near-duplicate detection with odd sketches.

1. One pass over the texts gives each document its number of distinct word shingles, a fingerprint of that set, band
   keys of its MinHash samples, and an odd sketch: the samples folded into a parity bitmap, whose XOR with another
   one has few bits where the similarity is high, and tells high similarities apart sharply.
2. Documents with equal fingerprints (exact copies of the set) become one class, a numbered node; only its first row,
   by id, goes on. Nodes stand for texts, not for ids: rows that share an id and nothing else are told apart.
3. In every bucket of equal band keys each member is paired with the bucket's first node, never all with all.
   Sketches drop pairs that are far below the threshold, the rest is confirmed on full shingle sets.
4. Buckets whose members are still in several components are looked at again: those outside the bucket's largest
   component meet all members, in cells of two bounded blocks. Sketches pick members with a likely partner in another
   component, and full sets decide in the task, by a product of incidence matrices. A cell returns a spanning forest of
   its confirmed links, not its pairs.
5. Components of all confirmed links.

With SAMPLES in BANDS of ROWS, a pair at similarity s shares no band with probability (1 - s**ROWS)**BANDS.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import by_size
from .chunks import rarer_collection, sole_holder
from .common import Scratch, connected_components, discard, materialize, modest_batches

BANDS, ROWS = 32, 6
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
DEVIATIONS = 6.0  # a pair is dropped on sketches only when its estimate is so many deviations below the threshold
CELL = 1_024  # members in a block of a cell
SHINGLES = 4_000_000  # shingles of the members in a block of a cell, but for a single longer text
HOT = 4_096  # a bucket with more than a HOT-th of all rows is broadcast to them, not joined on
SALTS = 16  # parts in which the rows of an open bucket meet what is known of it

_random = np.random.Generator(np.random.PCG64(20_240_229))
_MULTIPLY = _random.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) | np.uint64(1)
_ADD = _random.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """64-bit hashes of word shingles; words' hashes are memoized up to a bound."""

    def __init__(self, words: int, limit: int = 400_000):
        self.words, self.limit, self.known = words, limit, {}
        rarer_collection()

    def __call__(self, text: str) -> np.ndarray:
        """The sorted distinct shingles of a text: A-Z lower-cased, words between ASCII white space."""
        known = self.known
        if len(known) > self.limit:
            known.clear()
        words, hashes = text.encode("utf-8", "surrogatepass").lower().split(), []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            hashes.append(h)
        if not hashes:
            return np.zeros(0, dtype=np.uint64)
        h = np.array(hashes, dtype=np.uint64)
        n = min(self.words, len(h))
        count = len(h) - n + 1
        out = np.full(count, np.uint64(n), dtype=np.uint64)
        for i in range(n):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + count])
        return np.unique(out)


_shinglers: dict[int, Shingler] = {}


def shingler(words: int) -> Shingler:
    """One per worker process, so that its memo lives as long as the worker."""
    sole_holder("shinglers", _shinglers.clear)
    if words not in _shinglers:
        _shinglers[words] = Shingler(words)
    return _shinglers[words]


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets), SAMPLES) minima; the sets must not be empty."""
    flat, starts = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), SAMPLES), dtype=np.uint64)
    for k in range(SAMPLES):
        out[:, k] = np.minimum.reduceat((flat * _MULTIPLY[k] + _ADD[k]) >> np.uint64(16), starts)
    return out


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """(n, SKETCH_BITS / 64) parity bitmaps of the (number, value) pairs of MinHash samples."""
    n = len(samples)
    bit = (mix(samples * np.uint64(2 * SAMPLES + 1) + np.arange(SAMPLES, dtype=np.uint64)) % np.uint64(SKETCH_BITS)).astype(np.int64)
    counts = np.bincount((np.arange(n)[:, None] * SKETCH_BITS + bit).ravel(), minlength=n * SKETCH_BITS).reshape(n, SKETCH_BITS)
    return np.packbits((counts & 1).astype(np.uint8), axis=1).view(np.uint64)


def estimate(differing: np.ndarray | float) -> np.ndarray | float:
    """Similarity estimated from the number of set bits of two sketches' XOR."""
    left = np.maximum(1 - 2 * np.asarray(differing, dtype=np.float64) / SKETCH_BITS, 1e-9)
    return 1 + SKETCH_BITS / (4 * SAMPLES) * np.log(left)


def most_differing(threshold: float) -> int:
    """XOR bits up to which a pair may still reach the threshold, DEVIATIONS standard deviations allowed for.

    At similarity s the number D of differing samples is binomial; each flips two bits. The deviation of the XOR count
    has the binomial part, doubled, and the part of the folding.
    """
    d = SAMPLES * (1 - threshold) + DEVIATIONS * math.sqrt(SAMPLES * threshold * (1 - threshold))
    flips = 2 * d
    mean = SKETCH_BITS * (1 - (1 - 2 / SKETCH_BITS) ** flips) / 2
    return int(min(SKETCH_BITS, math.ceil(mean + 3 * math.sqrt(mean) / 2)))


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, text): a row is known by its id and a hash of its text; rows equal in both are the same."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))


def signatures(texts: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, fingerprint, bands, sketch); the last three are null for documents without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = shingler(words)
        for batch in batches:
            for start, texts in by_size(batch.column(2), 2 << 20):
                sets = [shingles(t) for t in texts]
                full = [s for s in sets if len(s)]
                prints: list = [None] * len(sets)
                bands, sketches = list(prints), list(prints)
                if full:
                    samples = minhashes(full)
                    key = np.zeros((len(full), BANDS), dtype=np.uint64)
                    for r in range(ROWS):
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + samples[:, r::ROWS])
                    key = mix(key + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                    sketch = odd_sketches(samples)
                    at = np.flatnonzero([len(s) > 0 for s in sets])
                    for i, k, s, x in zip(at.tolist(), key, sketch.view(np.int64), full, strict=True):
                        prints[i], bands[i], sketches[i] = xxhash.xxh3_128_digest(x.tobytes()), k, s
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).slice(start, len(texts)) for i in (0, 1)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(prints, pa.binary()),
                        pa.array(bands, pa.list_(pa.int64())),
                        pa.array(sketches, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "text_hash", "n_shingles", "fingerprint", "bands", "sketch"],
                )

    return modest_batches(texts).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, fingerprint binary, bands array<long>, sketch array<long>")


def differing_bits(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int, block: int = CELL) -> DataFrame:
    """The pairs (src, dst) whose full shingle sets satisfy 100 * intersection >= percent * union.

    The text of ``src`` goes ahead of those of its partners, once for each ``block`` of them, so that neither a text
    with very many partners is repeated for each nor all of these meet in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, of_src = shingler(words), np.zeros(0, dtype=np.uint64)
        for batch in batches:
            good = []
            for i, (src, node, text) in enumerate(zip(batch.column(0), batch.column(2), batch.column(3), strict=True)):
                mine = shingles(text.as_py() or "")
                if node.as_py() is None:
                    of_src = mine
                elif linked(len(np.intersect1d(of_src, mine, assume_unique=True)), len(of_src), len(mine), percent):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], names=["src", "dst"]).take(pa.array(good, pa.int64()))

    large = pairs.groupBy("src").count().filter(F.col("count") > block).select("src", F.ceil(F.col("count") / F.lit(block)).cast("int").alias("blocks"))
    dealt = pairs.join(large, "src", "left").withColumn("part", F.pmod(F.xxhash64("dst"), F.coalesce("blocks", F.lit(1))).cast("int"))
    ahead = dealt.select("src", "part").distinct().join(texts.withColumnRenamed("node", "src"), "src").select("src", "part", F.lit(None).cast("long").alias("dst"), "text")
    rest = dealt.join(texts.withColumnRenamed("node", "dst"), "dst").select("src", "part", "dst", "text")
    rows = ahead.unionByName(rest).repartition("src", "part").sortWithinPartitions("src", "part", F.col("dst").asc_nulls_first())
    return rows.mapInArrow(run, "src long, dst long")


def linked(both: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray | bool:
    return (both > 0) & (100 * both >= percent * (a + b - both))


def forest(n: int, links: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links (m, 2) between n items."""
    parent, out = list(range(n)), []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links.tolist():
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def salted_join(rows: DataFrame, of_buckets: DataFrame) -> DataFrame:
    """The rows (bucket, node, ...) with what is known of their bucket, one row each; a bucket's rows meet in SALTS parts."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(F.lit(13), "node"), F.lit(SALTS)).cast("int"))
    return salted.join(of_buckets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["bucket", "salt"]).drop("salt")


def dealt_cells(members: DataFrame, size: int, shingles: int = SHINGLES) -> DataFrame:
    """Deal the members (bucket, node, component, n_shingles, ...) of each bucket over cells (bucket, row, column).

    In a cell a block of all members (``other`` false) meets a block of those outside the bucket's largest component
    (``other`` true), so that each of the latter meets every member in one cell. Blocks are bounded in members and
    shingles. What a bucket costs is the product of the two numbers, not the square of its members.
    """
    sizes = members.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("of"))
    whole = sizes.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("of").alias("of"), F.max(F.struct("n", "component", "of")).alias("most")).filter("n > most.n")
    blocks = lambda n, of: F.greatest(F.ceil(n / F.lit(size)), F.ceil(of / F.lit(shingles)), F.lit(1)).cast("int")
    plan = whole.select("bucket", F.col("most.component").alias("largest"), blocks(F.col("n"), F.col("of")).alias("columns"), blocks(F.col("n") - F.col("most.n"), F.col("of") - F.col("most.of")).alias("rows"))
    placed = salted_join(members, plan)
    mine = lambda n: F.pmod(F.xxhash64(F.lit(11), "node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    base = [c for c in members.columns]
    all_of = placed.select(*base, F.lit(False).alias("other"), mine("columns").alias("column"), every("rows").alias("row"))
    others = placed.filter("component <> largest").select(*base, F.lit(True).alias("other"), mine("rows").alias("row"), every("columns").alias("column"))
    # Without this the cells of a bucket would stay in the one task that the join above brought them to.
    return all_of.unionByName(others).repartition("bucket", "row", "column")


def likely_members(cells: DataFrame, limit: int) -> DataFrame:
    """Of each cell, the members that have one of another component within ``limit`` XOR bits: (bucket, node)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sketch, comp, other = np.stack(pdf["sketch"].to_numpy()).view(np.uint64), pdf["component"].to_numpy(), pdf["other"].to_numpy()
        likely, every = np.zeros(len(pdf), dtype=bool), np.flatnonzero(~other)
        for i in np.flatnonzero(other):
            at = every[comp[every] != comp[i]]
            hit = at[np.bitwise_count(sketch[at] ^ sketch[i]).sum(axis=1, dtype=np.int64) <= limit]
            if len(hit):
                likely[i] = likely[hit] = True
        return pdf.loc[likely, ["bucket", "node"]].drop_duplicates()

    return cells.groupBy("bucket", "row", "column").applyInPandas(run, "bucket long, node long").distinct()


def links_in_cells(cells: DataFrame, words: int, percent: int) -> DataFrame:
    """A spanning forest (src, dst) of the links between components in each cell, decided on full shingle sets."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shingles = shingler(words)
        other = pdf["other"].to_numpy()
        sets = [shingles(t or "") for t in pdf["text"]]
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        values, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        shared = np.bincount(inverse, minlength=len(values)) > 1
        order = np.argsort(inverse, kind="stable")
        order = order[shared[inverse[order]]]
        rank = np.cumsum(shared) - 1
        column, row = rank[inverse[order]], owner[order]
        width = max(1, min(int(shared.sum()), (1 << 22) // len(sets)))
        both = np.zeros((int(other.sum()), int((~other).sum())), dtype=np.float32)
        part = np.zeros((len(sets), width), dtype=np.float32)
        for low in range(0, int(shared.sum()), width):
            a, b = np.searchsorted(column, [low, low + width])
            at = row[a:b], column[a:b] - low
            part[at] = 1
            both += part[other] @ part[~other].T
            part[at] = 0
        both = np.rint(both).astype(np.int64)
        comp, nodes = pdf["component"].to_numpy(), pdf["node"].to_numpy()
        good = linked(both, sizes[other][:, None], sizes[~other][None, :], percent) & (comp[other][:, None] != comp[~other][None, :])
        found = np.argwhere(good)
        names, ends = np.unique(np.concatenate([nodes[other][found[:, 0]], nodes[~other][found[:, 1]]]), return_inverse=True)
        out = forest(len(names), ends.reshape(2, -1).T)
        return pd.DataFrame([(names[a], names[b]) for a, b in out], columns=["src", "dst"], dtype="int64")

    return cells.groupBy("bucket", "row", "column").applyInPandas(run, "src long, dst long")


def near_classes(docs: DataFrame, words: int = 5, percent: int = 80, cell: int = CELL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, chosen) of each row; see ``near_duplicates``.

    ``chosen`` marks one text of each component, the first by id, nulls last, then by hash, and every row without
    words; rows equal in id and text are chosen alike.
    """
    same_row = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.text_hash") == F.col(f"{b}.text_hash"))
    row_order = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("doc_id"), F.col("text_hash").alias("text_hash"))
    with Scratch(docs.sparkSession, "near") as own:
        texts = identified(docs, id_col, text_col)
        signed = own.keep(signatures(texts, words), "signatures")
        full = signed.filter("n_shingles > 0")
        firsts = full.groupBy("fingerprint").agg(F.min(row_order).alias("first")).select("fingerprint", "first.doc_id", "first.text_hash")
        classes = own.keep(firsts.withColumn("node", F.monotonically_increasing_id()), "classes")  # written, so numbers stay
        first_rows = full.alias("f").join(classes.alias("c"), (F.col("f.fingerprint") == F.col("c.fingerprint")) & same_row("f", "c"))
        heads = own.keep(first_rows.select("c.node", "f.n_shingles", "f.bands", "f.sketch").dropDuplicates(["node"]), "heads")
        facts = heads.select("node", "n_shingles", "sketch")
        banded = heads.select("node", F.explode("bands").alias("bucket"))
        hubs = banded.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("members")).filter("members > 1")
        hubs = own.keep(hubs, "hubs")
        # Fewer than HOT buckets can hold more than a HOT-th of all rows each; only these may be broadcast.
        hot = F.broadcast(hubs.filter(F.col("members") > heads.count() * BANDS / HOT))
        rest = banded.join(hot.select("bucket"), "bucket", "left_anti").join(hubs, "bucket")
        shared = own.keep(banded.join(hot, "bucket").unionByName(rest), "buckets")
        limit = most_differing(percent / 100)
        pairs = shared.filter("node <> hub").select(F.col("hub").alias("src"), F.col("node").alias("dst")).distinct()
        pairs = pairs.join(facts.toDF("dst", "n_dst", "sketch_dst"), "dst").join(facts.toDF("src", "n_src", "sketch_src"), "src")
        sizes_fit = F.least("n_src", "n_dst") * 100 >= F.greatest("n_src", "n_dst") * percent
        pairs = own.keep(pairs.filter(sizes_fit & (differing_bits(F.col("sketch_src"), F.col("sketch_dst")) <= limit)).select("src", "dst"), "pairs")
        wanted = shared.select("node").distinct()
        rows_of = classes.join(wanted, "node", "left_semi")
        candidates = texts.alias("t").join(rows_of.alias("c"), same_row("t", "c")).select("c.node", "t.text").dropDuplicates(["node"])
        candidates = own.keep(candidates, "candidates")
        links = own.keep(confirmed(pairs, candidates, words, percent, cell), "links")
        loops = wanted.select(F.col("node").alias("src"), F.col("node").alias("dst"))
        components = connected_components(links.union(loops), "near-components")

        placed = shared.filter("members > 2").join(components, "node")
        open_buckets = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who"))
        open_buckets = open_buckets.filter("low <> high").groupBy("n", "who").agg(F.min("bucket").alias("bucket")).select("bucket")
        members = own.keep(salted_join(placed, open_buckets).select("bucket", "node", "component").join(facts, "node"), "members")
        likely = likely_members(dealt_cells(members, cell), limit)
        likely = own.keep(members.drop("sketch").join(likely, ["bucket", "node"], "left_semi"), "likely")
        cells = dealt_cells(likely, cell).join(candidates, "node").repartition("bucket", "row", "column")
        more = own.keep(links_in_cells(cells, words, percent), "more")
        if more.limit(1).count():
            discard(components)
            components = connected_components(links.union(loops).union(more), "near-components")

        named = classes.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
        lowest = named.groupBy("component").agg(F.min(row_order).alias("first"))
        of_class = named.select("fingerprint", "component").join(lowest, "component").select("fingerprint", "first")
        out = signed.select("doc_id", "text_hash", "n_shingles", "fingerprint").join(of_class, "fingerprint", "left")
        chosen = F.col("first").isNull() | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash")))
        done = materialize(out.select("doc_id", "text_hash", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("component_id"), chosen.alias("chosen")), "near-classes")
        discard(components)
        return done


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, cell: int = CELL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each document.

    A document's set holds its distinct shingles of ``words`` words, or its whole word sequence if that is shorter.
    Documents are linked where 100 * intersection >= percent * union, with a default of five words and 0.8; a
    component's id is its smallest document id. Null, empty and blank texts have no shingles and are linked with
    nothing. Repeated rows come back as often as they were there; rows with one id and different texts are compared
    like any others, and those without an id are kept unless they are copies of one with an id. An empty table gives
    an empty one; other columns are ignored. Very long texts cost memory in proportion.
    """
    found = near_classes(docs, words, percent, cell, id_col, text_col)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, cell: int = CELL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are left when one row of each group of near duplicates stays.

    The one that stays has the first id, nulls last; of rows equal in id and text any. Rows without words all stay,
    but of those equal in id and text one. Different texts that share an id are no duplicates.
    """
    chosen = near_classes(docs, words, percent, cell, id_col, text_col).filter("chosen").select(F.col("doc_id").alias("__near_id"), F.col("text_hash").alias("__near_hash")).distinct()
    rows = docs.withColumn("__row_id", F.col(id_col).cast("long")).withColumn("__row_hash", F.xxhash64(F.col(text_col)))
    kept = rows.join(chosen, F.col("__row_id").eqNullSafe(F.col("__near_id")) & (F.col("__row_hash") == F.col("__near_hash")), "left_semi")
    return kept.dropDuplicates(["__row_id", "__row_hash"]).select(*docs.columns)
