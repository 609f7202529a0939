"""Best-fit packing by hierarchical residual packing.

Every partition cuts its documents into pieces of at most one sequence and packs them best-fit decreasing, in windows
of a bounded number of pieces. Bins that are nearly full are final. The others become items of their own (a bin keeps
its content and order) and are packed again, in groups of a bounded number of items, with the groups merging like the
nodes of a tree: round by round there are fewer underfull bins and thus fewer groups, until one group remains or a
round no longer helps. Only (bin, fill) pairs move between the rounds; pieces get their place by one join at the end.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import by_size
from .common import discard, materialize, modest_batches
from .token_count import merger

CAPACITY = 2048
WINDOW = 200_000  # pieces packed together in a partition
GROUP = 400_000  # underfull bins packed together in a task of a later round
SLACK = 4  # a bin with at most so many free places is final
ROUNDS = 12


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin (numbered from 0), its offset there, and the bins' fills. Ties keep input order."""
    order = np.argsort(-lengths, kind="stable")
    bin_of, offset, fills = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64), []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by free places
    free_mask = 0
    for i in order.tolist():
        n = int(lengths[i])
        rest = free_mask >> n
        if rest:
            free = n + (rest & -rest).bit_length() - 1
            b = open_bins[free].pop()
            if not open_bins[free]:
                free_mask ^= 1 << free
        else:
            free, b = capacity, len(fills)
            fills.append(0)
        bin_of[i], offset[i] = b, fills[b]
        fills[b] += n
        free -= n
        if free:
            if not open_bins[free]:
                free_mask |= 1 << free
            open_bins[free].append(b)
    return bin_of, offset, np.array(fills, dtype=np.int64)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of n tokens; only the first may be shorter than the capacity."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces_of(docs: DataFrame, vocabulary: str, pattern: str, capacity: int = CAPACITY, window: int = WINDOW, end_id: int = 0) -> DataFrame:
    """Tokenize, cut and pack each partition: (doc_id, piece, start, length, ids_crc32, bin, offset, fill)."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, base = merger(vocabulary, pattern), TaskContext.get().partitionId() << 40
        ids: list[pa.Array] = []
        rows: list[tuple[int, int, int, int]] = []
        owners: list[int] = []

        def flush() -> pa.RecordBatch:
            nonlocal base
            piece, start, length, crc = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True))
            bin_of, offset, fills = best_fit(length, capacity)
            doc_ids = pa.concat_arrays(ids).take(pa.array(owners))
            out = pa.RecordBatch.from_arrays(
                [doc_ids, pa.array(piece.astype(np.int32)), *map(pa.array, (start, length, crc, bin_of + base, offset, fills[bin_of]))],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "fill"],
            )
            base += len(fills)
            return out

        docs_held = 0
        for batch in batches:
            for first, texts in by_size(batch.column(1)):
                ids.append(batch.column(0).slice(first, len(texts)))
                for data in m.encode_many(texts):
                    data += end
                    for k, (start, length) in enumerate(cut(len(data) // 4, capacity)):
                        rows.append((k, start, length, zlib.crc32(data[4 * start : 4 * (start + length)])))
                        owners.append(docs_held)
                    docs_held += 1
                if len(rows) >= window:
                    yield flush()
                    ids, rows, owners, docs_held = [], [], [], 0
        if rows:
            yield flush()

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long"
    return modest_batches(docs).select("doc_id", "text").mapInArrow(run, schema)


def pack_documents(
    docs: DataFrame, vocabulary: str, pattern: str, capacity: int = CAPACITY, window: int = WINDOW, group: int = GROUP, slack: int = SLACK, rounds: int = ROUNDS
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all pieces of all documents.

    Null and empty texts are one piece with the end id alone. Repeated rows are packed each. An empty table gives an
    empty one. Other columns are ignored. Sequences are gapless from 0 and never longer than the capacity.
    """
    pieces = materialize(pieces_of(docs, vocabulary, pattern, capacity, window), "packing-pieces")
    bins = pieces.filter("offset = 0").select("bin", "fill").filter(F.col("fill") < capacity - slack)

    def repack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["fill", "bin"], ascending=[False, True], kind="stable")
        bin_of, offset, fills = best_fit(pdf["fill"].to_numpy(), capacity)
        names = pdf["bin"].to_numpy()
        heads = np.zeros(len(fills), dtype=np.int64)
        heads[bin_of[::-1]] = names[::-1]
        return pd.DataFrame({"bin": names, "into": heads[bin_of], "at": offset, "fill": fills[bin_of]})

    places, before = None, None
    for _ in range(rounds):
        n = bins.count()
        groups = max(1, -(-n // group))
        if n < 2 or (before is not None and n > 0.99 * before):
            break
        step = materialize(
            bins.groupBy(F.pmod(F.xxhash64("bin"), F.lit(groups)).alias("g")).applyInPandas(lambda _, pdf: repack(pdf), "bin long, into long, at long, fill long"),
            "packing-round",
        )
        if places is None:
            places = step.select("bin", "into", "at")
        else:
            further = step.select(F.col("bin").alias("into"), F.col("into").alias("into2"), F.col("at").alias("at2"))
            old, places = places, materialize(
                places.join(further, "into", "left").select("bin", F.coalesce("into2", "into").alias("into"), (F.col("at") + F.coalesce("at2", F.lit(0))).alias("at")), "packing-places"
            )
            discard(old)
        bins, before = step.filter("at = 0").select(F.col("into").alias("bin"), "fill").filter(F.col("fill") < capacity - slack), n
        if groups == 1:
            break
    if places is None:
        placed = pieces.withColumns({"into": F.col("bin"), "at": F.lit(0)})
    else:
        placed = pieces.join(places, "bin", "left")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("into", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("at", F.lit(0))).cast("long").alias("offset")
    )
