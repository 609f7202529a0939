"""Masked pseudo-likelihood of documents under a bidirectional window network trained on the corpus.

Every word is predicted from the WINDOW words on either side, itself masked. Words are symbols: the most frequent
words of the whole corpus have one each, the others share buckets by hash. The network embeds the 2 * WINDOW symbols,
has one tanh layer, and predicts the symbol's class, then the symbol within its class (a two-level softmax). Below a
shared symbol stand all words of the corpus that share it, each with its part of the symbol's exact count, so that
every distinct word has a probability of its own: P(word | context) = P(symbol | context) * P(word | symbol). What is
masked stays masked there, too: the document's own occurrences are taken out of the counts of its words and symbols, and
each word gets UNSEEN occurrences instead, so a word that no other document has is rare and not certain. Those counts
stay a sharded table, as large as the corpus has distinct words. A document's score is the sum of the conditional
log-probabilities of its words.

Training sees every word of every document once. In each of ROUNDS rounds a hash of the ids picks that round's
documents; all tasks start from the round's model, run Adagrad over their documents, and return their parameters
weighted by words. These are averaged blockwise in two levels. The driver holds one model, whose size does not depend
on the corpus.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import by_size
from .chunks import rarer_collection
from .common import materialize, modest_batches

WINDOW = 2
CLASSES = 36
PER_CLASS = 36
KNOWN = 1_024  # words with a symbol of their own; symbol 0 pads, the rest are hash buckets
FREQUENT = 65_536  # words whose counts every task holds; only the rarer ones are looked up by a shuffle
WIDTH, HIDDEN = 16, 32
UNSEEN = 0.1  # added to the count of every word below a shared symbol
ROUNDS = 2
BATCH, RATE = 8_192, 0.1
BLOCK = 4_096  # parameters averaged together

SYMBOLS = CLASSES * PER_CLASS
SHAPES = {
    "embed": (SYMBOLS, WIDTH),
    "layer": (2 * WINDOW * WIDTH, HIDDEN),
    "layer_bias": (HIDDEN,),
    "classes": (HIDDEN, CLASSES),
    "class_bias": (CLASSES,),
    "members": (CLASSES, HIDDEN, PER_CLASS),
    "member_bias": (CLASSES, PER_CLASS),
}
Model = dict[str, np.ndarray]


def initial_model(seed: int = 5) -> Model:
    random = np.random.default_rng(seed)
    scale = {"embed": 0.1, "layer": (2 * WINDOW * WIDTH) ** -0.5, "classes": 0.05, "members": 0.05}
    return {k: (random.standard_normal(s) * scale.get(k, 0.0)).astype(np.float32) for k, s in SHAPES.items()}


def flat(model: Model) -> np.ndarray:
    return np.concatenate([model[k].ravel() for k in SHAPES])


def unflat(values: np.ndarray) -> Model:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = values[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


class Symbols:
    """Words to symbols; the memo of hashed words is emptied at a bound."""

    def __init__(self, words: list[str], limit: int = 400_000):
        self.own = {w.encode(): i + 1 for i, w in enumerate(words)}
        self.memo, self.limit = dict(self.own), limit
        rarer_collection()

    def __call__(self, text: str) -> np.ndarray:
        if len(self.memo) > self.limit:
            self.memo = dict(self.own)
        return self.of(words_of(text))

    def of(self, words: list[bytes]) -> np.ndarray:
        memo = self.memo
        out = list(map(memo.get, words))
        if None in out:
            for i, s in enumerate(out):
                if s is None:
                    w = words[i]
                    out[i] = memo[w] = KNOWN + 1 + xxhash.xxh32_intdigest(w) % (SYMBOLS - KNOWN - 1)
        return np.array(out, dtype=np.int16)


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def padded(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One array with WINDOW pads around each text; the positions of all words in it, and each word's text."""
    pad = np.zeros(WINDOW, dtype=np.int16)
    line = np.concatenate([x for t in texts for x in (pad, t)] + [pad]).astype(np.int16)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    at = np.arange(int(sizes.sum()), dtype=np.int32) + (owner + 1) * WINDOW
    return line, at, owner


def softmax(x: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(exponentials of each row, written over x; their sums; log-probability of ``chosen``)."""
    at = x[np.arange(len(x)), chosen]
    top = x.max(initial=0.0)
    if top > 60:  # no row needs more than its own largest value, few batches need any
        top = x.max(axis=1, keepdims=True)
        x -= top
        at = at - top[:, 0]
    np.exp(x, out=x)
    sums = x.sum(axis=1)
    return x, sums, at - np.log(sums)


OFFSETS = np.array([d for d in range(-WINDOW, WINDOW + 1) if d], dtype=np.int32)


def forward(model: Model, line: np.ndarray, at: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple | None]:
    """Log-probability of each word at ``at``; words come sorted by class inside. ``keep`` returns what training needs."""
    target = line[at]
    order = np.argsort(target // PER_CLASS, kind="stable")  # 16-bit integers sort by radix
    at, target = at[order], target[order]
    cls, member = target // PER_CLASS, target % PER_CLASS
    context = line[at[:, None] + OFFSETS]
    x = model["embed"].take(context, axis=0).reshape(len(at), -1)
    h = x @ model["layer"]
    h += model["layer_bias"]
    np.tanh(h, out=h)
    logits = h @ model["classes"]
    logits += model["class_bias"]
    outer, outer_sums, log_class = softmax(logits, cls)
    ends = np.searchsorted(cls, np.arange(CLASSES + 1))
    logits = np.empty((len(at), PER_CLASS), dtype=h.dtype)
    for c in range(CLASSES):
        a, b = ends[c], ends[c + 1]
        if b > a:
            np.matmul(h[a:b], model["members"][c], out=logits[a:b])
            logits[a:b] += model["member_bias"][c]
    inner, inner_sums, log_member = softmax(logits, member)
    out = np.empty(len(at), dtype=h.dtype)
    out[order] = log_class + log_member
    return out, (context, x, h, outer, outer_sums, inner, inner_sums, cls, member, ends) if keep else None


def gradients(model: Model, held: tuple) -> tuple[Model, np.ndarray, np.ndarray]:
    """Mean gradients of the negative log-probability; those of ``embed`` as (rows touched, their gradients)."""
    context, x, h, d_outer, outer_sums, d_inner, inner_sums, cls, member, ends = held
    n, rows = len(h), np.arange(len(h))
    one = h.dtype.type(1 / n)
    d_outer *= (one / outer_sums)[:, None]
    d_inner *= (one / inner_sums)[:, None]
    d_outer[rows, cls] -= one
    d_inner[rows, member] -= one
    out = {"classes": h.T @ d_outer, "class_bias": d_outer.sum(axis=0), "members": np.zeros_like(model["members"]), "member_bias": np.zeros_like(model["member_bias"])}
    d_h = d_outer @ model["classes"].T
    for c in range(CLASSES):
        a, b = ends[c], ends[c + 1]
        if b > a:
            np.matmul(h[a:b].T, d_inner[a:b], out=out["members"][c])
            d_inner[a:b].sum(axis=0, out=out["member_bias"][c])
            d_h[a:b] += d_inner[a:b] @ model["members"][c].T
    h *= h
    d_h -= d_h * h
    out["layer"], out["layer_bias"] = x.T @ d_h, d_h.sum(axis=0)
    d_x = (d_h @ model["layer"].T).reshape(-1, WIDTH)
    ids = context.ravel()
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    return out, ids[starts], np.add.reduceat(d_x.take(order, axis=0), starts, axis=0)


class Trainer:
    """Adagrad from a given model."""

    def __init__(self, model: Model):
        self.model = {k: v.copy() for k, v in model.items()}
        self.squares = {k: np.full_like(v, 1e-6) for k, v in model.items()}
        self.words = 0

    def learn(self, texts: list[np.ndarray]) -> None:
        line, at, _ = padded(texts)
        for start in range(0, len(at), BATCH):
            part = at[start : start + BATCH]
            _, held = forward(self.model, line, part, keep=True)
            grads, rows, embed = gradients(self.model, held)
            for k, g in grads.items():
                self.squares[k] += g * g
                self.model[k] -= RATE * g / np.sqrt(self.squares[k])
            self.squares["embed"][rows] += embed * embed
            self.model["embed"][rows] -= RATE * embed / np.sqrt(self.squares["embed"][rows])
            self.words += len(part)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the exact count of every word of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(words_of(text.as_py() or ""))
            if len(counts) > 500_000:
                yield packed(counts)
                counts.clear()
        if counts:
            yield packed(counts)

    def packed(counts: Counter[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in counts]), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    counted = modest_batches(docs).select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return materialize(counted, "lm-words")


def most_frequent(counted: DataFrame, known: int = KNOWN) -> list[str]:
    """The most frequent words; ties go by the word."""
    return [r["word"] for r in counted.orderBy(F.desc("n"), "word").limit(known).collect()]


def vocabulary(docs: DataFrame, known: int = KNOWN) -> list[str]:
    """The most frequent words of all documents, by exact counts."""
    return most_frequent(word_counts(docs), known)


def frequent_words(counted: DataFrame, most: int) -> list[tuple[str, int]]:
    """At most ``most`` words with their counts: all those from some count on, so that tasks need not rank words."""
    level = F.floor(F.log2("n") * 16)
    sizes = counted.groupBy(level.alias("level")).count().collect()
    lowest, held = None, 0
    for r in sorted(sizes, key=lambda r: -r["level"]):
        held += r["count"]
        if held > most:
            break
        lowest = r["level"]
    return [] if lowest is None else [(r["word"], r["n"]) for r in counted.filter(level >= lowest).collect()]


def as_symbols(docs: DataFrame, words: list[str], frequent: list[tuple[str, int]] = ()) -> DataFrame:
    """Every text's words as 16-bit symbols, written once and read by all later passes.

    (doc_id, row, symbols binary, logs, shared array<struct<word, n>>): ``row`` is the row's own number. Of its words
    without a symbol of their own, ``logs`` adds up the logs of the counts in other rows of those in ``frequent``, and
    ``shared`` lists the others, and how often each occurs in the row.
    """
    given = docs.sparkSession.sparkContext.broadcast((words, {w.encode(): n for w, n in frequent}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, row = Symbols(given.value[0]), TaskContext.get().partitionId() << 40
        count_of = (given.value[1] | dict.fromkeys(symbols.own, 0)).get
        for batch in batches:
            for start, texts in by_size(batch.column(1)):
                ids, ends, rare, times, in_all, here, distinct = [], [0], [], [], [], [], []
                for text in texts:
                    parts = words_of(text)
                    ids.append(symbols.of(parts).tobytes())
                    counts = Counter(parts)
                    found = list(map(count_of, counts))
                    if None in found:
                        for i, (w, n) in enumerate(counts.items()):
                            if found[i] is None:
                                found[i] = 0
                                rare.append(w)
                                times.append(n)
                    in_all += found
                    here += counts.values()
                    distinct.append(len(counts))
                    ends.append(len(rare))
                n, m = np.array(in_all, dtype=np.float64), np.array(here, dtype=np.float64)
                parts = np.where(n > 0, m * np.log(np.where(n > 0, n - m + UNSEEN, 1.0)), 0.0)
                logs = np.bincount(np.repeat(np.arange(len(texts)), distinct), weights=parts, minlength=len(texts))
                pairs = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(times, pa.int64())], names=["word", "n"])
                columns = [
                    batch.column(0).slice(start, len(texts)),
                    pa.array(range(row, row + len(texts)), pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array(logs, pa.float64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs),
                ]
                row += len(texts)
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "symbols", "logs", "shared"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, row long, symbols binary, logs double, shared array<struct<word:binary,n:long>>"
    return materialize(modest_batches(docs).select("doc_id", "text").mapInArrow(run, schema), "lm-symbols")


def symbol_counts(symbols: DataFrame) -> np.ndarray:
    """How often each symbol occurs in all texts of ``as_symbols``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SYMBOLS, dtype=np.int64)
        for batch in batches:
            for x in batch.column(0):
                counts += np.bincount(np.frombuffer(x.as_py(), dtype=np.int16), minlength=SYMBOLS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["symbol", "n"])

    out = np.zeros(SYMBOLS, dtype=np.int64)
    for r in symbols.select("symbols").mapInArrow(run, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect():
        out[r["symbol"]] = r["n"]
    return out


def distinct_words(counted: DataFrame, words: list[str]) -> np.ndarray:
    """How many distinct words stand below each symbol."""
    given = counted.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, counts = Symbols(given.value), np.zeros(SYMBOLS, dtype=np.int64)
        for batch in batches:
            counts += np.bincount(symbols.of([w.encode() for w in batch.column(0).to_pylist()]), minlength=SYMBOLS)
            symbols.memo = dict(symbols.own)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["symbol", "n"])

    out = np.zeros(SYMBOLS, dtype=np.int64)
    for r in counted.select("word").mapInArrow(run, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect():
        out[r["symbol"]] = r["n"]
    return out


def log_word_counts(symbols: DataFrame) -> DataFrame:
    """(row, rare_logs, n_only_here): over the words in ``shared`` of each row, the sum of the logs of their counts in the
    other rows, and how many of them no other row has."""
    each = symbols.select("row", F.inline("shared"))
    others = F.sum("n").over(Window.partitionBy("word")) - F.col("n")
    counted = each.select("row", "n", others.alias("others"))
    return counted.groupBy("row").agg(F.sum(F.col("n") * F.log(F.col("others") + F.lit(UNSEEN))).alias("rare_logs"), F.sum(F.when(F.col("others") == 0, F.col("n")).otherwise(0)).alias("n_only_here"))


def parts_of(column: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Consecutive parts of a batch of symbol arrays with about ``most`` words each."""
    start, part, held = 0, [], 0
    for i, x in enumerate(column):
        part.append(np.frombuffer(x.as_py(), dtype=np.int16))
        held += len(part[-1])
        if held >= most:
            yield start, part
            start, part, held = i + 1, [], 0
    if part:
        yield start, part


def train(symbols: DataFrame, rounds: int = ROUNDS, seed: int = 5) -> Model:
    """One pass over all documents of (doc_id, symbols) in ``rounds`` rounds of averaged local training."""
    spark, model = symbols.sparkSession, initial_model(seed)
    for r in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            trainer = Trainer(shared.value)
            for batch in batches:
                for _, texts in parts_of(batch.column(0)):
                    trainer.learn(texts)
            if trainer.words:
                values = flat(trainer.model).astype(np.float64) * trainer.words
                parts = [values[i : i + BLOCK] for i in range(0, len(values), BLOCK)]
                task = TaskContext.get().partitionId()
                columns = [pa.array(range(len(parts)), pa.int32()), pa.array([task % 64] * len(parts), pa.int32()), pa.array([float(trainer.words)] * len(parts)), pa.array(parts, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "bucket", "words", "sums"])

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"block": pdf["block"].iloc[:1], "bucket": pdf["bucket"].iloc[:1], "words": [pdf["words"].sum()], "sums": [np.sum(np.stack(pdf["sums"].to_numpy()), axis=0)]})

        kinds = "block int, bucket int, words double, sums array<double>"
        mine = symbols.filter(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == r)
        trained = mine.select("symbols").mapInArrow(run, kinds).groupBy("block", "bucket").applyInPandas(add, kinds).groupBy("block").applyInPandas(add, kinds)
        rows = sorted(trained.collect(), key=lambda x: x["block"])
        if rows:
            model = unflat(np.concatenate([np.array(x["sums"]) / x["words"] for x in rows]))
    return model


def score_texts(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Sum of conditional log-probabilities of each text."""
    line, at, owner = padded(texts)
    out = np.zeros(len(texts))
    for start in range(0, len(at), BATCH):
        logs, _ = forward(model, line, at[start : start + BATCH])
        out += np.bincount(owner[start : start + BATCH], weights=logs, minlength=len(texts))
    return out


def score_documents(docs: DataFrame, words: list[str] | None = None, model: Model | None = None, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_words, log_prob, mean_log_prob, mean_log_word, n_only_here) of each document, under a model trained on
    all of them by default.

    ``mean_log_word`` is the part of the score below shared symbols, per word there: how well the other documents tell
    which word it is; null without such a word. ``n_only_here`` counts the words that no other document has.
    The trained model knows every word of ``docs``. A ``model`` that is given comes without counts of words and scores
    symbols alone. Null, empty and blank texts have no words, log_prob 0 and a null mean. Repeated rows are trained on
    and scored each; an empty table gives an empty one, other columns are ignored. Very long texts take memory in
    proportion.
    """
    by_word = model is None
    counted = word_counts(docs) if by_word or words is None else None
    words = most_frequent(counted) if words is None else words
    symbols = as_symbols(docs, words, frequent_words(counted, frequent) if by_word else [])
    model = train(symbols) if model is None else model
    below = np.zeros((2, SYMBOLS - KNOWN - 1))  # occurrences of each shared symbol, and what all words below it have added
    if by_word:
        below[0] = symbol_counts(symbols)[KNOWN + 1 :]
        below[1] = UNSEEN * distinct_words(counted, words)[KNOWN + 1 :]
    shared = docs.sparkSession.sparkContext.broadcast((model, below))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, (of_symbol, added) = shared.value
        for batch in batches:
            for start, texts in parts_of(batch.column(2)):
                part = batch.slice(start, len(texts))
                scores, words_here, n_shared = score_texts(network, texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
                if by_word:
                    here = np.stack([np.bincount(x, minlength=SYMBOLS)[KNOWN + 1 :] for x in texts])
                    n_shared = here.sum(axis=1)
                    words_here = part.column(3).to_numpy() - (here * np.log(np.maximum(of_symbol - here + added, UNSEEN))).sum(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(x) for x in texts], pa.int64()), pa.array(scores.astype(np.float64)), pa.array(words_here), pa.array(n_shared)], names=["doc_id", "row", "n_words", "log_prob", "below", "n_shared"])

    scored = symbols.select("doc_id", "row", "symbols", "logs").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row long, n_words long, log_prob double, below double, n_shared long")
    if by_word:
        scored = scored.join(log_word_counts(symbols), "row", "left").withColumn("below", F.col("below") + F.coalesce("rare_logs", F.lit(0.0)))
        scored = scored.withColumn("log_prob", F.col("log_prob") + F.col("below"))
    only_here = F.coalesce("n_only_here", F.lit(0)).cast("long") if by_word else F.lit(None).cast("long")
    per = lambda total, n: F.when(F.col(n) > 0, F.col(total) / F.col(n))
    return scored.select("doc_id", "n_words", "log_prob", per("log_prob", "n_words").alias("mean_log_prob"), per("below", "n_shared").alias("mean_log_word"), only_here.alias("n_only_here"))
