"""Language identification by cross-parsing.

A suffix automaton per language accepts every substring of that language's labelled text. A text is parsed from left
to right into phrases, each the longest match with a language's text; the fewer phrases per letter, the closer the
text is to the language. The language with the lowest rate wins. Texts longer than STRETCH characters are parsed in
stretches of that length, each beginning a phrase.

The labelled text is a bounded sample: of each language at most SAMPLE_CHARS characters, from training documents
taken in the order of a hash of their ids.

All automata share one open-addressing table of edges, and all stretches of a batch take their steps together, one
numpy operation for every language and stretch, so a step costs no Python per character.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import by_size
from .chunks import sole_holder
from .common import modest_batches

SAMPLE_CHARS = 60_000
SAMPLE_DOCS = 60
LANGUAGES = 64  # with more languages each is learned from fewer characters, as many as these have in all
STRETCH = 1_024
UNKNOWN = "und"
REJECT_RATE = 0.6  # phrases per character from which a text is in none of the learned languages

words_of = re.compile(r"[^\W\d_]+").findall
# Fixed rule: what is numeric and no decimal digit, like fractions or circled numbers, is a word character but no letter.
_between = re.compile("[" + "".join(c for c in map(chr, range(0x110000)) if c.isnumeric() and not c.isdecimal() and not c.isalpha()) + "]")


def normalized(text: str | None) -> str:
    """Lower-case words of letters, with a space before each; empty if there is no letter."""
    words = words_of(text.lower()) if text else None
    if words and not "".join(words).isalpha():
        words = words_of(_between.sub(" ", text.lower()))
    return " " + " ".join(words) if words else ""


def automaton(text: str) -> list[dict[str, int]]:
    """The edges out of each state of the suffix automaton of a text; state 0 is the initial one."""
    edges: list[dict[str, int]] = [{}]
    length, link, last = [0], [-1], 0
    for c in text:
        new = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = twin
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = twin
                    p = link[p]
        last = new
    return edges


class CrossParser:
    """The automata of a sample of (language, text) pairs as arrays.

    Edges are keyed by state * width + the character's code and lie in a table with linear probing; code 0 stands for
    characters that no language has.
    """

    def __init__(self, sample: tuple[tuple[str, str], ...]):
        self.languages = [lang for lang, _ in sample]
        letters = sorted({c for _, text in sample for c in text})
        self.width = len(letters) + 1
        self.code = np.zeros(0x110000, dtype=np.int32)
        self.code[[ord(c) for c in letters]] = np.arange(1, self.width)
        self.roots = np.zeros(len(sample), dtype=np.int64)
        self.first = np.full((len(sample), self.width), -1, dtype=np.int32)  # edges out of the initial states
        states, keys, ends = 0, [], []
        for i, (_, text) in enumerate(sample):
            edges = automaton(text)
            self.roots[i] = states
            sources = np.repeat(np.arange(len(edges), dtype=np.int64), [len(out) for out in edges])
            codes = self.code[np.fromiter((ord(c) for out in edges for c in out), dtype=np.int64, count=len(sources))]
            keys.append((sources + states) * self.width + codes)
            ends.append(np.fromiter((t for out in edges for t in out.values()), dtype=np.int64, count=len(sources)) + states)
            self.first[i, codes[sources == 0]] = ends[-1][sources == 0]
            states += len(edges)
        key, end = np.concatenate(keys), np.concatenate(ends).astype(np.int32)
        bits = max(4, int(len(key) * 1.8).bit_length())
        self.mask, self.shift = np.int64((1 << bits) - 1), np.uint64(64 - bits)
        self.keys, self.ends = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, -1, dtype=np.int32)
        at = self.slot(key)
        while len(key):
            # Of the keys that want a free slot one gets it; the others and those that found it taken move on.
            free = self.keys[at] < 0
            self.keys[at[free]] = key[free]
            left = self.keys[at] != key
            self.ends[at[~left]] = end[~left]
            key, end, at = key[left], end[left], (at[left] + 1) & self.mask

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def next_states(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The states after one more character each, -1 where there is no edge."""
        key = state * self.width + code
        at = self.slot(key)
        held = self.keys[at]
        out = np.where(held == key, self.ends[at], -1)
        open_ = np.flatnonzero((held != key) & (held >= 0))
        key, at = key[open_], at[open_]
        while len(open_):
            at = (at + 1) & self.mask
            held = self.keys[at]
            hit = held == key
            out[open_[hit]] = self.ends[at[hit]]
            go = ~hit & (held >= 0)
            open_, key, at = open_[go], key[go], at[go]
        return out

    def counts(self, lines: list[str], stretch: int = STRETCH) -> np.ndarray:
        """(lines, languages): the phrases of each line; a character the language lacks is a phrase of its own."""
        n, out = len(self.languages), np.zeros((len(lines), len(self.languages)), dtype=np.int64)
        codes = self.code[np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        sizes = np.array([len(x) for x in lines], dtype=np.int64)
        parts = -(-sizes // stretch)
        owner = np.repeat(np.arange(len(lines)), parts)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = np.repeat(np.cumsum(sizes) - sizes, parts) + number * stretch
        length = np.minimum(sizes[owner] - number * stretch, stretch)
        order = np.argsort(-length, kind="stable")
        owner, start, length = owner[order], start[order], length[order]
        active = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), side="left")  # stretches longer than t
        # One lane for each stretch and language, those of the longer stretches first.
        root, lang = np.tile(self.roots, len(owner)), np.tile(np.arange(n), len(owner))
        state, count = root.copy(), np.zeros(len(root), dtype=np.int64)
        for t, lanes in enumerate(active.tolist()):
            code = np.repeat(codes[start[:lanes] + t], n)
            lanes *= n
            new = self.next_states(state[:lanes], code)
            miss = np.flatnonzero(new < 0)
            if len(miss):
                again = self.first[lang[miss], code[miss]]
                count[miss] += (state[miss] != root[miss]).astype(np.int64) + (again < 0)
                new[miss] = np.where(again < 0, root[miss], again)
            state[:lanes] = new
        count += state != root
        np.add.at(out, owner, count.reshape(-1, n))
        return out


_parsers: dict[tuple, CrossParser] = {}


def parser_of(sample: tuple[tuple[str, str], ...]) -> CrossParser:
    """Built once per worker process and sample."""
    sole_holder("parsers", _parsers.clear)
    if sample not in _parsers:
        _parsers.clear()
        _parsers[sample] = CrossParser(sample)
    return _parsers[sample]


def judge(texts: list[str | None], sample: tuple[tuple[str, str], ...]) -> list[tuple[str, float, float]]:
    """(language, score, phrases per character) of each. Score: how many fewer phrases than the runner-up, as a share of its."""
    lines = [normalized(t) for t in texts]
    out = [(UNKNOWN, 0.0, 1.0)] * len(lines)
    at = [i for i, line in enumerate(lines) if line]
    if not sample or not at:
        return out
    parser = parser_of(sample)
    counts = parser.counts([lines[i] for i in at])
    for i, row, best in zip(at, np.sort(counts, axis=1), counts.argmin(axis=1).tolist(), strict=True):
        score = 1 - row[0] / row[1] if len(row) > 1 else 1.0
        out[i] = parser.languages[best], float(min(1.0, max(0.0, score))), float(row[0] / len(lines[i]))
    return out


def training_sample(labelled: DataFrame, chars: int = SAMPLE_CHARS, docs: int = SAMPLE_DOCS, languages: int = LANGUAGES) -> tuple[tuple[str, str], ...]:
    """(language, text) pairs of every language, at most ``chars`` characters each, of the rows (doc_id, text, lang) given.

    With more than ``languages`` languages each has so many characters fewer that all together stay within the same bound.
    """
    usable = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = usable.groupBy("lang").agg(F.count("*").alias("of_lang"))
    found = counts.count()
    chars = max(1, min(chars, chars * languages // max(found, 1)))
    order = F.xxhash64(F.lit(3), "doc_id")
    rows = []
    if found:
        # Thinned to about four times the documents wanted before any are ranked, so that no task sees a whole language.
        share = F.least(F.lit(1.0), F.lit(4.0 * docs) / F.col("of_lang"))
        thin = usable.join(F.broadcast(counts), "lang").filter(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 20)) < share * (1 << 20))
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id", "text"))
        rows = thin.select("lang", F.substring("text", 1, chars).alias("text"), order.alias("o"), rank.alias("r")).filter(F.col("r") <= docs).orderBy("lang", "r").collect()
    texts: dict[str, str] = {}
    for r in rows:
        held = texts.get(r["lang"], "")
        if len(held) < chars:
            texts[r["lang"]] = (held + normalized(r["text"]))[:chars]
    return tuple((lang, text + " ") for lang, text in sorted(texts.items()) if text)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is never learned from; one without an id may be."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify_languages(docs: DataFrame, sample: tuple[tuple[str, str], ...]) -> DataFrame:
    """docs with lang_pred, score and rate (phrases per character); only ``text`` is read to predict.

    Null texts and texts without a letter are ``und`` with score 0 and rate 1, as is everything when nothing was
    learned. Ties go to the language first in the alphabet. Columns with the three new names are replaced, all others
    stay as they are; repeated rows are judged each, an empty table gives an empty one. Time is linear in the text.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(sample)  # at most LANGUAGES * SAMPLE_CHARS characters
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "rate")]
    at = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in by_size(batch.column(at)):
                # null and empty texts get the same judgement
                lang, score, rate = zip(*judge(texts, shared.value), strict=True)
                part = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang), pa.array(score), pa.array(rate)], names=[*kept, "lang_pred", "score", "rate"])

    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double").add("rate", "double")
    return modest_batches(docs).select(*kept).mapInArrow(run, schema)


def language_predictions(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rate): learned from the documents that are not held out."""
    sample = training_sample(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    out = identify_languages(docs.select("doc_id", "text"), sample)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rate")
