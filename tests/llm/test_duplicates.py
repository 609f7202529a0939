import math
import random
import re

import numpy as np
import pytest

from chronoplane.llm import common, near_dup, vector_dup


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_connected_components(spark):
    rnd = random.Random(5)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(rnd.randrange(50), rnd.randrange(50)) for _ in range(30)] + [(1000, 1000)]
    got = common.connected_components(spark.createDataFrame(links, "src long, dst long"))
    nodes = {x for e in links for x in e}
    assert {r.node: r.component for r in got.collect()} == components(nodes, links)
    assert common.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def chain(n, seed=None):
    """A path that ends in 0, its other nodes numbered upwards or, with a seed, at random."""
    names = [*range(1, n), 0]
    if seed is not None:
        random.Random(seed).shuffle(names)
    return list(zip(names, names[1:]))


@pytest.mark.parametrize("links,finish", [(chain(62), 0), (chain(5_000, 2), 0), ([(0, i) for i in range(1, 3_000)] + chain(280, 1), 100)])
def test_rounds_are_logarithmic(spark, links, finish):
    nodes, rounds = {x for e in links for x in e}, []
    got = common.connected_components(spark.createDataFrame(links, "src long, dst long"), finish=finish, rounds=rounds)
    assert {r.node: r.component for r in got.collect()} == components(nodes, links)
    assert len(rounds) <= 4 * math.log2(len(nodes)) and rounds == sorted(rounds, reverse=True)


def test_scratch_tables_go(spark):
    def folders():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(common.shared_dir(spark))
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return {str(f.getPath()) for f in fs.listStatus(path)}

    before = folders()
    common.connected_components(spark.createDataFrame(chain(50), "src long, dst long"), finish=0)
    assert len(folders() - before) == 1
    near_dup.near_duplicates(spark.createDataFrame(corpus(), "doc_id long, text string"))
    assert len(folders() - before) == 2


def drifting(n, seed):
    """Documents that each differ by five words from the next, in random order but for the smallest id, which ends them."""
    rnd = random.Random(seed)
    words = ["d%d" % rnd.randrange(1 << 30) for _ in range(5 * n + 200)]
    ids = list(range(1, n))
    rnd.shuffle(ids)
    return [(i, " ".join(words[5 * k : 5 * k + 200])) for k, i in enumerate([*ids, 0])]


def test_drifting_documents_are_one_group(spark):
    rows = drifting(280, 3)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85)
    assert {tuple(r) for r in got.collect()} == brute_near(rows, 3, 85) and {r.component_id for r in got.collect()} == {0}


def test_drifting_vectors_are_one_group(spark):
    """Neighbours on an arc are 0.2 apart, over many cells."""
    names = [*range(1, 5_000), 0]
    random.Random(2).shuffle(names)
    rows = [(i, [float(np.cos(k * 0.2)), float(np.sin(k * 0.2)), 0.01 * k], 1) for k, i in enumerate(names[:31])]
    rows += [(10_000 + i, [float(np.cos(k)), float(np.sin(k))], 2) for k, i in zip(np.linspace(0, 3, 1_000), range(1_000))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {tuple(r) for r in vector_dup.near_vectors(table, per_cell=8).collect()} == brute_vectors(rows)


def test_one_id_with_different_texts(spark):
    rows = [(1, "alpha beta gamma delta epsilon zeta eta"), (1, "one two three four five six seven"), (2, "one two three four five six seven"), (2, "one two three four five six seven"), (3, "other words"), (None, "other words"), (1, None), (1, "")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, __id int")
    got = sorted(((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in near_dup.near_duplicates(docs).collect()))
    assert got == sorted([(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 1, 3, True), (-1, 1, 3, False), (1, 0, 1, True), (1, 0, 1, True)])
    left = near_dup.without_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id, r.text or "", r["__id"]) for r in left.collect()) == sorted([(1, rows[0][1], 0), (1, rows[1][1], 1), (3, "other words", 4), (1, "", 6), (1, "", 7)])


def test_block_pairs_meet_once(spark):
    members = spark.createDataFrame([(k, i) for k, n in ((1, 50), (2, 3)) for i in range(n)], "k int, item long")
    cells = {}
    for r in common.block_pairs(members, ["k"], "item", 10).collect():
        cells.setdefault((r.k, r.lo, r.hi), []).append((r.item, r.mine))
    for k, n in ((1, 50), (2, 3)):
        met = {}
        for (group, lo, hi), rows in cells.items():
            if group == k:
                for a, x in rows:
                    for b, y in rows:
                        if a < b and (lo == hi or x != y):
                            met[a, b] = met.get((a, b), 0) + 1
        assert len(met) == n * (n - 1) // 2 and set(met.values()) == {1}
    assert max(map(len, cells.values())) < 40


def shingle_set(text, words):
    w = re.findall(r"[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def brute_near(rows, words, percent):
    sets = {i: shingle_set(t, words) for i, t in rows}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    seen = {(a, b) for ids in holders.values() for a in ids for b in ids if a < b}
    links = [(a, b) for a, b in seen if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = components(sets, links)
    return {(i, len(s), comp[i], comp[i] == i) for i, s in sets.items()}


def corpus():
    rnd = random.Random(6)
    vocabulary = ["w%d" % i for i in range(4000)] + ["É", "Ünder"]
    rows, n = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one"), (5, "a b"), (6, "A\x0bB"), (7, "a b c")], 8
    for group in range(25):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randrange(20, 400))]
        for _ in range(rnd.randrange(1, 14)):
            copy = list(base)
            for _ in range(int(len(base) * rnd.choice([0, 0.01, 0.02, 0.03, 0.05, 0.08]))):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            rows.append((n, rnd.choice([" ", "\n"]).join(copy)))
            n += 1
    chain = [rnd.choice(vocabulary) for _ in range(200)]
    for _ in range(40):  # each close to the one before, far from the first
        chain = chain[4:] + [rnd.choice(vocabulary) for _ in range(4)]
        rows.append((n, " ".join(chain)))
        n += 1
    return rows


@pytest.mark.parametrize("words,percent,cell", [(3, 85, near_dup.CELL), (5, 80, near_dup.CELL), (3, 85, 4)])
def test_near_duplicates(spark, words, percent, cell):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, bucket string, component long").repartition(6)
    got = near_dup.near_duplicates(docs, words=words, percent=percent, cell=cell)
    assert {tuple(r) for r in got.collect()} == brute_near(rows, words, percent)


def test_near_duplicates_of_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {tuple(r) for r in near_dup.near_duplicates(docs, words=3, percent=85).collect()}
    assert got == brute_near([(r.doc_id, r.text) for r in docs.collect()], 3, 85)
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0
    twice = near_dup.near_duplicates(docs.union(docs)).groupBy("doc_id").count()
    assert twice.filter("count <> 2").count() == 0 and twice.count() == docs.count()


def test_sketch_estimates_similarity():
    rnd = np.random.default_rng(1)
    for similarity in (0.8, 0.9, 0.97):
        errors = []
        for _ in range(60):
            n = 600
            both = int(2 * n * similarity / (1 + similarity))
            pool = rnd.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64)
            a, b = pool[:n], pool[n - both :]
            s = near_dup.odd_sketches(near_dup.minhashes([a, b]))
            errors.append(near_dup.estimate(int(np.bitwise_count(s[0] ^ s[1]).sum())) - both / len(pool))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def brute_vectors(rows, threshold=0.93):
    good = []
    for i, v, label in rows:
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, dtype=np.float64)
            good.append((i, label, x / np.linalg.norm(x)))
    links = [(a, b) for k, (a, la, x) in enumerate(good) for b, lb, y in good[k + 1 :] if la == lb and len(x) == len(y) and x @ y >= threshold]
    comp = components([r[0] for r in rows], links)
    count = {r[0]: 0 for r in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return {(r[0], count[r[0]], comp[r[0]], comp[r[0]] == r[0]) for r in rows}


@pytest.mark.parametrize("per_cell,block", [(vector_dup.PER_CELL, vector_dup.BLOCK), (16, 20), (16, 1_024)])
def test_vectors_of_table(spark, sf, per_cell, block):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    rnd, n = np.random.default_rng(2), len(rows)
    for k in range(120):
        _, v, label = rows[rnd.integers(40)]
        rows.append((n + k, [float(x) for x in np.array(v) + rnd.normal(0, rnd.choice([0, 0.01, 0.03]), len(v))], label))
    rows += [(n + 200, None, 1), (n + 201, [0.0] * 64, 1), (n + 202, [None] * 64, 1), (n + 203, [float("inf")] * 64, 1), (n + 204, rows[0][1], None), (n + 205, [], 1), (n + 206, [1.0, 0.0], 1), (n + 207, [2.0, 0.0], 1)]
    table = spark.createDataFrame([(i, v, x, 0) for i, v, x in rows], "vec_id long, embedding array<double>, label int, home int").repartition(5)
    got = {tuple(r) for r in vector_dup.near_vectors(table, per_cell=per_cell, block=block).collect()}
    assert got == brute_vectors(rows)
    assert vector_dup.near_vectors(table.limit(0)).count() == 0


def test_cells_lose_no_link_of_spread_vectors(spark):
    rnd = np.random.default_rng(3)
    base = rnd.normal(size=(900, 64))
    noisy = base + rnd.normal(size=base.shape) * rnd.uniform(0.1, 0.36, size=(900, 1))
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(np.concatenate([base, noisy]))]
    got = {r.vec_id: r.n_links for r in vector_dup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), per_cell=8).collect()}
    true = {r[0]: r[1] for r in brute_vectors(rows)}
    assert sum(true.values()) > 500 and got == true


def test_vectors_are_written_once_however_near_the_cells(spark, monkeypatch):
    """Spread vectors lie near the borders of most cells: no table has a row for each cell that a vector may reach."""
    random_rows = np.random.default_rng(5).normal(size=(600, 24))
    rows = [(k, [float(x) for x in v], 1) for k, v in enumerate([*random_rows, *(random_rows[:60] * 1.5 + 0.01)])]
    sizes, plain = [], vector_dup.materialize
    monkeypatch.setattr(vector_dup, "materialize", lambda df, tag, *more: (out := plain(df, tag, *more), sizes.append(out.count()))[0])
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {tuple(r) for r in vector_dup.near_vectors(table, per_cell=16, block=100).collect()} == brute_vectors(rows)
    assert max(sizes) <= len(rows)


def test_pruned_cells_and_dense_tiles_keep_all_links():
    rnd = np.random.default_rng(4)
    centers = rnd.normal(size=(6, 16))
    x = np.concatenate([c + rnd.normal(scale=s, size=(60, 16)) for c, s in zip(centers, (0.02, 0.2, 0.3, 0.5, 0.5, 1.0), strict=True)])
    cells = vector_dup.spherical_k_means(vector_dup.units(x), 8)
    home, ids, copies = (vector_dup.units(x) @ cells.T).argmax(axis=1), rnd.permutation(len(x)), rnd.integers(1, 4, len(x))
    u = vector_dup.units(x)
    link = (u @ u.T >= 0.93) & ~np.eye(len(x), dtype=bool)
    want = {int(ids[k]): int((copies * link[k]).sum()) for k in range(len(x)) if link[k].any()}
    low = components(ids.tolist(), [(int(ids[a]), int(ids[b])) for a, b in np.argwhere(link)])
    whole = vector_dup.Block(x, ids, copies, home)
    halves = [vector_dup.Block(x[k::2], ids[k::2], copies[k::2], home[k::2]) for k in range(2)]
    for prune in (1, 10_000):
        parts = [[vector_dup.compare(whole, whole, cells, 0.93, prune)], [vector_dup.compare(a, b, cells, 0.93, prune) for a, b in [(halves[0],) * 2, (halves[1],) * 2, halves]]]
        for tables in parts:
            got, edges = {}, []
            for t in tables:
                edges += list(zip(t["id"].tolist(), t["root"].tolist(), strict=True))
                for i, n in zip(t["id"].tolist(), t["links"].tolist(), strict=True):
                    got[i] = got.get(i, 0) + n
            assert got == want and components(ids.tolist(), edges) == low
