import math
import zlib

import numpy as np
import pytest

from chronoplane.llm import language_id, lm_score


def brute_phrases(text, sample):
    count, i = 0, 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in sample:
            j += 1
        i = max(i + 1, j - 1)
        count += 1
    return count


def test_cross_parse_equals_substring_search():
    rnd = np.random.default_rng(1)
    for letters in ("ab", "abc", "abcdefg"):
        sample = tuple((lang, "".join(rnd.choice(list(letters), 300))) for lang in "xy")
        parser = language_id.CrossParser(sample)
        texts = ["".join(rnd.choice(list(letters + "z\U0001f642"), rnd.integers(0, 60))) for _ in range(80)]
        assert parser.counts(texts).tolist() == [[brute_phrases(t, s) for _, s in sample] for t in texts]
        parts = [sum((np.array([brute_phrases(t[i : i + 7], s) for _, s in sample]) for i in range(0, len(t), 7)), np.zeros(2, dtype=int)).tolist() for t in texts]
        assert parser.counts(texts, stretch=7).tolist() == parts


def test_only_letters_make_words():
    assert language_id.normalized("½ ² Ⅷ ① 12 _ ") == "" and language_id.normalized("a½b Über_x9 一二") == " a b über x 一二"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.language_predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r.held_out and r.lang is not None]
    right = [r for r in held if r.lang == r.lang_pred]
    assert len(held) > 150 and len(right) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in out)


def test_language_edge_cases(spark):
    rows = [(1, "the cat and the dog", "en", 0.5), (2, "der hund und die katze", "de", 0.5), (3, None, None, None), (4, "", "en", 0.1), (5, "12 + 34 = 46!", "de", 0.1), (6, "und der hund " * 20_000, None, 0.2), (7, "the dog", None, 0.2), (7, "the dog", None, 0.2), (8, "½ ² Ⅷ ①", "de", 0.3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    sample = language_id.training_sample(docs)
    assert [x[0] for x in sample] == ["de", "en"]
    out = language_id.identify_languages(docs, sample).collect()
    assert sorted((r.doc_id, r.lang_pred) for r in out) == [(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, "de"), (7, "en"), (7, "en"), (8, "und")]
    assert {r.lang_pred for r in language_id.identify_languages(docs, ()).collect()} == {"und"}
    assert language_id.language_predictions(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id.language_predictions(docs.filter("lang is null")).collect()} == {"und"}


def brute_log_prob(model, ids):
    total = 0.0
    line = [0] * lm_score.WINDOW + list(ids) + [0] * lm_score.WINDOW
    m = {k: v.astype(np.float64) for k, v in model.items()}
    for k, t in enumerate(ids):
        at = k + lm_score.WINDOW
        x = np.concatenate([m["embed"][line[at + d]] for d in (-2, -1, 1, 2)])
        h = np.tanh(x @ m["layer"] + m["layer_bias"])
        c, j = divmod(t, lm_score.PER_CLASS)
        for logits, chosen in ((h @ m["classes"] + m["class_bias"], c), (h @ m["members"][c] + m["member_bias"][c], j)):
            total += logits[chosen] - math.log(np.exp(logits).sum())
    return total


def test_scores_equal_plain_formula():
    rnd = np.random.default_rng(2)
    model = {k: (v + rnd.normal(0, 0.3, v.shape)).astype(np.float32) for k, v in lm_score.initial_model().items()}
    texts = [rnd.integers(1, lm_score.SYMBOLS, n) for n in (0, 1, 2, 40, 0, 3)]
    got = lm_score.score_texts(model, texts)
    assert np.allclose(got, [brute_log_prob(model, t) for t in texts], rtol=1e-4, atol=1e-4)


def test_gradients_equal_differences():
    rnd = np.random.default_rng(3)
    model = {k: v.astype(np.float64) + rnd.normal(0, 0.2, v.shape) for k, v in lm_score.initial_model().items()}
    line, at, _ = lm_score.padded([rnd.integers(1, lm_score.SYMBOLS, 30)])
    _, held = lm_score.forward(model, line, at, keep=True)
    grads, rows, embed = lm_score.gradients(model, held)
    grads["embed"] = np.zeros_like(model["embed"])
    grads["embed"][rows] = embed
    for k in lm_score.SHAPES:
        for i in np.argsort(-np.abs(grads[k]).ravel())[:3]:
            place, losses = np.unravel_index(i, model[k].shape), []
            for step in (1e-3, -1e-3):
                model[k][place] += step
                losses.append(-lm_score.forward(model, line, at)[0].astype(np.float64).mean())
                model[k][place] -= step
            assert (losses[0] - losses[1]) / 2e-3 == pytest.approx(grads[k][place], rel=0.05, abs=1e-4)


def test_training_raises_the_mean_log_probability(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    words = lm_score.vocabulary(docs)
    counted = {}
    for r in docs.collect():
        for w in r.text.encode().lower().split():
            counted[w] = counted.get(w, 0) + 1
    assert words == [w.decode() for w, _ in sorted(counted.items(), key=lambda x: (-x[1], x[0]))[: lm_score.KNOWN]]
    model = lm_score.train(lm_score.as_symbols(docs, words))
    scored = {r.doc_id: r for r in lm_score.score_documents(docs, words, model).collect()}
    before = {r.doc_id: r for r in lm_score.score_documents(docs, words, lm_score.initial_model()).collect()}
    assert len(scored) == docs.count()
    mean = lambda s: sum(r.log_prob for r in s.values()) / sum(r.n_words for r in s.values())
    assert mean(scored) > mean(before) + 0.8
    symbols = lm_score.Symbols(words)
    for doc_id in list(scored)[:5]:
        text = docs.filter(f"doc_id = {doc_id}").first().text
        assert scored[doc_id].log_prob == pytest.approx(brute_log_prob(model, symbols(text)), rel=1e-3)


def test_real_order_and_second_occurrences_score_higher(spark):
    """Of most documents the words as they stand, and of documents that occur twice the words of either."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    words = lm_score.vocabulary(docs)
    model = lm_score.train(lm_score.as_symbols(docs, words))
    rnd, real = np.random.default_rng(5), [(r.doc_id, r.text) for r in docs.collect() if len(r.text.split()) >= 100]
    mixed = [(i, " ".join(rnd.permutation(t.split()))) for i, t in real]
    a, b = ({r.doc_id: r.log_prob for r in lm_score.score_documents(spark.createDataFrame(x, "doc_id long, text string"), words, model).collect()} for x in (real, mixed))
    assert sum(a[i] > b[i] for i in a) >= 0.8 * len(a)
    once = {r.doc_id: r for r in lm_score.score_documents(docs).collect()}
    chosen = [i for i, _ in real[::10]]
    again = docs.union(docs.filter(docs.doc_id.isin(chosen)).selectExpr("doc_id + 1000000", "text"))
    twice = {r.doc_id: r for r in lm_score.score_documents(again).collect()}
    of = lambda r: -99.0 if r.mean_log_word is None else r.mean_log_word
    limit = sorted(of(once[i]) for i, _ in real)[int(0.9 * len(real))]
    caught = sum(of(twice[i]) > limit for i in chosen)
    assert caught >= 0.6 * len(chosen), (caught, len(chosen))
    assert all(twice[i].mean_log_prob > once[i].mean_log_prob and twice[i].n_only_here == 0 for i in chosen)
    assert sum(once[i].n_only_here > 0 for i, _ in real) > 0.5 * len(real)


def test_scoring_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "one two", "c"), (3, "one two", "c"), (4, "long words here " * 20_000, "d")], "doc_id long, text string, words string")
    out = sorted((r.doc_id, r.n_words, r.mean_log_prob is None) for r in lm_score.score_documents(docs).collect())
    assert out == [(1, 0, True), (2, 0, True), (3, 2, False), (3, 2, False), (4, 60_000, False)]
    assert lm_score.score_documents(docs.limit(0)).count() == 0


def test_words_that_share_a_symbol_have_their_own_probability(spark):
    rnd = np.random.default_rng(4)
    names = [f"w{i}" for i in range(2_000)]
    texts = [" ".join(["the", *rnd.choice(names, 60, p=np.arange(2_000, 0, -1) / 2_001_000)]) for _ in range(80)]
    rows = list(enumerate([*texts, texts[3], "the the", "the onlyhere"])) + [(None, texts[5]), (3, "w1 W1 w2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "text")
    words = ["the"]
    symbols, counts, of_symbol = lm_score.Symbols(words), {}, {}
    for w in (w for _, t in rows for w in t.encode().lower().split() if w != b"the"):
        counts[w] = counts.get(w, 0) + 1
        of_symbol[symbols(w.decode())[0]] = of_symbol.get(symbols(w.decode())[0], 0) + 1
    assert max(of_symbol.values()) > 20
    model = lm_score.train(lm_score.as_symbols(docs, words))
    below = {}
    for w in counts:
        below[symbols(w.decode())[0]] = below.get(symbols(w.decode())[0], 0) + 1

    def parts(text):
        own = [w for w in text.encode().lower().split() if w != b"the"]
        total = 0.0
        for w in own:
            s = symbols(w.decode())[0]
            others = of_symbol[s] - sum(symbols(x.decode())[0] == s for x in own)
            total += math.log((counts[w] - own.count(w) + lm_score.UNSEEN) / (others + lm_score.UNSEEN * below[s]))
        return total

    wanted = sorted((brute_log_prob(model, symbols(t)) + parts(t), len(t.split())) for _, t in rows)
    for frequent in (0, 40, lm_score.FREQUENT):
        out = lm_score.score_documents(docs, words, frequent=frequent)
        assert out.columns == ["doc_id", "n_words", "log_prob", "mean_log_prob", "mean_log_word", "n_only_here"]
        got = sorted((r.log_prob, r.n_words) for r in out.collect())
        assert np.allclose([x for x, _ in got], [x for x, _ in wanted], rtol=1e-3, atol=1e-2) and [n for _, n in got] == [n for _, n in wanted]


def test_all_languages_are_learned(spark):
    rows = [(i, "".join(chr(97 + (i // 26**k) % 26) for k in range(3)) * 9, f"l{i:03d}") for i in range(300)]
    sample = language_id.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert [lang for lang, _ in sample] == [r[2] for r in rows]
    few = language_id.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), chars=12, languages=150)
    assert len(few) == 300 and {len(text) for _, text in few} == {7}
