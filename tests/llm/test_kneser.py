"""The model of word pairs against a plain count of everything."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waymark.llm import kneser

TEXTS = ["a b a b c", "the cat Sat on the mat", "the cat sat on the hat the end", "", None, "b a the cat", "x " * 40 + "a b", "the cat sat", "on the mat a b c d e f"]


def tokens(text):
    return [*(text or "").lower().split(), "</end>"]


def brute(train, text):
    """log10 of the probability of a text."""
    pairs, words = Counter(), Counter()
    for t in train:
        w = tokens(t)
        words.update(w)
        pairs.update(zip(["<start>", *w], w))
    before, after = defaultdict(set), defaultdict(list)
    total = Counter()
    for (v, w), c in pairs.items():
        before[w].add(v)
        after[v].append(c)
        total[v] += c
    high = kneser.discounts([sum(c == k for c in pairs.values()) for k in (1, 2, 3, 4)])
    low = kneser.discounts([sum(len(b) == k for b in before.values()) for k in (1, 2, 3, 4)])
    d = lambda table, c: table[min(c, 3)]
    left = sum(d(low, len(b)) for b in before.values()) / len(pairs)
    out = 0
    w = tokens(text)
    for v, x in zip(["<start>", *w], w):
        single = max(len(before[x]) - d(low, len(before[x])), 0) / len(pairs) + left / (len(words) + 1)
        c = pairs[(v, x)]
        if total[v]:
            single = max(c - d(high, c), 0) / total[v] + sum(d(high, n) for n in after[v]) / total[v] * single
        out += math.log10(single)
    return out, len(w), sum(x in words for x in w), sum(words.values()), sum(math.log10((words[x] + 1) / (sum(words.values()) + len(words) + 1)) for x in w)


@pytest.mark.parametrize("group", [1 << 21, 4])
def test_scores(spark, monkeypatch, group):
    monkeypatch.setattr(kneser, "GROUP_WORDS", group)
    unseen = ["a zzz the cat", "mat hat cat", "b c q q a b"]
    frame = lambda texts: spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model = kneser.train(frame(TEXTS))
    both = TEXTS + unseen
    rows = {r.doc_id: r for r in kneser.score(frame(both), model, F.col("doc_id")).collect()}
    for i, text in enumerate(both):
        score, n, known, total, base = brute(TEXTS, text)
        assert (rows[i].n_tokens, rows[i].n_known, rows[i].train_tokens) == (n, known, total)
        assert rows[i].score == pytest.approx(score, rel=1e-9)
        assert rows[i].base_score == pytest.approx(base, rel=1e-9)


@pytest.mark.parametrize("before", ["the", "x", "unknown-word"])
def test_probabilities_add_up(spark, before):
    model = kneser.train(spark.createDataFrame([(t,) for t in TEXTS], "text string"))
    words = sorted({w for t in TEXTS for w in (t or "").lower().split()})
    scorer, total = kneser.Scorer(model), 0.0
    for word in [*words, "unseen"]:
        (_, tokens_, bounds), = kneser._token_chunks(pa.array([f"{before} {word}"]))
        total += 10 ** scorer.log10(tokens_, bounds)[0][1]
    (_, tokens_, bounds), = kneser._token_chunks(pa.array([before]))
    total += 10 ** scorer.log10(tokens_, bounds)[0][1]  # the end token
    assert total == pytest.approx(1)


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    model = kneser.train(empty)
    rows = kneser.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model, F.col("doc_id")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.score) for r in rows] == [(3, 0, 0, 0.0)]
    assert kneser.score(empty, model, F.col("doc_id")).count() == 0


def test_scramble_is_reversible():
    x = np.array([0, 1, 2 ** 32, 2 ** 64 - 1, 123456789], np.uint64)
    assert (kneser.unmixed(kneser.mixed(x)) == x).all()
    assert (kneser.unpack(kneser.pack(np.sort(x)), len(x)) == np.sort(x)).all()
