"""Ranked search against brute force and odd cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import lowered, with_clashes

from waymark.llm import ranked
from waymark.llm.scratch import Scratch

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, items, k):
    texts = [(i, Counter(TERM.findall(lowered(t)))) for i, t in docs]
    texts = [(i, c) for i, c in texts if c]
    n_docs, n_terms = len(texts), sum(sum(c.values()) for _, c in texts)
    dfs = Counter(t for _, c in texts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in texts:
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms
            score = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * dfs[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m))
                        for t, r in Counter(TERM.findall(lowered(text))).items() if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank + 1, None if none else i, -score) for rank, (score, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def answer(spark, docs, items, k):
    step = Scratch(spark)
    got = ranked.search(ranked.build_index(docs, step), items, step, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_odd_documents(spark, odd, k):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    items = [("a", docs[0][1]), ("b", docs[2][1] + " " + docs[3][1]), ("c", None), ("d", ""), ("e", "!? \n"), (None, docs[1][1].upper()), ("f", "nowhere to be found"),
             ("a", docs[0][1]), ("g", "ka ka lo Dé dÉ 10"), ("h", " ".join(t or "" for _, t in docs[:6]))]
    queries = with_clashes(spark.createDataFrame(items, "item_id string, text string"))
    assert answer(spark, with_clashes(odd), queries, k) == brute(docs, items, k)


def test_empty_tables(spark, empty, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    assert answer(spark, odd, none, 5) == [] == answer(spark, empty, none, 5)
    assert answer(spark, empty, spark.createDataFrame([(1, "ka")], none.schema), 5) == []


def test_skipped_blocks_lose_nothing(monkeypatch):
    """One segment of many documents in which common words are in long and rare words in short lists."""
    import pyarrow as pa
    draw = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(draw.choices(vocabulary, weights=[1 / (i + 1) for i in range(400)], k=draw.choice([3, 10, 40, 200]))) for _ in range(3000)]
    docs = list(enumerate(texts))
    items = [(j, " ".join(draw.choices(vocabulary, weights=[1 / (i + 1) for i in range(400)], k=12))) for j in range(20)] + [(20, "w0 w1 w2"), (21, "w399")]
    want = brute(docs, items, 7)
    names = ["n_docs", "n_terms", "doc_ids", "sizes", "terms", "dfs", "docs", "counts"]
    for block, short in ((64, 32), (1, 1), (16, 10 ** 9)):
        monkeypatch.setattr(ranked, "BLOCK", block)
        monkeypatch.setattr(ranked, "SHORT", short)
        columns = ranked.segment_of(pa.array(range(3000)), pa.array(texts))
        assert columns[0] == 3000
        batch = pa.RecordBatch.from_pydict(dict(zip(names, [[c.to_pylist() if isinstance(c, pa.Array) else c.tolist() if isinstance(c, np.ndarray) else c] for c in columns], strict=True)))
        segment = ranked.Segment(batch, 3000, columns[1])
        terms, got = columns[4].to_pylist(), []
        for item, text in items:
            asked = Counter(t for t in text.split() if t in terms)
            factor = [r * math.floor(1000 * math.log(6002 / (2 * columns[5][terms.index(t)] + 1))) for t, r in asked.items()]
            found, score = segment.best(np.array([terms.index(t) for t in asked], np.int64), np.array(factor, np.int64), 7)
            got += [(item, n + 1, int(d), int(s)) for n, (d, s) in enumerate(zip(found, score, strict=True))]
        assert sorted(got, key=str) == want


def test_blocks_are_skipped(monkeypatch):
    """With one strong document the search scores few blocks of the long lists."""
    import pyarrow as pa
    texts = ["common words " + "filler " * (i % 50) for i in range(6400)]
    texts[5000] = "common words rare"
    columns = ranked.segment_of(pa.array(range(6400)), pa.array(texts))
    batch = pa.RecordBatch.from_pydict(dict(zip(["n_docs", "n_terms", "doc_ids", "sizes", "terms", "dfs", "docs", "counts"],
                                                [[c.to_pylist() if isinstance(c, pa.Array) else c.tolist() if isinstance(c, np.ndarray) else c] for c in columns], strict=True)))
    segment, seen, score = ranked.Segment(batch, 6400, columns[1]), [], ranked.Segment._score
    monkeypatch.setattr(ranked.Segment, "_score", staticmethod(lambda blocks, lists, level: seen.extend(blocks) or score(blocks, lists, level)))
    terms = columns[4].to_pylist()
    found, _ = segment.best(np.array([terms.index(t) for t in ("common", "words", "rare")]), np.array([1, 1, 8000]), 1)
    assert found.tolist() == [5000] and len(seen) < 20
