"""Packing and periodic runs against brute force and odd cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest
from conftest import with_clashes
from pyspark.sql import functions as F

from waymark.llm import packing, runs, tokens
from waymark.llm.q_sequences import with_planted_runs
from waymark.llm.queries import QUERIES

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(VOCABULARY)


def hostile_texts(draw):
    parts = ["it's", "IT'S.", "J̌", "H̱x", "é.", ".'s", "<|endoftext|>", "<|EndOfText|>", "a<|startoftext|>b", "a.̸", "ä.b", " ", " x", "1.5", "don't?!",
             "ΑΣ", "ΣΑΣ.", "İx", "İ.", "'ll", "x'll)", "日本", "ß.", "😀,", "ͅa", "aͅ.", "()", '"a"', "A;B", "\x00.", "‍", "한글.", "한", "a\x1fb", "\x85"]
    return ["".join(draw.choice(parts) + draw.choice(["", " ", "\n", "\t ", "  "]) for _ in range(draw.randint(0, 60))) for _ in range(400)]


def test_ids_are_those_of_the_tokenizer(tokenizer, monkeypatch):
    draw = random.Random(1)
    texts = [*hostile_texts(draw), None, "", " \n", "word " * 3000, "x" * 5000]
    for stretch in (1 << 19, 50):
        monkeypatch.setattr(tokens, "STRETCH", stretch)
        got = list(tokens.text_ids(pa.array(texts, pa.string()), VOCABULARY))
        for text, ids in zip(texts, got, strict=True):
            assert ids.tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, text


def test_store_starts_anew(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "STORE_WORDS", 5)
    texts = ["a b c d", "e f g a", "b h i j k l m n"] * 3
    monkeypatch.setattr(tokens, "STRETCH", 8)
    assert [i.tolist() for i in tokens.text_ids(pa.array(texts), VOCABULARY)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_first_fit_takes_the_first():
    draw = random.Random(2)
    for _ in range(50):
        tree, free = packing.FirstFit(), []
        for size in sorted((draw.randint(1, 64) for _ in range(draw.randint(1, 200))), reverse=True):
            n = next((i for i, f in enumerate(free) if f >= size), len(free))
            if n == len(free):
                free.append(64)
            assert tree.put(size, 64) == (n, 64 - free[n])
            free[n] -= size


def check_packing(rows, docs, tokenizer, length):
    """Every id in one piece, sequences without gaps; returns the ids used and padded."""
    want = defaultdict(list)
    for doc_id, text in docs:
        want[doc_id].append([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2])
    got, held = defaultdict(lambda: defaultdict(list)), defaultdict(list)
    for r in rows:
        ids = [int.from_bytes(r.ids[i:i + 4], "little") for i in range(0, len(r.ids), 4)]
        assert len(ids) == r.length and 0 < r.length <= length
        got[r.doc_id][r.start].append((r.doc_tokens, ids))
        held[r.sequence_id].append((r.offset, r.length))
    for doc_id, texts in want.items():
        starts = got.pop(doc_id)
        assert sorted((len(t), t[s:s + length], s) for t in texts for s in range(0, len(t), length)) == sorted((n, ids, s) for s, all_ in starts.items() for n, ids in all_)
    assert not got
    padded = 0
    for parts in held.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
        padded += 0 if at & (at - 1) == 0 else length - at
    return sum(len(t) for ts in want.values() for t in ts), padded


@pytest.mark.parametrize("length,group", [(64, 1024), (64, 3), (4096, 1024)])
def test_packing(spark, odd, tokenizer, length, group):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    packed = packing.pack(with_clashes(odd), VOCABULARY, length=length, group_sequences=group)
    used, padded = check_packing(packed.collect(), docs, tokenizer, length)
    assert padded < max(length * (used // length // group + 1), used // 20)
    joined = packing.sequences(packed, length).collect()
    assert sum(len(r.ids) // 4 for r in joined) == used and all(r.used == len(r.ids) // 4 and r.padded_to >= r.used for r in joined)


def test_packing_of_nothing(spark, empty):
    assert packing.pack(empty, VOCABULARY).collect() == []


def brute_runs(words, exponent=4, shortest=6):
    out = {}
    for period in range(1, len(words) // exponent + 1):
        at = 0
        while at < len(words) - period:
            if words[at] != words[at + period]:
                at += 1
                continue
            start = at
            while at < len(words) - period and words[at] == words[at + period]:
                at += 1
            if at - start >= (exponent - 1) * period and at - start + period >= shortest:
                out.setdefault((start, at + period), period)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def collapsed(words, found):
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def periodic(draw, longest):
    words = [draw.choice("abcdefgh"[:draw.choice([1, 2, 2, 3, 8])]) for _ in range(draw.randint(0, longest))]
    for _ in range(draw.randint(0, 4)):
        if words:
            a = draw.randrange(len(words))
            period = draw.randint(1, max(1, (len(words) - a) // 4))
            for i in range(a, a + draw.randint(1, len(words) - a)):
                words[i] = words[a + (i - a) % period]
    return words


@pytest.mark.parametrize("exponent", [2, 3, 4, 7])
@pytest.mark.parametrize("append", [1, 5, 64, 1 << 18])
def test_runs_match_brute_force(monkeypatch, exponent, append):
    draw = random.Random(exponent)
    monkeypatch.setattr(runs, "APPEND", append)
    for _ in range(30):
        texts = [periodic(draw, draw.choice([3, 40, 250])) for _ in range(draw.randint(0, 5))]
        found, left = runs.batch_runs(pa.array([" ".join(t) if t else None for t in texts], pa.string()), exponent, 6)
        for words, got, rest in zip(texts, found.to_pylist(), left.to_pylist(), strict=True):
            want = brute_runs(words, exponent)
            assert [(r["start"], r["length"], r["period"]) for r in got] == want
            assert rest == collapsed(words, want)


def test_long_runs():
    found, left = runs.batch_runs(pa.array(["a b c d e " * 100_000, "x " * 300_000, "z"]), 4, 6)
    assert found.to_pylist() == [[{"start": 0, "length": 500_000, "period": 5}], [{"start": 0, "length": 300_000, "period": 1}], []]
    assert left.to_pylist() == ["a b c d e", "x", "z"]


def planted(doc_id, text):
    words = SPACED.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % period] for i in range(n)]


def test_find_runs(spark, odd, empty):
    more = spark.createDataFrame([(i, "one two\tthree four\n five  " * 20, None, None, None) for i in range(100, 140)] + [(141, "é é é é é é", "x", "y", 1)], odd.schema)
    docs = with_clashes(odd.unionByName(more))
    rows = docs.select("doc_id", "text", with_planted_runs(F.col("doc_id"), F.col("text")).alias("planted"))
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(100, 140)) > 0
    for r in rows.collect():
        assert SPACED.findall(r.planted or "") == planted(r.doc_id, r.text)
    got = runs.find_runs(docs, F.col("doc_id").alias("doc_id"), F.col("text").alias("given"))
    assert got.count() == docs.count()
    for r in got.collect():
        words = SPACED.findall(r.given or "")
        want = brute_runs(words) if len(words) < 1000 else [tuple(x) for x in r.runs]
        assert [tuple(x) for x in r.runs] == want and r.collapsed == collapsed(words, want)
    assert runs.find_runs(empty, F.col("doc_id").alias("doc_id")).collect() == []


def test_runs_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op13_periodic_runs"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    some = 0
    for r in rows:
        words = planted(r.doc_id, docs[r.doc_id])
        if len(words) > 1500:
            continue
        want = brute_runs(words)
        some += bool(want)
        best = min(want, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r.n_runs, r.runs_sha256, r.collapsed_sha256) == (len(want), sha("".join(f"{s},{n},{q}\n" for s, n, q in want)), sha(collapsed(words, want)))
        assert (r.start, r.length, r.period, r.exponent_milli) == ((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4)
    assert some > 5


def test_packing_query(spark, sf, tokenizer):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = QUERIES["op12_packing"](spark, sf).collect()
    ids = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs}
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    for r in rows:
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)) and r.doc_tokens == len(ids[r.doc_id])
    used = defaultdict(int)
    for r in rows:
        used[r.sequence_id] += r.length
    assert sum(4096 - n for n in used.values()) < 0.02 * 4096 * len(used)
