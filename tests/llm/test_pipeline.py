"""The stages of the pipeline on the smallest data against brute force."""

from collections import Counter

import corpus_pipeline
import pyarrow as pa
import pytest
from conftest import words
from pyspark.sql import functions as F

from waymark.llm import language, mixing, secrets


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        given, docs = docs, corpus_pipeline.cut_lineage(stage(spark, docs, sf))
        out.append((name, given, docs))
    return out


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_order_and_columns(stages):
    assert [n for n, _, _ in stages] == ["language", "near_duplicates", "decontamination", "secrets", "mixture"]
    assert all(after.columns == before.columns for _, before, after in stages[:-1])


def test_every_stage_bounds_its_batches(spark, sf, stages):
    """Batches to Python hold few MB of text after a stage was called by itself, however large the session's own are."""
    texts = spark.range(200, numPartitions=1).select(F.repeat(F.lit("x"), 100_000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    for (name, stage), (_, given, _) in zip(corpus_pipeline.STAGES, stages, strict=True):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 30))
        stage(spark, given, sf)
        largest = max(r.n for r in texts.mapInArrow(sizes, "n bigint").collect())
        assert largest <= ((4 if name == "language" else 16) << 20) + 200_000


def test_language_keeps_what_was_learned(stages):
    _, before, after = stages[0]
    assert rows(after) == Counter(tuple(r) for r in before.collect() if any(c.isalpha() for c in r.text or ""))


FOREIGN = [
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "Jokaisella on oikeus elämään, vapauteen ja henkilökohtaiseen turvallisuuteen. Ketään ei saa pitää orjana tai orjuutettuna.",
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
    "Каждый человек имеет право на жизнь, на свободу и на личную неприкосновенность. 12 статей.",
]


def test_language_drops_what_was_not_learned(spark, stages):
    """Planted texts in two languages without a label go, with 20 rows of each; nothing else goes with them."""
    _, before, after = stages[0]
    planted = spark.createDataFrame([(-10 - 10 * i - k, t) for i, t in enumerate(FOREIGN) for k in range(10)], "doc_id bigint, text string")
    kept = language.known_language(before.unionByName(planted, allowMissingColumns=True))
    assert kept.filter("doc_id < 0").count() == 0
    assert kept.count() == after.count()
    # labels of a language left out: most of its documents go, all others stay
    for out in ("de", "fr"):
        some = before.withColumn("lang", F.when(F.col("lang") != out, F.col("lang")))
        n = {r.known: r["count"] for r in language.known_language(some).groupBy(F.col("lang").isNotNull().alias("known")).count().collect()}
        assert n[True] == after.filter(F.col("lang") != out).count()
        assert n.get(False, 0) <= 0.1 * after.filter(F.col("lang") == out).count()


def test_language_learns_from_every_labelled_row(spark, monkeypatch):
    """The trees hold the counts of all labelled texts: more than 500 of a label, long ones, and the whole of each."""
    texts = [(i, "en", f"row {i} tells of wind and weather over the hills") for i in range(1200)]
    texts += [(1200, "en", "a long tale " * 30_000), (None, "fr", "le vent et la pluie"), (1201, "fr", "la pluie et le soleil"), (1202, None, "zzz"), (1203, "fr", None)]
    docs = spark.createDataFrame(texts, "doc_id long, lang string, text string")
    seen = []
    monkeypatch.setattr(language, "freeze", lambda names, lang, gram, n, f=language.freeze: seen.append(
        {name: int(n[lang == i].sum()) for i, name in enumerate(names)}) or f(names, lang, gram, n))
    kept = language.known_language(docs)
    size = {name: sum(len(t) for _, label, t in texts if label == name and t) for name in ("en", "fr")}
    assert seen[0] == size
    assert {name: sum(s.get(name, 0) for s in seen[1:]) for name in size} == size  # each half once
    assert kept.filter("lang IS NOT NULL").count() == 1203


def test_one_of_each_group(stages):
    _, before, after = stages[1]
    docs = sorted(before.collect(), key=lambda r: r.doc_id)
    sets = []
    for r in docs:
        w = words(r.text)
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    assert rows(after) == Counter(tuple(docs[i]) for i in sorted(set(label)))


def test_no_benchmark_passage_stays(spark, sf, stages):
    _, before, after = stages[2]
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[k:k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    widths = {len(w) for w in windows}

    def clean(text):
        w = words(text)
        return not any(tuple(w[k:k + n]) in windows for n in widths for k in range(len(w) - n + 1))

    assert rows(after) == Counter(tuple(r) for r in before.collect() if clean(r.text))


def test_no_secret_stays(stages):
    _, before, after = stages[3]
    assert after.count() == before.count()
    assert secrets.report(after).filter("n_access + n_hex > 0").count() == 0
    changed = {r.doc_id for r in secrets.report(before).filter("spans <> ''").collect()}
    old = {r.doc_id: r for r in before.collect()}
    assert all((r.doc_id in changed) == (r != old[r.doc_id]) for r in after.collect())


def test_mixture_of_the_rest(spark, sf, stages):
    _, before, after = stages[4]
    assert rows(after) == rows(mixing.mix(before)) == rows(corpus_pipeline.run(spark, sf))
