"""Language identification by prediction by partial matching.

One variable-order byte context tree per language, orders 0 to 3, is counted on a bounded sample of labelled documents
(``per_language`` rows by a hash of the id, none longer than ``longest`` characters) and then frozen. The code length of
a byte follows escape method C with exclusion: from the longest context that the language knows, a known byte costs
``-log2(n / (total + distinct))``, else the escape ``-log2(distinct / (total + distinct))`` is paid and the next shorter
context asked without the bytes already offered; behind order 0 the remaining bytes are equally likely. Since the
statistics are frozen, every (context, byte) cost is worked out once, and a text's exact code length is a sum of table
entries over all its bytes. A text starts as if behind line breaks; A-Z is lower-cased.

The tables hold (contexts x byte values x languages) floats: some 50 MB for four languages, bounded by the sample.
``known_language`` learns from all labelled documents of any length in place of the sample; its tables are bounded by the
contexts of three bytes that occur.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is everything when nothing was learned.
Null labels teach nothing; a null id is in training. Equal code lengths go to the first label in code point order. The
score is the posterior share of the chosen language under equal priors.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.words import LOWER, flat, stretches
from waymark.operators.quantiles import bounded_quantiles
from waymark.session import cut_lineage

ORDER = 3
UNKNOWN = "und"
_PIECE = 1 << 18  # bytes of text that are worked on at once
_HELD = 1 << 19  # grams that a task holds before it gives counts out


class Model(NamedTuple):
    languages: list[str]
    symbol: np.ndarray  # of each byte, 0 for bytes never seen
    n_symbols: int
    context: np.ndarray  # of three symbols: the longest known context
    costs: np.ndarray  # bits, per language and (context, symbol); the last entry is 0


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, per_language: int = 400, longest: int = 200_000, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, text, n`` of at most ``per_language`` training rows of each label, numbered from 1 in it."""
    draw = F.xxhash64(F.col(doc_id).cast("string"))
    rows = docs.filter(~held_out(F.col(doc_id)) & F.col(lang).isNotNull() & (F.length(text) <= longest)).select(F.col(lang).alias("lang"), draw.alias("draw"), F.col(text).alias("text"))
    # The cut is found on the draws alone, so that texts of rows that are not chosen are never sorted or moved.
    first = Window.partitionBy("lang").orderBy("draw")
    cut = rows.select("lang", "draw").withColumn("n", F.row_number().over(first)).filter(F.col("n") <= per_language)
    cut = cut_lineage(cut.groupBy("lang").agg(F.max("draw").alias("cut")))
    chosen = rows.join(cut, "lang").filter("draw <= cut")
    order = Window.partitionBy("lang").orderBy("draw", "text")
    return chosen.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_language).select("lang", "text", "n")


def _padded(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with ``ORDER`` line breaks before each, and which bytes are the texts' own."""
    lengths = np.diff(bounds)
    if len(lengths) == 1:  # of any length: no numbers of its places
        return np.append(np.full(ORDER, 10, np.uint8), LOWER[data]), np.append(np.zeros(ORDER, bool), np.ones(len(data), bool))
    place = np.arange(len(data)) + ORDER * (np.repeat(np.arange(len(lengths)), lengths) + 1)
    out, own = np.full(len(data) + ORDER * len(lengths), 10, np.uint8), np.zeros(len(data) + ORDER * len(lengths), bool)
    out[place], own[place] = LOWER[data], True
    return out, own


def _merged(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, of = np.unique(np.concatenate([g for g, _ in counts]), return_inverse=True)
    return grams, np.bincount(of, np.concatenate([n for _, n in counts]), len(grams)).astype(np.int64)


def gram_counts(sample: DataFrame, part: Column | None = None) -> DataFrame:
    """``lang, part, gram, n``: each byte with the three before it, as one number; a task adds up before it gives counts out."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def given() -> Iterator[pa.RecordBatch]:
            for (name, p), counts in held.items():
                gram, n = _merged(counts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram), pa.string()), pa.array([p] * len(gram), pa.int32()), pa.array(gram, pa.int64()), pa.array(n, pa.int64())],
                                                 ["lang", "part", "gram", "n"])
            held.clear()

        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True))
            rows: dict[tuple, list[int]] = {}
            for i, key in enumerate(keys):
                rows.setdefault(key, []).append(i)
            for key, own_rows in rows.items():
                data, bounds = flat(batch.column(1).take(pa.array(own_rows)))
                for i, j in stretches(bounds, _PIECE):
                    bytes_, own = _padded(data[bounds[i]:bounds[j]], bounds[i:j + 1] - bounds[i])
                    for a in range(0, len(bytes_) - ORDER, 4 * _PIECE):
                        b = bytes_[a:a + 4 * _PIECE + ORDER].astype(np.uint32)
                        gram = ((b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:])[own[a + ORDER:a + 4 * _PIECE + ORDER]]
                        held.setdefault(key, []).append(np.unique(gram, return_counts=True))
            if sum(len(g) for counts in held.values() for g, _ in counts) > 2 * _HELD:
                held = {key: [_merged(counts)] for key, counts in held.items()}
                if sum(len(counts[0][0]) for counts in held.values()) > _HELD:
                    yield from given()
        yield from given()

    rows = sample.select("lang", "text", (F.lit(0) if part is None else part).cast("int").alias("part"))
    return rows.mapInArrow(count, "lang string, part int, gram bigint, n bigint").groupBy("lang", "part", "gram").agg(F.sum("n").alias("n"))


def freeze(languages: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Model:
    """The cost tables from the gram counts of all languages."""
    seen = np.unique(np.concatenate([(gram >> s) & 255 for s in (0, 8, 16, 24)]))
    symbol = np.zeros(256, np.int64)
    symbol[seen] = np.arange(1, len(seen) + 1)
    width = len(seen) + 1
    parts = [symbol[(gram >> s) & 255] for s in (24, 16, 8, 0)]
    # Contexts of each length, as numbers of their symbols; all lengths share one numbering from the empty one upwards.
    codes = [np.zeros(len(gram), np.int64)]
    for length in range(1, ORDER + 1):
        codes.append(sum(parts[3 - k] * width ** (k - 1) for k in range(1, length + 1)))
    known = [np.unique(c) for c in codes]
    base = np.concatenate([[0], np.cumsum([len(k) for k in known])])
    number = lambda length, code: base[length] + np.searchsorted(known[length], code)
    context = np.zeros((width, width, width), np.int32)
    k1, k2, k3 = known[1:]
    context[:, :, k1] = number(1, k1)
    context[:, k2 // width, k2 % width] = number(2, k2)
    context[k3 // width ** 2, k3 // width % width, k3 % width] = number(3, k3)
    costs = np.zeros((len(languages), base[-1] * width + 1), np.float32)
    for i in range(len(languages)):
        own = lang == i
        tables = []
        for length in range(ORDER + 1):
            counts = np.zeros((len(known[length]), width))
            np.add.at(counts, (np.searchsorted(known[length], codes[length][own]), parts[3][own]), n[own])
            tables.append(counts)
        for length in range(ORDER + 1):
            bits = np.zeros((len(known[length]), width))
            open_ = np.ones(bits.shape, bool)
            escape = np.zeros(len(bits))
            for shorter in range(length, -1, -1):
                counts = tables[shorter][np.searchsorted(known[shorter], known[length] % width ** shorter)] * open_
                total, distinct = counts.sum(axis=1), (counts > 0).sum(axis=1)
                offered = counts > 0
                with np.errstate(divide="ignore", invalid="ignore"):
                    bits = np.where(offered, escape[:, None] - np.log2(counts / (total + distinct)[:, None]), bits)
                    escape += np.where(distinct > 0, -np.log2(distinct / (total + distinct)), 0)
                open_ &= ~offered
            taken = (~open_).sum(axis=1)
            bits = np.where(open_, (escape + np.log2(256 - taken))[:, None], bits)
            costs[i, base[length] * width:base[length + 1] * width] = bits.ravel()
    return Model(languages, symbol.astype(np.int32), width, context.ravel(), costs)


def learn(docs: DataFrame, per_language: int = 400, **names: str) -> Model | None:
    """Fit on the bounded sample; only its gram counts reach the driver."""
    return fit(labelled_sample(docs, per_language, **names))


def fit(sample: DataFrame) -> Model | None:
    return _model(gram_counts(sample).toArrow())


def _model(counts: pa.Table) -> Model | None:
    """The frozen trees of all languages in a table of gram counts; counts of one gram are added up."""
    if not counts.num_rows:
        return None
    names = pa.concat_arrays(counts["lang"].chunks).dictionary_encode()
    found = names.dictionary.to_pylist()
    languages = sorted(found)
    lang = np.array([languages.index(name) for name in found])[names.indices.to_numpy()]
    return freeze(languages, lang, counts["gram"].to_numpy().astype(np.int64), counts["n"].to_numpy().astype(np.float64))


def code_lengths(model: Model, column: pa.Array) -> np.ndarray:
    """Bits of each whole text per language, as (languages, texts)."""
    data, bounds = flat(column)
    out = np.zeros((len(model.languages), len(bounds) - 1))
    last, width = model.costs.shape[1] - 1, model.n_symbols
    for i, j in stretches(bounds, _PIECE):
        padded, own = _padded(data[bounds[i]:bounds[j]], bounds[i:j + 1] - bounds[i])
        starts = bounds[i:j] - bounds[i] + ORDER * np.arange(j - i)
        # A text longer than a piece is added up piece by piece.
        for a in range(0, len(padded) - ORDER, 4 * _PIECE):
            s = model.symbol[padded[a:a + 4 * _PIECE + ORDER]]
            entry = model.context[(s[:-3] * width + s[1:-2]) * width + s[2:-1]] * width + s[3:]
            entry = np.append(np.where(own[a + ORDER:a + ORDER + len(entry)], entry, last), last)
            first = max(0, int(np.searchsorted(starts, a, side="right")) - 1)
            behind = int(np.searchsorted(starts, a + len(entry) - 1))
            cuts = np.maximum(starts[first:max(behind, first + 1)] - a, 0)
            for l in range(len(out)):
                out[l, i + first:i + first + len(cuts)] += np.add.reduceat(model.costs[l][entry], cuts, dtype=np.float64)
    return out


def identify(docs: DataFrame, model: Model | None, *keep: Column, text: str = "text") -> DataFrame:
    """The ``keep`` columns, ``lang_pred`` and ``score`` of each document."""
    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return docs.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return _coded(docs, model, F.struct(*keep), lettered, F.col(text)).select("kept.*", "lang_pred", "score")


def _coded(docs: DataFrame, model: Model, kept: Column, lettered: Column, text: Column) -> DataFrame:
    """``kept, lang_pred, score``, and ``bits`` of the text in that language and its ``size`` in bytes."""
    rows = docs.select(kept.alias("kept"), lettered.alias("lettered"), text.alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    schema = f"kept {rows.schema['kept'].dataType.simpleString()}, lang_pred string, score double, bits double, size bigint"

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        names = np.array(own.languages, object)
        for batch in batches:
            bits = code_lengths(own, batch.column(2))
            best = bits.argmin(axis=0) if bits.shape[1] else np.zeros(0, np.int64)
            score = 1 / np.exp2(np.maximum(bits.min(axis=0) - bits, -1000)).sum(axis=0)
            known = batch.column(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.where(known, names[best], UNKNOWN), pa.string()), pa.array(np.where(known, score, 0.0)),
                 pa.array(bits.min(axis=0)), pa.array(np.diff(flat(batch.column(2))[1]))], ["kept", "lang_pred", "score", "bits", "size"])

    return rows.mapInArrow(predict, schema)


_SOFT = 64  # bytes at the typical rate that are added to a text: a short text has to differ more


def _letters(text: str) -> Column:
    """The words of letters alone, without those that hold a digit or an address, joined by one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+", " "), r"[^\p{L}\p{M}]++", " "))


def known_language(docs: DataFrame, excess: float = 1.1, spreads: float = 6.0, per_language: int | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` without those in a language that was not learned.

    All labelled documents count, whole and in no sample. They are dealt into two halves by a hash of the id: trees of each
    half code the other one, which tells how many bits a byte of the language's letters typically takes where it was not
    learned by heart (the median), and their spread. The trees of both halves together then code all documents.
    A document stays if its best language codes its letters with at most ``excess`` times that rate more, or ``spreads``
    standard deviations if these are wider. Digits, marks and addresses tell no language and are not looked at; a text whose
    words all hold some stays. Null texts and those without a letter go, and all go when nothing was learned. A label
    with rows in one half only takes the widest limit. ``per_language`` asks for a bounded sample of each label in place of all.
    """
    columns = docs.columns
    half = F.pmod(F.xxhash64(F.col(doc_id).cast("string")), F.lit(2)).cast("int")
    if per_language is None:
        rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), half.alias("half"))
    else:
        rows = cut_lineage(labelled_sample(docs, per_language, doc_id=doc_id, text=text, lang=lang).select("lang", "text", (F.col("n") % 2).alias("half")))
    counts = gram_counts(rows, F.col("half")).toArrow()  # bounded by the grams of four bytes that occur
    model = _model(counts)
    if model is None:
        return docs.limit(0)
    over = lambda m: (F.col("bits") - F.col("size") * m) / (F.col("size") + _SOFT)
    coded = []
    for i in (0, 1):
        other = _model(counts.filter(pc.equal(counts["part"], 1 - i)))
        if other is not None:
            theirs = rows.filter((F.col("half") == i) & F.col("lang").isin(other.languages))
            coded.append(_coded(theirs, other, F.col("lang"), F.lit(True), _letters("text")).filter("size > 0").select(F.col("kept").alias("lang"), "bits", "size"))
    found = {}
    if coded:
        held = cut_lineage(coded[0].unionByName(coded[1]) if len(coded) > 1 else coded[0])
        rates = cut_lineage(bounded_quantiles(held.withColumn("v", F.col("bits") / F.col("size")), "v", [0.5], ["lang"]).select("lang", F.col("q")[0].alias("rate")))
        wide = held.join(F.broadcast(rates), "lang")  # a row per language
        wide = bounded_quantiles(wide.withColumn("v", over(F.col("rate"))), "v", [0.1, 0.9], ["lang"]).join(F.broadcast(rates), "lang")
        found = {r.lang: (r.rate, max(excess * r.rate, spreads * (r.q[1] - r.q[0]) / 2.56)) for r in wide.collect()}
    widest = max(found.values(), key=sum, default=(8.0, 8.0))
    limits = docs.sparkSession.createDataFrame([(n, *found.get(n, widest)) for n in model.languages], "lang_pred string, rate double, allowed double")
    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    coded = _coded(docs, model, F.struct(*[F.col(f"`{c}`") for c in columns]), lettered, _letters(text))
    kept = coded.join(F.broadcast(limits), "lang_pred").filter(over(F.col("rate")) <= F.col("allowed"))  # a row per language
    return kept.select(*[F.col(f"kept.`{c}`").alias(c) for c in columns])
