r"""Secret scans with multipart credential linking, in DataFrame functions only.

Base findings stand on their own: ``assign`` (a named value of 8 and more characters), ``access`` (AKIA.. of 16 and
more) and ``hex`` (32 and more). Weak candidates are the shorter ones of these (``short``: values of 4 to 7, ``id``:
AKIA.. of 8 to 15, ``digest``: hex of 16 to 31), 40-character keys of mixed characters (``key``), account names
(``login``) and service addresses (``endpoint``). Each part is an identifier, a secret or an endpoint. An interval join
within scopes (parts of one document at most ``reach`` code points apart) decides about them: a weak identifier needs a
secret, a weak secret an identifier, an endpoint both. The join sweeps the parts of a document in order and looks only
at the nearest part of each role on both sides, which decides existence without forming pairs.

Positions come from splitting at the matches: a match starts behind all pieces and matches before it. Scan results
hold lengths only and are written once with a row number, so nothing of the texts is shuffled.

Defined cases: a null text has no spans, and stays null when redacted; repeated rows and repeated or null ids each give their own row; overlapping spans
of different kinds all stay. Other columns pass through ``redact`` unchanged, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.scratch import join_small
from waymark.session import cut_lineage

REACH = 200


class Part(NamedTuple):
    pattern: str
    group: int  # the group whose length decides
    least: int
    base: str  # the kind of matches of at least that length, or "" if there are only weak ones
    weak: str
    weak_least: int
    role: str


# Order of the kinds in reports: base kinds as listed, then the weak ones.
KINDS = ["assign", "access", "hex", "short", "id", "digest", "key", "login", "endpoint"]
_GLUE = r"""["']?\x20*[:=]\x20*["']?"""
PARTS = [
    Part(r"(?i:password|passwd|secret|token|api_?key)" + _GLUE + r"([A-Za-z0-9+/_.=-]+)", 1, 8, "assign", "short", 4, "secret"),
    Part(r"AKIA[A-Z0-9]+", 0, 16, "access", "id", 8, "identifier"),
    Part(r"[0-9a-f]{16,}", 0, 32, "hex", "digest", 16, "secret"),  # a run of 16 and more is a whole run
    Part(r"[A-Za-z0-9+/]{40,}", 0, 0, "", "key", 40, "secret"),
    Part(r"(?i:user_?name|user_?id|login|client_?id|account_?id)" + _GLUE + r"([A-Za-z0-9@+/_.=-]+)", 1, 0, "", "login", 3, "identifier"),
    Part(r"https?://[A-Za-z0-9.-]+", 0, 0, "", "endpoint", 10, "endpoint"),
]


def _matches(text: Column, part: Part) -> Column:
    """An array of (before, length, size, mixed) per match: the piece before it, its length, the deciding length."""
    found = F.regexp_extract_all(text, F.lit(part.pattern), F.lit(0))
    pieces = F.split(text, part.pattern, -1)
    size = (lambda m: F.length(F.regexp_extract(m, part.pattern, part.group))) if part.group else F.length
    mixed = (lambda m: (F.length(m) == 40) & m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]")) if part.weak == "key" else (lambda m: F.lit(True))
    each = F.transform(found, lambda m, i: F.struct(
        F.length(F.get(pieces, i)).alias("before"), F.length(m).alias("length"), size(m).alias("size"), mixed(m).alias("mixed")))
    return F.when(text.rlike(part.pattern), each)


def scan(docs: DataFrame, *keep: Column, text: str = "text") -> DataFrame:
    """``row``, the ``keep`` columns and one array of matches per part, written once."""
    body = F.coalesce(F.col(text), F.lit(""))
    arrays = [_matches(body, p).alias(p.weak) for p in PARTS]
    return cut_lineage(docs.select(F.monotonically_increasing_id().alias("row"), *keep, *arrays))


def found_spans(scanned: DataFrame, reach: int = REACH) -> DataFrame:
    """``row, kind, start, end, base``: base findings and the weak candidates that are linked."""
    # One row per match; the arrays of all parts are put together, each with its part's number.
    number = lambda n: lambda m: F.struct(F.lit(n).alias("part"), m.alias("m"))
    tagged = [F.transform(F.coalesce(F.col(p.weak), F.array()), number(n)) for n, p in enumerate(PARTS)]
    each = scanned.select("row", F.posexplode(F.concat(*tagged)).alias("pos", "x")).select("row", "pos", "x.part", "x.m.*")
    upto = Window.partitionBy("row", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("before") + F.col("length")).over(upto)
    each = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("length"))
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("part") + 1)
    base = (pick([p.base for p in PARTS]) != "") & (F.col("size") >= pick([p.least for p in PARTS]))
    weak = ~base & (F.col("size") >= pick([p.weak_least for p in PARTS])) & F.col("mixed")
    parts = each.withColumn("base", base).filter(base | weak).select(
        "row", "start", "end", "base", pick([p.role for p in PARTS]).alias("role"),
        F.when(F.col("base"), pick([p.base for p in PARTS])).otherwise(pick([p.weak for p in PARTS])).alias("kind"))
    order = Window.partitionBy("row").orderBy("start", "end", "kind")
    before, behind = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)

    def near(role: str) -> Column:
        last = F.max(F.when(F.col("role") == role, F.col("end"))).over(before)
        following = F.min(F.when(F.col("role") == role, F.col("start"))).over(behind)
        return F.coalesce(F.col("start") - last <= reach, F.lit(False)) | F.coalesce(following - F.col("end") <= reach, F.lit(False))

    linked = F.when(F.col("role") == "identifier", near("secret")).when(F.col("role") == "secret", near("identifier")).otherwise(near("secret") & near("identifier"))
    return parts.withColumn("linked", linked).filter("base OR linked").select("row", "kind", "start", "end", "base")


def report(docs: DataFrame, reach: int = REACH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` (kind:start:end, code points)."""
    scanned = scan(docs, F.col(doc_id).alias("doc_id"), text=text)
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    name = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    spans = found_spans(scanned, reach).withColumn("s", F.struct("start", place.alias("place"), "base", "kind", name.alias("name")))
    per_row = spans.groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("s"))
    both = scanned.select("row", "doc_id").join(per_row, "row", "left").withColumn("s", F.coalesce("s", F.filter(F.array(F.lit(None).cast(per_row.schema["s"].dataType.elementType)), lambda x: F.lit(False))))
    count = lambda kind: F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    names = lambda s: F.concat_ws(",", F.transform(s, lambda x: x["name"]))
    return both.select("doc_id", count("assign"), count("access"), count("hex"),
                       F.sha2(names(F.filter("s", lambda x: x["base"])), 256).alias("base_sha256"), names(F.col("s")).alias("spans"))


def redact(docs: DataFrame, marker: str = "[SECRET]", reach: int = REACH, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with every found span replaced by ``marker`` (overlapping spans by one) and the length column renewed.

    Rows without a span stay as they are. Spans depend on the text alone, so they meet the documents by two 64-bit digests of it.
    """
    digests = [F.xxhash64(F.col(text)), F.xxhash64(F.lit(marker), F.col(text))]
    any_part = F.greatest(*[F.coalesce(F.size(p.weak), F.lit(0)) for p in PARTS]) > 0
    scanned = scan(docs.select(F.col(text).alias("body")), *[d.alias(f"d{i}") for i, d in enumerate([F.xxhash64("body"), F.xxhash64(F.lit(marker), F.col("body"))])], text="body")
    touched = scanned.filter(any_part)
    earlier = Window.partitionBy("row").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    cuts = found_spans(touched, reach).withColumn("from", F.coalesce(F.max("end").over(earlier), F.lit(0)))
    cuts = cuts.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "from", "end"))).alias("cuts"), F.max("end").alias("rest"))
    cuts = cut_lineage(touched.select("row", "d0", "d1").join(cuts, "row").drop("row").dropDuplicates(["d0", "d1"]))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *[d.alias(f"e{i}") for i, d in enumerate(digests)])
    both = join_small(packed, cuts, (F.col("d0") == F.col("e0")) & (F.col("d1") == F.col("e1")), "left")
    body = F.col(f"doc.`{text}`")
    piece = lambda c: F.when(c["start"] >= c["from"], F.concat(body.substr(c["from"].cast("int") + 1, (c["start"] - c["from"]).cast("int")), F.lit(marker))).otherwise("")
    fresh = F.concat(F.array_join(F.transform("cuts", piece), ""), body.substr(F.col("rest").cast("int") + 1, F.length(body)))
    out = both.withColumn("fresh", F.when(F.col("cuts").isNotNull(), fresh))
    renewed = {text: F.col("fresh"), length: F.length("fresh").cast(dict(docs.dtypes).get(length, "bigint"))}
    return out.select(*[(F.when(F.col("fresh").isNotNull(), renewed[c]).otherwise(F.col(f"doc.`{c}`")) if c in renewed else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
