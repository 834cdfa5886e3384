"""Personal data: patterns, and terms that reveal what the patterns found. DataFrame functions only.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers.
Each distinct value is a protected entity. Words of the documents that mention it,
wherever they stand, may reveal it: over the corpus, with documents
as the unit, PMI(e; t) = log2(n(e, t) n / (n(e) n(t))) says how much a term tells
of an entity and IC(e) = -log2(n(e) / n) how much there is to tell. Their
quotient is the disclosure, 1 + log2(n(e, t) / n(t)) / IC(e). Few documents say little of
n(e, t) / n(t), so it is smoothed towards n(e) / n, its value if term and entity had nothing
to do with each other, with the weight of PRIOR documents; no value is too rare to be
protected. From GENERALISE on a term is generalised, from REMOVE on it is removed,
wherever it stands in a document that mentions that entity. Documents without a base span are
left alone.

Values that stand in the same documents have the same n(e, t) for all terms, so they are one
group: pairs are counted by group, and a list of addresses of one document costs as much as
one address.

Patterns are written so that the regex engine neither recurses nor tries a
run of characters again from its middle; they match what the plain patterns match.

Defined results: a null text counts as empty and has no spans; offsets are code points,
end exclusive; rows that repeat an id are rows of their own and count as documents. Empty
tables give empty results. Other columns are not read by ``detect``; ``sanitise`` keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

KINDS = ("email", "ip", "card", "phone")
TERM_KINDS = ("generalised", "removed")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character without which a text has no match of the kind.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
TERM = r"\p{L}{3,}"
STEP = 256
PRIOR = 0.5
GENERALISE = 0.8
REMOVE = 0.95

_SPAN = "struct<kind:int,start:int,end:int,value:string>"


def _before(numbers: Column) -> Column:
    """For each of some integers the sum of those before it: sums run within blocks of STEP, then over the blocks, so that a
    place costs no more where there are many."""

    def run(xs: Column) -> Column:
        start = F.struct(F.lit(0).alias("total"), F.expr("cast(array() as array<int>)").alias("before"))
        return F.aggregate(xs, start, lambda s, x: F.struct((s["total"] + x).alias("total"), F.concat(s["before"], F.array(s["total"])).alias("before")))

    blocks = F.transform(_block_numbers(numbers), lambda k: run(F.slice(numbers, k * STEP + 1, F.lit(STEP))))
    whole = lambda b: F.zip_with(b, run(F.transform(b, lambda x: x["total"]))["before"], lambda x, at: F.transform(x["before"], lambda n: n + at))
    return F.flatten(F.flatten(F.transform(F.array(blocks), whole)))


def _block_numbers(values: Column) -> Column:
    return F.sequence(F.lit(0), F.floor(F.size(values) / STEP).cast("int"))


def located(text: Column, pattern: str) -> Column:
    """Leftmost matches that do not overlap, as (hit, start, end): the gaps between them give their places."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    found = F.struct(hits.alias("hits"), gaps.alias("gaps"), F.transform(hits, lambda h: F.length(h)).alias("sizes"))

    def place(f: Column) -> Column:
        first = F.slice(f["gaps"], F.lit(1), F.size(f["hits"]))
        both = F.zip_with(first, f["sizes"], lambda g, h: g + h)
        starts = F.flatten(F.transform(F.array(both), lambda b: F.zip_with(_before(b), first, lambda s, g: s + g)))
        return F.zip_with(f["hits"], starts, lambda h, s: F.struct(h.alias("hit"), s.alias("start"), (s + F.length(h)).alias("end")))

    empty = F.expr("cast(array() as array<struct<hit:string,start:int,end:int>>)")
    spans = F.flatten(F.transform(F.array(found), place))  # the array of one keeps the matches from being searched for again
    return F.when(F.regexp_like(text, F.lit(pattern)), spans).otherwise(empty)


def _luhn(hit: Column) -> Column:
    digits = F.regexp_replace(hit, r"[\x20-]", "")
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), value), F.lit(0), lambda s, x: s + x) % 10 == 0


def _holds(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: F.regexp_like(p, F.lit(r"^0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])$")))
    if kind == "card":
        return _luhn(hit)
    if kind == "phone":
        return F.length(F.regexp_replace(hit, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def _of_kind(text: Column, k: int, kind: str) -> Column:
    spans = F.filter(located(text, PATTERNS[kind]), lambda s: _holds(kind, s["hit"]))
    return F.transform(spans, lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lower(s["hit"]).alias("value")))


def base_spans(text: Column) -> Column:
    """The base spans of a text that is not null, by kind and start: (kind, start, end, value)."""
    none = F.expr(f"cast(array() as array<{_SPAN}>)")
    parts = []
    for k, kind in enumerate(KINDS):
        spans = _of_kind(text, k, kind)
        parts.append(F.when(F.contains(text, F.lit(NEEDS[kind])), spans).otherwise(none) if NEEDS[kind] else spans)
    return F.concat(*parts)


def _terms(text: Column) -> Column:
    """The words of a text outside its e-mail addresses, the only base spans that hold letters: (term, start, end)."""

    def outside(f: Column) -> Column:
        sizes = F.zip_with(F.transform(f["gaps"], lambda g: F.length(g)), F.transform(f["hits"], lambda h: F.length(h)), lambda g, h: g + F.coalesce(h, F.lit(0)))
        starts = F.flatten(F.transform(F.array(sizes), _before))
        of_gap = lambda g, at: F.transform(located(g, TERM), lambda s: F.struct(F.lower(s["hit"]).alias("term"), (s["start"] + at).alias("start"), (s["end"] + at).alias("end")))
        return F.flatten(F.zip_with(f["gaps"], starts, of_gap))

    pattern = PATTERNS["email"]
    found = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return F.flatten(F.transform(F.array(found), outside))


def _joined(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in (*KINDS, *TERM_KINDS)])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, n_terms, base_sha256, spans, found (all spans as an array),
    and the columns of ``keep`` as keep_0, keep_1 and so on."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)])
    base = rows.withColumn("base", base_spans(F.col("text")))
    nothing = F.expr("cast(array() as array<struct<term:string,start:int,end:int>>)")
    base = base.withColumn("words", F.when(F.size("base") > 0, _terms(F.col("text"))).otherwise(nothing)).drop("text")
    base = cut(base.withColumn("row", F.monotonically_increasing_id()), "pii-base")
    spans = cut(_risky(rows, base), "pii-risky")
    places = base.where(F.size("words") > 0).select("row", F.explode("words").alias("w")).select("row", "w.*")
    spans = places.join(spans.hint("merge"), ["row", "term"]).select("row", F.when(F.col("disclosure") >= REMOVE, len(KINDS) + 1).otherwise(len(KINDS)).alias("kind"), "start", "end", "term")
    spans = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end", F.col("term").alias("value")))).alias("terms"))
    out = base.join(cut(spans, "pii-terms").hint("merge"), "row", "left")
    terms = F.coalesce("terms", F.expr(f"cast(array() as array<{_SPAN}>)"))
    out = out.withColumn("found", F.concat("base", terms))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        "doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)], F.size(terms).cast("long").alias("n_terms"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"), "found", *[f"keep_{i}" for i in range(len(keep))],
    )


def _risky(rows: DataFrame, base: DataFrame) -> DataFrame:
    """The terms of a row that tell of a value in it with a disclosure of at least GENERALISE, and the highest one: (row, term, disclosure)."""
    total = base.count()
    held = base.where(F.size("base") > 0)
    values = held.select("row", F.explode(F.array_distinct(F.transform("base", lambda s: s["value"]))).alias("value"))
    # values of the same documents are a group, known by the number of documents and hashes of them all
    marks = [F.bit_xor(F.xxhash64("row")), F.bit_xor(F.xxhash64("row", F.lit(1)))]
    entities = cut(values.groupBy("value").agg(F.count(F.lit(1)).alias("n_e"), F.struct(F.min("row"), F.max("row"), *marks, F.count(F.lit(1))).alias("group")), "pii-entities")
    groups = values.join(entities.hint("merge"), "value").select("row", "n_e", "group").distinct()
    groups = groups.groupBy("row").agg(F.collect_list(F.struct("group", "n_e")).alias("groups"))
    own = held.select("row", F.array_distinct(F.transform("words", lambda w: w["term"])).alias("own")).where(F.size("own") > 0)
    near = cut(own.join(groups.hint("merge"), "row"), "pii-near")
    near = near.select("row", "own", F.explode("groups").alias("g")).select("row", "g.*", F.explode("own").alias("term"))
    pairs = cut(near.groupBy("group", "n_e", "term").agg(F.count(F.lit(1)).alias("n_et")), "pii-pairs")
    words = rows.select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), lambda w: F.lower(w)))).alias("term"))
    terms = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    terms = cut(terms.join(pairs.select("term").distinct(), "term", "left_semi"), "pii-words")
    joint = pairs.join(terms.hint("merge"), "term")
    share = F.col("n_e") / F.lit(float(max(1, total)))
    given = (F.col("n_et") + PRIOR * share) / (F.col("n_t") + PRIOR)
    scored = joint.select("group", "term", F.when(share < 1, 1 - F.log2(given) / F.log2(share)).otherwise(0.0).alias("disclosure"))
    scored = cut(scored.where(F.col("disclosure") >= GENERALISE), "pii-scored")
    return near.join(scored.hint("merge"), ["group", "term"]).groupBy("row", "term").agg(F.max("disclosure").alias("disclosure"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with base spans replaced by their kind, generalised terms by ``[TERM]``, removed ones by nothing."""
    found = detect(docs, id_col, text_col, keep=tuple(docs.columns))
    label = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS], F.lit("[TERM]"), F.lit(""))
    order = F.array_sort(F.transform("found", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    held = {c: F.col(f"keep_{i}") for i, c in enumerate(docs.columns)}
    text = F.coalesce(held[text_col], F.lit(""))

    def step(part: Column, begin: Column):
        def run(state: Column, s: Column) -> Column:
            piece = F.array(F.substring(part, state["at"] - begin + 1, s["start"] - state["at"]), F.element_at(label, s["kind"] + 1))
            return F.when(s["start"] >= state["at"], F.struct((-s["back"]).alias("at"), F.concat(state["out"], piece).alias("out"))).otherwise(state)

        return run

    def block(state: Column, spans: Column) -> Column:
        # a block's part of the text is cut out once, as cutting counts characters from the start
        part = F.substring(text, state["at"] + 1, F.array_max(F.transform(spans, lambda s: -s["back"])) - state["at"])
        whole = F.transform(F.array(part), lambda p: F.aggregate(spans, F.struct(state["at"].alias("at"), F.expr("cast(array() as array<string>)").alias("out")), step(p, state["at"])))
        joined = F.transform(whole, lambda w: F.struct(w["at"].alias("at"), F.concat(state["out"], F.array(F.array_join(w["out"], ""))).alias("out")))
        return F.when(F.size(spans) > 0, F.element_at(joined, 1)).otherwise(state)

    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    blocks = F.flatten(F.transform(F.array(order), lambda o: F.transform(_block_numbers(o), lambda k: F.slice(o, k * STEP + 1, F.lit(STEP)))))
    clean = F.aggregate(blocks, start, block, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text))))
    return found.select(*[(F.when(held[c].isNotNull(), clean) if c == text_col else held[c]).alias(c) for c in docs.columns])
