"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Targets: sources in code point order (null last) weigh 3, 1, 2, repeating, and
share EPOCHS of all words; a target stops at CAP times its source's words, the
excess is shared again by weight until no target is above. The targets are then
divided into blocks of BLOCK words, given to sources by the highest quotients
target / (2k + 1); each source's blocks are given to its shards in the same
way. Within a shard, documents stand in seeded order, the shard's blocks follow
that order, and the quota takes them from the front, beginning again at its end.

Bounds: what reaches the driver is one row per source, at most MAX_SOURCES
(more raise an error: a mixture names its sources). Shards hold about SHARD_ROWS
rows of all sources, so a source with a third of all rows is dealt over all shards.

Defined results: a null text has no words; a document without words has taken 0;
a null source is a source of its own. Documents that repeat an id, or have none, are rows of
their own; they are dealt to shards by id and text, so only equal texts of one id meet in one. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, numbered

WEIGHTS = (3, 1, 2)
EPOCHS = Fraction(3, 2)
CAP = 2
BLOCK = 8
SHARD_ROWS = 1024
MAX_SHARDS = 1 << 20
MAX_SOURCES = 100_000
SEED = 20
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: tuple = WEIGHTS, epochs: Fraction = EPOCHS, cap: int = CAP) -> list[Fraction]:
    """Each source's share by weight, none above ``cap`` times its size while others can take more."""
    weight = [Fraction(weights[i % len(weights)]) for i in range(len(sizes))]
    out: list = [None] * len(sizes)
    left, open_ = epochs * sum(sizes), set(range(len(sizes)))
    while open_:
        rate = left / sum(weight[i] for i in open_)
        full = [i for i in open_ if weight[i] * rate > cap * sizes[i]]
        if not full:
            for i in open_:
                out[i] = weight[i] * rate
            break
        for i in full:
            out[i] = Fraction(cap * sizes[i])
            left -= out[i]
            open_.remove(i)
    return out


def sainte_lague(votes: list, seats: int, most: list[int]) -> list[int]:
    """Seats by the highest quotients votes / (2k + 1), none above ``most``; ties go to the earlier party."""
    n = len(votes)
    v, cap = np.array([float(x) for x in votes]), np.array(most, np.int64)
    cap = np.where(v > 0, cap, 0)
    seats = min(seats, int(cap.sum()))
    if seats <= 0:
        return [0] * n
    low, high = 0.0, 2 * float(v.sum())
    won = np.zeros(n, np.int64)
    for _ in range(200):
        middle = (low + high) / 2
        if not low < middle < high:
            break
        got = np.minimum(np.floor(v / middle + 0.5), cap).astype(np.int64)
        if got.sum() <= seats:
            high, won = middle, got
        else:
            low = middle
    won = np.maximum(won - 1, 0)  # the last ones are given exactly
    exact = [Fraction(x) for x in votes]
    heap = [(-exact[i] / (2 * int(won[i]) + 1), i) for i in range(n) if won[i] < cap[i]]
    heapq.heapify(heap)
    for _ in range(seats - int(won.sum())):
        i = heapq.heappop(heap)[1]
        won[i] += 1
        if won[i] < cap[i]:
            heapq.heappush(heap, (-exact[i] / (2 * int(won[i]) + 1), i))
    return won.tolist()


def _shard_quotas(cells: pd.DataFrame) -> pd.DataFrame:
    """One source's quota over its shards."""
    cells = cells.sort_values("shard")
    words = [int(x) for x in cells["words"]]
    quota = sainte_lague(words, int(cells["quota"].iloc[0]), [-(-CAP * w // BLOCK) for w in words])
    return pd.DataFrame({"src": cells["src"], "shard": cells["shard"], "words": cells["words"], "take": [min(q * BLOCK, CAP * w) for q, w in zip(quota, words, strict=True)]})


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken."""
    return _planned(docs, id_col, text_col, source_col, seed).select("doc_id", "size", "source_size", "target", "taken")


def _planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, row: str | None = None) -> DataFrame:
    """The plan, with the numbers in the column ``row`` as row, which decide between equal rows."""
    spark = docs.sparkSession
    sized = docs.select(
        (F.col(row) if row else F.lit(0).cast("long")).alias("row"), F.xxhash64(F.col(text_col)).alias("key"),
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    sized = cut(sized, "mix-sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"a mixture of more than {MAX_SOURCES} sources")
    totals.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r.words for r in totals]
    target = targets(sizes)
    quotas = sainte_lague(target, round(sum(target) / BLOCK), [-(-CAP * s // BLOCK) for s in sizes])
    rows = sum(r.n for r in totals)
    shards = min(MAX_SHARDS, 1 << max(0, (rows - 1) // SHARD_ROWS).bit_length())
    schema = "src long, source string, source_size long, target double, quota long"
    sources = spark.createDataFrame([(i, r.source, r.words, float(t), q) for i, (r, t, q) in enumerate(zip(totals, target, quotas, strict=True))], schema)
    dealt = sized.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "key"), F.lit(shards)))
    dealt = dealt.join(F.broadcast(sources), dealt["source"].eqNullSafe(sources["source"])).drop("source")
    cells = dealt.groupBy("src", "shard").agg(F.sum("size").alias("words"), F.first("quota").alias("quota"))
    cells = cells.groupBy("src").applyInPandas(_shard_quotas, "src long, shard long, words long, take long")
    dealt = dealt.drop("quota").join(cells, ["src", "shard"])
    order = Window.partitionBy("src", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "key"), "doc_id", "key", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    dealt = dealt.withColumn("end", F.sum("size").over(order))
    whole = F.when(F.col("words") > 0, F.expr("take div words")).otherwise(0)
    rest = F.when(F.col("words") > 0, F.expr("take % words")).otherwise(0)
    part = F.greatest(F.lit(0), F.least("end", rest) - (F.col("end") - F.col("size")))
    return dealt.select("row", "doc_id", "size", "source_size", "target", (whole * F.col("size") + part).cast("long").alias("taken"))


def _first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its n-th word."""
    through = F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*+{WORD}"), F.lit(0))
    return F.array_join(F.slice(through, F.lit(1), n.cast("int")), "")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """The mixture itself: whole copies of the documents, and for a part of one its first words; all columns are kept."""
    own, own_row, own_size, own_taken, part = fresh(docs, "_id", "_row", "_size", "_taken", "_part")
    docs_in_order = numbered(docs, own_row)
    taken = _planned(docs_in_order, id_col, text_col, source_col, seed, own_row).where("taken > 0")
    taken = taken.select(F.col("row").alias(own), F.col("size").alias(own_size), F.col("taken").alias(own_taken))
    rows = docs_in_order.join(taken, F.col(own_row) == F.col(own))
    whole = F.expr(f"transform(sequence(1, cast({own_taken} div {own_size} as int)), x -> 0L)")
    none, rest = F.expr("cast(array() as array<bigint>)"), F.col(own_taken) % F.col(own_size)
    copies = F.concat(F.when(F.col(own_taken) >= F.col(own_size), whole).otherwise(none), F.when(rest > 0, F.array(rest)).otherwise(none))
    rows = rows.withColumn(part, F.explode(copies))
    cut_text = F.when(F.col(part) > 0, _first_words(F.col(text_col), F.col(part))).otherwise(F.col(text_col))
    rows = rows.withColumn(text_col, cut_text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(part) > 0, F.length(text_col).cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
