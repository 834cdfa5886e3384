"""Exact deduplication by distributed MSD radix partitioning.

Documents are split by successive bytes until a group holds one document or its
bytes have ended; documents that end in the same group are equal, so equality
needs no digest. Digits grow from 32 bytes by a factor of 16, so a text of n
bytes takes about log16(n / 32) rounds, and each byte is dealt out once.

Skew: equal texts first meet inside an input task (by the same recursion, in
memory bounded by FLUSH_BYTES), so that a group of copies, however large, sends
one row for each buffer. The rows of a digit are counted with partial
aggregation and joined back by a join that Spark may split.

Defined results: a null text counts as empty; empty texts are one group. The row
with the largest doc_id stays (null is the smallest); of repeated rows with that
doc_id one stays. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, fresh, in_batches, numbered, pieces, without

FIRST_DIGIT = 32
GROWTH = 16
FLUSH_BYTES = 12 << 20

_LOCAL = "rep long, body binary, members array<long>, rows array<long>, top long, n long, sha string"


def radix_groups(texts: list[bytes], start: int = 0, width: int = FIRST_DIGIT) -> list[list[int]]:
    """Positions of equal texts, by MSD radix recursion over digits of growing width."""
    out, todo = [], [(list(range(len(texts))), start, width)]
    while todo:
        rows, at, wide = todo.pop()
        if len(rows) == 1:
            out.append(rows)
            continue
        buckets: dict[bytes, list[int]] = {}
        for i in rows:
            buckets.setdefault(texts[i][at : at + wide], []).append(i)
        for digit, group in buckets.items():
            if len(group) == 1 or len(digit) < wide:
                out.append(group)
            else:
                todo.append((group, at + wide, wide * GROWTH))
    return out


def _local_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each distinct text of a buffer, with the ids that have it."""
    schema = pa.schema([("rep", pa.int64()), ("body", pa.binary()), ("members", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64())), ("top", pa.int64()), ("n", pa.int64()), ("sha", pa.string())])
    serial = TaskContext.get().partitionId() << 33
    ids: list = []
    numbers: list = []
    texts: list[bytes] = []
    held = 0

    def flush() -> pa.RecordBatch:
        nonlocal serial, held
        rows = []
        for group in radix_groups(texts):
            members = [ids[i] for i in group]
            body = texts[group[0]]
            known = [m for m in members if m is not None]
            rows.append((serial, body, members, [numbers[i] for i in group], max(known) if known else None, len(members), hashlib.sha256(body).hexdigest()))
            serial += 1
        ids.clear()
        numbers.clear()
        texts.clear()
        held = 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types, strict=True)], schema=schema)

    for batch in batches:
        for piece in pieces(batch, 1, FLUSH_BYTES):
            for i, t, row in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                ids.append(i)
                numbers.append(row)
                texts.append(t or b"")
                held += len(texts[-1])
                if held >= FLUSH_BYTES:
                    yield flush()
    if ids:
        yield flush()


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return _classes(docs, id_col, text_col, F.lit(None)).drop("row")


def _classes(docs: DataFrame, id_col: str, text_col: str, row: Column) -> DataFrame:
    """The same, with the number of each row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("body"), row.cast("long").alias("row"))
    local = cut(in_batches(rows, _local_classes, _LOCAL), "exact-local")
    named = cut(local.select("rep", "members", "rows", F.col("sha").alias("text_sha256")), "exact-members")
    before = local
    active = local.select("rep", F.lit(-1).cast("long").alias("node"), F.col("body").alias("rest"), F.struct("top", F.col("rep").alias("by")).alias("best"), "n")
    done, width = [], FIRST_DIGIT
    while True:
        keyed = active.select(
            "rep", "node", F.substring("rest", 1, width).alias("digit"), F.expr(f"substring(rest, {width + 1})").alias("rest"), "best", "n"
        )
        groups = keyed.groupBy("node", "digit").agg(
            F.min("rep").alias("child"), F.max("best").alias("of_all"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("reps")
        )
        groups = cut(groups.where("reps > 1").drop("reps"), "exact-groups")
        ended = F.col("child").isNull() | (F.octet_length("digit") < width)
        state = keyed.join(groups.hint("merge"), ["node", "digit"], "left").select(
            "rep", F.coalesce("child", "rep").alias("node"), F.when(~ended, F.col("rest")).alias("rest"), "best",
            "n", F.coalesce("of_all", "best").alias("of_all"), F.coalesce("total", "n").alias("total"), ended.alias("ended"),
        )
        state = cut(state, "exact-state")
        ends = state.where("ended").select("rep", F.col("of_all.top").alias("keep_id"), F.col("of_all.by").alias("keep_rep"), F.col("total").alias("group_size"))
        done.append(cut(ends, "exact-ends"))
        discard(groups, before)
        before, active = state, state.where("not ended").select("rep", "node", "rest", "best", "n")
        if active.isEmpty():
            break
        width *= GROWTH
    discard(before)
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    first = F.coalesce(F.expr("array_position(members, keep_id)"), F.lit(1)) - 1
    out = named.join(found, "rep")
    out = out.select("*", F.posexplode("members").alias("at", "doc_id"))
    kept = (F.col("rep") == F.col("keep_rep")) & (F.col("at") == first)
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", F.get("rows", F.col("at")).alias("row"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of repeated rows of a kept document one stays."""
    (own,) = fresh(docs, "_row")
    rows = numbered(docs, own)
    return without(rows, own, lambda: _classes(rows, id_col, text_col, F.col(own)).where("not kept").select("row"))
