"""Near-duplicate detection by circulant MinHash, banding and exact Jaccard verification.

A first permutation sends every shingle to a slot of a ring; the second gives
each slot a rank, and coordinate k of a signature is the smallest rank after turning the
ring by k, so all coordinates of a shingle are one contiguous slice of the
ranks. Signatures of BANDS bands of ROWS coordinates meet in buckets: two sets
of similarity 0.85 share no band with probability (1 - 0.85^4)^24, about 2e-8. Sets of far more than SLOTS shingles agree in
most coordinates, so such texts all meet and the exact check tells them apart.

Equal sets are one class before banding (found by partial aggregation, so a large
group of copies sends a row per task). The smallest class of each bucket
leads it, and two classes that share a bucket share its leader. Full shingle sets of the classes that share a
bucket are written once. First every follower is verified against its leader alone, in blocks of LEADER_BLOCK: work in proportion to the
followers, which joins a group of near copies however large. Links are merged into components.

What is left are pairs of two followers of which one is not in its leader's component. The Jaccard distance
is a metric, so two sets whose distances to the leader differ by more than a link may span cannot be linked: followers are laid out in
rings of that width around the leader, and only blocks of the same or the next ring meet, all pairs of at most BLOCK by BLOCK
followers to a task, never two blocks of the leader's own component. No link between components is lost. A
task returns each class's link to the smallest class that it reaches in the task, never
pairs. Components are then found in rounds of joins.

Defined results: null, empty and wordless texts have no shingles and link with nothing
(their component is their own id); rows that repeat an id are rows of their own, with equal
results if their texts are equal; a null id is a component's id only if it has no
other. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, discard, fresh, give_back, in_batches, numbered, pieces, without
from .components import components
from .shingles import mix, sets

WIDTH = 5
PERCENT = 85
BANDS = 24
ROWS = 4
SLOTS = 1 << 20
SEED = 10
BLOCK = 256
LEADER_BLOCK = 64
BLOCK_SHINGLES = 1 << 20
COLUMNS = 8192
BATCH_BYTES = 1 << 20


def _ranks() -> np.ndarray:
    """The second permutation, continued so that every slice of a turn is contiguous."""
    order = np.random.default_rng(SEED).permutation(SLOTS).astype(np.uint32)
    return np.concatenate([order, order[: BANDS * ROWS]])


class Signer:
    """Signatures and band keys of shingle sets."""

    def __init__(self):
        self.turns = np.lib.stride_tricks.sliding_window_view(_ranks(), BANDS * ROWS)
        self.factors = np.random.default_rng(SEED + 1).integers(1, 2**63, ROWS, dtype=np.uint64) | np.uint64(1)
        self.band = np.arange(BANDS, dtype=np.uint64)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        slots = (mix(shingles + np.uint64(SEED)) >> np.uint64(44)).astype(np.int64)
        out = self.turns[slots[:4096]].min(0)
        for at in range(4096, len(slots), 4096):
            out = np.minimum(out, self.turns[slots[at : at + 4096]].min(0))
        return out

    def bands(self, shingles: np.ndarray) -> np.ndarray:
        rows = self.signature(shingles).reshape(BANDS, ROWS).astype(np.uint64)
        return mix((rows * self.factors).sum(1, dtype=np.uint64) + self.band).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    signer = Signer()
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
    for batch in batches:
        for piece in pieces(batch, 2, BATCH_BYTES):
            ids, keys, texts, rows = (c.to_pylist() for c in piece.columns)
            own = list(sets(texts, WIDTH))
            columns = [ids, keys, rows, [len(s) for s in own], [hashlib.blake2b(s.tobytes(), digest_size=20).digest() if len(s) else None for s in own], [signer.bands(s) if len(s) else [] for s in own]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "key", "row", "n_shingles", "digest", "bands"])


def overlaps(members: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of incidence matrices."""
    sizes = [len(s) for s in members]
    shingles, column, times = np.unique(np.concatenate(members), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(members)), sizes)
    shared = times > 1
    place = np.cumsum(shared) - 1
    held = shared[column]
    row, column = row[held], place[column[held]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(members), len(members)), np.float64)
    for at in range(0, int(shared.sum()), COLUMNS):
        i, j = np.searchsorted(column, [at, at + COLUMNS])
        part = np.zeros((len(members), COLUMNS), np.float32)
        part[row[i:j], column[i:j] - at] = 1
        out += part @ part.T
    return out


def local_roots(members: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """For each set the smallest position that it reaches over links of enough similarity."""
    sizes = np.array([len(s) for s in members], np.float64)
    both = overlaps(members)
    linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    np.fill_diagonal(linked, True)
    root = np.arange(len(members))
    while True:
        new = np.where(linked, root[None, :], len(members)).min(1)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def distances(leader: np.ndarray, members: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the intersection and of the union of a set with others."""
    sizes = np.array([len(m) for m in members], np.int64)
    flat = np.concatenate(members)
    held = leader[np.minimum(np.searchsorted(leader, flat), len(leader) - 1)] == flat
    both = np.add.reduceat(held.astype(np.int64), np.cumsum(sizes) - sizes)
    return both, sizes + len(leader) - both


def _members(tile: pa.Table) -> dict[int, np.ndarray]:
    """The sets of a task by class; a class may have been written more than once."""
    out: dict[int, np.ndarray] = {}
    for cids, blobs in zip(tile.column("cid").chunks, tile.column("shingles").chunks, strict=True):
        for k, cid in enumerate(cids.to_pylist()):
            if cid not in out:
                out[cid] = np.frombuffer(blobs[k].as_buffer(), np.uint64)
    return out


def _after(members: dict[int, np.ndarray]) -> None:
    """Give memory back after a task of many shingles."""
    if sum(map(len, members.values())) > BLOCK_SHINGLES // 8:
        give_back()


def _to_leader(percent: int):
    """Followers' rings around their leader, and whether they are linked to it."""

    def run(tile: pa.Table) -> pa.Table:
        lead = tile.column("lead")[0].as_py()
        members = _members(tile)
        leader = members.pop(lead)
        cids = sorted(members)
        if cids:
            both, union = distances(leader, [members[c] for c in cids])
            ring = np.floor((1 - both / union) / _ring(percent)).astype(np.int32)
            linked = 100 * both >= percent * union
        else:
            ring, linked = np.zeros(0, np.int32), np.zeros(0, bool)
        _after(members)
        return pa.table({"lead": pa.array([lead] * len(cids), pa.int64()), "cid": pa.array(cids, pa.int64()), "n": pa.array([len(members[c]) for c in cids], pa.int64()), "ring": pa.array(ring), "linked": pa.array(linked)})

    return run


def _ring(percent: int) -> float:
    """A width beyond the distance of a link, so that linked sets lie at most one ring apart."""
    return max((100 - percent) / 100, 0.01) * (1 + 1e-9)


def _verify(percent: int):
    def run(tile: pa.Table) -> pa.Table:
        members = _members(tile)
        cids = sorted(members)
        root = local_roots([members[c] for c in cids], percent)
        far = np.flatnonzero(root != np.arange(len(cids)))
        ids = np.array(cids, np.int64)
        _after(members)
        return pa.table({"u": pa.array(ids[far], pa.int64()), "v": pa.array(ids[root[far]], pa.int64())})

    return run


def _write_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()  # rows that repeat an id and a text
    for batch in batches:
        for piece in pieces(batch, 1, BATCH_BYTES):
            cids, texts = (c.to_pylist() for c in piece.columns)
            new = [k for k, c in enumerate(cids) if c not in seen and not seen.add(c)]
            blobs = [s.tobytes() for s in sets([texts[k] for k in new], WIDTH)]
            yield pa.RecordBatch.from_arrays([pa.array([cids[k] for k in new], pa.int64()), pa.array(blobs, pa.binary())], ["cid", "shingles"])


def near_classes(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    return _classes(docs, percent, id_col, text_col).select("doc_id", "n_shingles", "component_id", "kept")


def _followers(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classes of equal sets, and (lead, cid, n) for those that share a bucket with a smaller one."""
    classes = signed.where("n_shingles > 0").groupBy("digest").agg(
        F.min("row").alias("cid"), F.min("doc_id").alias("low"), F.min(F.struct("doc_id", "key")).alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")
    )
    classes = cut(classes, "near-classes")
    banded = classes.select("cid", "n", F.posexplode("bands").alias("band", "hash"))
    buckets = cut(banded.groupBy("band", "hash").agg(F.min("cid").alias("lead"), F.count(F.lit(1)).alias("many")).where("many > 1").drop("many"), "near-buckets")
    followers = cut(banded.join(buckets.hint("merge"), ["band", "hash"]).where("cid <> lead").select("lead", "cid", "n").distinct(), "near-followers")
    discard(buckets)
    return classes, followers


def _sets(rows: DataFrame, classes: DataFrame, followers: DataFrame) -> DataFrame:
    """The shingle sets of leaders and followers, from a second reading of the texts: (cid, shingles)."""
    wanted = followers.select("cid").union(followers.select(F.col("lead").alias("cid"))).distinct().join(classes.select("cid", "rep"), "cid")
    wanted = cut(wanted.select("cid", F.col("rep.doc_id").alias("want_id"), F.col("rep.key").alias("want_key")), "near-wanted")
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted.hint("merge")
    texts = rows.join(few, rows["doc_id"].eqNullSafe(F.col("want_id")) & (F.col("key") == F.col("want_key"))).select("cid", "text")
    found = cut(in_batches(texts, _write_sets, "cid long, shingles binary"), "near-sets")
    discard(wanted)
    return found


def _led(followers: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """(lead, cid, n, ring, linked) of all followers."""
    groups = cut(followers.groupBy("lead").agg(_blocks(LEADER_BLOCK).alias("blocks")), "near-groups")
    own = followers.join(groups.hint("merge"), "lead").select("lead", F.pmod(F.xxhash64("cid"), F.col("blocks")).alias("block"), "cid")
    lead = groups.select("lead", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("lead").alias("cid"))
    tiles = own.unionByName(lead).join(found.hint("merge"), "cid")
    out = cut(tiles.groupBy("lead", "block").applyInArrow(_to_leader(percent), "lead long, cid long, n long, ring int, linked boolean"), "near-led")
    discard(groups)
    return out


def _blocks(size: int) -> Column:
    """Blocks of a group, by sets and by their shingles."""
    return F.ceil(F.greatest(F.count(F.lit(1)) / size, F.sum("n") / BLOCK_SHINGLES))


def _open_tiles(led: DataFrame, labels: DataFrame) -> DataFrame:
    """(cid, tile) for every pair of blocks of a leader's followers that may hold a link between two components."""
    component = labels.select(F.col("node"), F.col("label.cid").alias("of"))
    placed = led.join(component.hint("merge"), F.col("cid") == F.col("node"), "left").select("lead", "cid", "n", "ring", F.coalesce("of", "cid").alias("own"))
    placed = placed.join(component.hint("merge"), F.col("lead") == F.col("node"), "left").select("lead", "cid", "n", "ring", (F.col("own") == F.coalesce("of", "lead")).alias("same"))
    placed = cut(placed, "near-placed")
    cells = placed.groupBy("lead", "same", "ring").agg(F.count(F.lit(1)).alias("n"), _blocks(BLOCK).alias("blocks"))
    cells = cells.groupBy("lead").agg(F.collect_list(F.struct("same", "ring", "n", "blocks")).alias("cells"))
    cells = cut(cells.where(F.exists("cells", lambda c: ~c["same"])), "near-cells")  # at most two cells a ring, and few rings
    members = placed.drop("n").join(cells.hint("merge"), "lead")
    mine = F.filter("cells", lambda c: (c["same"] == F.col("same")) & (c["ring"] == F.col("ring")))
    members = members.withColumn("block", F.pmod(F.xxhash64("cid"), F.element_at(mine, 1)["blocks"]))
    alone = lambda c: (c["ring"] == F.col("ring")) & (c["same"] == F.col("same")) & (c["n"] == 1)
    near = F.filter("cells", lambda c: (F.abs(c["ring"] - F.col("ring")) <= 1) & ~(c["same"] & F.col("same")) & ~alone(c))
    here = F.struct("same", "ring", "block")

    def with_blocks(c: Column) -> Column:
        there = F.transform(F.sequence(F.lit(0).cast("long"), c["blocks"] - 1), lambda k: F.struct(c["same"].alias("same"), c["ring"].alias("ring"), k.alias("block")))
        return F.transform(there, lambda t: F.struct(F.least(here, t).alias("x"), F.greatest(here, t).alias("y")))

    tiles = members.select("cid", "lead", F.explode(F.flatten(F.transform(near, with_blocks))).alias("t"))
    return tiles.select("cid", F.struct("lead", "t.x", "t.y").alias("tile"))


def _classes(docs: DataFrame, percent: int, id_col: str, text_col: str, row_col: str | None = None) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("text"), (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"))
    signed = cut(in_batches(rows, _sign, "doc_id long, key long, row long, n_shingles long, digest binary, bands array<long>"), "near-signed")
    classes, followers = _followers(signed)
    found = _sets(rows, classes, followers)
    led = _led(followers, found, percent)
    values = classes.select(F.col("cid").alias("node"), F.struct(F.col("low").isNull().alias("none"), "low", "cid").alias("value"))
    labels = components(led.where("linked").select(F.col("cid").alias("u"), F.col("lead").alias("v")), values)
    dealt = _open_tiles(led, labels).join(found.hint("merge"), "cid")
    links = cut(dealt.groupBy("tile").applyInArrow(_verify(percent), "u long, v long").distinct(), "near-links")
    if not links.isEmpty():
        before = labels
        labels = components(links.union(before.where("node <> label.cid").select("node", "label.cid")), values)
        discard(before)
    named = classes.select("digest", "cid", "low").join(labels, F.col("cid") == F.col("node"), "left")
    named = cut(named.select("digest", F.when(F.col("node").isNull(), F.col("low")).otherwise(F.col("label.low")).alias("component_id"), F.coalesce("label.cid", "cid").alias("root")), "near-named")
    discard(followers, found, led, links, labels, classes)
    out = signed.select("doc_id", "key", "row", "n_shingles", "digest").join(named.hint("merge"), "digest", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "key", "row", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "root")


def deduplicate(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, with all their columns: the smallest id (null last), then the smallest hash of the text.

    Rows without words are components of their own, one of each id and text."""
    (own,) = fresh(docs, "_row")
    rows = numbered(docs, own)
    return without(rows, own, lambda: _copies(rows, percent, id_col, text_col, own))


def _copies(rows: DataFrame, percent: int, id_col: str, text_col: str, own: str) -> DataFrame:
    """Numbers of the rows that go."""
    alone = lambda name: F.when(F.col("root").isNull(), F.col(name))
    found = cut(_classes(rows, percent, id_col, text_col, own).select("row", "root", alone("doc_id").alias("own_id"), alone("key").alias("own_key"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "row").alias("place")), "near-found")
    first = found.groupBy("root", "own_id", "own_key").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("many")).where("many > 1")
    first = first.select(F.col("root").alias("of"), F.col("own_id").alias("of_id"), F.col("own_key").alias("of_key"), F.col("first.row").alias("stays"))
    group = F.col("root").eqNullSafe(F.col("of")) & F.col("own_id").eqNullSafe(F.col("of_id")) & F.col("own_key").eqNullSafe(F.col("of_key"))
    return found.join(first.hint("merge"), group).where("row <> stays").select("row")
