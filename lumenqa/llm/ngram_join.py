"""Near-duplicate join on word shingles: MinHash candidates, Bayesian pruning, exact verification.

Documents are sets of five-word shingles (a text of one to four words is one shingle; words are as written).
Copies, which have equal sets, form a class; the rest works on one row a class.

1. Every class gets 128 MinHash values. Bands of four, 24 of them, propose pairs: a pair of similarity 0.8 is
   missed with a chance of 0.59^24 = 3e-6, one of 0.9 with 3e-11.
2. Classes of a bucket are compared value by value, 16, 32, 64 and then 128 (one byte each): after each step a
   pair is dropped once the posterior probability that its similarity reaches the threshold, under a uniform
   prior, is below ``tolerance``. What survives is joined into candidate groups.
3. Within each candidate group the exact Jaccard similarity of every pair is computed on whole shingle sets.
   Verified pairs give the classes (connected components) and the number of links of each document.

Large buckets and groups are dealt into blocks, and pairs of blocks to tasks, so no task holds a whole group. A
bucket's blocks have about BUCKET_BLOCK rows of 128 bytes, a group's about GROUP_BLOCK rows and GROUP_BYTES of
shingles, so a group of m classes ships each of its sets about m / GROUP_BLOCK times, or once up to that size.
A task never emits pairs: it returns a spanning star of what it linked and a count of links per class, so
output stays linear while no link is lost. There is no cap on bucket, group or text size.

Class nodes are 64 bits of a BLAKE2b digest of the shingle set; sets that share them but not the next 64 get nodes
of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenqa.llm import bitset
from lumenqa.llm import words as W
from lumenqa.llm.components import connected_components
from lumenqa.llm.rowkeys import NO_ID, keys_of, row_key, rows_hit
from lumenqa.llm.workspace import Workspace, extended, text_bytes, text_slices

SHINGLE, VALUES, BANDS, BAND_ROWS = 5, 128, 24, 4
STEPS = (16, 32, 64, 128)
BUCKET_BLOCK, GROUP_BLOCK, GROUP_BYTES = 4096, 1024, 4_000_000
#: A class with at least one in HOT of all rows meets its rows by broadcast: there are at most HOT such classes.
HOT = 1000
PAIRS = 400_000
U = np.uint64


@cache
def multipliers() -> np.ndarray:
    return W.mix(np.arange(1, VALUES + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    found = W.split(data, offsets)
    counts = np.diff(found.first)
    places = W.window_places(found.first, size)
    hashes = W.window_hashes(found.hashes, places, size, W.WINDOW_BASES[0])
    n_long = np.where(counts >= size, counts - size + 1, 0)
    cuts = np.concatenate([[0], np.cumsum(n_long)])
    out = []
    for d in range(len(counts)):
        if n_long[d]:
            out.append(np.unique(hashes[cuts[d] : cuts[d + 1]]))
        elif counts[d]:
            lo, hi = found.first[d : d + 1], found.first[d + 1 : d + 2]
            out.append(W.mix(W.stretch_hashes(found.hashes, lo, hi, W.WINDOW_BASES[0]) + U(counts[d])))
        else:
            out.append(np.zeros(0, U))
    return out


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The least of each of VALUES keyed hashes, in bounded memory."""
    best = np.full(VALUES, ~U(0), U)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048, None] * multipliers()
        best = np.minimum(best, (part ^ (part >> U(29))).min(axis=0))
    return best


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, "text"):
            data, offsets = text_bytes(part.column("text"))
            d, k = keys_of(part, data, offsets)
            node, node2, n, bands, sigs = [], [], [], [], []
            for s in shingle_sets(data, offsets):
                n.append(len(s))
                if not len(s):
                    node.append(None), node2.append(None), bands.append(None), sigs.append(None)
                    continue
                low = minhash(s)
                for out, half in zip((node, node2), np.frombuffer(blake2b(s.tobytes(), digest_size=16).digest(), "<i8").tolist(), strict=True):
                    out.append(half)
                quads = low[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS)
                band = np.zeros(BANDS, U) + np.arange(1, BANDS + 1, dtype=U)
                for c in range(BAND_ROWS):
                    band = W.mix(band * U(0xD6E8FEB86659FD93) + quads[:, c])
                bands.append(band.view(np.int64))
                sigs.append(W.mix(low).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(d), pa.array(k), pa.array(row_key(d, k)), pa.array(node, pa.int64()), pa.array(node2, pa.int64()), pa.array(n, pa.int32()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                names=["d", "k", "key", "node", "node2", "n", "bands", "sig"],
            )


@cache
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For each step the least matches at which P(similarity >= threshold | matches) is not below tolerance.

    A byte of unlike values agrees once in 256, so p = s + (1 - s) / 256; the posterior of p is Beta(m+1, n-m+1).
    """
    p = threshold + (1 - threshold) / 256
    out = []
    for n in STEPS:
        tail, m = 0.0, 0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)
            if tail >= tolerance:
                break
        out.append(m)
    return tuple(out)


def surviving(sig: np.ndarray, i: np.ndarray, j: np.ndarray, least: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that no step drops; later values are looked at only for pairs that are left."""
    before, same = 0, np.zeros(len(i), np.int32)
    for upto, need in zip(STEPS, least, strict=True):
        same = same + (sig[i, before:upto] == sig[j, before:upto]).sum(axis=1, dtype=np.int32)
        left = same >= need
        i, j, same, before = i[left], j[left], same[left], upto
    return i, j


def least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each member's component."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        np.minimum.at(label, before[i], low)
        np.minimum.at(label, before[j], low)
        label = label[label]
        if (label == before).all():
            break
    return label


def deal(df: DataFrame, blocks: Column) -> DataFrame:
    """Rows of each group to pairs of its ``blocks``: (group, lo, hi) with every pair of rows together in one of them."""
    blocks = blocks.cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(3)), blocks).cast("int")
    dealt = df.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("blocks", "other")


def runs_of(batches: Iterator[pa.RecordBatch], names: list[str], many: int) -> Iterator[pa.Table]:
    """Sorted rows in tables that hold whole groups of equal ``names``, about ``many`` rows each."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        for at in range(0, batch.num_rows, many):
            held.append(batch.slice(at, many))
            rows += held[-1].num_rows
            if rows < many:
                continue
            table = pa.Table.from_batches(held)
            keys = [np.asarray(table.column(c)) for c in names]
            change = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))
            if len(change):
                cut = int(change[-1]) + 1
                yield table.slice(0, cut)
                held = table.slice(cut).to_batches()
                rows = table.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def compare_buckets(least: tuple[int, ...]):
    """Arrow function over rows sorted by (band, lo, hi): spanning stars (u, v) of the surviving pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_of(batches, ["band", "lo", "hi"], 20_000):
            band, lo, hi, own, node = (np.asarray(t.column(c)) for c in ("band", "lo", "hi", "own", "node"))
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, VALUES)
            new = np.concatenate([[True], (band[1:] != band[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
            ends = np.append(np.flatnonzero(new)[1:], len(new))
            end = ends[np.cumsum(new) - 1]
            found_i, found_j, rows, shift = [], [], np.arange(len(node)), 1
            while len(rows := rows[rows + shift < end[rows]]):
                pick = rows[(lo[rows] == hi[rows]) | (own[rows] != own[rows + shift])]
                for at in range(0, len(pick), PAIRS):
                    i, j = surviving(sig, pick[at : at + PAIRS], pick[at : at + PAIRS] + shift, least)
                    found_i.append(i), found_j.append(j)
                shift += 1
            i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_i, found_j))
            label = least_labels(len(node), i, j)
            far = np.flatnonzero(label != np.arange(len(node)))
            u, v = node[label[far]], node[far]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

    return run


def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, "text"):
            sets = [s.tobytes() for s in shingle_sets(*text_bytes(part.column("text")))]
            kept = [c for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(sets, pa.binary())], names=[*kept, "shingles"])


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``left`` shares with each of ``right``.

    Shingles that few pairs share are counted pair by pair, the others as a product of matrices.
    """
    g, h = len(left), len(right)
    a, b = np.concatenate(left), np.concatenate(right)
    owner_a, owner_b = np.repeat(np.arange(g), [len(s) for s in left]), np.repeat(np.arange(h), [len(s) for s in right])
    common = np.intersect1d(a, b)
    out = np.zeros((g, h))
    if not len(common):
        return out

    def placed(values, owner):
        at = np.minimum(np.searchsorted(common, values), len(common) - 1)
        hit = np.flatnonzero(common[at] == values)
        order = np.argsort(at[hit], kind="stable")
        return at[hit][order], owner[hit][order]

    (col_a, row_a), (col_b, row_b) = placed(a, owner_a), placed(b, owner_b)
    n_a, n_b = np.bincount(col_a, minlength=len(common)), np.bincount(col_b, minlength=len(common))
    dense = n_a * n_b > g * h / 400
    number = np.cumsum(dense) - 1
    for at in range(0, int(dense.sum()), 4096):
        width = min(4096, int(dense.sum()) - at)
        cells = []
        for n, col, row in ((g, col_a, row_a), (h, col_b, row_b)):
            pick = np.flatnonzero(dense[col] & (number[col] >= at) & (number[col] < at + width))
            part = np.zeros((n, width), np.float32)
            part[row[pick], number[col[pick]] - at] = 1
            cells.append(part)
        out += cells[0] @ cells[1].T
    rare = np.flatnonzero(~dense[col_a])
    first_b = np.cumsum(n_b) - n_b
    for at in range(0, len(rare), 50_000):
        pick = rare[at : at + 50_000]
        times = n_b[col_a[pick]]
        spread = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        pairs = np.repeat(row_a[pick], times) * h + row_b[np.repeat(first_b[col_a[pick]], times) + spread]
        if 8 * len(pairs) > g * h:
            out += np.bincount(pairs, minlength=g * h).reshape(g, h)
        else:
            np.add.at(out.reshape(-1), pairs, 1)
    return out


def jaccard_links(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs of a set of ``left`` and one of ``right`` whose exact Jaccard similarity reaches the threshold."""
    shared = shared_counts(left, right)
    union = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :] - shared
    return shared >= threshold * union - 1e-9


def verify_groups(threshold: float):
    """Arrow function over rows sorted by (cc, lo, hi): (node, root, links) of each row in its pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_of(batches, ["cc", "lo", "hi"], 500):
            cc, lo, hi, own, node, copies = (np.asarray(t.column(c)) for c in ("cc", "lo", "hi", "own", "node", "copies"))
            new = np.concatenate([[True], (cc[1:] != cc[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
            starts = np.flatnonzero(new)
            roots, links = node.copy(), np.zeros(len(node), np.int64)
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(node)], strict=True):
                if b - a < 2:
                    continue
                sets = [np.frombuffer(x.as_py(), U) for x in t.column("shingles")[a:b]]
                # rows of a pair of blocks meet across it alone; rows of one block meet each other
                i, j = (np.flatnonzero(own[a:b] == x[a]) for x in (lo, hi))
                if not len(i) or not len(j):
                    continue
                linked = jaccard_links([sets[x] for x in i], [sets[x] for x in j], threshold)
                if lo[a] == hi[a]:
                    np.fill_diagonal(linked, False)
                else:
                    links[a + j] = linked.T @ copies[a + i]
                links[a + i] = linked @ copies[a + j]
                u, v = np.nonzero(linked)
                roots[a:b] = node[a:b][least_labels(b - a, i[u], j[v])]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(roots), pa.array(links)], names=["node", "root", "links"])

    return run


def told_apart(sig: DataFrame) -> DataFrame:
    """``sig`` with a new node for each class that shares its node with another: of several, the one of the least node2 keeps it."""
    shared = sig.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("node2").alias("first"), F.max("node2").alias("last"))
    shared = shared.where("first < last").drop("last").checkpoint()
    if not shared.head(1):
        return sig
    other = F.when(F.col("first").isNull() | (F.col("node2") == F.col("first")), F.col("node")).otherwise(F.xxhash64("node", "node2"))
    return sig.join(shared, "node", "left").withColumn("node", other).drop("first")


def similarity_classes(docs: DataFrame, work: Workspace, threshold: float = 0.8, tolerance: float = 1e-6) -> DataFrame:
    """(d, k, key, class_id, n_links, kept) of every row of ``docs`` (doc_id, text); see near_duplicates."""
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ddl = "d long, k long, key long, node long, node2 long, n int, bands array<long>, sig binary"
    sig = told_apart(work.table(slim.mapInArrow(signatures, ddl), "signatures"))
    classes = sig.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(F.struct("d", "k", "key")).alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("n").alias("n"))
    with_bands = sig.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(F.struct("bands", "sig")).alias("s"))

    banded = with_bands.select("node", F.explode("s.bands").alias("band"))
    live = banded.groupBy("band").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = banded.join(live, "band").join(with_bands.select("node", "s.sig"), "node")
    dealt = deal(members, F.ceil(F.col("m") / BUCKET_BLOCK))
    ordered = dealt.repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi", "node").select("band", "lo", "hi", "own", "node", "sig")
    proposed = ordered.mapInArrow(compare_buckets(least_matches(threshold, tolerance)), "u long, v long").distinct()
    groups = connected_components(proposed)

    met = groups.join(classes, "node")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / GROUP_BLOCK), F.ceil(8 * F.sum("n") / GROUP_BYTES))
    chosen = met.join(met.groupBy("label").agg(blocks.alias("blocks")), "label").select("node", F.col("label").alias("cc"), "blocks", "copies", F.col("rep.d").alias("__d"), F.col("rep.k").alias("__k"), F.col("rep.key").alias("key")).checkpoint()
    bits = spark.sparkContext.broadcast(bitset.build(chosen, chosen.count()))
    texts = slim.mapInArrow(rows_hit(bits, ["__d", "__k", "text"], True), "__d long, __k long, text string")
    sets = (
        texts.join(chosen.drop("key"), ["__d", "__k"])
        .select("cc", "node", "blocks", "copies", "text")
        .mapInArrow(shingled, "cc long, node long, blocks long, copies long, shingles binary")
        .dropDuplicates(["node"])
    )
    parts = deal(sets, F.col("blocks")).repartition("cc", "lo", "hi").sortWithinPartitions("cc", "lo", "hi", "node")
    verified = parts.select("cc", "lo", "hi", "own", "node", "copies", "shingles").mapInArrow(verify_groups(threshold), "node long, root long, links long").checkpoint()
    joined = connected_components(verified.where("node <> root").select(F.col("root").alias("u"), F.col("node").alias("v")))

    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.join(joined, "node", "left").join(links, "node", "left")
    known = known.select("node", "copies", "rep", F.coalesce("label", "node").alias("label"), F.coalesce("links", F.lit(0)).alias("links"))
    first = known.groupBy("label").agg(F.min("rep").alias("first"))
    of_node = known.join(first, "label").select("node", (F.col("links") + F.col("copies") - 1).alias("n_links"), "first", "copies").checkpoint()
    often = F.col("copies") * HOT >= F.lit(sig.count())  # at most HOT classes
    hot, rows = F.broadcast(of_node.where(often)), sig.select("d", "k", "key", "node")
    doc = F.col("first.d")
    many = rows.join(hot, "node")
    few = rows.join(hot.select("node"), "node", "left_anti").join(of_node.where(~often), "node", "left")
    return many.unionByName(few).select(
        "d", "k", "key",
        F.nullif(F.coalesce(doc, F.col("d")), F.lit(NO_ID)).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (F.col("first").isNull() | ((doc == F.col("d")) & (F.col("first.k") == F.col("k")))).alias("kept"),
    )


def near_duplicates(docs: DataFrame, work: Workspace, threshold: float = 0.8, tolerance: float = 1e-6) -> DataFrame:
    """doc_id, class_id, n_links and kept for every row of ``docs`` (doc_id, text, ...).

    class_id is the least doc_id of the connected component of pairs at or above the threshold; n_links counts
    the other rows within it of the row itself, copies included. kept marks the component's least document (all
    its repeated rows). A null or wordless text links to nothing and is its own class. Null doc_ids come last and
    give a null class_id only where a class has no other. An empty table gives no rows; other columns are ignored.
    """
    out = similarity_classes(docs, work, threshold, tolerance)
    return out.select(F.nullif("d", F.lit(NO_ID)).alias("doc_id"), "class_id", "n_links", "kept")


def one_of_each(docs: DataFrame, work: Workspace, threshold: float = 0.8, tolerance: float = 1e-6) -> DataFrame:
    """``docs`` with one row of each similarity class: the one of the least doc_id. Wordless rows all stay."""
    spark, columns = docs.sparkSession, docs.columns
    classes = similarity_classes(docs, work, threshold, tolerance)
    often = classes.groupBy("d", "k", "key", "kept").agg(F.count(F.lit(1)).alias("times")).where("not kept or times > 1").checkpoint()
    bits = spark.sparkContext.broadcast(bitset.build(often, often.count()))
    typed = docs.withColumn("text", F.col("text").cast("string"))
    rest = typed.mapInArrow(rows_hit(bits, columns, False), typed.schema)
    hit = typed.mapInArrow(rows_hit(bits, [*columns, "__d", "__k"], True), extended(typed, __d="long", __k="long"))
    gone = often.where("not kept").select(F.col("d").alias("__d"), F.col("k").alias("__k"))
    wordless = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    left = hit.join(gone, ["__d", "__k"], "left_anti")
    some = left.where(~wordless).dropDuplicates(["__d", "__k"]).unionByName(left.where(wordless))
    return rest.unionByName(some.select(columns))


