r"""Removal of repeated passages, with a count-min prefilter.

A window is ``window`` consecutive words of one document, compared by two
independent 64-bit hashes. A word goes if any
window that covers it has the same words as a window that starts earlier in (doc_id, place) order.

Pass 1 counts. A window is counted at its anchor, the smallest hash among its GRAM-word grams: equal windows
have equal anchors at different places, so the count of an anchor is never below the count of the windows
it stands for, and anchors are about seven times fewer. Each task sketches the anchors of its share in a
count-min sketch with counters that stop at two, and ships it in blocks of cells; blocks of equal number are
merged, and a cell of the merged sketch is one bit: seen twice or more. Pass 2 sends only windows whose anchor
is seen twice in every row of the sketch, and groups them exactly by hash, keeping the earliest start. Pass 3
joins these starts to the documents that have such windows, and cuts the words. No repeated window is lost: an
underestimate is impossible, and an overestimate only sends a window that grouping then finds to be single.

Cells are four times the anchors expected, at least 2^20, so they grow with the input. Up to ``max_cells`` (2^29) the
merged bits are broadcast, ROWS * cells / 8 bytes: 128 MB at most. A larger sketch is a table dealt by cell number:
tasks' counts of a cell are added up on the way, anchors meet the cells seen twice in a join, and the documents with
such anchors get the list of theirs; passes 2 and 3 then ask that list. Both give the same rows.

Copies of whole texts are set aside first: all their windows start earlier in the copy of least doc_id, so they
are cut without being looked at again. Only texts that occur twice or have repeated windows are ever shuffled.

Groupings are partial before the shuffle, so a passage that a third of the documents share sends one row a
task. Documents with the same doc_id and text count as one document (nothing is removed from one because of
the other); of the same doc_id and different texts, the one with the smaller text hash is earlier. A null
doc_id comes last. Null and empty texts have no words. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenqa.llm import bitset
from lumenqa.llm import words as W
from lumenqa.llm.rowkeys import ids_of, keys_of, rows_hit, text_keys
from lumenqa.llm.workspace import Workspace, extended, text_bytes, text_slices, then

GRAM = 8
ROWS = 2
BLOCK = 1 << 16
U = np.uint64


def anchored(found: W.Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window places, the gram place of each window's anchor, gram hashes by place)."""
    places = W.window_places(found.first, size)
    if not len(places):
        return places, places, np.zeros(0, U)
    gram = min(GRAM, size)
    spread = size - gram + 1
    grams = np.full(len(found.hashes), ~U(0), U)
    at = np.arange(len(found.hashes) - gram + 1)
    grams[: len(at)] = W.window_hashes(found.hashes, at, gram, W.WINDOW_BASES[0])
    best, where = grams[places], places.copy()
    for k in range(1, spread):
        other = grams[places + k]
        less = other < best
        best = np.where(less, other, best)
        where[less] = places[less] + k
    return places, where, grams


def cells_of(anchors: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (W.mix(anchors + U(0x9E3779B97F4A7C15 * (row + 1) & 0xFFFFFFFFFFFFFFFF)) & U(cells - 1)).astype(np.int64)


def partition_sketch(size: int, cells: int):
    """Arrow function: texts of a task to the blocks of its sketch (block, cells seen once, cells seen more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks(anchors: np.ndarray) -> Iterator[pa.RecordBatch]:
            for row in range(ROWS):
                got, n = np.unique(cells_of(anchors, row, cells), return_counts=True)
                block = got // BLOCK
                cut = np.flatnonzero(np.diff(block)) + 1
                lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(got)]])
                if len(got):
                    inner, many = (got % BLOCK).astype(np.uint16), n > 1
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row * (cells // BLOCK) + int(block[i]) for i in lo], pa.int64()),
                            pa.array([inner[i:j][~many[i:j]].tobytes() for i, j in zip(lo, hi, strict=True)], pa.binary()),
                            pa.array([inner[i:j][many[i:j]].tobytes() for i, j in zip(lo, hi, strict=True)], pa.binary()),
                        ],
                        names=["block", "once", "more"],
                    )

        held, n = [], 0
        for batch in batches:
            for part in text_slices(batch, "text"):
                found = W.split(*text_bytes(part.column("text")))
                _, where, grams = anchored(found, size)
                held.append(grams[np.unique(where)])
                n += len(held[-1])
                if n > 1_000_000:
                    yield from blocks(np.concatenate(held))
                    held, n = [], 0
        if n:
            yield from blocks(np.concatenate(held))

    return run


def merge_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the sketches' blocks of one number: bits of the cells that were seen twice or more."""
    total, number = np.zeros(BLOCK, np.uint8), None
    for b in batches:
        for block, once, more in zip(*(c.to_pylist() for c in b.columns), strict=True):
            number = block
            one = np.frombuffer(once, np.uint16)
            total[one] = np.minimum(total[one] + 1, 2)
            total[np.frombuffer(more, np.uint16)] = 2
    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([np.packbits(total > 1).tobytes()], pa.binary())], names=["block", "bits"])


def cells_for(n_bytes: int) -> int:
    return 1 << max(20, int(4 * n_bytes / 40).bit_length())


def repeated_cells(cells: int, over, size: int) -> np.ndarray:
    """The merged sketch as packed bits, ROWS x cells; ``over`` applies an Arrow function to the texts."""
    sketch = over(partition_sketch(size, cells), "block long, once binary, more binary")
    merged = sketch.groupBy("block").applyInArrow(merge_blocks, "block long, bits binary")
    bits = np.zeros((ROWS, cells // BLOCK, BLOCK // 8), np.uint8)
    flat = bits.reshape(-1, BLOCK // 8)
    for row in merged.toLocalIterator():
        flat[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return bits.reshape(ROWS, -1)


def anchor_rows(size: int):
    """Arrow function: each place that is an anchor in its text, as (anchor, d, k)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                found = W.split(data, offsets)
                _, where, grams = anchored(found, size)
                at = np.unique(where)
                doc = found.doc_of()[at] if len(at) else at
                d, k = keys_of(part, data, offsets)
                yield pa.RecordBatch.from_arrays([pa.array(grams[at].view(np.int64)), pa.array(d[doc]), pa.array(k[doc])], names=["anchor", "d", "k"])

    return run


def dealt_sketch(anchors: DataFrame, cells: int) -> DataFrame:
    """(__d, __k, __anchors): of each document the anchors whose cells are seen twice or more in every row of the sketch."""
    left = anchors
    for row in range(ROWS):
        cell = F.pmod(F.xxhash64("anchor", F.lit(row)), F.lit(cells)).alias("cell")
        again = anchors.select(cell).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cell")
        left = left.select("anchor", "d", "k", cell).join(again, "cell", "left_semi").drop("cell")
    return left.groupBy(F.col("d").alias("__d"), F.col("k").alias("__k")).agg(F.collect_set("anchor").alias("__anchors"))  # no longer than the text


def estimated_repeated(found: W.Words, size: int, part: pa.RecordBatch, bits: np.ndarray | None) -> np.ndarray:
    """Places of the windows whose anchor the sketch says is repeated: by its bits, or by the lists that rows bring along."""
    places, where, grams = anchored(found, size)
    if not len(places):
        return places
    if bits is None:
        lists = part.column("__anchors")
        sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0)).astype(np.int64)
        own = np.asarray(pa.compute.list_flatten(lists)).astype(np.int64).view(U)
        told = W.mix(own ^ W.mix(np.repeat(np.arange(len(sizes)), sizes).astype(U)))
        return places[np.isin(W.mix(grams[where] ^ W.mix(found.doc_of()[places].astype(U))), told)]
    hit = np.ones(len(where), bool)
    for row in range(ROWS):
        cell = cells_of(grams[where], row, bits.shape[1] * 8)
        hit &= (bits[row][cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
    return places[hit]


def candidate_windows(size: int, sketch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sketch and sketch.value
        for batch in batches:
            for part in text_slices(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                found = W.split(data, offsets)
                at = estimated_repeated(found, size, part, bits)
                if not len(at):
                    continue
                doc = found.doc_of()[at]
                h = [x.view(np.int64) for x in found.window_keys(at, size)]
                place = (at - found.first[doc]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (h[0], h[1], *(x[doc] for x in keys_of(part, data, offsets)), place)], names=["h1", "h2", "d", "k", "place"]
                )

    return run


def only_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, "text"):
            data, offsets = text_bytes(part.column("text"))
            k, k2 = text_keys(data, offsets)
            yield pa.RecordBatch.from_arrays([pa.array(ids_of(part)), pa.array(k), pa.array(k2)], names=["d", "k", "k2"])


def screened(size: int, sketch, columns: list[str], todo: bool):
    """The documents of which some window (todo) or no window can be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sketch.value
        for batch in batches:
            for part in text_slices(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                found = W.split(data, offsets)
                some = np.zeros(len(part), bool)
                some[found.doc_of()[estimated_repeated(found, size, part, bits)]] = True
                if todo:
                    d, k = keys_of(part, data, offsets)
                    part = pa.RecordBatch.from_arrays([*part.columns, pa.array(d), pa.array(k)], names=[*part.schema.names, "__d", "__k"])
                yield part.filter(pa.array(some if todo else ~some)).select(columns)

    return run


def with_keys(columns: list[str]):
    """Arrow function: rows with their keys __d and __k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                d, k = keys_of(part, *text_bytes(part.column("text")))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(d), pa.array(k)], names=[*part.schema.names, "__d", "__k"]).select(columns)

    return run


def cut_words(size: int, sketch, columns: list[str], rule: str):
    """Cut documents by rule: ``windows`` cuts those estimated repeated that are nowhere the earliest, ``copy`` every
    window, ``none`` nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                found = W.split(data, offsets)
                n = np.diff(found.first)
                keep = np.ones(len(found.starts), bool)
                if rule == "copy":
                    keep = np.repeat(n < size, n)
                if rule == "windows":
                    again = np.zeros(len(keep), bool)
                    again[estimated_repeated(found, size, part, sketch and sketch.value)] = True
                    for d in range(len(part)):
                        if (first := part.column("__firsts")[d].as_py()) is not None:
                            again[found.first[d] + np.asarray(first, np.int64)] = False
                    gone = np.zeros(len(keep) + 1, np.int64)
                    np.add.at(gone, np.flatnonzero(again), 1)
                    np.add.at(gone, np.flatnonzero(again) + size, -1)
                    keep = np.cumsum(gone[:-1]) == 0
                kept, raw = [], data.tobytes()
                for d in range(len(part)):
                    lo, hi = found.first[d], found.first[d + 1]
                    if keep[lo:hi].all():
                        kept.append(b" ".join(raw[offsets[d] : offsets[d + 1]].split()))  # bytes split at the same six separators
                    else:
                        sel = np.flatnonzero(keep[lo:hi]) + lo
                        kept.append(b" ".join([raw[s:e] for s, e in zip(found.starts[sel].tolist(), found.ends[sel].tolist(), strict=True)]))
                left = np.concatenate([[0], np.cumsum(keep)])
                removed = n - (left[found.first[1:]] - left[found.first[:-1]])
                made = {
                    "n_words": pa.array(n.astype(np.int64)), "n_removed": pa.array(removed.astype(np.int64)),
                    "kept_text": pa.array(kept, pa.binary()).cast(pa.string()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
                }
                yield pa.RecordBatch.from_arrays([made[c] if c in made else part.column(c) for c in columns], names=columns)

    return run


def remove_repeats(docs: DataFrame, work: Workspace, size: int = 20, max_cells: int = 1 << 29) -> DataFrame:
    """All rows and columns of ``docs`` (doc_id, text, ...) with n_words, n_removed, kept_text and kept_sha256.

    kept_text joins the kept words by one space. Columns of docs named like these are replaced.
    """
    spark = docs.sparkSession
    made = ["n_words", "n_removed", "kept_text", "kept_sha256"]
    docs = docs.drop(*made, "__d", "__k", "__k2", "__firsts", "__anchors").withColumn("text", F.col("text").cast("string"))
    columns, identity = docs.columns, ["__k", "__k2"]

    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(only_keys, "d long, k long, k2 long")
    often = keys.groupBy(F.col("k").alias("__k"), F.col("k2").alias("__k2")).agg(F.min("d").alias("__first"), F.max("d").alias("__last"))
    often = often.where("__first < __last").drop("__last").checkpoint()
    bits = spark.sparkContext.broadcast(bitset.build(often.select(F.col("__k").alias("key")), often.count()))
    hit = docs.mapInArrow(rows_hit(bits, [*columns, "__d", *identity], True, by_text=True), extended(docs, __d="long", __k="long", __k2="long"))
    hit = hit.join(often, identity, "left")
    copies = hit.where(F.col("__d") > F.col("__first")).select(columns)
    earliest = work.table(hit.where(F.coalesce(F.col("__d") == F.col("__first"), F.lit(True))).select(columns), "earliest")
    slim = ["doc_id", "text"]

    def over(step, ddl, names=slim):
        """``step`` over the texts that remain: those of one row, and the earliest of each class of copies."""
        lone = docs.select(names).mapInArrow(then(rows_hit(bits, names, False, by_text=True), step), ddl)
        return lone.unionByName(earliest.select(names).mapInArrow(step, ddl))

    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = cells_for(n_bytes)
    keyed, windows = extended(docs, __d="long", __k="long"), "h1 long, h2 long, d long, k long, place int"
    if cells <= max_cells:
        sketch = spark.sparkContext.broadcast(repeated_cells(cells, over, size))
        candidates = over(candidate_windows(size, sketch), windows)
        todo = over(screened(size, sketch, [*columns, "__d", "__k"], True), keyed, columns)
    else:
        sketch = None
        marks = work.table(dealt_sketch(work.table(over(anchor_rows(size), "anchor long, d long, k long"), "anchors"), cells), "marks")
        work.forget("anchors")
        named = over(with_keys([*columns, "__d", "__k"]), keyed, columns)
        todo = work.table(named.join(marks, ["__d", "__k"]).select(*columns, "__d", "__k", "__anchors"), "todo")
        candidates = todo.select(*slim, "__anchors").mapInArrow(candidate_windows(size, None), windows)
    firsts = (
        candidates.groupBy("h1", "h2")
        .agg(F.min(F.struct("d", "k", "place")).alias("m"))
        .groupBy(F.col("m.d").alias("__d"), F.col("m.k").alias("__k"))
        .agg(F.collect_list("m.place").alias("__firsts"))
    )
    out = extended(docs, n_words="long", n_removed="long", kept_text="string", kept_sha256="string")
    cutter = lambda rule: cut_words(size, sketch, [*columns, *made], rule)
    lists = [] if sketch else ["__anchors"]
    cut = todo.join(firsts, ["__d", "__k"], "left").select(*columns, *lists, "__firsts").mapInArrow(cutter("windows"), out)
    if sketch:
        idle = over(then(screened(size, sketch, columns, False), cutter("none")), out, columns)
    else:
        idle = named.join(marks, ["__d", "__k"], "left_anti").select(columns).mapInArrow(cutter("none"), out)
    return idle.unionByName(cut).unionByName(copies.mapInArrow(cutter("copy"), out))
