"""Benchmark decontamination by template windows.

Benchmark items and documents are reduced to templates (see templates), so a question whose numbers, units or
names were replaced still matches. Windows of ``window`` template tokens are hashed on both sides; a bit table
of the items' windows (at most 128 MB, whatever the benchmark) spares the shuffle of windows that cannot match,
and the rest meets the items' windows in a hash join. A document may hold several copies of an item, so joined
windows are grouped by alignment (place in the document less place in the item): windows of one alignment, of
alignments less than half an item apart (copies with words put in or left out; two grids of buckets), and all
together. A document holds an item when the windows of one group cover at least ``coverage`` of the item's windows
and its slots are consistent: one value of the item always stands for one value of the document. The group that
covers most is told; equal values everywhere in it mean ``verbatim``, else ``reparameterised``.

Items of fewer tokens than a window are one window of their own length; below ``least`` tokens an item matches its
own words alone, lower-cased, in their order. The kind of an item's first token depends on what stands before it in
a document, so the window it begins is hashed in each reading the token can have there; read as a name or unit it
stands for itself alone. Windows with fewer literals than half their tokens do not count, unless an item
has no others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenqa.llm import bitset, templates
from lumenqa.llm import words as W
from lumenqa.llm.rowkeys import NO_ID, hashed_keys, keys_of, rows_hit
from lumenqa.llm.workspace import bounded_batches, extended, text_bytes, text_slices

U = np.uint64


def windows(t: templates.Templates, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start places, hashes, literals in each) of the windows of ``size`` tokens."""
    at = W.window_places(t.first, size)
    if not len(at):
        return at, np.zeros(0, np.int64), at
    literals = np.concatenate([[0], np.cumsum(t.kinds == templates.LITERAL)])
    hashes = W.mix(W.window_hashes(t.keys, at, size, W.WINDOW_BASES[0]) + U(size))
    return at, hashes.view(np.int64), literals[at + size] - literals[at]


def slots_in(t: templates.Templates, at: np.ndarray, size: int) -> list[np.ndarray]:
    """The values of each window's slots, in order."""
    slot = np.flatnonzero(t.kinds != templates.LITERAL)
    lo, hi = np.searchsorted(slot, at), np.searchsorted(slot, at + size)
    values = t.values[slot].view(np.int64)
    return [values[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]


def exact_windows(t: templates.Templates, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start places, hashes) of the windows of ``size`` tokens as words, without slots."""
    at = W.window_places(t.first, size)
    return at, W.mix(W.window_hashes(t.values, at, size, W.WINDOW_BASES[0]) + U(size)).view(np.int64) if len(at) else np.zeros(0, np.int64)


def begun_as(t: templates.Templates, kind: int) -> templates.Templates:
    """``t`` with the first token of each text, where it is a literal that can be of this kind inside a text, of it."""
    head = t.first[:-1][np.diff(t.first) > 0]
    head = head[t.kinds[head] == templates.LITERAL]
    if kind == templates.UNIT:
        head = head[np.isin(t.values[head], templates.unit_hashes())]
    keys, kinds = t.keys.copy(), t.kinds.copy()
    kinds[head], keys[head] = kind, templates.slot_keys()[kind]
    return templates.Templates(t.first, keys, t.values, kinds)


def item_windows(window: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                t = templates.canonical(*text_bytes(part.column("text")))
                counts = np.diff(t.first)
                ids = part.column("item_id")

                def rows(of, size, at, h, slots, fixed):
                    return pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array(of)), pa.array(np.full(len(of), size, np.int32)), pa.array((at - t.first[of]).astype(np.int32)),
                            pa.array(counts[of].astype(np.int32)), pa.array(h), pa.array(slots, pa.list_(pa.int64())), pa.array(np.full(len(of), fixed)),
                        ],
                        names=["item_id", "size", "place", "tokens", "h", "slots", "fixed"],
                    )

                for size in range(1, least):
                    at, h = exact_windows(t, size)
                    of = np.searchsorted(t.first, at, side="right") - 1
                    pick = np.flatnonzero(counts[of] == size)
                    yield rows(of[pick], size, at[pick], h[pick], [[]] * len(pick), False)
                others = [begun_as(t, kind) for kind in (templates.NAME, templates.UNIT)]
                for size in range(least, window + 1):
                    use = counts == size if size < window else counts >= window
                    at, h, literals = windows(t, size)
                    doc = np.searchsorted(t.first, at, side="right") - 1
                    rich = 2 * literals >= size
                    any_rich = np.zeros(len(counts), bool)
                    any_rich[doc[rich]] = True
                    pick = np.flatnonzero(use[doc] & (rich | ~any_rich[doc]))
                    yield rows(doc[pick], size, at[pick], h[pick], slots_in(t, at[pick], size), False)
                    for other in others:
                        begun = pick[(at[pick] == t.first[doc[pick]]) & (other.kinds[at[pick]] != t.kinds[at[pick]])]
                        yield rows(doc[begun], size, at[begun], windows(other, size)[1][begun], slots_in(other, at[begun], size), True)

    return run


def document_windows(bits, sizes: list[int], least: int):
    """Windows of documents whose hash the items' bit table has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        for batch in batches:
            for part in text_slices(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                t = templates.canonical(data, offsets)
                d, k = keys_of(part, data, offsets)
                for size in sizes:
                    at, h = exact_windows(t, size) if size < least else windows(t, size)[:2]
                    pick = np.flatnonzero(bitset.hits(table, h)) if len(h) else at
                    if not len(pick):
                        continue
                    of = np.searchsorted(t.first, at[pick], side="right") - 1
                    slots = slots_in(t, at[pick], size) if size >= least else [[]] * len(pick)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(d[of]), pa.array(k[of]), pa.array(at[pick] - t.first[of]), pa.array(h[pick]), pa.array(slots, pa.list_(pa.int64()))],
                        names=["d", "k", "at", "h", "found"],
                    )

    return run


def copies_of(aligned: Column, tokens: Column) -> Column:
    """The groups a window belongs to: its alignment, that in buckets of half an item on two grids, and all windows."""
    wide = F.greatest(F.lit(2), F.floor(tokens / 2))
    shift = F.floor(wide / 2)
    kinds = (aligned, F.floor(aligned / wide), F.floor((aligned + shift) / wide), F.lit(0))
    return F.array(*(F.struct(F.lit(i).alias("grid"), of.cast("long").alias("bucket")) for i, of in enumerate(kinds)))


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = 8, least: int = 4, coverage: float = 0.25) -> DataFrame:
    """(d, k, item_id, coverage, kind) for each document that holds a benchmark item; d and k as in rowkeys."""
    spark = docs.sparkSession
    bounded_batches(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    id_type = asked.schema["item_id"].dataType.simpleString()
    items = asked.mapInArrow(item_windows(window, least), f"item_id {id_type}, size int, place int, tokens int, h long, slots array<long>, fixed boolean").distinct().checkpoint()
    of_item = items.groupBy("item_id").agg(F.countDistinct("place").alias("windows"))
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # at most ``window`` values
    bits = spark.sparkContext.broadcast(bitset.build(items.select(F.col("h").alias("key")), items.count()))
    found = slim.mapInArrow(document_windows(bits, sizes, least), "d long, k long, at long, h long, found array<long>")
    met = found.join(items, "h").where(F.size("found") == F.size("slots")).where(~F.col("fixed") | (F.get("found", F.lit(0)) == F.get("slots", F.lit(0))))
    near = met.withColumn("copy", F.explode(copies_of(F.col("at") - F.col("place"), F.col("tokens"))))
    copy = ["d", "k", "item_id", "copy"]
    # one row a copy and window place; a place met twice in a group keeps the reading nearest to the item's values
    place = near.groupBy(*copy, "place").agg(F.min(F.struct((F.col("found") != F.col("slots")).alias("differs"), "found", "slots")).alias("m"))
    pairs = F.arrays_zip(F.col("m.slots").alias("was"), F.col("m.found").alias("now"))
    told = (
        place.groupBy(*copy)
        .agg(F.count(F.lit(1)).alias("n"), F.max("m.differs").alias("differs"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"))
        .join(of_item, "item_id")
        .where(F.col("n") >= coverage * F.col("windows"))
        .where(F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["was"]))))
        .groupBy("d", "k", "item_id")
        .agg(F.max(F.struct((F.col("n") / F.col("windows")).alias("coverage"), (~F.col("differs")).alias("same"))).alias("best"))
    )
    return told.select("d", "k", "item_id", "best.coverage", F.when(F.col("best.same"), "verbatim").otherwise("reparameterised").alias("kind"))


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, coverage, kind): one row for each document and benchmark item it holds, no row for clean ones.

    Rows with the same doc_id and text count once. Null and empty texts hold nothing; null items ask nothing.
    Items of equal texts, or texts of equal templates, are each told; rows of one item_id are readings of one item, whose
    windows count by place. A document of any length is read whole, and one window at many places counts once a place.
    A null doc_id is kept as null. Empty tables on either side give no rows. Other columns are ignored.
    """
    return leaks(docs, benchmark, **options).select(F.nullif("d", F.lit(NO_ID)).alias("doc_id"), "item_id", "coverage", "kind")


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; every other row stays, with all its columns."""
    columns, typed = docs.columns, docs.withColumn("text", F.col("text").cast("string"))
    bad = leaks(docs, benchmark, **options).select(F.col("d").alias("__d"), F.col("k").alias("__k")).distinct().checkpoint()
    keys = bad.mapInArrow(hashed_keys, "key long")
    bits = docs.sparkSession.sparkContext.broadcast(bitset.build(keys, bad.count()))
    rest = typed.mapInArrow(rows_hit(bits, columns, False), typed.schema)
    hit = typed.mapInArrow(rows_hit(bits, [*columns, "__d", "__k"], True), extended(typed, __d="long", __k="long"))
    return rest.unionByName(hit.join(bad, ["__d", "__k"], "left_anti").select(columns))
