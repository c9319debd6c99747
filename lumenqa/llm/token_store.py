"""Token ids in files of independent, interleaved rANS blocks with one shared frequency table.

Writing goes in three steps. Texts are range-partitioned and sorted by doc_id, tokenised, and kept as ids of 16 bits (32
for vocabularies beyond 65,536) with their place in the partition; the ids are counted on the way. The counts over the whole corpus become one
static table (frequencies that add up to 2^SCALE, one at least for each id that occurs). Then the documents are cut,
where they lie, into blocks of whole documents, and each block is coded alone: its tokens are dealt to LANES interleaved coders with 64-bit
states and 32-bit words, so coding and decoding run as vectors.

A block row holds everything to decode it without any other: the documents and their lengths, the global number of
its first id, the coded words, the final states, checkpoints (states and word place every CHECKPOINT steps, so parts of
a block can be decoded at the same time or alone), and the crc32 of its ids and of its coded bytes. Blocks and table are Parquet
files, which every store that Spark can write takes; the files of blocks are in ascending doc_id order by name, and so are
the blocks in each.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenqa.llm import words as W
from lumenqa.llm.presplit import Cache, Splitter, byte_letters
from lumenqa.llm.templates import lowered
from lumenqa.llm.workspace import Workspace, text_bytes, text_slices

SCALE = 20
LANES, CHECKPOINT, BLOCK = 4096, 128, 1 << 20
LOW = 1 << 31
#: Input bytes, as the planner estimates them, for each range partition beyond spark.sql.shuffle.partitions.
PART_BYTES, MOST_PARTS = 64 << 20, 100_000
#: Bytes of text that are tokenised at once.
SLICE = 500_000
IDS = ["part", "place", "doc_id", "before", "n", "ids", "counts"]
U = np.uint64


@dataclass
class Table:
    """freq and start by symbol; symbol by slot, found by search in the sorted starts."""

    ids: np.ndarray
    freq: np.ndarray
    start: np.ndarray

    @staticmethod
    def of_counts(ids: np.ndarray, counts: np.ndarray) -> Table:
        """Frequencies in proportion to the counts, at least one each, that add up to 2^SCALE."""
        order = np.argsort(ids)
        ids, counts = ids[order].astype(np.int64), counts[order].astype(np.float64)
        total = 1 << SCALE
        freq = np.maximum(1, np.floor(counts / max(counts.sum(), 1) * (total - len(ids)))).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
        if len(freq):
            freq[np.argmax(freq)] += total - freq.sum()
        return Table(ids, freq, np.concatenate([[0], np.cumsum(freq)])[:-1].astype(np.int64))


def encode_block(symbols: np.ndarray, table: Table) -> tuple[bytes, bytes, list[int], list[bytes]]:
    """(coded words, final states, word places of checkpoints, states at checkpoints) of symbol numbers.

    Token t is coded by lane t mod LANES, the last step first; a decoder then reads words from the end of what was
    written, so they are stored in reverse. Checkpoint c stands before step (c + 1) * CHECKPOINT in decoding order.
    """
    lanes = max(1, min(LANES, len(symbols)))
    state = np.full(lanes, LOW, U)
    words, places, states, written = [], [], [], 0
    freq, start = table.freq.astype(U), table.start.astype(U)
    for step in range(-(-len(symbols) // lanes) - 1, -1, -1):
        s = symbols[step * lanes : (step + 1) * lanes]
        f, x = freq[s], state[: len(s)]
        full = x >= (f << U(63 - SCALE))
        if full.any():
            words.append((x[full] & U(0xFFFFFFFF)).astype(np.uint32)[::-1])
            written += len(words[-1])
            x = np.where(full, x >> U(32), x)
        q = x // f
        state[: len(s)] = (q << U(SCALE)) + (x - q * f) + start[s]
        if step and step % CHECKPOINT == 0:
            places.append(written)
            states.append(state.tobytes())
    stream = np.concatenate(words)[::-1] if words else np.zeros(0, np.uint32)
    return stream.tobytes(), state.tobytes(), [written - p for p in places[::-1]], states[::-1]


def decode_steps(stream: np.ndarray, at: int, state: np.ndarray, n: int, first: int, steps: int, table: Table, slots: np.ndarray) -> np.ndarray:
    """The symbols of ``steps`` steps from step ``first`` of a block of n symbols, given states and word place there."""
    lanes = len(state)
    state = state.copy()
    out = []
    mask = U((1 << SCALE) - 1)
    freq, start = table.freq.astype(U), table.start.astype(U)
    for step in range(first, first + steps):
        m = min(lanes, n - step * lanes)
        x = state[:m]
        slot = x & mask
        s = slots[slot]
        x = freq[s] * (x >> U(SCALE)) + slot - start[s]
        empty = np.flatnonzero(x < U(LOW))
        if len(empty):
            x[empty] = (x[empty] << U(32)) | stream[at : at + len(empty)].astype(U)
            at += len(empty)
        state[:m] = x
        out.append(s)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def slot_table(table: Table) -> np.ndarray:
    return np.repeat(np.arange(len(table.ids), dtype=np.uint16 if len(table.ids) <= 1 << 16 else np.uint32), table.freq)


def decode_block(coded: bytes, final: bytes, n: int, table: Table, slots: np.ndarray, places=(), states=(), part: int | None = None) -> np.ndarray:
    """The symbols of a block, or of its part between two checkpoints alone."""
    stream, state = np.frombuffer(coded, np.uint32), np.frombuffer(final, U)
    total = -(-n // len(state)) if n else 0
    if part is None:
        return decode_steps(stream, 0, state, n, 0, total, table, slots)
    first = part * CHECKPOINT
    at, state = (0, state) if part == 0 else (places[part - 1], np.frombuffer(states[part - 1], U))
    return decode_steps(stream, at, state, n, first, min(CHECKPOINT, total - first), table, slots)


#: Kinds of bytes in plain texts: white space, letters, digits, others.
KIND = np.full(256, 3, np.uint8)
KIND[[0x20, *range(0x09, 0x0E)]] = 0
KIND[[*range(97, 123), *range(128, 256)]] = 1
KIND[48:58] = 2


def not_plain(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The texts with an apostrophe, a ``<``, or any character but ASCII and the letters U+00C0 to U+00FF."""
    before = np.concatenate([np.zeros(1, np.uint8), data[:-1]])
    inner = (data >= 0x80) & (data <= 0xBF)
    odd = (data == 0x27) | (data == 0x3C) | (data == 0xC2) | (data >= 0xC4) | (inner & ((before != 0xC3) | (data == 0x97) | (data == 0xB7)))
    sums = np.concatenate([[0], np.cumsum(odd)])
    return sums[offsets[1:]] > sums[offsets[:-1]]


def told_apart(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Representatives and classes of words, after words that share a hash but not their bytes got classes of their own."""
    lengths, to = ends - starts, first[back]
    same = lengths == lengths[to]
    at = np.flatnonzero(same & (to != np.arange(len(to))))
    spread = np.arange(int(lengths[at].sum())) - np.repeat(np.cumsum(lengths[at]) - lengths[at], lengths[at])
    unlike = data[np.repeat(starts[at], lengths[at]) + spread] != data[np.repeat(starts[to[at]], lengths[at]) + spread]
    if unlike.any():
        same[np.repeat(at, lengths[at])[unlike]] = False
    odd = np.flatnonzero(~same)
    back = back.copy()
    back[odd] = len(first) + np.arange(len(odd))
    return np.concatenate([first, odd]), back


#: Longest word whose bytes and length fit two numbers of 64 bits; buckets of the word table, two words each; ids it holds.
SHORT, BUCKETS, MOST_IDS = 15, 1 << 19, 1 << 23
ROUNDS = 8
#: Masks of the first 0 to 8 bytes of a number.
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


class WordTable:
    """Ids by word in flat arrays, so all words of a slice are looked up at once. A word of up to SHORT bytes is its key:
    its bytes and its length, told apart exactly. A new word pushes the older one of a full bucket out; when the
    stretch of ids is full, the table starts afresh. Each distinct word of a slice that is longer, or one of more than
    ROUNDS new ones in a bucket, goes through a cache.
    """

    def __init__(self, make: Callable[[bytes], bytes], kind: np.dtype, limit: int):
        self.make, self.kind, self.others = make, kind, Cache(make, limit)
        self.reset()

    def reset(self) -> None:
        self.buckets, self.held, self.used = BUCKETS, np.zeros(1 << 16, self.kind), 1  # place 0 is the caller's
        self.low, self.high = np.zeros(2 * BUCKETS, U), np.zeros(2 * BUCKETS, U)
        self.at, self.n = np.zeros(2 * BUCKETS, np.int64), np.zeros(2 * BUCKETS, np.uint8)

    def add(self, entries: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(places, numbers) of the ids of further entries."""
        n = np.array([len(e) // self.kind.itemsize for e in entries], np.int64)
        upto = self.used + np.cumsum(n)
        if len(n) and upto[-1] > len(self.held):
            self.held = np.concatenate([self.held, np.zeros(max(int(upto[-1]), 2 * len(self.held)) - len(self.held), self.kind)])
        if len(n):
            self.held[self.used : upto[-1]] = np.frombuffer(b"".join(entries), self.kind)
            self.used = int(upto[-1])
        return upto - n, n

    def find(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, numbers) in ``held`` of the ids of each data[start:start + length], valid until the next call."""
        if self.used > MOST_IDS:
            self.reset()
        eight = np.ndarray(len(data) + 16, "<u8", np.concatenate([data, np.zeros(23, np.uint8)]), strides=(1,))  # the 8 bytes from each place on
        low, high = eight[starts] & FIRST_BYTES[np.minimum(lengths, 8)], lengths.astype(U) << U(56)
        beyond = np.flatnonzero(lengths > 8)
        high[beyond] |= eight[starts[beyond] + 8] & FIRST_BYTES[np.minimum(lengths[beyond] - 8, 7)]
        mixed = (low ^ (high * U(0x9E3779B97F4A7C15))) * U(0xD6E8FEB86659FD93)
        mixed = (mixed ^ (mixed >> U(32))) * U(0xBF58476D1CE4E5B9)
        place = ((mixed >> U(32)) & U(self.buckets - 1)).astype(np.int64)
        low[lengths > SHORT] = high[lengths > SHORT] = 0  # no key of any word
        entry = place.copy()
        left = np.flatnonzero((self.low[entry] != low) | (self.high[entry] != high) | (high == 0))
        entry[left] += self.buckets
        at, n = self.at[entry], self.n[entry].astype(np.int64)
        entry = entry[left]
        left = left[(self.low[entry] != low[left]) | (self.high[entry] != high[left]) | (high[left] == 0)]
        if not len(left):
            return at, n
        raw = data.tobytes()
        rest, left = left[high[left] == 0], left[high[left] != 0]
        for _ in range(ROUNDS):  # one word of each bucket in turn
            if not len(left):
                break
            one = left[np.unique(place[left], return_index=True)[1]]
            made = self.add([self.make(raw[a : a + k]) for a, k in zip(starts[one].tolist(), lengths[one].tolist(), strict=True)])
            to = place[one]
            for kept, new in ((self.low, low[one]), (self.high, high[one]), (self.at, made[0]), (self.n, made[1])):
                kept[to + self.buckets] = kept[to]
                kept[to] = new
            to = place[left]
            known = (self.low[to] == low[left]) & (self.high[to] == high[left])
            at[left[known]], n[left[known]] = self.at[to[known]], self.n[to[known]]
            left = left[~known]
        rest = np.concatenate([rest, left])
        if len(rest):
            begin, end = starts[rest], starts[rest] + lengths[rest]
            _, first, back = np.unique(W.byte_hashes(data, begin, end), return_index=True, return_inverse=True)
            first, back = told_apart(data, begin, end, first, back)
            made = self.add([self.others[raw[a:b]] for a, b in zip(begin[first].tolist(), end[first].tolist(), strict=True)])
            at[rest], n[rest] = made[0][back], made[1][back]
        return at, n


class LibraryEncoder:
    """Ids by the tokenizers library: its model is asked once for each pre-split word as long as the cache holds it.

    Plain texts are split all at once: runs of letters, single digits, runs of others. Their words are looked up in a
    table of arrays, and the ids are gathered for all. Other texts go through the splitter one by one.
    """

    def __init__(self, path: str, limit: int = 250_000):
        self.splitter = Splitter(path)
        self.model = self.splitter.library.model
        self.kind = np.dtype("<u2" if max(self.splitter.library.get_vocab(with_added_tokens=True).values(), default=0) < 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.letters = byte_letters()
        self.cache = Cache(self.ids, limit)
        self.table = WordTable(lambda raw: self.ids(raw.decode()), self.kind, limit)

    def ids(self, word: str) -> bytes:
        if not (word.isascii() and word.isprintable()):
            word = "".join([self.letters[b] for b in word.encode("utf-8", "surrogateescape")])
        return array(self.code, [t.id for t in self.model.tokenize(word)]).tobytes()

    def encode(self, text: str) -> bytes:
        out, get = [], self.cache.__getitem__
        for mark, words in self.splitter.stretches(text):
            if mark is not None:
                out.append(array(self.code, [self.splitter.special[mark]]).tobytes())
            out.extend(map(get, words))
        return b"".join(out)

    def encode_slice(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts of a column, each closed by ``end_id``, and where each text's ids begin and the last end."""
        data, offsets = text_bytes(column)
        odd = not_plain(data, offsets)
        low = lowered(data)
        kind = KIND[low]
        if odd.any():
            kind[np.repeat(odd, np.diff(offsets))] = 0  # no words here
        begins = np.ones(len(low), bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        begins[offsets[:-1][offsets[:-1] < len(low)]] = True
        places = np.flatnonzero(begins)
        lengths = np.diff(places, append=len(low))
        word = kind[places] != 0
        starts = places[word]
        at, n = self.table.find(low, starts, lengths[word])
        self.table.held[0] = end_id
        upto = np.searchsorted(starts, offsets[1:])
        at, n = np.insert(at, upto, 0), np.insert(n, upto, 1)
        done = np.cumsum(n)
        total = int(done[-1]) if len(done) else 0
        ids = self.table.held[np.repeat(at - (done - n), n) + np.arange(total)]
        cut = np.concatenate([[0], done[upto + np.arange(len(upto))]])
        if odd.any():
            texts = [np.frombuffer(self.encode(column[d].as_py()), self.kind) if odd[d] else ids[:0] for d in range(len(odd))]
            ids = np.concatenate([x for d, t in enumerate(texts) for x in (t, ids[cut[d] : cut[d + 1]])])
            cut[1:] += np.cumsum([len(t) for t in texts])
        return ids, cut


@cache
def encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def tokenised(path: str, end_id: int):
    """Sorted texts of a partition to their ids: (part, place, doc_id, before, n, ids); before counts ids in the partition.

    A last row without ids holds the counts of all ids of the partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, place, before, total = encoder(path), TaskContext.get().partitionId(), 0, 0, np.zeros(0, np.int64)
        for batch in batches:
            for piece in text_slices(batch, "text", SLICE):
                ids, cut = coder.encode_slice(piece.column("text"), end_id)
                n = np.diff(cut)
                buffers = [None, pa.py_buffer(cut * coder.kind.itemsize), pa.py_buffer(ids)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(n), part, np.int32)), pa.array(place + np.arange(len(n), dtype=np.int64)), piece.column("doc_id"),
                        pa.array(before + cut[:-1]), pa.array(n), pa.Array.from_buffers(pa.large_binary(), len(n), buffers).cast(pa.binary()),
                        pa.nulls(len(n), pa.binary()),
                    ],
                    names=IDS,
                )
                place, before = place + len(n), before + len(ids)
                total = added(total, np.bincount(ids))
        if place:
            last = [[part], [place], [None], [before], [0], [None], [total.tobytes()]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(last, kinds, strict=True)], names=IDS)

    return run


def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of two counts by id, of which either may end earlier."""
    out = np.zeros(max(len(a), len(b)), np.int64)
    out[: len(a)] = a
    out[: len(b)] += b
    return out


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for row in batch.column("counts").to_pylist():
            total = added(total, np.frombuffer(row, np.int64))
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["id", "n"])


BLOCK_DDL = (
    "part int, place long, first long, n long, doc_ids array<long>, lengths array<long>, coded binary, states binary, "
    "places array<long>, saved array<binary>, ids_crc32 long, coded_crc32 long"
)


def blocks_of(table, offsets, kind: np.dtype):
    """Arrow function: documents as they lie in the id files to coded blocks of whole documents that follow each other.

    A file's rows are in order, and a file may be read in several splits, so no shuffle is needed: a block ends where
    the next row is not the next document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = table.value
        number = np.zeros(int(shared.ids.max(initial=0)) + 1, np.int64)
        number[shared.ids] = np.arange(len(shared.ids))
        held, size, last = [], 0, None

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(r[3] for r in held), kind)
            coded, final, places, saved = encode_block(number[ids], shared)
            part, place = held[0][4:]
            row = {
                "part": part, "place": place, "first": offsets.value[part] + held[0][1], "n": len(ids), "doc_ids": [r[0] for r in held],
                "lengths": [r[2] for r in held], "coded": coded, "states": final, "places": places, "saved": saved,
                "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes()), "coded_crc32": zlib.crc32(coded),
            }
            return pa.RecordBatch.from_pylist([row], schema=BLOCK_SCHEMA)

        for batch in batches:
            for part, place, d, before, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (size + n > BLOCK or (part, place - 1) != last):
                    yield flush()
                    held, size = [], 0
                held.append((d, before, n, ids, part, place))
                size, last = size + n, (part, place)
        if held:
            yield flush()

    return run


BLOCK_SCHEMA = pa.schema(
    [("part", pa.int32()), ("place", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
     ("coded", pa.binary()), ("states", pa.binary()), ("places", pa.list_(pa.int64())), ("saved", pa.list_(pa.binary())), ("ids_crc32", pa.int64()), ("coded_crc32", pa.int64())]
)


def write_tokens(docs: DataFrame, work: Workspace, path: str, end_id: int = 1, partitions: int | None = None) -> tuple[DataFrame, Table]:
    """Encode ``docs`` (doc_id, text) into block files in ascending doc_id order; returns the blocks as read and the table.

    Every document ends with ``end_id``. A null text is empty. A null doc_id comes first; rows of one doc_id are in order
    of their texts, wholly equal rows in any. An empty table makes no block. Other columns are ignored.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = int(str(slim._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # the planner's estimate, free of a scan
    parts = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(size // PART_BYTES, MOST_PARTS))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text").asc_nulls_first()]
    ordered = slim.repartitionByRange(parts, *order[:2]).sortWithinPartitions(*order)
    ids = work.table(ordered.mapInArrow(tokenised(path, end_id), "part int, place long, doc_id long, before long, n long, ids binary, counts binary"), "ids")
    counts = ids.select("counts").where("counts IS NOT NULL").mapInArrow(counted, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # one row an id of the vocabulary
    table = Table.of_counts(counts["id"].to_numpy(), counts["n"].to_numpy())
    per_part = {r["part"]: r["n"] for r in ids.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # one row a partition
    offsets, at = {}, 0
    for p in sorted(per_part):
        offsets[p], at = at, at + per_part[p]
    shared, starts = spark.sparkContext.broadcast(table), spark.sparkContext.broadcast(offsets)
    coded = ids.where("ids IS NOT NULL").drop("counts").mapInArrow(blocks_of(shared, starts, encoder(path).kind), BLOCK_DDL)
    # a file of ids may be read in any order and in splits: its blocks go to the file of their own number, sorted
    blocks = work.table(coded.repartitionById(max(per_part, default=0) + 1, F.col("part")).sortWithinPartitions("place"), "blocks")
    work.forget("ids")
    return blocks, table


def decoded(row: dict, known: Table, slots: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of a block from its parts ``first`` to ``last`` (all by default), each begun at its checkpoint; checksums are compared."""
    where = f"block {row['part']}/{row['place']}"
    if zlib.crc32(row["coded"]) != row["coded_crc32"]:
        raise ValueError(f"{where}: coded bytes are damaged")
    parts = len(row["places"]) + 1
    wanted = range(first, parts if last is None else min(parts, last + 1))
    symbols = [decode_block(row["coded"], row["states"], row["n"], known, slots, row["places"], row["saved"], p) for p in wanted]
    ids = known.ids[np.concatenate(symbols)].astype("<u4")
    if len(wanted) == parts and zlib.crc32(ids.tobytes()) != row["ids_crc32"]:
        raise ValueError(f"{where}: ids are damaged")
    return ids


def read_ids(blocks: DataFrame, table: Table, lo: int, hi: int) -> DataFrame:
    """(at, token_ids): the ids numbered lo to hi - 1 of the whole corpus, in stretches that begin at ``at``.

    Only blocks that hold some are read, and of each only the parts between the checkpoints around them are decoded.
    """
    shared = blocks.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        slots = slot_table(known)
        for batch in batches:
            for row in (r for at in range(batch.num_rows) for r in batch.slice(at, 1).to_pylist()):
                stretch = len(np.frombuffer(row["states"], U)) * CHECKPOINT  # ids of a part
                a, b = max(lo - row["first"], 0), min(hi - row["first"], row["n"])
                ids = decoded(row, known, slots, a // stretch, (b - 1) // stretch)[a - a // stretch * stretch :][: b - a]
                yield pa.RecordBatch.from_arrays([pa.array([row["first"] + a], pa.int64()), pa.array([ids.astype(np.int32)], pa.list_(pa.int32()))], names=["at", "token_ids"])

    held = blocks.where((F.col("first") < hi) & (F.col("first") + F.col("n") > lo))
    return held.drop("doc_ids", "lengths").mapInArrow(run, "at long, token_ids array<int>")


def read_tokens(blocks: DataFrame, table: Table, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, token_ids]) from block files alone; a block that fails its checksums raises."""
    shared = blocks.sparkSession.sparkContext.broadcast(table)
    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", token_ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        slots = slot_table(known)
        for batch in batches:
            for row in (r for at in range(0, batch.num_rows, 8) for r in batch.slice(at, 8).to_pylist()):
                ids = decoded(row, known, slots)
                n = np.array(row["lengths"], np.int64)
                ends = np.cumsum(n)
                cut = [ids[e - m : e] for e, m in zip(ends.tolist(), n.tolist(), strict=True)]
                made = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["first"] + ends - n), pa.array(n), pa.array([zlib.crc32(c.tobytes()) for c in cut], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    made.append(pa.array([c.astype(np.int32) for c in cut], pa.list_(pa.int32())))
                    names.append("token_ids")
                yield pa.RecordBatch.from_arrays(made, names=names)

    return blocks.select("part", "place", "first", "n", "doc_ids", "lengths", "coded", "states", "places", "saved", "ids_crc32", "coded_crc32").mapInArrow(run, ddl)
