import random

import numpy as np
import pyarrow as pa

from lumenqa.llm import bitset, rowkeys, workspace
from lumenqa.llm import words as W
from lumenqa.llm.components import connected_components


def test_chains_hubs_and_loops(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(5, i) for i in range(200, 400)]
    extra = [(rng.randint(1000, 1100), rng.randint(1000, 1100)) for _ in range(80)]
    edges = chain + hub + [(7, 7), (5, 100)] + extra + extra
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in up}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_bit_table_lets_every_key_through(spark):
    keys = [random.Random(2).getrandbits(63) for _ in range(5000)]
    bits = bitset.build(spark.createDataFrame([(k,) for k in keys], "key long"), len(keys))
    assert bitset.hits(bits, np.array(keys)).all()
    others = np.array([random.Random(i).getrandbits(63) for i in range(10_000, 14_000)])
    assert bitset.hits(bits, others).mean() < 0.2
    assert not bitset.hits(bitset.build(spark.createDataFrame([], "key long"), 0), others).any()


def test_words_of_joined_texts():
    texts = ["a bb\tccc", "", "dd", " ee ff", "gg"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t) for t in texts])
    w = W.split(data, offsets)
    raw = data.tobytes()
    got = [[raw[s:e].decode() for s, e in zip(w.starts[a:b], w.ends[a:b])] for a, b in zip(w.first[:-1], w.first[1:])]
    assert got == [t.split() for t in texts]
    same = W.split(np.frombuffer(b"zz dd bb", np.uint8), np.array([0, 8]))
    assert same.hashes[1] == w.hashes[3] and same.hashes[2] == w.hashes[1]


def test_slices_cover_a_batch():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (10, 0, 500, 20, 30)] + [None])], names=["text"])
    parts = list(workspace.text_slices(batch, "text", 50))
    assert [len(p) for p in parts] == [2, 1, 3]
    assert pa.Table.from_batches(parts).column("text").to_pylist() == batch.column("text").to_pylist()


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_hashes_tell_thue_morse_words_apart():
    """Polynomials modulo 2^64 take such a word and its complement for one."""
    for n in (1024, 2048):
        a = thue_morse(n)
        b = a.translate(str.maketrans("ab", "ba"))
        data = np.frombuffer(f"{a} {b} {a}".encode(), np.uint8)
        w = W.split(data, np.array([0, len(data)]))
        for h in (w.hashes, w.others):
            assert h[0] == h[2] != h[1]
        k = rowkeys.text_keys(data, np.array([0, n, n + 1, 2 * n + 1]))
        assert k[0][0] != k[0][2] and k[1][0] != k[1][2]


def test_byte_hashes_depend_on_the_bytes_alone():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, size=4000).astype(np.uint8)
    starts = rng.integers(0, 3900, size=3000)
    ends = starts + rng.integers(1, 40, size=3000)
    found = {}
    for h, a, b in zip(W.byte_hashes(data, starts, ends).tolist(), starts, ends):
        assert found.setdefault(data[a:b].tobytes(), h) == h
    assert len(set(found.values())) == len(found)
