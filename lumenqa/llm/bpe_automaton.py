"""Byte-pair encoding by a deterministic automaton over tokens, compiled from the merges.

The automaton accepts exactly the token sequences that the merges produce. It starts as one state with an arc
for each base symbol. Each merge (u, v) -> w in order of rank is a gadget: the arcs labelled u lead to a state of
their own, a copy of where they led; there the arc v is taken out, as u v would have been merged; and every
state with an arc u gets an arc w, to where v led after u. A copy keeps a link to its source and the rank at which
it was made, and a removal is one entry (token, rank); an arc w exists where its first part u existed when w
was made, so it is absent where a removal of some prefix of w is older than the next longer prefix. The
automaton of all merges is thus the size of the merge list, and the transition function is a few table lookups.

A prefix of a word has at most one accepted tokenisation, so a word is encoded left to right by transitions,
longest label first; a place without a way on is left for good, so the walk is linear in the word. Transitions
found are kept in a table, words in a bounded cache. Decoding emits the labels of the arcs walked.

Null texts are empty; texts are encoded whole, and a very long one is a slice of its own, whose words, ids and labels
are lists of its words' entries at one time. Rows, other columns and their order are untouched; columns named
like the new ones are replaced. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenqa.llm.presplit import Cache, Splitter, byte_letters
from lumenqa.llm.workspace import bounded_batches, extended, text_slices

NEVER = 1 << 60
TABLE = 1 << 19
PREFIX = 4


class Automaton:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.labels = {i: t for t, i in self.ids.items()}
        self.end = model.get("end_of_word_suffix") or ""
        self.parts: dict[int, tuple[int, int]] = {}  # token -> (its first part, rank)
        self.state_of: dict[int, int] = {}  # where the arcs labelled by a token lead; 0 is the start
        self.source: list[int] = [-1]  # the state a state was copied from
        self.copied: list[int] = [NEVER]  # and the rank at which
        self.removed: list[dict[int, int]] = [{}]  # token -> rank at which its arc was taken out
        self.owner: list[int] = [-1]
        for rank, pair in enumerate(model["merges"]):
            u, v = pair if isinstance(pair, list) else pair.split(" ")
            self.add_merge(self.ids[u], self.ids[v], self.ids[u + v], rank)
        self.prefixes, self.removals = cache(self.prefixes), cache(self.removals)  # the automaton is complete now
        self.table: dict[int, bool] = {}
        self.reach: dict[str, int] = {}  # first PREFIX symbols -> length of the longest token that begins so
        for t in self.ids:
            t = t.removesuffix(self.end) or t
            if len(t) >= PREFIX and self.reach.get(t[:PREFIX], 0) < len(t):
                self.reach[t[:PREFIX]] = len(t)

    def add_merge(self, u: int, v: int, w: int, rank: int) -> None:
        state = self.state_of.get(u, 0)
        if not self.has_arc(state, v):
            return  # u v never stands when this merge's turn comes, so it makes no token
        target = self.state_of.get(v, 0)
        if state == 0 or self.owner[state] != u or u == v:
            self.source.append(state)
            self.copied.append(rank)
            self.removed.append({})
            self.owner.append(u)
            state = self.state_of[u] = len(self.source) - 1
        self.removed[state][v] = rank
        if w in self.parts:
            raise ValueError("two merges make one token")
        self.parts[w] = (u, rank)
        self.state_of[w] = target
        self.owner[target] = -1  # shared from now on: the next removal there needs a copy

    def has_arc(self, state: int, token: int) -> bool:
        for prefix, made in self.prefixes(token):
            for removed, copied in self.removals(state):
                rank = removed.get(prefix)
                if rank is not None and rank <= made and rank <= copied:
                    return False
        return True

    def prefixes(self, token: int) -> list[tuple[int, int]]:
        """The token, its first part, the first part of that and so on, each with the rank at which the one before was made."""
        out, made = [(token, NEVER)], NEVER
        while token in self.parts:
            token, made = self.parts[token]
            out.append((token, made))
        return out

    def removals(self, state: int) -> list[tuple[dict[int, int], int]]:
        """The removals at a state and at the states it was copied from, each with the rank up to which they count."""
        out, copied = [], NEVER
        while state >= 0:
            if self.removed[state]:
                out.append((self.removed[state], copied))
            copied = min(copied, self.copied[state])
            state = self.source[state]
        return out

    def step(self, last: int, token: int) -> bool:
        """Whether ``token`` may follow ``last``; kept in a table of bounded size."""
        key = last << 20 | token
        found = self.table.get(key)
        if found is None:
            if len(self.table) >= TABLE:
                self.table.clear()
            found = self.table[key] = self.has_arc(self.state_of.get(last, 0), token)
        return found

    def walk(self, word: str) -> list[int]:
        """The tokens of one pre-split word."""
        if word.isascii() and word.isprintable():
            symbols = word
        else:
            letters = byte_letters()
            symbols = "".join([letters[b] for b in word.encode("utf-8", "surrogateescape")])
        n, ids, table, reach = len(symbols), self.ids, self.table, self.reach
        whole = ids.get(symbols + self.end)
        if whole is not None and self.alone(whole):
            return [whole]
        walked, cuts, dead, at = [], [0], set(), 0
        while at < n:
            before = walked[-1] << 20 if at else 0
            for end in range(min(n, at + reach.get(symbols[at : at + PREFIX], PREFIX - 1)), at, -1):
                if dead and end in dead:
                    continue
                token = ids.get(symbols[at:end] if end < n else symbols[at:] + self.end)
                if token is None:
                    continue
                if at:
                    arc = table.get(before | token)
                    arc = self.step(walked[-1], token) if arc is None else arc
                else:
                    arc = self.alone(token)
                if arc:
                    walked.append(token)
                    cuts.append(end)
                    at = end
                    break
            else:
                if not at:
                    raise ValueError(f"no path spells {word!r}")
                dead.add(at)
                walked.pop()
                cuts.pop()
                at = cuts[-1]
        return walked

    def alone(self, token: int) -> bool:
        """Whether the start state has an arc for the token: it is a base symbol or some merge made it."""
        return token in self.parts or len(self.labels[token].removesuffix(self.end) or self.end) == 1


class Codec:
    """Encodes and decodes whole texts; one a process and file."""

    def __init__(self, path: str):
        self.splitter, self.automaton = Splitter(path), Automaton(path)
        self.decimal = {i: str(i) for i in self.automaton.labels}
        self.cache = Cache(self.entry)

    def entry(self, word: str) -> tuple[int, str, str]:
        ids = self.automaton.walk(word)
        return len(ids), " ".join([self.decimal[i] for i in ids]), self.emit(ids)

    def emit(self, ids: list[int]) -> str:
        """The labels of the arcs walked, as the file's decoder joins them (it names none: by spaces)."""
        labels = self.automaton.labels
        return " ".join([labels[i] for i in ids])

    def path(self, text: str) -> tuple[int, str, str]:
        """(number of tokens, decimal ids, labels) of a text."""
        n, ids, labels, cache = 0, [], [], self.cache
        for mark, words in self.splitter.stretches(text):
            if mark is not None:
                n += 1
                ids.append(str(self.splitter.special[mark]))
                labels.append(mark)
            if words:
                found = [cache[w] for w in words]
                n += sum([e[0] for e in found])
                ids.append(" ".join([e[1] for e in found]))
                labels.append(" ".join([e[2] for e in found]))
        return n, " ".join(ids), " ".join(labels)

    def encode(self, text: str) -> list[int]:
        return list(map(int, self.path(text)[1].split()))

    def decode(self, ids: list[int]) -> str:
        special = {i: t for t, i in self.splitter.special.items()}
        return " ".join([special.get(i) or self.automaton.labels[i] for i in ids])


@cache
def codec(path: str) -> Codec:
    return Codec(path)


COLUMNS = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "token_ids": "array<int>", "decoded_text": "string"}


def coded(docs: DataFrame, path: str, want: tuple[str, ...] = ("n_tokens", "token_ids")) -> DataFrame:
    """``docs`` with the columns of COLUMNS that are wanted."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop(*want).withColumn("text", F.col("text").cast("string"))
    names = [*docs.columns, *want]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            for part in text_slices(batch, "text"):
                rows = [coder.path(t or "") for t in part.column("text").to_pylist()]
                made = {"n_tokens": pa.array([r[0] for r in rows], pa.int64())}
                if "ids_sha256" in want:
                    made["ids_sha256"] = pa.array([hashlib.sha256(r[1].encode()).hexdigest() for r in rows], pa.string())
                if "decoded_sha256" in want:
                    made["decoded_sha256"] = pa.array([hashlib.sha256(r[2].encode()).hexdigest() for r in rows], pa.string())
                if "token_ids" in want:
                    made["token_ids"] = pa.array([list(map(int, r[1].split())) for r in rows], pa.list_(pa.int32()))
                if "decoded_text" in want:
                    made["decoded_text"] = pa.array([r[2] for r in rows], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, *(made[c] for c in want)], names=names)

    return docs.mapInArrow(run, extended(docs, **{c: COLUMNS[c] for c in want}))


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` with decoded_text, the labels of their token_ids; null ids decode to null."""
    rows = rows.drop("decoded_text")
    names = [*rows.columns, "decoded_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for part in batches:
            texts = [None if ids is None else coder.decode(ids) for ids in part.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=names)

    return rows.mapInArrow(run, extended(rows, decoded_text="string"))
