"""Pluggable model calls: language models, entailment and encoders behind one interface, with offline stand-ins.

A scorer is made once a task and called with batches, so a model loads once and rows move by Arrow. Everything around
the call, gates, parsing, clamping, averages, stays in DataFrame expressions. The stand-ins are deterministic.
"""

from __future__ import annotations

import hashlib
import json
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumenqa.functions import text as T


class Completion(Protocol):
    def complete(self, prompts: list[str]) -> list[str]: ...


class Entailment(Protocol):
    def probabilities(self, premises: list[str], claims: list[str]) -> list[tuple[float, float, float]]:
        """(entailment, neutral, contradiction) of each pair."""


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...


class StubJudge:
    """Scores drawn from the prompt's digest, as the JSON that a judge replies with."""

    def complete(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            d = hashlib.sha256(p.encode()).digest()
            score = d[0] % 11
            out.append(json.dumps({"passed": score >= 7, "final_score": score, "subscores": {"realism": d[1] % 3, "dual_use": d[2] % 5, "correctness": d[3] % 5}}))
        return out


class StubEntailment:
    """Share of the claim's words that the premise has."""

    def probabilities(self, premises: list[str], claims: list[str]) -> list[tuple[float, float, float]]:
        out = []
        for p, c in zip(premises, claims, strict=True):
            words = set(c.lower().split())
            share = len(words & set(p.lower().split())) / max(1, len(words))
            out.append((share, (1 - share) * 0.75, (1 - share) * 0.25))
        return out


class StubEncoder:
    """Signed word hashing to 64 dimensions, unit length."""

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), 64), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                d = hashlib.blake2b(w.encode(), digest_size=4).digest()
                out[i, d[0] % 64] += 1 if d[1] & 1 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


#: For each provider: path of the call, header of the key, request body, and where the reply stands in the response.
SERVICES = {
    "openai": ("/v1/chat/completions", "Authorization", lambda m, p: {"model": m, "temperature": 0, "messages": [{"role": "user", "content": p}]}, lambda r: r["choices"][0]["message"]["content"]),
    "anthropic": ("/v1/messages", "x-api-key", lambda m, p: {"model": m, "max_tokens": 1024, "messages": [{"role": "user", "content": p}]}, lambda r: r["content"][0]["text"]),
    "gemini": ("/v1beta/models/{model}:generateContent", "x-goog-api-key", lambda m, p: {"contents": [{"parts": [{"text": p}]}]}, lambda r: r["candidates"][0]["content"]["parts"][0]["text"]),
    "hf": ("/generate", "Authorization", lambda m, p: {"inputs": p, "parameters": {"max_new_tokens": 1024}}, lambda r: r["generated_text"]),
}


class HttpCompletion:
    """A completion service over HTTP: the provider's own call at ``base``, one prompt a request.

    A failed call is the reply ``[PROVIDER_API_ERROR] reason``, as answers are kept and scored; ``raising`` raises instead.
    """

    def __init__(self, provider: str, base: str, model: str, key: str = "", timeout: float = 60, raising: bool = False):
        self.provider, self.base, self.model, self.key, self.timeout, self.raising = provider, base.rstrip("/"), model, key, timeout, raising

    def one(self, prompt: str) -> str:
        path, header, body, reply = SERVICES[self.provider]
        headers = {"Content-Type": "application/json", header: f"Bearer {self.key}" if header == "Authorization" else self.key}
        if self.provider == "anthropic":
            headers["anthropic-version"] = "2023-06-01"
        request = urllib.request.Request(self.base + path.format(model=self.model), json.dumps(body(self.model, prompt)).encode(), headers)
        with urllib.request.urlopen(request, timeout=self.timeout) as response:
            return (reply(json.load(response)) or "").strip()

    def complete(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            try:
                out.append(self.one(p))
            except Exception as e:  # noqa: BLE001 - one failed call is one failed answer
                if self.raising:
                    raise
                out.append(f"[{self.provider.upper()}_API_ERROR] {e}")
        return out


def with_columns(df: DataFrame, ddl: str, make: Callable[[], object], call: Callable[[object, pa.RecordBatch], list[pa.Array]], batch: int = 64) -> DataFrame:
    """``df`` with the columns of ``ddl`` made by ``call(model, batch)`` on batches of at most ``batch`` rows."""
    added = StructType.fromDDL(ddl)
    names = [*df.columns, *added.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                yield pa.RecordBatch.from_arrays([*part.columns, *call(model, part)], names=names)

    return df.mapInArrow(run, StructType([*df.schema.fields, *added.fields]))


def completed(df: DataFrame, prompt: str, make: Callable[[], Completion] = StubJudge, as_status: bool = True) -> DataFrame:
    """``df`` with reply and status. An error is a status, or with ``as_status`` false a reply that says so."""

    def call(model: Completion, b: pa.RecordBatch) -> list[pa.Array]:
        prompts = [p or "" for p in b.column(b.schema.get_field_index(prompt)).to_pylist()]
        try:
            replies, state = model.complete(prompts), ["ok"] * len(prompts)
        except Exception as e:  # noqa: BLE001 - one failed batch must not fail the job
            replies = [None if as_status else f"[API_ERROR] {e}"] * len(prompts)
            state = ["error"] * len(prompts) if as_status else ["ok"] * len(prompts)
        return [pa.array(replies, pa.string()), pa.array(state, pa.string())]

    return with_columns(df, "reply string, status string", make, call)


VERDICT = "passed boolean, final_score int, subscores struct<realism:int,dual_use:int,correctness:int>"


def parsed_verdicts(df: DataFrame) -> DataFrame:
    """reply as verdict; what is no JSON object with a final_score is the zero result."""
    v = F.from_json(T.json_block(T.unfenced(F.col("reply"))), StructType.fromDDL(VERDICT))
    zero = F.from_json(F.lit('{"passed":false,"final_score":0,"subscores":{"realism":0,"dual_use":0,"correctness":0}}'), StructType.fromDDL(VERDICT))
    return df.withColumn("verdict", F.when(v["final_score"].isNotNull(), v).otherwise(zero)).withColumn("valid", v["final_score"].isNotNull())


def answer_scores(reply: Column, rule: str) -> Column:
    """(answer_relevance, answer_faithfulness) of a judge's reply, whole numbers from 0 to 5.

    clamp: an absent score is 0 and one out of range goes to the nearest end. reject: either is null. No JSON object:
    both null. Means over them leave nulls out.
    """
    block = T.json_block(T.unfenced(reply))
    valid = F.get_json_object(block, "$").isNotNull()

    def score(name: str) -> Column:
        found = F.get_json_object(block, f"$.{name}").try_cast("double").cast("int")
        return F.when(valid, T.clamped_score(F.coalesce(found, F.lit(0))) if rule == "clamp" else T.score_in_range(found)).alias(name)

    return F.struct(score("answer_relevance"), score("answer_faithfulness"))


def judged(qas: DataFrame, prompt: str, gate: str, make: Callable[[], Completion] = StubJudge) -> DataFrame:
    """Judge only rows whose array ``gate`` is empty; the others get the zero result without a call."""
    zero = F.struct(F.lit(False).alias("passed"), F.lit(0).alias("final_score"), F.struct(F.lit(0).alias("realism"), F.lit(0).alias("dual_use"), F.lit(0).alias("correctness")).alias("subscores"))
    asked = parsed_verdicts(completed(qas.where(F.size(gate) == 0), prompt, make))
    stopped = qas.where(F.size(gate) > 0).withColumns({"reply": F.lit(None).cast("string"), "status": F.lit("gated"), "verdict": zero, "valid": F.lit(False)})
    return asked.unionByName(stopped)


def sentence_entailment(answers: DataFrame, key: str, premise: str, answer: str, make: Callable[[], Entailment] = StubEntailment, rule: str = "mean") -> DataFrame:
    """(key, entailment, contradiction) over an answer's sentences.

    mean: mean probabilities, 0 where there is no sentence. label: shares of sentences whose likeliest label it is, null
    where there is none.
    """
    each = answers.select(key, F.col(premise).alias("premise"), F.explode_outer(T.sentences(F.col(answer))).alias("claim"))

    def call(model: Entailment, b: pa.RecordBatch) -> list[pa.Array]:
        names = b.schema.names
        premises = [x or "" for x in b.column(names.index("premise")).to_pylist()]
        claims = b.column(names.index("claim")).to_pylist()
        got = model.probabilities(premises, [c or "" for c in claims])
        rows = [None if c is None else p for c, p in zip(claims, got, strict=True)]
        return [pa.array([None if r is None else float(r[i]) for r in rows], pa.float64()) for i in range(3)]

    scored = with_columns(each, "e double, n double, c double", make, call)
    if rule == "mean":
        made = [F.coalesce(F.avg(x), F.lit(0.0)).alias(name) for x, name in (("e", "entailment"), ("c", "contradiction"))]
    else:
        top = F.greatest("e", "n", "c")
        made = [F.avg(F.when(F.col("claim").isNotNull(), (F.col(x) == top).cast("double"))).alias(name) for x, name in (("e", "entailment"), ("c", "contradiction"))]
    return scored.groupBy(key).agg(*made)


def encoded(df: DataFrame, column: str, prefix: str = "", make: Callable[[], Encoder] = StubEncoder) -> DataFrame:
    """``df`` with vector, the unit-length encoding of prefix + text."""

    def call(model: Encoder, b: pa.RecordBatch) -> list[pa.Array]:
        texts = [prefix + (x or "") for x in b.column(b.schema.get_field_index(column)).to_pylist()]
        return [pa.array(list(model.encode(texts)), pa.list_(pa.float32()))]

    return with_columns(df, "vector array<float>", make, call)


GENERATED = "struct<professional:array<struct<question:string,expected_answer:string>>,basic:array<struct<question:string,expected_answer:string>>>"


def exploded_questions(df: DataFrame) -> DataFrame:
    """Rows (persona, question, expected_answer) of replies with a list for each persona; others give none."""
    got = df.withColumn("g", F.from_json(T.json_block(T.unfenced(F.col("reply"))), GENERATED))

    def listed(persona: str):
        items = F.coalesce(f"g.{persona}", F.array().cast("array<struct<question:string,expected_answer:string>>"))
        return F.transform(items, lambda q: F.struct(F.lit(persona.title()).alias("persona"), q["question"].alias("question"), q["expected_answer"].alias("expected_answer")))

    both = F.concat(listed("professional"), listed("basic"))
    return got.withColumn("q", F.explode(both)).select(*df.columns, "q.*").where(~T.is_blank(F.col("question")))
