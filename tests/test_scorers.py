import numpy as np
from pyspark.sql import functions as F

from lumenqa.functions import prompts, scorers
from lumenqa.operators import judging
from lumenqa.streaming import incremental


class Broken:
    def complete(self, prompts):
        raise RuntimeError("down")


def test_gated_rows_are_not_asked(spark):
    qas = spark.createDataFrame([("a", "p1", []), ("b", "p2", ["local_hard_gate_fail", "x"])], "qid string, prompt string, gate array<string>")
    out = {r.qid: r for r in scorers.judged(qas, "prompt", "gate").collect()}
    assert out["b"].status == "gated" and out["b"].verdict.final_score == 0 and not out["b"].verdict.passed
    assert out["a"].status == "ok" and out["a"].valid and 0 <= out["a"].verdict.final_score <= 10


def test_errors_are_status_or_answers(spark):
    df = spark.createDataFrame([("x",)], "prompt string")
    assert scorers.completed(df, "prompt", Broken).first().status == "error"
    row = scorers.completed(df, "prompt", Broken, as_status=False).first()
    assert row.status == "ok" and row.reply.startswith("[API_ERROR]")
    bad = scorers.parsed_verdicts(df.withColumn("reply", F.lit("no json"))).first()
    assert not bad.valid and bad.verdict.final_score == 0


def test_entailment_rules(spark):
    df = spark.createDataFrame([("a", "the cat sat", "The cat sat. Dogs bark!"), ("b", "x", "")], "id string, p string, ans string")
    mean = {r.id: r for r in scorers.sentence_entailment(df, "id", "p", "ans").collect()}
    assert 0 < mean["a"].entailment < 1 and mean["b"].entailment == 0.0
    label = {r.id: r for r in scorers.sentence_entailment(df, "id", "p", "ans", rule="label").collect()}
    assert label["a"].entailment == 0.5 and label["b"].entailment is None


def test_encoder_and_generation(spark):
    v = scorers.encoded(spark.createDataFrame([("a b",), (None,)], "t string"), "t", "query: ").collect()
    assert abs(np.linalg.norm(v[0].vector) - 1) < 1e-6
    reply = '```json\n{"professional":[{"question":"q1","expected_answer":"a"}],"basic":[{"question":" ","expected_answer":"a"},{"question":"q2","expected_answer":"b"}]}\n```'
    rows = scorers.exploded_questions(spark.createDataFrame([(1, reply), (2, "none")], "id int, reply string")).collect()
    assert sorted((r.id, r.persona, r.question) for r in rows) == [(1, "Basic", "q2"), (1, "Professional", "q1")]


def test_prompts(spark):
    row = spark.createDataFrame([("q", ["x", "y"])], "q string, c array<string>").select(prompts.answer_prompt(F.col("q"), F.col("c")).alias("p")).first()
    assert row.p == "Question: q\nContexts:\n[1] x\n[2] y"


def test_stream_judges_each_key_once(spark, tmp_path):
    src, sink = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "qid string, prompt string, gate array<string>"

    def add(*ids):
        spark.createDataFrame([(i, f"p{i}", []) for i in ids], schema).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        incremental.judge_stream(stream, lambda df: scorers.judged(df, "prompt", "gate"), sink, str(tmp_path / "ck")).awaitTermination()

    add("a", "b", "a")
    add("b", "c")
    assert sorted(r.qid for r in spark.read.parquet(sink).collect()) == ["a", "b", "c"]


def test_pass_expansion():
    assert judging.passes(["m", "n"], 1, 2) == [("m", 1, "m@seed:1"), ("n", 1, "n@seed:1"), ("m", 2, "m@seed:2")]


def test_http_completion_of_each_provider():
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from lumenqa.functions.scorers import HttpCompletion

    shapes = {
        "openai": lambda p: {"choices": [{"message": {"content": f" {p}! "}}]}, "anthropic": lambda p: {"content": [{"text": f"{p}!"}]},
        "gemini": lambda p: {"candidates": [{"content": {"parts": [{"text": f"{p}!"}]}}]}, "hf": lambda p: {"generated_text": f"{p}!"},
    }
    asked = {
        "openai": lambda b: b["messages"][0]["content"], "anthropic": lambda b: b["messages"][0]["content"],
        "gemini": lambda b: b["contents"][0]["parts"][0]["text"], "hf": lambda b: b["inputs"],
    }

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            provider = {"/v1/chat/completions": "openai", "/v1/messages": "anthropic", "/generate": "hf"}.get(self.path, "gemini")
            prompt = asked[provider](body)
            self.send_response(500 if prompt == "fail" else 200)
            self.end_headers()
            self.wfile.write(json.dumps(shapes[provider](prompt)).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    for provider in shapes:
        got = HttpCompletion(provider, base, "m", "k").complete(["hello", "fail"])
        assert got[0] == "hello!" and got[1].startswith(f"[{provider.upper()}_API_ERROR]")
    server.shutdown()
