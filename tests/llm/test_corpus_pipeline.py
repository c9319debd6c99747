import corpus_pipeline
from lumenqa.llm.workspace import Workspace
from tests.llm.test_decontamination import ITEM

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def make(rng_words, n):
    return " ".join(rng_words(n))


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    import random

    rng = random.Random(4)
    words = lambda n: ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(n)]
    clean = [make(words, 60) for _ in range(120)]
    passage = make(words, 55)
    near = clean[0].split()
    near[30] = "other"
    toxic = [make(words, 25) + " vileword nastyword " + make(words, 25) + " vileword nastyword" for _ in range(60)]
    texts = clean + [" ".join(near), clean[1]] + [make(words, 40) + " " + passage, make(words, 40) + " " + passage] + [make(words, 30) + " " + ITEM] + toxic
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(900, None, "en", "s", None), (901, "", None, None, 0)]
    sf = str(tmp_path)
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, int("vileword" in t)) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs, work, left = spark.read.parquet(f"{sf}/documents.parquet"), Workspace(spark), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "bpe":
            assert out.columns == docs.columns
        docs = work.table(out, name)
        left[name] = {r.doc_id: r for r in docs.collect()}
    first_toxic = 125
    assert not [d for d in left["toxicity"] if first_toxic <= d < 185] and set(range(125)) <= set(left["toxicity"])
    assert set(left["toxicity"]) - set(left["ngram_join"]) == {120, 121}
    assert set(left["substring_dedup"]) == set(left["ngram_join"])
    assert left["substring_dedup"][122].text == texts[122] and len(left["substring_dedup"][123].text.split()) == 40
    assert left["substring_dedup"][123].n_chars == len(left["substring_dedup"][123].text)
    assert set(left["substring_dedup"]) - set(left["decontamination"]) == {124}
    assert {900, 901} <= set(left["bpe"]) and left["bpe"][900].n_tokens == 0
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, docs.collect()))
    work.drop()


def test_empty_tables_and_repeated_rows(spark, tmp_path):
    rows = [(1, "one text of a few words here", "en", "s", 28)] * 3 + [(2, None, None, None, None)] * 2 + [(None, "another text altogether", "de", "s", 22)]
    for name, some in (("empty", []), ("some", rows)):
        sf = f"{tmp_path}/{name}"
        spark.createDataFrame(some, COLUMNS).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        got = sorted(str(r.doc_id) for r in corpus_pipeline.run(spark, sf).collect())
        assert got == ([] if name == "empty" else ["1", "2", "2", "None"])
