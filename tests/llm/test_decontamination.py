import random

from lumenqa.llm import decontamination

ITEM = "If Anna buys 12 apples and gives 5 apples to Ben after 3 hours, how many apples does Anna have left over?"
CHANGED = "If Maria buys 40 apples and gives 7 apples to Tom after 9 hours, how many apples does Maria have left over?"
CROSSED = "If Maria buys 40 apples and gives 7 apples to Tom after 9 hours, how many apples does Laura have left over?"
FILLER = "some words that stand around the quoted question and mean nothing at all here "


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    out = sorted((r.doc_id, r.item_id, r.kind) for r in decontamination.contaminated(d, b).collect())
    left = sorted(str(r.doc_id) for r in decontamination.without_leaks(d, b).collect())
    return out, left


def test_verbatim_reparameterised_and_inconsistent(spark):
    docs = [(1, FILLER + ITEM + FILLER), (2, FILLER + CHANGED), (3, CROSSED), (4, FILLER), (5, None), (6, ""), (1, FILLER + ITEM + FILLER), (7, "x" * 3_000_000 + " " + CHANGED)]
    out, left = run(spark, docs, [(10, ITEM), (11, None), (12, ""), (13, "two words")])
    assert out == [(1, 10, "verbatim"), (2, 10, "reparameterised"), (7, 10, "reparameterised")]
    assert left == ["3", "4", "5", "6"]


def test_short_items_and_empty_tables(spark):
    out, left = run(spark, [(1, "we ask: name the first river here. thanks"), (2, "name the river")], [(1, "Name the first river")])
    assert out == [(1, 1, "verbatim")] and left == ["2"]
    assert run(spark, [(1, ITEM)], []) == ([], ["1"])
    assert run(spark, [], [(1, ITEM)]) == ([], [])
    d = spark.createDataFrame([(1, ITEM, 5, "a")], "doc_id long, text string, item_id int, h string")
    b = spark.createDataFrame([(3, ITEM, "q")], "item_id long, text string, doc_id string")
    assert decontamination.contaminated(d, b).count() == 1
    assert decontamination.without_leaks(d, b).columns == d.columns


def test_copies_of_one_item_are_judged_apart(spark):
    names, filler = [("Maria", "Tom"), ("Laura", "Jim"), ("Clara", "Max"), ("Olga", "Sam")], FILLER * 2
    text = "If {} buys {} apples and gives {} apples to {} after {} hours, how many apples does {} have left over?"
    copy = lambda i: text.format(names[i % 4][0], 40 + i, 7 + i, names[i % 4][1], 20 + i, names[i % 4][0])
    docs = [(i, copy(i) + " " + filler + copy(i + 1) + " " + copy(i + 2)) for i in range(20)]
    docs += [(21, CROSSED + " " + filler + CROSSED.replace("40", "50")), (22, CROSSED + " " + ITEM)]
    # a longer item with a word put in every fourteen: no alignment alone covers a quarter
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" if i % 5 else "{}" for i in range(70)]
    edited = lambda k: " ".join(w.format(100 * k + i) + " extra" * (i % 14 == 13) for i, w in enumerate(words))
    docs += [(30 + i, edited(i + 2) + " " + filler + edited(i + 3)) for i in range(5)]
    out, left = run(spark, docs, [(10, ITEM), (11, " ".join(w.format(i) for i, w in enumerate(words)))])
    assert out == [*((i, 10, "reparameterised") for i in range(20)), (22, 10, "verbatim"), *((30 + i, 11, "reparameterised") for i in range(5))]
    assert left == ["21"]


def test_short_items_inside_sentences(spark):
    items = [(1, "What is the capital of France?"), (2, "Minutes of the last meeting"), (3, "Blue Zebra"), (4, "quagga"), (5, ITEM)]
    docs = [(1, 'He then asked "What is the capital of France?" and left'), (2, "then, he said, what is the capital of France"), (3, "we know that Paris is the capital of France"),
            (4, "after 12 minutes of the last meeting"), (5, "he saw (a blue zebra) there"), (6, "a blue striped zebra"), (7, "one Quagga. more"), (8, "What is the capital of Spain"),
            (9, 'so "What is the capital of Spain" it was'), (10, "he said, " + " ".join(ITEM.split()[:8])), (11, "he read out loud " + CHANGED), (12, "quaggas of the last meeting minutes"),
            (13, "so Blue Zebra and Blue Zebra")]
    out, left = run(spark, docs, items)
    assert out == [(1, 1, "verbatim"), (2, 1, "verbatim"), (4, 2, "verbatim"), (5, 3, "verbatim"), (7, 4, "verbatim"), (8, 1, "reparameterised"), (9, 1, "reparameterised"), (11, 5, "reparameterised"), (13, 3, "verbatim")]
    assert left == ["10", "12", "3", "6"]


def typed(text):
    return ["N" if w[0].isdigit() else w for w in text.split()], text.split()


def aligned_copies(doc, item, size=8, coverage=0.25):
    """Alignments at which windows of equal typed words cover enough of the item: whether each has consistent numbers."""
    (dt, dw), (it, iw) = typed(doc), typed(item)
    found = []
    for off in range(-len(iw), len(dw)):
        hits = [p for p in range(len(it) - size + 1) if off + p >= 0 and dt[off + p : off + p + size] == it[p : p + size]]
        if hits and len(hits) >= coverage * (len(it) - size + 1):
            pairs = {(iw[p + i], dw[off + p + i]) for p in hits for i in range(size) if it[p + i] == "N"}
            found.append(len(pairs) == len({a for a, _ in pairs}))
    return found


def test_random_templates_equal_brute_force(spark):
    """Every document with a consistent alignment is told, and none whose alignments nowhere cover enough."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    items, shapes = [], []
    for i in range(6):
        shape = [rng.choice(words) if rng.random() < 0.75 else rng.choice("xyz") for _ in range(rng.randint(12, 40))]
        shapes.append(shape)
        items.append((i, " ".join({"x": "1", "y": "2", "z": "3"}.get(w, w) for w in shape)))

    def copy(shape, bad):
        values = {c: str(rng.randint(10, 99)) for c in "xyz"}
        return [(str(rng.randint(100, 999)) if bad else values[w]) if w in "xyz" else w for w in shape]

    docs = []
    for d in range(150):
        text = []
        for _ in range(rng.randint(0, 3)):
            text += [rng.choice(words) for _ in range(rng.randint(0, 12))]
            part = copy(rng.choice(shapes), rng.random() < 0.4)
            text += part[: rng.choice([6, 10, len(part), len(part)])]
        docs.append((d, " ".join([*text, "end"])))
    got = {(d, i) for d, i, _ in run(spark, docs, items)[0]}
    alignments = {(d, i): aligned_copies(t, x) for d, t in docs for i, x in items}
    sure, possible = {k for k, v in alignments.items() if any(v)}, {k for k, v in alignments.items() if v}
    assert len(sure) > 40 and sure <= got <= possible
    alone = {k for k, v in alignments.items() if len(v) == 1}
    assert alone & got == alone & sure


def test_null_ids_equal_items_and_a_window_of_many_documents(spark):
    docs = [(None, FILLER + ITEM), *[(i, FILLER + CHANGED + " " + FILLER * (i % 3)) for i in range(300)], (400, (CHANGED + " ") * 200)]
    out, left = run(spark, [d for d in docs if d[0] is not None], [(1, ITEM), (2, ITEM)])
    assert out == sorted((d, i, "reparameterised") for d in [*range(300), 400] for i in (1, 2)) and left == []
    d, b = spark.createDataFrame(docs[:1], "doc_id long, text string"), spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.kind) for r in decontamination.contaminated(d, b).collect()] == [(None, 1, "verbatim")]
    assert decontamination.without_leaks(d, b).count() == 0
