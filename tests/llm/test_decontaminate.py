import random

from tallyward.llm import decontaminate as d

DOCS, BENCH = "doc_id long, text string, h string, at int", "item_id long, text string, tok string"


def run(spark, docs, bench):
    return {(r.doc_id, r.item_id): r for r in d.leaks(spark.createDataFrame([(*x, "a", 1) for x in docs], DOCS), spark.createDataFrame([(*x, "t") for x in bench], BENCH)).collect()}


QUESTION = "A train leaves the old station with Anna at 9 km from town and reaches the river after 45 minutes, how far does Anna walk home?"


def test_copies_and_new_parameters_are_leaks(spark):
    other = QUESTION.replace("Anna", "Boris").replace("9 km", "3,500 miles").replace("45", "7")
    loose = QUESTION.replace("with Anna", "with Boris").replace("9", "3")  # Boris leaves, Anna walks home: one name, two values
    bench = [(1, QUESTION), (2, "Nothing of this kind is ever written in any of those long documents."), (3, None), (4, "too short"), (1, QUESTION)]
    docs = [
        (10, "Some words before. " + QUESTION + " Some words after."), (11, "start in the middle of " + other.lower().replace("boris", "Boris")),
        (12, "A text about trains that leave an old station, not more than that."), (13, None), (14, ""), (None, QUESTION), (15, loose), (10, "again"),
        (16, "word " * 30_000 + QUESTION.upper()),
    ]
    got = run(spark, docs, bench)
    assert {k for k in got} >= {(10, 1), (11, 1), (None, 1)}
    assert got[10, 1].verbatim and not got[11, 1].verbatim and got[11, 1].n_loose == 0
    assert not {k for k in got if k[0] in (12, 13, 14) or k[1] != 1}
    assert (15, 1) not in got or got[15, 1].n_loose <= 0.2 * got[15, 1].n_slots
    cleaned = d.clean(spark.createDataFrame([(*x, "a", 1) for x in docs], DOCS), spark.createDataFrame([(*x, "t") for x in bench], BENCH))
    assert {r.doc_id for r in cleaned.collect()} >= {12, 13, 14} and 10 not in {r.doc_id for r in cleaned.collect()}


def test_copies_in_one_case(spark):
    item = "Der alte Mann sah das Haus, den Garten und die Katze an der Wand, als Anna im Winter mit Otto zum Fluss kam und lachte"
    docs = [(1, "vorher " + item.lower()), (2, item.upper() + " NACHHER"), (3, "Kein Wort davon im Winter an der Wand"), (4, item)]
    assert {k[0] for k in run(spark, docs, [(7, item)])} == {1, 2, 4}


def test_copies_of_items_rich_in_names(spark):
    items = [
        (1, "In the old house by the sea lived Anna Smith, Ben Jones, Carl White and a dog that never barked"),
        (2, "The prize went to Anna Smith, Ben Jones, Carl White and Dora Black because their essay on rivers was best."),
        (3, "How Many Apples Did Anna Smith Give To Ben Jones On Monday Morning?"),
        (4, "12 14 16 18 20 22 24 26 28 30"),
    ]
    docs = [(10 * k, f"This was said before. {t} And this comes after.") for k, t in items] + [(10 * k + 1, t) for k, t in items]
    docs.append((99, "Where Many Pears Did Otto Brown Take To Carl White On Friday Evening? 11 13 15 17 19 21 23 25 27 29"))
    docs.append((22, items[1][1].replace("Anna Smith", "Emil Stone").replace("Carl White", "Rosa Green")))
    got = run(spark, docs, items)
    assert set(got) == {(10 * k + j, k) for k, _ in items for j in (0, 1)} | {(22, 2)}
    assert all(r.coverage == 1 for r in got.values())


def test_each_text_of_an_id_is_an_item(spark):
    texts = [QUESTION, "Nothing of this kind is ever written in any of those long documents.", "Seven white birds sat on the roof of the house and sang until it rained."]
    for ids in ((1, 1, 1), (None, None, None)):
        got = d.leaks(spark.createDataFrame([(k, t, "a", 1) for k, t in enumerate(texts)], DOCS), spark.createDataFrame([(i, t, "t") for i, t in zip(ids, texts)] * 2, BENCH)).collect()
        assert sorted((r.doc_id, r.item_id) for r in got) == [(k, ids[0]) for k in range(3)]


def test_inconsistent_slots_are_not_leaks(spark):
    item = "The number 5 comes first and the number 5 comes second while the number 5 comes third of all"
    same, mixed = item.replace("5", "8"), "The number 1 comes first and the number 2 comes second while the number 3 comes third of all"
    assert set(run(spark, [(1, same), (2, mixed)], [(7, item)])) == {(1, 7)}


def test_passages_agree_with_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    bench = [(i, " ".join(word() for _ in range(rng.randint(12, 40)))) for i in range(30)]
    docs, want = [], set()
    for i in range(200):
        words = [word() for _ in range(rng.randint(0, 120))]
        if rng.random() < 0.4:
            k, text = rng.choice(bench)
            at = rng.randint(0, len(words))
            words[at:at] = text.split()
            want.add((i, k))
        docs.append((i, " ".join(words)))
    assert set(run(spark, docs, bench)) == want


def test_many_windows_take_the_other_join(spark, monkeypatch):
    monkeypatch.setattr(d, "BROADCAST_WINDOWS", 0)
    assert set(run(spark, [(1, "well " + QUESTION), (2, "no")], [(7, QUESTION)])) == {(1, 7)}


def test_empty_tables(spark):
    assert not run(spark, [], [(1, QUESTION)]) and not run(spark, [(1, QUESTION)], [])


def test_clean_drops_documents_and_texts_without_id(spark):
    item = "a farmer sells seven baskets of apples to the old market near the river every day"
    other = "nothing of the kind stands in these words at all, nor anywhere near them today"
    names = ["doc_id", "text", "key", "bad", "a.b", "item"]
    rows = [(1, "before " + item + " after", *"abcd"), (6, other, *"efgh"), (None, item, *"ijkl"), (None, other, *"mnop"), (2, None, *"qrst"), (3, "", *"uvwx"), (4, "word " * 50_000 + item, *"yzyz")]
    df = spark.createDataFrame(rows, names)
    kept = d.clean(df, spark.createDataFrame([(5, item)], "item_id long, text string"))
    assert kept.columns == names and {r["a.b"] for r in kept.collect()} == {"g", "o", "s", "w"}
    assert d.clean(df, spark.createDataFrame([], "item_id long, text string")).count() == 7
    assert d.clean(df.limit(0), spark.createDataFrame([(5, item)], "item_id long, text string")).count() == 0
