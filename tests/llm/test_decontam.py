"""Re-parameterised and exact copies of benchmark items."""

import pyarrow as pa

from webloom.llm import decontam

ITEM = "Anna has 12 apples. Anna buys 5 more. Anna eats 3 of them. Anna gives 2 to Tom."
NUMBERS = "Anna 12 km Bob 30 km Carla 7 kg Tom 4 kg 9 h"


def shared(one, two, width=decontam.WIDTH):
    a, b = (set(decontam.Template(pa.array([t])).windows(width)[1].tolist()) for t in (one, two))
    return len(a & b)


def test_windows_of_names_at_sentence_starts():
    assert shared(ITEM, ITEM.replace("Anna", "Bob")) >= 5
    assert shared("Anna has 12 apples and buys many more", "so they say Bob has 9 apples and buys many more") == 1
    assert shared("Anna sees The old cat here today now", "anna sees the old cat here today now") == 0


def test_forms_hash_as_the_words_do():
    one, two = (decontam.Template(pa.array([t])) for t in ("Anna has 12 apples and buys many more", "x Anna has 12 apples and buys many more"))
    starts, hashes, choices = one.windows(8)
    assert hashes[choices == 1].tolist() == two.windows(8)[1][two.windows(8)[0] == 1].tolist()
    assert one.slots(0, 8, 1) == ["anna", "12"] and one.slots(0, 8) == ["12"] and one.slots(0, 8, decontam.LITERAL) == []


def test_poor_windows_and_short_items_by_their_words():
    assert shared(NUMBERS, "He said: " + NUMBERS) == len(NUMBERS.split()) - decontam.WIDTH + 1
    assert shared(NUMBERS, NUMBERS.replace("Anna", "Eva").replace("12", "13")) == len(NUMBERS.split()) - decontam.WIDTH - 1
    assert shared("What is 7?", "he asks: what is 7? nothing", 3) == 1
    assert shared("What is 7?", "he asks: what is 8? nothing", 3) == 0


def test_copies_are_contaminated(spark):
    texts = [ITEM.replace("Anna", "Bob"), "Before this. " + ITEM.replace("Anna", "Eva").replace("12", "14") + " After.", "Look, " + NUMBERS + " it says", "he asks: what is 7? nothing",
             "he asks: what is 8? nothing", NUMBERS.replace("Carla 7", "Rosa 8").replace("Bob 30", "Ida 31"), None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM), (2, NUMBERS), (3, "What is 7?")], "item_id long, text string")
    got = {r.doc_id: r.bench_items for r in decontam.decontaminate(docs, items).collect()}
    assert [got[i] for i in range(len(texts))] == [[1], [1], [2], [3], None, None, None, None]
