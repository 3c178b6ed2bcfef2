"""Template windows of benchmark items."""

from corpusforge.llm import decontamination as D

ITEMS = [
    (1, "A train leaves the station with Anna at 9 km from the town and 12 passengers stay while 9 others leave it."),
    (2, "the first law of motion says that bodies at rest remain at rest until a force acts"),
    (3, "too short"), (None, "nobody ever numbered this one but it has plenty of words in it"), (5, None), (6, "only five small words here"),
]


def found(spark, docs, items=ITEMS):
    d = spark.createDataFrame([(i, t, 1, "w") for i, t in docs], "doc_id long, text string, item_id int, w string")
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    left = sorted([r.doc_id for r in D.decontaminate(d, b).collect()], key=str)
    return sorted([(r.doc_id, r.item_id) for r in D.contaminated(d, b).collect()], key=str), left


def test_leaks(spark):
    pad = "Some words stand ahead of it. "
    law = ITEMS[1][1]
    docs = [
        (10, pad + ITEMS[0][1] + " And more."),
        (11, pad + ITEMS[0][1].replace("9", "31").replace("12", "7").replace("Anna", "Zoe").replace("km", "miles")),  # other values
        (12, pad + "A train leaves the station with Anna at 31 km from the town and 12 passengers stay while 8 others leave it."),  # one value became two
        (13, "nothing of the kind, though the first law of motion says that"),
        (14, law.upper() + "!"), (15, None), (16, ""), (None, law), (17, "word " * 200_000 + law), (14, law), (18, "so: only five small words here, indeed"), (19, "only five small words there"),
        (20, "nobody ever numbered this one but it has plenty of words in it"), (21, "1,2,3 " + "4," * 20_000 + "5 " + "A. " * 3000),
    ]
    got, left = found(spark, docs)
    assert got == sorted([(10, 1), (11, 1), (14, 2), (None, 2), (17, 2), (18, 6), (20, None)], key=str)
    assert left == sorted([12, 13, 15, 16, 19, 21], key=str)


def test_empty(spark):
    assert found(spark, []) == ([], [])
    assert found(spark, [(1, "a b c d e f g h i j k")], []) == ([], [1])


def test_short_and_partly_copied_items(spark):
    long = " ".join(f"{a}{b}" for a in ("ko", "ma", "ri", "su", "te", "na", "lo") for b in ("ra", "mi", "to", "ne", "du", "la", "vi", "po"))
    assert len(long.split()) == 56
    items = [(1, "What is 12 + 30?"), (2, "Who wrote Hamlet?"), (3, long), (4, "Explain why small birds sing at dawn")]
    part = lambda n: "before it " + " ".join(long.split()[10 : 10 + n]) + " and after"
    docs = [
        (1, "they ask: what is 12 + 30? indeed"), (2, "what is 12 + 31?"), (3, "so who wrote hamlet"), (4, "who wrote Macbeth and Hamlet"),
        (5, part(30)), (6, part(13)), (7, part(12)), (8, "please Explain why small birds sing at dawn"), (9, "please Explain why big birds sing at dawn"),
    ]
    assert found(spark, docs, items) == ([(1, 1), (3, 2), (5, 3), (6, 3), (8, 4)], [2, 4, 7, 9])
