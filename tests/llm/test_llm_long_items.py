"""Decontamination with items longer than the first length of windows."""

from weftgraph.llm import decontamination as D


def words(name, n, start=0):
    return " ".join(f"{name}{i}" for i in range(start, n))


def test_long_answers_and_questions_count_as_a_whole(spark):
    items = [(1, f"{words('ask', 50)}? {words('tell', 400)}."), (2, f"{words('say', 257)}? {words('reply', 20)}."),
             (3, f"{words('quiz', 40)}? {words('told', 3000)}."), (4, "what is the capital of that land? it is named farville"),
             (5, f"{words('one', 257)}? {words('other', 300)}.")]
    filler = words("f", 900)
    docs = [(1, f"{filler} {words('ask', 50, 14)} {words('tell', 400, 140)} {filler}", {1}),  # the ends of both
            (2, f"{filler} {words('ask', 50)} {words('tell', 128)} {filler}", set()),  # 0.32 of the answer
            (3, f"{filler} say256 {words('reply', 20)} {filler}", set()),  # a word of the question
            (4, f"{filler} {words('say', 257)} {words('reply', 20)} {filler}", {2}),
            (5, f"{words('quiz', 40)} {words('told', 3000, 900)} What is the capital of that land? It is named Farville", {3, 4}),
            (6, f"{words('quiz', 40)} {words('told', 1500)}", set()),
            (7, f"{filler} one256 {words('other', 300)} {filler}", set()),
            (8, " ".join(f"{filler} {words('quiz', 40)} {words('told', 3000)}" for _ in range(40)), {3})]
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame([x[:2] for x in docs], "doc_id long, text string")
    found = {i: set() for i, _, _ in docs}
    for r in D.leak_report(d, b).collect():
        found[r["doc_id"]].add(r["item_id"])
        assert r["score"] >= D.THRESHOLD - 1e-9 and min(r["question_overlap"], r["answer_overlap"]) >= D.OVERLAP
    assert found == {i: want for i, _, want in docs}
    assert {r["doc_id"] for r in D.without_leaks(d, b).collect()} == {i for i, _, want in docs if not want}
