"""Decontamination against exhaustive scoring of every window and item."""

import math
import random
from collections import Counter

from weftgraph.llm import decontamination as D
from weftgraph.llm.queries import REGISTRY

SF = "/root/testdata/sf0.01"


def every_window(index, text):
    """Items whose score in some window reaches the threshold, by the definition of BM25."""
    texts = [q + a for _, q, a in index.items]
    n, mean = len(texts), sum(map(len, texts)) / len(texts)
    df = Counter(w for t in texts for w in set(t))
    words, out = D._words(text.lower()), {}
    for at in range(0, max(1, len(words)), index.chunk):
        window = words[at:at + 2 * index.chunk]
        have = set(window)
        for i, t in enumerate(texts):
            own = {w: math.log(1 + (n - df[w] + .5) / (df[w] + .5)) * f * 2.2 / (f + 1.2 * (.25 + .75 * len(t) / mean))
                   for w, f in Counter(t).items()}
            score = sum(v for w, v in own.items() if w in have) / sum(own.values())
            if score >= index.threshold - 1e-12:
                q, a = index.verify(i, window, D.grams_of_window(window))
                if q >= D.OVERLAP and a >= D.OVERLAP and score > out.get(index.items[i][0], 0):
                    out[index.items[i][0]] = score
    return out


def test_same_as_exhaustive_search(monkeypatch):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocab, weights=[60 / (k + 1) for k in range(60)], k=rng.randint(1, 25))) + ". End "
              + rng.choice(vocab)) for i in range(45)]
    index = D.BlockMaxIndex(items)
    texts = ["", None]
    for _ in range(120):
        words = rng.choices(vocab, k=rng.randint(0, 300))
        for _ in range(rng.randint(0, 2)):
            part = D._words(rng.choice(items)[1].lower())
            part = [w for w in part if rng.random() < 0.9]
            at = rng.randint(0, len(words))
            words[at:at] = part
        texts.append(" ".join(words))
    want = [every_window(index, t or "") for t in texts]
    assert sum(map(len, want)) > 30
    for batch, piece in ((200_000, 1 << 20), (50, 1 << 20), (200_000, 1 << 9)):
        monkeypatch.setattr(D, "BATCH_WORDS", batch)
        monkeypatch.setattr(D, "PIECE", piece)
        got = index.search(texts)
        if piece == 1 << 20:
            assert [{h[0]: round(h[1], 9) for h in g} for g in got] == [{k: round(v, 9) for k, v in w.items()} for w in want]
        else:  # windows of a long text start elsewhere: whole items are found all the same
            for g, t in zip(got, texts):
                whole = {i for i, s in items if f" {' '.join(D._words(s.lower()))} " in f" {' '.join(D._words((t or '').lower()))} "}
                assert whole <= {h[0] for h in g}


def test_query_finds_exactly_the_planted_items(spark):
    norm = lambda t: " " + " ".join(D._words(t.lower())) + " "
    items = [(r["item_id"], norm(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [(r["doc_id"], norm(r["text"])) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = sorted((d, i) for d, t in docs for i, s in items if s in t)
    got = REGISTRY["op1_bm25_decontamination"](spark, SF).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == want and want


def test_edge_cases_and_several_indexes(spark, monkeypatch):
    bench = [(1, "what is the capital of that land? it is named farville", "x"), (2, None, "x"), (3, "", "x"), (4, "...", "x"),
             (1, "what is the capital of that land? it is named farville", "x"), (None, "one two three four five six", "x"),
             (6, " ".join(f"long{i}" for i in range(900)), "x")]
    filler = " ".join(f"f{i}" for i in range(500))
    docs = [(1, f"{filler} What is the capital of that land? It is named Farville! {filler}", 1), (2, None, 1), (3, "", 1),
            (4, filler, 1), (5, "the capital of that land", 1), (None, "one two three four five six", 1),
            (7, " ".join(f"long{i}" for i in range(900)), 1), (1, "one two three four five six", 1)]
    b = spark.createDataFrame(bench, "item_id long, text string, hit string")
    d = spark.createDataFrame(docs, "doc_id long, text string, _hits int")
    want = {(1, 1), (None, -1), (7, 6), (1, -1)}
    assert {(r["doc_id"], r["item_id"]) for r in D.leak_report(d, b).collect()} == want
    kept = D.without_leaks(d, b)
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 5]
    parts = D.build_indexes(b, index_items=2)
    assert len(parts) == 4 and sum(len(p.items) for p in parts) == len(D.build_indexes(b)[0].items)
    monkeypatch.setattr(D, "INDEX_ITEMS", 2)
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.leak_report(d, none).collect() == [] and D.without_leaks(d, none).count() == len(docs)
    assert D.leak_report(d.limit(0), b).collect() == []
