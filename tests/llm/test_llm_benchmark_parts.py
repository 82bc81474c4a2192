"""Decontamination: the number of indexes changes no hit and no score."""

import random

from weftgraph.llm import decontamination as D


def test_hits_do_not_depend_on_the_number_of_indexes(spark, monkeypatch):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(80)]
    weights = [80 / (k + 1) for k in range(80)]
    items = [(i, " ".join(rng.choices(vocab, weights, k=rng.randint(1, 25))) + ". End " + rng.choice(vocab)) for i in range(45)]
    items += [(50, " ".join(rng.choices(vocab, weights, k=700))), (3, items[5][1]), (7, items[7][1]), (None, "w1 w2 w3 w4"),
              (60, None), (61, "..")]
    texts = []
    for _ in range(150):
        words = rng.choices(vocab, weights, k=rng.randint(0, 300))
        for _ in range(rng.randint(0, 3)):
            part = [w for w in D._words((rng.choice(items)[1] or "").lower()) if rng.random() < 0.8]
            at = rng.randint(0, len(words))
            words[at:at] = part
        texts.append(" ".join(words))
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = D.BlockMaxIndex(sorted((-1 if i is None else i, t or "") for i, t in items))
    want = sorted((k, *hit) for k, hits in enumerate(whole.search(texts)) for hit in hits)
    assert len(want) > 50
    for index_items in (4096, 20, 3):
        parts = D.build_indexes(b, index_items=index_items)
        assert len(parts) == -(-len(items) // index_items)
        found = {}
        for part in parts:
            for k, hits in enumerate(part.search(texts)):
                for hit in hits:
                    found[k, hit[0]] = max(found.get((k, hit[0]), (0,)), hit[1:])
        assert sorted((k, i) for k, i in found) == [x[:2] for x in want]
        assert all(found[x[:2]][0] == x[2] for x in want)
        monkeypatch.setattr(D, "INDEX_ITEMS", index_items)
        assert len(D.build_indexes(b)) == len(parts)
        assert sorted(tuple(r) for r in D.leak_report(d, b).collect()) == want
