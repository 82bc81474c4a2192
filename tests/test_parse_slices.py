"""Graphs of a batch are parsed in slices, so that a task never holds the triples of a whole batch."""

import pandas as pd

from weftgraph.sources import graph_text as T


def test_batches_are_parsed_in_slices_in_order(monkeypatch):
    monkeypatch.setattr(T, "PARSE_CHARS", 100)
    graphs = ["(s / say-01" + " :tok x" * (i % 7) + ")" if i % 5 else "(s / say-01" for i in range(60)] + ["(s / go" + " :tok y" * 99 + ")"]
    batch = pd.DataFrame({"sent_id": [str(i) for i in range(len(graphs))], "graph": graphs}, index=[3] * len(graphs))
    out = list(T._parse_batches(iter([batch, batch.iloc[:0]])))
    assert len(out) > 10 and max(len(x) for x in out) <= 10
    found = pd.concat(out)
    assert list(found["sent_id"]) == list(batch["sent_id"])
    assert [f is not None for f in found["failure"]] == [i < 60 and i % 5 == 0 for i in range(61)]
    assert [0 if t is None else len(t) for t in found["triples"]] == [0 if i % 5 == 0 else 1 + i % 7 for i in range(60)] + [100]
