"""The pipeline against its stages done plainly, and the queries' SQL."""

import collections

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from check import TABLES, rows_of
from test_llm_mixing import plain_targets
from test_llm_near_join import plain
from weftgraph.llm import decontamination as D
from weftgraph.llm.queries import ORACLES, REGISTRY

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_rules(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept = set(rows)
    out = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        before, out = kept, stage(spark, out, SF)
        assert out.columns == docs.columns
        kept = [r["doc_id"] for r in out.collect()]
        assert len(kept) == len(set(kept))
        kept = set(kept)
        if name == "language":
            assert kept == {i for i in before if any(c.isalpha() for c in rows[i]["text"] or "")}
        elif name == "near copies":
            assert kept == {c for _, _, c in plain([(i, rows[i]["text"]) for i in before], 5, 80, 100)}
        else:
            norm = lambda t: " " + " ".join(D._words(t.lower())) + " "
            items = [norm(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert kept == {i for i in before if not any(s in norm(rows[i]["text"]) for s in items)}
    words = {i: len(rows[i]["text"].split()) for i in kept}
    sizes, taken = collections.Counter(), collections.Counter()
    for i in kept:
        sizes[rows[i]["source"]] += words[i]
    mixed = corpus_pipeline.STAGES[3][1](spark, out, SF)
    copies = collections.Counter(r["doc_id"] for r in mixed.collect())
    assert mixed.columns == docs.columns and set(copies) <= kept and max(copies.values()) <= 2
    for i, n in copies.items():
        taken[rows[i]["source"]] += n * words[i]
    for s, t in plain_targets(dict(sizes)).items():
        assert 0.95 * t <= taken[s] <= t + 1e-6
    final = corpus_pipeline.run(spark, SF).collect()
    assert collections.Counter(r["doc_id"] for r in final) == copies
    slots = collections.defaultdict(list)
    for r in final:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, _key int, lang_pred string, _hits int, "
          "size int, copies int, _SALT int, digest string")
MORE = (0, "", 0, 0, 0, 0, "")


def test_odd_documents_pass_every_stage(spark):
    words = "the quick brown fox jumps over the lazy dog near the old river bank while the children watch it"
    rows = [(i, f"{words} and number{i} {'word ' * i}", "en", None if i % 2 else "a", 1, *MORE) for i in range(1, 12)]
    rows += [(20, None, "en", "a", 0, *MORE), (21, "", None, None, 0, *MORE), (22, "12 34", "en", "a", 5, *MORE),
             (None, " ".join(words.split()[::-1]), None, "a", 9, *MORE), (23, words * 3000, "en", "b", 9, *MORE)]
    rows += [rows[0]] * 3
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF)
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")], name
        got = [r["doc_id"] for r in docs.collect()]
        assert 23 in got and not {20, 21, 22} & set(got), name
        if name == "near copies":
            assert got.count(1) == 1 and None in got  # repeated rows are copies
    out = corpus_pipeline.STAGES[4][1](spark, docs, SF)
    assert out.count() == docs.count() and out.columns[0] == "doc_id"


def test_empty_table_passes_every_stage(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.collect() == [], name


def test_registered():
    names = entry.queries()
    assert names["pipeline"] is corpus_pipeline.run
    assert {int(n[2:].split("_")[0]) for n in REGISTRY} == set(range(1, 14)) and set(REGISTRY) <= set(names)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = REGISTRY[name](spark, SF)
    cur = con.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cur.fetchall())
