"""The pipeline's language stage drops what no profile fits and keeps clean short documents."""

import corpus_pipeline
from pyspark.sql import functions as F
from weftgraph.llm import language

SF = "/root/testdata/sf0.01"


def test_unlearned_scripts_go_and_short_documents_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    strange = {-1: "这是一份没有学过的文字的文件。" * 20, -2: "Это документ на языке, которого нет в профилях. " * 20,
               -3: "这是一份没有学过的文字的文件。" * 20 + " ok", -4: "漢"}
    planted = spark.createDataFrame([(i, t, None) for i, t in strange.items()], "doc_id long, text string, lang string")
    held = docs.where(~language.training_part(F.col("doc_id")) & F.col("lang").isNotNull() & (F.trim("text") != ""))
    short = held.select((F.col("doc_id") + 10_000_000).alias("doc_id"), F.lit(None).cast("string").alias("lang"),
                        F.regexp_extract("text", r"^\s*(\S+(\s+\S+){0,4})", 1).alias("text")).where(F.col("text").rlike(r"\p{L}"))
    given = docs.unionByName(planted, allowMissingColumns=True).unionByName(short, allowMissingColumns=True)
    profiles = language.fit_profiles(given)
    least = language.least_score(given, profiles)
    assert 0 < least < 1
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, given, SF).select("doc_id").collect()}
    assert not kept & set(strange)
    for part in (held, short):
        ids = {r["doc_id"] for r in part.collect()}
        assert ids and ids <= kept


def test_threshold_and_profiles_are_learned_from_all_documents(spark):
    """A document that the sample of a large language leaves out counts for both."""
    letters = "abcdefghijklmnop"
    name = lambda i: "".join(letters[int(d, 16)] for d in f"{i:x}")
    rows = [(i, f"kato mato pato sato {name(i)}", "aa") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    drawn = {r["text"] for r in language.training_sample(docs).collect()}
    learned = {r["text"] for r in language.training_sample(docs, fit_docs=None).collect()}
    assert drawn < learned and len(learned) > language.FIT_DOCS
    odd = next(i for i, t, _ in rows if t in learned - drawn)
    strange = "zwr " * 40_000
    docs = spark.createDataFrame([(i, strange if i == odd else t, x) for i, t, x in rows], docs.schema)
    profiles = language.fit_profiles(docs, fit_docs=None)
    assert profiles.predict("zwr", language.letter_table())[1] > 0
    few = language.fit_profiles(docs)
    far = few.predict(strange, language.letter_table())[1]
    assert language.least_score(docs, few, share=1.0, tail=0.0) == far
