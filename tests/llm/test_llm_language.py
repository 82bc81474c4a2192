"""Language identification: a plain profile and distance, held-out accuracy, edge cases."""

import collections
import zlib

from weftgraph.llm import language
from weftgraph.llm.queries import REGISTRY

SF = "/root/testdata/sf0.01"


def plain_counts(text):
    blanked = "".join(c if c.isalpha() else " " for c in text.lower())
    padded = " " + " ".join(blanked.split()) + " "
    if not padded.strip():
        return {}
    out = collections.Counter()
    for n in (1, 2, 3):
        for i in range(len(padded) - n + 1):
            gram = padded[i:i + n]
            if gram != " ":
                code = 0
                for c in gram:
                    code = code << 21 | ord(c)
                out[code] += 1
    return dict(out)


def test_counts_against_a_plain_loop(monkeypatch):
    letters = language.letter_table()
    texts = ["The cat, the DOG; 12 x", "", "...", "é", "a  b\n\nc", "中文 字 𝒳y", "x" * 50, " lead and trail ", "²½ 3"]
    for piece in (1 << 18, 3, 1):
        monkeypatch.setattr(language, "PIECE", piece)
        for t in texts:
            codes, n = language.gram_counts(t, letters)
            assert dict(zip(codes.tolist(), n.tolist())) == plain_counts(t), (t, piece)


def test_distance_is_out_of_place(spark):
    letters = language.letter_table()
    by = {name: language.ranked(*language.gram_counts(t, letters), 20) for name, t in
          (("xx", "abra cadabra abra"), ("yy", "zebra zulu zoo"))}
    known = language.Profiles.of(by, 20)
    for text in ("abra", "zulu zebra", "qq"):
        counts = plain_counts(text)
        mine = sorted(counts, key=lambda c: (-counts[c], c))[:20]
        far = {}
        for name, profile in by.items():
            place = {c: i for i, c in enumerate(profile.tolist())}
            far[name] = sum(abs(i - place[c]) if c in place else 20 for i, c in enumerate(mine))
        best = min(sorted(far), key=lambda name: far[name])
        lang, score = known.predict(text, letters)
        assert lang == best and abs(score - (1 - far[best] / (20 * len(mine)))) < 1e-12


def test_query_on_held_out_documents(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = REGISTRY["op3_rank_order_language"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
    held = [r for r in got if r["held_out"]]
    right = sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held)
    assert right >= 0.97 * len(held)


def test_edge_cases(spark):
    schema = "doc_id long, text string, lang string, lang_pred string, Score double, _lang int"
    text = {"aa": "kato mato pato kato", "bb": "wulf gulf sulf wulf"}
    rows = [(i, text["aa" if i % 2 else "bb"], "aa" if i % 2 else "bb", "q", 0.0, 1) for i in range(40)]
    rows += [(100, None, "aa", "q", 0.0, 1), (101, "12 !", "aa", "q", 0.0, 1), (102, "", None, "q", 0.0, 1),
             (None, "kato", "aa", "q", 0.0, 1), (3, text["aa"], "aa", "q", 0.0, 1), (103, "kato " * 200_000, None, "q", 0.0, 1)]
    df = spark.createDataFrame(rows, schema)
    got = {r["doc_id"]: r for r in language.language_report(df).collect()}
    assert {got[i]["lang_pred"] for i in (100, 101, 102)} == {"und"} and got[100]["score"] == 0
    assert got[103]["lang_pred"] == got[None]["lang_pred"] == "aa" and got[None]["held_out"]
    assert all(got[i]["lang_pred"] == ("aa" if i % 2 else "bb") for i in range(40))
    kept = language.keep_identified(df, language.fit_profiles(df))
    assert kept.columns == df.columns and kept.count() == len(rows) - 3
    empty = spark.createDataFrame([], schema)
    assert language.language_report(empty).collect() == []
    unknown = language.language_report(spark.createDataFrame([(1, "kato", None, "", 0.0, 1)], schema)).collect()
    assert [(r["lang_pred"], r["score"]) for r in unknown] == [("und", 0.0)]
