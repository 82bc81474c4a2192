"""Personal data: base spans against plain matching, estimates on votes with known truth."""

import hashlib
import random
import re

from weftgraph.llm import pii
from weftgraph.llm.queries import REGISTRY

SF = "/root/testdata/sf0.01"
# The base patterns as they are stated for the query.
BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        total += sum(divmod(int(c) * (1 + i % 2), 10))
    return total % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                    or kind == "card" and 14 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 10 <= len(digits) <= 15):
                out.append((m.start(), k, kind, m.end()))
    return sorted(out)


def expected(text):
    spans = base_spans(text)
    listed = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)
    return [sum(s[2] == k for s in spans) for k, _ in BASE], hashlib.sha256(listed.encode()).hexdigest(), listed


def check(rows, got):
    by = {}
    for i, t in rows:
        by.setdefault(i, []).append(t)
    assert len(got) == len(rows)
    for r in got:
        assert any((list(r[1:5]), r["base_sha256"]) == expected(t)[:2]
                   and set(expected(t)[2].split(",")) - {""} <= set(r["spans"].split(",")) for t in by[r["doc_id"]]), r


HARD = [
    "a@b.c.d@e.f x@y a.b+c@d-e.fr, a@b..c @x.y é@x.com 𝒳mail me@host.example.com.", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.0003.4 1.2.3",
    "4111 1111 1111 1111, 4111-1111-1111-1112 411111111111111 1 2 3 4 5 6 7 8 9 0 1 2 3 4", "+1 (743) 555-3824 +49--123 +1 2 +123456789012345678 ++1.2.3.4.5.6.7.8.9.0",
    "+1 (743) 555-\n3824", "4111111111111111" * 2, "0.0.0.0 255.255.255.255.255.255.255.255 9999999999999999999999.1.1.1", "a@b.c" * 50,
    "x@y.com+z@y.com z.z@z.z-@z.z", "5500-0000 0000-0004 4000000000000000006 40000000000000000060 +14111111111111111",
    "contact me (at) example.com or call (743) 555-3824 on 8[.]8[.]8[.]8", "".join(random.Random(1).choices("0123456789.-+@ ()ab\né𝒳", k=4000)),
    "a" * 60_000 + " " + "1" * 60_000 + " " + "1 " * 30_000 + "a@" + "b." * 30_000 + "c " + "+1" + "(" * 60_000 + "1.2.3." * 20_000 + "4",
    "1.2.3.4 x@y.zz " * 3000,
]


def test_base_spans(spark):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(50, None), (51, ""), (None, HARD[0]), (52, HARD[1]), (52, HARD[1])]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, spans string, found int")
    check(rows, pii.pii_report(df).collect())


def test_random_texts(spark):
    rng = random.Random(9)
    parts = ["1.2.3.4", "4111111111111111", "+1 (743) 555-3824", "a@b.co", "256.3.4.5", "@", "+", " ", "-", ".", "12", "(", ")", "x", "\n", "é"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 40)))) for i in range(400)]
    check(rows, pii.pii_report(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_query_and_native_plan(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = REGISTRY["op2_weak_pii"](spark, SF)
    assert "Python" not in df._jdf.queryExecution().toString()
    check(docs, df.collect())


def test_empty_table(spark):
    assert pii.pii_report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_spans_that_the_method_adds(spark):
    clean = [(i, f"Write a mail to name{i} (at) example.com or call us: (743) 555-{1000 + i} today") for i in range(60)]
    base = [(100 + i, f"mail name{i}@example.com, call +1 743 555-{1000 + i} token=12345678901234{i:02d}") for i in range(60)]
    got = pii.pii_report(spark.createDataFrame(clean + base, "doc_id long, text string")).collect()
    check(clean + base, got)
    added = [r for r in got if r["doc_id"] < 100 and "phone:" in r["spans"] and "email:" in r["spans"]]
    assert len(added) == 60
    spans = {r["doc_id"]: r["spans"] for r in got}
    assert all("card" not in spans[i] or "card" in expected(t)[2] for i, t in base)


def test_estimated_reliability():
    rng = random.Random(2)
    reliable, table, truth = (0.95, 0.8, 0.6), {}, {}
    for _ in range(4000):
        y = rng.random() < 0.3
        votes = [0 if rng.random() < 0.2 else (1 if (rng.random() < p) == y else -1) for p in reliable]
        key = ",".join(["ip", *map(str, votes)])
        table[key] = table.get(key, 0) + 1
        truth.setdefault(key, []).append(y)
    soft = pii.estimate(sorted(table.items()))
    right = sum(sum((soft[k] > 0.5) == y for y in ys) for k, ys in truth.items())
    assert right / 4000 > 0.9
    assert pii.estimate([]) == {}
