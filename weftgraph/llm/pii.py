"""Personal data spans by weak supervision, in DataFrame functions only.

Patterns find candidate spans of four kinds.  Labelers (format rules, gazetteers, words
and characters around the span) vote for or against each candidate or abstain.
Expectation-maximisation over the table of vote patterns estimates how reliable each
labeler is for each kind, and the resulting soft labels train a naive Bayes classifier of
span features, which decides about the candidates that the base patterns do not settle.
Spans that match a base pattern and pass its rule always stay.

Every pattern is written so that the matcher runs in time linear in the text and does not
recurse: repeated groups are possessive, and a run of characters is entered only at its
first character or where the previous match ended.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.lineage import materialize

KINDS = ("email", "ip", "card", "phone")
#: kind, whether it is the base pattern of the kind, a cheap pattern without which a text
#: cannot match, and the pattern itself.  Line feeds are in no pattern.
PATTERNS = (
    ("email", True, r"@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", True, r"[0-9]\.[0-9]", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", True, r"[0-9](?:[\x20-]?[0-9]){9}", r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++"),
    ("phone", True, r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("email", False, r"[(\[{]at[)\]}]",
     r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[{]at[)\]}]\x20?[A-Za-z0-9-]++"
     r"(?:\x20?(?:\.|[(\[{]dot[)\]}])\x20?[A-Za-z0-9-]++)++"),
    ("ip", False, r"[0-9]\[\.\][0-9]", r"(?<![0-9])[0-9]++\[\.\][0-9]++\[\.\][0-9]++\[\.\][0-9]++"),
    ("phone", False, r"[0-9]{3}[\x20.-][0-9]{4}",
     r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])"),
)
#: Country calling codes, top-level domains and issuer prefixes in common use.
CALLING = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
DOMAINS = (r"(?i)(?:\.|dot[)\]}])\x20?(?:com|org|net|edu|gov|mil|int|info|biz|io|dev|app|de|fr|es|it|uk|nl|be|at|ch|pl|pt|eu"
           r"|us|ca|br|mx|cn|jp|in|ru|au)$")
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
CUES = {"email": r"(?i)mail|contact|write|escri|schreib|écri", "ip": r"(?i)\bip\b|host|server|addr|node",
        "card": r"(?i)card|visa|credit|pay|karte|carte|tarjeta", "phone": r"(?i)tel|phone|call|fax|mobil|cell"}
AGAINST = r"(?i)(?:token|key|hash|version|build|id|isbn|sku|serial)\W{0,4}$|[=/#_]$"
CONTEXT = 24
ROUNDS = 25
#: Probability from which a candidate that no base rule settles becomes a span.
ADD_FROM = 0.9
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
MATCH = "array<struct<gap:int,value:string,before:string,after:string>>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits has a Luhn check sum."""
    back, total = F.reverse(digits), F.lit(0)
    for i in range(1, 20):
        d = F.coalesce(F.nullif(F.substring(back, i, 1), F.lit("")).cast("int"), F.lit(0))
        total = total + (d if i % 2 else F.when(d > 4, 2 * d - 9).otherwise(2 * d))
    return total % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    """The rule of a kind for a match of one of its patterns."""
    n = F.length(_digits(value))
    if kind == "ip":
        return F.replace(value, F.lit("[.]"), F.lit(".")).rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$")
    if kind == "card":
        return n.between(14, 19) & _luhn(F.when(n <= 19, _digits(value)).otherwise(F.lit("")))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def find_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, found``: per document and pattern its matches from left to right, each with
    the number of characters since the last one, its text, up to ``CONTEXT`` characters
    before it and one after it."""
    out = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    for i, (_, _, hint, pattern) in enumerate(PATTERNS):
        may = F.col("text").rlike(hint)
        out = out.withColumn(f"_pieces{i}", F.when(may, F.split("text", pattern, -1))).withColumn(
            f"_found{i}", F.when(may, F.regexp_extract_all("text", F.lit(pattern), 0)))
    def matches(i: int) -> Column:
        pieces = F.col(f"_pieces{i}")
        return F.coalesce(F.transform(F.col(f"_found{i}"), lambda value, at: F.struct(
            F.length(F.get(pieces, at)).alias("gap"), value.alias("value"),
            F.right(F.get(pieces, at), F.lit(CONTEXT)).alias("before"),
            F.left(F.get(pieces, at + 1), F.lit(1)).alias("after"))), F.expr(f"cast(array() as {MATCH})"))

    lists = [matches(i) for i in range(len(PATTERNS))]
    return out.select("doc_id", F.array(*lists).alias("found"))


def _votes(kind: str, base: bool, m: Column) -> list[Column]:
    """One vote per labeler: 1, -1 or 0 for no opinion."""
    value, digits = m["value"], _digits(m["value"])
    known = {"email": value.rlike(DOMAINS), "card": digits.rlike(ISSUERS),
             "phone": digits.rlike(CALLING) if base else F.lit(True),
             "ip": ~value.rlike(r"^0*(?:0|10|127|22[4-9]|2[3-5][0-9])\D")}[kind]
    rule = F.when(_passes(kind, value), F.lit(1 if base else 0)).otherwise(F.lit(-1))
    cue = F.when(m["before"].rlike(AGAINST), F.lit(-1)).when(m["before"].rlike(CUES[kind]), F.lit(1)).otherwise(F.lit(0))
    glued = m["before"].rlike(r"[\p{L}\p{N}]$") | m["after"].rlike(r"^[\p{L}\p{N}]")
    return [rule, F.when(known, F.lit(1)).otherwise(F.lit(-1)), cue, F.when(glued, F.lit(-1)).otherwise(F.lit(1))]


def _features(i: int, kind: str, m: Column, votes: list[Column]) -> Column:
    """Values of a small fixed range that describe a candidate."""
    shape = lambda c: F.when(c == "", "none").when(c.rlike(r"[\p{L}\p{N}]"), "word").when(
        c.rlike(r"\s"), "space").otherwise("sign")
    digits = F.least(F.length(_digits(m["value"])), F.lit(20)) if kind != "email" else F.lit(0)
    cols = [("rule", votes[0]), ("known", votes[1]), ("cue", votes[2]), ("digits", digits),
            ("before", shape(F.right(m["before"], F.lit(1)))), ("after", shape(m["after"])),
            ("length", F.floor(F.least(F.length(m["value"]), F.lit(40)) / 8)), ("pattern", F.lit(i))]
    return F.array(*[F.concat(F.lit(f"{kind}|{name}="), c.cast("string")) for name, c in cols])


def spans_of(found: DataFrame) -> DataFrame:
    """``doc_id, spans``: all candidates with kind, place, base rule, votes and features."""
    def add(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda x, y: x + y)

    def with_ends(df: DataFrame, i: int) -> DataFrame:
        # running sums by blocks of about the square root of their number: no step looks at
        # all matches before it
        lengths, blocks = F.col(f"_len{i}"), F.col(f"_block{i}")
        width = F.ceil(F.sqrt(F.size(lengths).cast("double") + 1)).cast("int")
        count = F.floor(F.size(lengths) / width).cast("int")
        df = df.withColumn(f"_len{i}", F.transform(F.get("found", F.lit(i)), lambda m: m["gap"] + F.length(m["value"])))
        df = df.withColumn(f"_block{i}", F.transform(
            F.sequence(F.lit(0), count), lambda b: add(F.slice(lengths, b * width + 1, width))))
        return df.withColumn(f"_end{i}", F.transform(lengths, lambda _, j: add(
            F.slice(blocks, 1, F.least(F.floor(j / width).cast("int"), F.size(blocks)))) + add(
            F.slice(lengths, F.floor(j / width).cast("int") * width + 1, j % width + 1))))

    def spans(i: int) -> Column:
        kind, base = PATTERNS[i][:2]

        def span(m: Column, j: Column) -> Column:
            end, votes = F.get(F.col(f"_end{i}"), j), _votes(kind, base, m)
            return F.struct((end - F.length(m["value"])).alias("start"), F.lit(KINDS.index(kind)).alias("kind"),
                            end.alias("end"), (F.lit(base) & (votes[0] == 1)).alias("stays"),
                            F.concat_ws(",", F.lit(kind), *[v.cast("string") for v in votes]).alias("votes"),
                            _features(i, kind, m, votes).alias("features"))

        return F.transform(F.get("found", F.lit(i)), span)

    out = found
    for i in range(len(PATTERNS)):
        out = with_ends(out, i)
    lists = [spans(i) for i in range(len(PATTERNS))]
    return out.select("doc_id", F.flatten(F.array(*lists)).alias("spans"))


def estimate(table: list[tuple[str, int]], rounds: int = ROUNDS) -> dict[str, float]:
    """Expectation-maximisation for labelers that vote independently given the truth.

    ``table`` has vote patterns (``kind,vote,vote,...``) and their numbers; the result has
    the probability of each pattern to be personal data.  Abstentions say nothing.
    """
    out: dict[str, float] = {}
    for kind in KINDS:
        rows = [(p, [int(v) for v in p.split(",")[1:]], n) for p, n in table if p.split(",")[0] == kind]
        if not rows:
            continue
        width = len(rows[0][1])
        prior, yes, no = 0.5, [0.8] * width, [0.2] * width
        for _ in range(rounds):
            soft = []
            for _, votes, n in rows:
                odds = math.log(prior / (1 - prior))
                for v, a, b in zip(votes, yes, no):
                    odds += math.log(a / b) if v > 0 else math.log((1 - a) / (1 - b)) if v < 0 else 0.0
                soft.append(1 / (1 + math.exp(-max(-50.0, min(50.0, odds)))))
            total = sum(n for *_, n in rows)
            prior = (1 + sum(q * n for q, (*_, n) in zip(soft, rows))) / (2 + total)
            for j in range(width):
                said = [(q, v[j], n) for q, (_, v, n) in zip(soft, rows) if v[j]]
                yes[j] = (4 + sum(q * n for q, v, n in said if v > 0)) / (5 + sum(q * n for q, v, n in said))
                no[j] = (1 + sum((1 - q) * n for q, v, n in said if v > 0)) / (5 + sum((1 - q) * n for q, v, n in said))
        out.update({p: q for (p, *_), q in zip(rows, soft)})
    return out


def _lookup(values: dict[str, float], key: Column) -> Column:
    """A bounded table as a constant of the plan."""
    return F.coalesce(F.from_json(F.lit(json.dumps(values)), "map<string,double>")[key], F.lit(0.0))


def train(spans: DataFrame) -> dict[str, float]:
    """Weights of a naive Bayes classifier: log odds per kind (``prior``) and feature.

    Both tables that come to the driver are bounded by the values that votes and features
    can have, whatever the number of documents.
    """
    each = spans.select(F.explode("spans").alias("s")).select("s.kind", "s.votes", "s.features")
    table = each.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()
    soft = estimate(sorted((r["votes"], r["n"]) for r in table))
    q = _lookup(soft, F.col("votes"))
    sums = (each.select(q.alias("q"), F.explode(F.concat(
        F.col("features"), F.array(F.concat(F.substring_index("votes", ",", 1), F.lit("|prior"))))).alias("feature"))
        .groupBy("feature").agg(F.sum("q").alias("yes"), F.sum(1 - F.col("q")).alias("no")).collect())
    known = {r["feature"]: (r["yes"], r["no"]) for r in sums}
    weights = {}
    for name, (yes, no) in known.items():
        all_yes, all_no = known[name.split("|")[0] + "|prior"]
        weights[name] = (math.log((yes + 1) / (no + 1)) if name.endswith("|prior") else
                         math.log((yes + 1) / (all_yes + 8)) - math.log((no + 1) / (all_no + 8)))
    return weights


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", add_from: float = ADD_FROM) -> DataFrame:
    """``doc_id, spans``: per document the spans ``(start, kind, end, stays)`` by start and
    kind, in code points, end exclusive.  ``stays`` marks those of the base patterns.

    A null text is empty and has no spans; ids may be null or repeat, a row is returned for
    each row; an empty table gives an empty result.  Other columns are not read.
    """
    found = materialize(find_matches(docs, id_col, text_col), "pii-matches")
    spans = materialize(spans_of(found), "pii-spans")
    weights = train(spans)
    least = math.log(add_from / (1 - add_from))

    def likely(s):
        # what breaks the rule of its kind (check sum, ranges) teaches, but is never added
        broken = F.element_at(F.split(s["votes"], ","), 2) == "-1"
        names = F.concat(s["features"], F.array(F.concat(F.substring_index(s["votes"], ",", 1), F.lit("|prior"))))
        return ~broken & (F.aggregate(names, F.lit(0.0), lambda total, f: total + _lookup(weights, f)) >= least)

    base = F.filter("spans", lambda s: s["stays"])
    placed = spans.withColumn("base", base)
    added = F.filter("spans", lambda s: ~s["stays"] & likely(s) & ~F.exists(
        F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    short = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"),
                               s["stays"].alias("stays"))
    return placed.select("doc_id", F.array_sort(F.concat(
        F.transform("base", short), F.array_distinct(F.transform(added, short)))).alias("spans"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone`` (base spans), ``base_sha256``, ``spans`` (all)."""
    out = detect(docs).withColumn("base", F.filter("spans", lambda s: s["stays"]))
    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = [count(k) for k in range(len(KINDS))]
    return out.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
                      _listed(F.col("spans")).alias("spans"))
