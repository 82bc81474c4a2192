"""Temporal list join against a walk over all entries of all captures."""

import random

from weftgraph.llm import url_lists


def plain(captures, entries, allow=("allow",)):
    days = {}
    for name, kind, key, action, day in entries:
        if key is not None and day is not None and action in ("add", "remove"):
            days.setdefault((name, kind, key), {}).setdefault(day, set()).add(action)
    out = []
    for page, url, day in captures:
        host = place = None
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = rest.split("/")[0].split("?")[0].split("#")[0].rsplit("@", 1)[-1].split(":")[0].lower() or None
            path = rest[len(rest.split("/")[0]):].split("?")[0].split("#")[0] if "/" in rest.split("?")[0].split("#")[0] else ""
            place = host and host + path.rstrip("/")
        active = []
        for (name, kind, key), by in days.items():
            past = [d for d in by if day is not None and d <= day]
            if not past or "remove" in by[max(past)] or host is None:
                continue
            hit = (host == key if kind == "host" else host == key or host.endswith("." + key) if kind == "domain"
                   else place == key or place.startswith(key + "/"))
            if hit:
                run = sorted(past, reverse=True)
                since = run[0]
                for d in run[1:]:
                    if "remove" in by[d]:
                        break
                    since = d
                active.append((-len(key), {"prefix": 0, "host": 1, "domain": 2}[kind], name not in allow, name, kind, key, since))
        active.sort()
        best = active[0] if active else None
        out.append((page, url, day, "none" if not best else "allow" if not best[2] else "block", len(active),
                    *(best[3:] if best else (None,) * 4)))
    return sorted(out, key=str)


CAPTURE, ENTRY = "page_id long, url string, day int, list string", "list string, kind string, key string, action string, day int, url string"


def both(spark, captures, entries):
    got = url_lists.evaluate(spark.createDataFrame([(*c, "x") for c in captures], CAPTURE),
                             spark.createDataFrame([(*e, "y") for e in entries], ENTRY))
    assert got.columns == ["page_id", "url", "day", "verdict", "n_active", "list", "kind", "key", "since"]
    return sorted((tuple(r) for r in got.collect()), key=str), plain(captures, entries)


def test_against_the_plain_walk(spark):
    rng = random.Random(4)
    hosts = ["a.example.com", "b.a.example.com", "example.com", "other.org"]
    keys = [("host", h) for h in hosts] + [("domain", h) for h in (*hosts, "com")] + [
        ("prefix", "a.example.com/x"), ("prefix", "a.example.com/x/y"), ("prefix", "other.org")]
    entries = [(rng.choice(["spam", "malware", "allow"]), *rng.choice(keys), rng.choice(["add", "add", "remove"]), rng.randint(0, 200))
               for _ in range(120)]
    entries += [("spam", "host", None, "add", 1), ("spam", "host", "a.example.com", "add", None), ("spam", "host", "x", "odd", 3)]
    # a hot key with a change on every day
    entries += [("hot", "host", "other.org", "add" if d % 2 else "remove", d) for d in range(300)]
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(['', 'u:p@'])}{h}{rng.choice(['', ':80'])}{p}" for h in (*hosts, "EXAMPLE.com")
            for p in ("", "/", "/x", "/x/y/z?q=/1", "/xy#f", "/x/")]
    captures = [(i, rng.choice(urls), rng.randint(0, 260)) for i in range(400)]
    captures += [(1, None, 5), (2, "no url", 5), (3, urls[0], None), (None, urls[2], 50), (4, urls[1], 7), (4, urls[1], 7), (5, "http://", 1)]
    got, want = both(spark, captures, entries)
    assert got == want


def test_empty_tables(spark):
    got, want = both(spark, [(1, "http://a.b/", 3)], [])
    assert got == want and got[0][3] == "none"
    assert both(spark, [], [("spam", "host", "a.b", "add", 1)]) == ([], [])


def test_native(spark):
    df = url_lists.url_report(spark.createDataFrame([(1, "http://a.b.c/", "x")], "page_id long, url string, html string"))
    assert "Python" not in df._jdf.queryExecution().toString()
