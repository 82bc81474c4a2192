"""URL filters by a temporal list join, in DataFrame functions only.

List entries are dated additions and removals of a host, of a domain with all hosts under
it, or of a path prefix.  Per entry they become validity intervals, and every capture is
evaluated against the entries that were active on the day it was fetched.

The as-of join is an equality join on the entry's key and a bucket of ``BUCKET_DAYS``
days, so that neither the whole history of a key nor all captures of a host meet at once;
the captures of a host are spread further by a salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.lineage import materialize
from weftgraph.skew import SALT, join_salted

BUCKET_DAYS = 32
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/:?#]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def url_host(url: Column) -> Column:
    """Lower-case host of a URL, null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def url_place(url: Column) -> Column:
    """Host and path without query, fragment and closing slashes."""
    return F.concat(url_host(url), F.rtrim(F.regexp_extract(url, PATH, 1), F.lit("/")))


def capture_keys(url: Column) -> Column:
    """All ``(kind, key)`` of entries that can match a URL."""
    host, place = url_host(url), url_place(url)

    def tails(parts, sep, first):
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(
            F.slice(parts, i, F.size(parts)) if first else F.slice(parts, 1, i), sep))

    def of(kind, keys):
        return F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))

    return F.when(host.isNotNull(), F.concat(
        F.array(F.struct(F.lit("host").alias("kind"), host.alias("key"))),
        of("domain", tails(F.split(host, r"\."), ".", True)),
        of("prefix", tails(F.split(place, "/"), "/", False))))


def validity(entries: DataFrame) -> DataFrame:
    """``list, kind, key, since, until`` (end exclusive, null: open) from dated entries
    ``list, kind, key, action, day``.

    An addition holds until the next removal.  Of an addition and a removal on one day
    the removal counts.  Entries are first reduced to one per key and day, so the window
    sees at most a row per day, however often a key is listed.
    """
    daily = (entries.where("key is not null and day is not null and action in ('add', 'remove')")
             .groupBy("list", "kind", "key", "day").agg(F.max(F.col("action") == "remove").alias("gone")))
    key = Window.partitionBy("list", "kind", "key").orderBy("day")
    changed = (daily.withColumn("_was", F.coalesce(F.lag("gone").over(key), F.lit(True)))
               .where(F.col("gone") != F.col("_was")))
    return (changed.withColumn("until", F.lead("day").over(key)).where(~F.col("gone"))
            .select("list", "kind", "key", F.col("day").alias("since"), "until"))


def evaluate(captures: DataFrame, entries: DataFrame, allow: tuple[str, ...] = ("allow",),
             bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """One row per capture (``page_id, url, day``) with ``verdict, n_active, list, kind, key, since``.

    The most specific active entry decides (the longest key, then prefix before host before
    domain); where entries tie an ``allow`` list wins, then the list first by name.
    ``verdict`` is ``allow``, ``block`` or ``none``.  A null or malformed URL and a null day
    match nothing, repeated captures are each returned, and without entries or captures
    the result is all ``none`` or empty.
    """
    bucket = lambda c: F.floor(c / bucket_days).cast("int")
    spans = validity(entries)
    last = captures.agg(F.coalesce(F.max("day"), F.lit(0))).first()[0]
    upto = F.greatest(F.col("since"), F.least(F.coalesce(F.col("until") - 1, F.lit(last)), F.lit(last)))
    spans = spans.where(F.col("since") <= F.lit(last)).withColumn(
        "bucket", F.explode(F.sequence(bucket(F.col("since")), bucket(upto))))
    distinct = materialize(captures.groupBy("page_id", "url", "day").agg(F.count(F.lit(1)).alias("_n")), "url-captures")
    keyed = distinct.select("page_id", "url", "day", F.explode(capture_keys(F.col("url"))).alias("_k")).select(
        "page_id", "url", "day", "_k.kind", "_k.key", bucket(F.col("day")).alias("bucket"))
    active = (join_salted(keyed, spans, ["kind", "key", "bucket"], ["page_id", "url", "day"], salt=SALT)
              .where("since <= day and (until is null or day < until)"))
    rank = F.when(F.col("kind") == "prefix", 3).when(F.col("kind") == "host", 2).otherwise(1)
    allows = F.col("list").isin(*allow)
    best = F.max_by(F.struct("list", "kind", "key", "since"),
                    F.struct(F.length("key"), rank, allows.cast("int"), _before("list")))
    found = active.groupBy("page_id", "url", "day").agg(F.count(F.lit(1)).alias("n_active"), best.alias("_best"))
    found = found.select(*[F.col(c).alias(f"_{c}") for c in ("page_id", "url", "day")], "n_active", "_best")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("page_id", "url", "day")]
    out = distinct.join(found, same, "left")
    verdict = F.when(F.col("_best").isNull(), "none").when(F.col("_best.list").isin(*allow), "allow").otherwise("block")
    return out.select("page_id", "url", "day", verdict.alias("verdict"),
                      F.coalesce("n_active", F.lit(0)).alias("n_active"), "_best.list", "_best.kind", "_best.key",
                      "_best.since", F.explode(F.array_repeat(F.lit(1), F.col("_n").cast("int"))).alias("_n")).drop("_n")


def _before(name: str) -> Column:
    """A value that is greater for names earlier in code point order: bytes turned over,
    closed by one that is greater than any."""
    return F.concat(F.translate(F.hex(F.encode(F.col(name), "UTF-8")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))


def _draw(n: int, *parts: Column) -> Column:
    """A number below n from a digest of the parts."""
    return F.pmod(F.conv(F.substring(F.md5(F.encode(F.concat(*parts), "UTF-8")), 1, 7), 16, 10).cast("int"), F.lit(n))


def page_captures(pages: DataFrame) -> DataFrame:
    """The pages as captures, each on a day (0 to 359) that follows from its id."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url",
                        _draw(360, F.lit("fetch"), F.col("page_id").cast("string")).alias("day"))


def page_entries(pages: DataFrame) -> DataFrame:
    """Dated entries of three lists about the hosts, domains and first path parts that the
    pages have: about a third are added, most of these removed later, some added again."""
    host = url_host(F.col("url"))
    domain = F.regexp_extract(host, r"([^.]+\.[^.]+\.[^.]+)$", 1)
    prefix = F.regexp_extract(url_place(F.col("url")), r"^([^/]+/[^/]+)", 1)
    keys = pages.select(F.explode(F.array(
        *[F.struct(F.lit(kind).alias("kind"), key.alias("key"))
          for kind, key in (("host", host), ("domain", domain), ("prefix", prefix))])).alias("k"))
    keys = keys.select("k.*").where("key <> ''").distinct()
    listed = keys.select("kind", "key", F.explode(F.array(F.lit("spam"), F.lit("malware"), F.lit("allow"))).alias("list"))
    name = F.concat("list", "kind", "key")
    start = _draw(300, F.lit("day"), name)
    step = 20 + _draw(90, F.lit("step"), name)
    events = F.array(F.struct(F.lit("add").alias("action"), start.alias("day")),
                     F.struct(F.lit("remove").alias("action"), (start + step).alias("day")),
                     F.struct(F.lit("add").alias("action"), (start + 2 * step).alias("day")))
    return (listed.where(_draw(3, F.lit("pick"), name) == 0)
            .select("list", "kind", "key", F.explode(F.slice(events, 1, 1 + _draw(3, F.lit("n"), name))).alias("e"))
            .select("list", "kind", "key", "e.action", "e.day"))


def url_report(pages: DataFrame) -> DataFrame:
    return evaluate(page_captures(pages), page_entries(pages))


ORACLE = """
WITH u AS (
  SELECT page_id, url, ('0x' || substr(md5('fetch' || page_id), 1, 7))::INT % 360 AS day,
         nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/:?#]+)', 1)), '') AS host,
         rtrim(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/') AS path FROM pages),
k AS (SELECT DISTINCT kind, key FROM (
        SELECT 'host' AS kind, host AS key FROM u
        UNION ALL SELECT 'domain', regexp_extract(host, '([^.]+\\.[^.]+\\.[^.]+)$', 1) FROM u
        UNION ALL SELECT 'prefix', regexp_extract(host || path, '^([^/]+/[^/]+)', 1) FROM u) WHERE key <> ''),
l AS (SELECT kind, key, list, list || kind || key AS name
      FROM k, (SELECT unnest(['spam', 'malware', 'allow']) AS list)),
p AS (SELECT *, ('0x' || substr(md5('day' || name), 1, 7))::INT % 300 AS start,
             20 + ('0x' || substr(md5('step' || name), 1, 7))::INT % 90 AS step,
             1 + ('0x' || substr(md5('n' || name), 1, 7))::INT % 3 AS n
      FROM l WHERE ('0x' || substr(md5('pick' || name), 1, 7))::INT % 3 = 0),
v AS (SELECT list, kind, key, start AS since, CASE WHEN n > 1 THEN start + step END AS until FROM p
      UNION ALL SELECT list, kind, key, start + 2 * step, NULL FROM p WHERE n = 3),
m AS (SELECT u.page_id, u.url, u.day, v.* FROM u JOIN v ON v.since <= u.day AND (v.until IS NULL OR u.day < v.until)
      AND CASE v.kind WHEN 'host' THEN u.host = v.key WHEN 'domain' THEN u.host = v.key OR ends_with(u.host, '.' || v.key)
               ELSE u.host || u.path = v.key OR starts_with(u.host || u.path, v.key || '/') END),
b AS (SELECT *, count(*) OVER (PARTITION BY page_id) AS n_active,
             row_number() OVER (PARTITION BY page_id ORDER BY length(key) DESC,
               CASE kind WHEN 'prefix' THEN 3 WHEN 'host' THEN 2 ELSE 1 END DESC, list = 'allow' DESC, list) AS r FROM m)
SELECT u.page_id, u.url, u.day, CASE WHEN b.list IS NULL THEN 'none' WHEN b.list = 'allow' THEN 'allow' ELSE 'block' END
         AS verdict, coalesce(b.n_active, 0) AS n_active, b.list, b.kind, b.key, b.since
FROM u LEFT JOIN b ON b.page_id = u.page_id AND b.r = 1
"""
