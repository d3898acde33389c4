"""URL filters as a temporal join: dated list entries become validity intervals, captures meet those active at fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewheel.llm.common import stage

#: At most so many intervals are broadcast; more are joined by a shuffle, salted for hot hosts.
BROADCAST_ROWS = 200_000
SALTS = 16
FOREVER = "9999-12-31"
#: From the widest to the narrowest kind of key.
KINDS = ("domain", "host", "prefix", "url")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def plain_url(url: Column) -> Column:
    """Host in small letters, path and query; without scheme, user, port, fragment and a slash at the end."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.concat(host_of(url), F.regexp_replace(rest, "/$", ""))


def keys_of(url: Column) -> Column:
    """(kind, key) of everything a list entry may name: the host, its domains, its path to each depth, the URL."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels) - i + 1), ".").alias("key")))
    parts = F.split(F.substring_index(plain_url(url), "?", 1), "/")
    paths = F.transform(F.slice(parts, 2, F.size(parts)), lambda _, i: F.struct(F.lit("prefix").alias("kind"), F.array_join(F.slice(parts, 1, i + 2), "/").alias("key")))
    paths = F.filter(paths, lambda k: ~F.endswith(k["key"], F.lit("/")))  # an empty part ends no prefix
    narrow = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("key")) for k, v in (("host", host), ("url", plain_url(url)))])
    return F.when(F.length(host) > 0, F.filter(F.concat(domains, paths, narrow), lambda k: F.length(k["key"]) > 0)).otherwise(F.array().cast("array<struct<kind:string,key:string>>"))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, key, valid_from, valid_to) of dated entries (list, kind, key, action, at); action is add or remove.

    An entry holds from its day until the next one of the same list and key; of entries of one
    day the removal counts. Entries with a null date or key are left out.
    """
    clean = entries.where("at is not null and key is not null").groupBy("list", "kind", "key", "at").agg(F.max("action").alias("action"))
    following = Window.partitionBy("list", "kind", "key").orderBy("at")
    spans = clean.withColumn("valid_to", F.coalesce(F.lead("at").over(following), F.lit(FOREVER).cast("date")))
    return spans.where("action = 'add'").select("list", "kind", "key", F.col("at").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(page_id, url, fetched, blocked, list, kind, key, valid_from) of every capture (page_id, url, fetched).

    Of all entries active on the day of the fetch the narrowest decides, then the longest key,
    then the first list by name. A null or malformed URL or a null day meets none. Rows that
    repeat are each returned; either table may be empty; other columns are ignored.
    """
    spans = stage(intervals(entries), "intervals")
    spans = spans.select("list", F.col("kind").alias("_kind"), F.col("key").alias("_key"), "valid_from", "valid_to")
    rows = captures.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("fetched").cast("date").alias("fetched"))
    # An element of its own keeps captures without a key; it is spread by page and meets nothing.
    own = F.struct(F.lit("").alias("kind"), F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("key"))
    keyed = rows.select("*", F.explode(F.concat(F.array(own), keys_of(F.col("url")))).alias("k")).select("page_id", "url", "fetched", "k.*")
    active = (F.col("kind") == F.col("_kind")) & (F.col("key") == F.col("_key")) & (F.col("fetched") >= F.col("valid_from")) & (F.col("fetched") < F.col("valid_to"))
    if spans.count() <= BROADCAST_ROWS:
        met = keyed.join(F.broadcast(spans), active, "left")
    else:
        salted = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        copies = spans.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = salted.join(copies, active & (F.col("salt") == F.col("_salt")), "left")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    best = F.struct(rank.alias("rank"), F.length("key").alias("long"), F.col("list"), F.col("key"), F.col("valid_from"), F.col("kind"))
    hits = met.where((F.col("kind") == "") | F.col("list").isNotNull())
    order = F.struct(-rank, -F.length("key"), F.col("list"), F.col("key"), F.col("valid_from"))
    found = hits.groupBy("page_id", "url", "fetched").agg(F.min_by(F.when(F.col("list").isNotNull(), best), F.when(F.col("list").isNotNull(), order)).alias("b"), F.count(F.when(F.col("kind") == "", 1)).alias("copies"))
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return found.select("page_id", "url", "fetched", F.col("b").isNotNull().alias("blocked"), F.col("b.list").alias("list"), F.col("b.kind").alias("kind"), F.col("b.key").alias("key"), F.col("b.valid_from").alias("valid_from"))


#: The dates of list entries and fetches of the query are made from the pages, as these have none: a host is on a
#: list from a day that its MD5 gives, off it again some weeks later and back on it. So are, by the first byte of
#: the MD5, some paths, which stay, and some URLs, which are taken off.
FIXED_ENTRIES = (
    ("registry", "domain", "example.org", "add", "2024-06-01"),
    ("registry", "domain", "example.org", "remove", "2024-08-01"),
    ("registry", "domain", "example.net", "add", "2024-11-15"),
)


def made_entries(pages: DataFrame) -> DataFrame:
    def dated(kind: str, name: str, keys: DataFrame, *steps: tuple[str, Column]) -> DataFrame:
        found = keys.where("key <> ''").distinct().withColumn("n", F.conv(F.substr(F.md5("key"), F.lit(1), F.lit(4)), 16, 10).cast("int"))
        start = F.lit("2024-01-01").cast("date")
        s = F.explode(F.array(*[F.struct(F.lit(action).alias("action"), F.date_add(start, day).alias("at")) for action, day in steps])).alias("s")
        chosen = found.where({"host": "true", "prefix": "n < 16384", "url": "n < 8192"}[kind])
        return chosen.select(F.lit(name).alias("list"), F.lit(kind).alias("kind"), "key", s).select("list", "kind", "key", "s.*")

    n, plain = F.col("n"), plain_url(F.col("url"))
    hosts = dated("host", "hosts", pages.select(host_of(F.col("url")).alias("key")), ("add", n % 300), ("remove", n % 300 + 20 + n % 40), ("add", n % 300 + 120))
    path = F.substring_index(F.substring_index(plain, "?", 1), "/", 2)
    paths = dated("prefix", "paths", pages.select(path.alias("key")).where(F.col("key").rlike("/.")), ("add", n % 200))
    urls = dated("url", "urls", pages.select(plain.alias("key")), ("add", n % 100), ("remove", n % 100 + 150))
    fixed = pages.sparkSession.createDataFrame(list(FIXED_ENTRIES), "list string, kind string, key string, action string, at string").withColumn("at", F.col("at").cast("date"))
    return hosts.unionByName(paths).unionByName(urls).unionByName(fixed)


def query(spark, sf_dir: str) -> DataFrame:
    """Every page as a capture on a day that its id gives; edge cases are those of ``evaluate``."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    captures = pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int")).alias("fetched"))
    out = evaluate(captures, made_entries(pages))
    return out.withColumns({"fetched": F.col("fetched").cast("string"), "valid_from": F.col("valid_from").cast("string")})


ORACLE = r"""
WITH u AS (SELECT row_number() OVER () AS rid, page_id, url, CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INT) AS DATE) AS fetched,
                  lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)) AS host,
                  regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1) AS rest FROM pages),
p AS (SELECT *, host || regexp_replace(rest, '/$', '') AS plain, string_split(string_split(host || regexp_replace(rest, '/$', ''), '?')[1], '/') AS parts FROM u),
h AS (SELECT DISTINCT host, CAST('0x' || substr(md5(host), 1, 4) AS INT) AS n FROM p WHERE host <> ''),
a AS (SELECT DISTINCT parts[1] || '/' || parts[2] AS key, CAST('0x' || substr(md5(parts[1] || '/' || parts[2]), 1, 4) AS INT) AS n FROM p WHERE len(parts) > 1 AND parts[2] <> ''),
w AS (SELECT DISTINCT plain AS key, CAST('0x' || substr(md5(plain), 1, 4) AS INT) AS n FROM p WHERE plain <> ''),
e AS (SELECT 'hosts' AS list, 'host' AS kind, host AS key, DATE '2024-01-01' + n % 300 AS f, DATE '2024-01-01' + (n % 300 + 20 + n % 40) AS t FROM h
      UNION ALL SELECT 'hosts', 'host', host, DATE '2024-01-01' + (n % 300 + 120), DATE '9999-12-31' FROM h
      UNION ALL SELECT 'paths', 'prefix', key, DATE '2024-01-01' + n % 200, DATE '9999-12-31' FROM a WHERE n < 16384
      UNION ALL SELECT 'urls', 'url', key, DATE '2024-01-01' + n % 100, DATE '2024-01-01' + (n % 100 + 150) FROM w WHERE n < 8192
      UNION ALL SELECT 'registry', 'domain', 'example.org', DATE '2024-06-01', DATE '2024-08-01'
      UNION ALL SELECT 'registry', 'domain', 'example.net', DATE '2024-11-15', DATE '9999-12-31'),
c AS (SELECT rid, fetched, 3 AS width, 'domain' AS kind, array_to_string(string_split(host, '.')[i:], '.') AS key FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM p WHERE host <> '')
      UNION ALL SELECT rid, fetched, 2, 'host', host FROM p WHERE host <> ''
      UNION ALL SELECT rid, fetched, 1, 'prefix', array_to_string(parts[1:i], '/') FROM (SELECT *, unnest(range(2, len(parts) + 1)) AS i FROM p WHERE host <> '') WHERE parts[i] <> ''
      UNION ALL SELECT rid, fetched, 0, 'url', plain FROM p WHERE host <> ''),
m AS (SELECT rid, list, kind, key, f, row_number() OVER (PARTITION BY rid ORDER BY width, length(key) DESC, list, key, f) AS r
      FROM c JOIN e USING (kind, key) WHERE fetched >= f AND fetched < t)
SELECT page_id, url, CAST(fetched AS VARCHAR) AS fetched, key IS NOT NULL AS blocked, list, kind, key, CAST(CAST(f AS DATE) AS VARCHAR) AS valid_from
FROM p LEFT JOIN m ON p.rid = m.rid AND r = 1
"""
