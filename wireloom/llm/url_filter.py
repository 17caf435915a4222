"""URL filter lists over time, with DataFrame operations only.

A list is dated entries that add or remove a pattern: a domain, which also covers its subdomains, or
a domain with the first part of a path.  A pattern's entries become validity intervals, from an
addition's day to the day of the pattern's next entry.  Each capture is evaluated as of its fetch
day: of the patterns that are active then and cover its URL the longest decides.

Captures are first reduced to distinct (host, path part, day), and these to distinct (pattern, day).  The as-of
join is a merge: per pattern its days and the starts of its intervals are put in order, and each day takes the latest interval
that began; it is active if it hasn't ended.  A pattern's group has a row a day at most for its captures and one for its
entries, however many captures a domain has and however far apart days lie.

Defined results: a null URL, or one without a host, has no patterns and isn't blocked; neither is a capture
without a day.  Of several entries of a pattern on one day the one with the largest seq counts (null last; then additions, then
the larger category).  Entries with a null pattern or day are ignored; null `adds` is a removal.  Repeated captures give repeated rows;
an empty table of captures gives no rows, an empty list blocks nothing.  Hosts of any number of labels and any length are taken whole.
Columns of the captures that are named as a result (RESULT) aren't returned; all others are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The columns that evaluate() adds.
RESULT = ["host", "n_active", "pattern", "category", "listed_on", "blocked"]
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
_PART = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^/?#]+)"


def keyed(captures: DataFrame) -> DataFrame:
    """Adds the lower-case host and the first part of the path; '' where there is none. Columns of these names go."""
    host = F.coalesce(F.rtrim(F.lower(F.regexp_extract("url", _HOST, 1)), F.lit(".")), F.lit(""))
    others = [F.col(f"`{c}`") for c in captures.columns if c not in ("host", "part")]
    return captures.select(*others, host.alias("host"), F.coalesce(F.regexp_extract("url", _PART, 1), F.lit("")).alias("part"))


def patterns():
    """All patterns that cover (host, part): the host, its parent domains of two labels or more, and the host with the part."""
    domains = F.expr("""
        CASE WHEN host = '' THEN array()
             WHEN instr(host, '.') = 0 THEN array(host)
             ELSE transform(sequence(1, size(split(host, '[.]')) - 1), i -> array_join(slice(split(host, '[.]'), i, size(split(host, '[.]'))), '.')) END
    """)
    return F.when((F.col("host") == "") | (F.col("part") == ""), domains).otherwise(F.array_append(domains, F.concat("host", F.lit("/"), "part")))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, category, since, until) from entries (pattern, category, day, adds, seq); until is null while active."""
    last = F.max(F.struct("seq", F.coalesce("adds", F.lit(False)).alias("adds"), "category")).alias("last")
    daily = entries.where("pattern is not null and day is not null").groupBy("pattern", "day").agg(last)
    # one row a pattern and day, so a window holds no more than a pattern's days
    following = F.lead("day").over(Window.partitionBy("pattern").orderBy("day"))
    spans = daily.select("pattern", F.col("day").alias("since"), following.alias("until"), "last.adds", "last.category")
    return spans.where("adds").select("pattern", "category", "since", "until")


def as_of(asked: DataFrame, active: DataFrame) -> DataFrame:
    """(pattern, day, category, since) for the distinct (pattern, day) of asked that lie in an interval."""
    days = asked.select("pattern", "day").distinct().withColumn("i", F.lit(None).cast("struct<since:bigint,until:bigint,category:string>"))
    starts = active.select("pattern", F.col("since").alias("day"), F.struct(F.col("since").cast("long").alias("since"), F.col("until").cast("long").alias("until"), "category").alias("i"))
    both = days.withColumn("asks", F.lit(1)).unionByName(starts.withColumn("asks", F.lit(0)))
    latest = F.last("i", ignorenulls=True).over(Window.partitionBy("pattern").orderBy("day", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = both.withColumn("i", latest).where("asks = 1 and i is not null and (i.until is null or day < i.until)")
    return met.select("pattern", "day", "i.category", "i.since")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Each capture (with url and day) with host, n_active, pattern, category, listed_on and blocked."""
    own = [c for c in captures.columns if c not in RESULT]
    captures = captures.select(*[F.col(f"`{c}`") for c in own])
    seen = keyed(captures.select("url", F.col("day").cast("long").alias("day"))).where("host != '' and day is not null").select("host", "part", "day").distinct()
    asked = seen.select("host", "part", "day", F.explode(patterns()).alias("pattern"))
    met = asked.join(as_of(asked, intervals(entries)), ["pattern", "day"])
    best = F.max(F.struct(F.length("pattern").alias("n"), "pattern", "category", "since"))
    verdict = met.groupBy("host", "part", "day").agg(F.count("*").alias("n_active"), best.alias("best"))
    keys = keyed(captures.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), "url", F.col("day").cast("long").alias("day")))
    found = keys.join(verdict, ["host", "part", "day"], "left")
    return found.select(
        *[F.col("row")[c].alias(c) for c in own],
        "host",
        F.coalesce("n_active", F.lit(0)).alias("n_active"),
        F.col("best.pattern").alias("pattern"),
        F.col("best.category").alias("category"),
        F.col("best.since").alias("listed_on"),
        F.col("best").isNotNull().alias("blocked"),
    )


#: The tables hold no lists and no fetch times.  The query's list is derived from all patterns of the
#: pages: by the digits of its MD5 a pattern is listed or not, from a day on, for some days, and
#: perhaps listed again.  A page's fetch day follows from its id.
FIRST, DAYS = 19000, 1096


def listed(pages: DataFrame) -> DataFrame:
    known = keyed(pages).groupBy("host", "part").agg(F.lit(1).alias("one"))
    known = known.select(F.explode(patterns()).alias("pattern")).distinct().withColumn("h", F.md5("pattern")).where("substr(h, 1, 1) < '6'")
    digits = lambda at, n: F.conv(F.substring("h", at, n), 16, 10).cast("long")
    start, days = F.lit(FIRST) + F.pmod(digits(2, 3), F.lit(DAYS)), digits(5, 2) + 30
    category = F.when(F.expr("substr(h, 7, 1) < '8'"), "malware").otherwise("spam")
    dated = F.array(
        F.struct(start.alias("day"), F.lit(True).alias("adds"), F.lit(1).alias("seq")),
        F.struct((start + days).alias("day"), F.lit(False).alias("adds"), F.lit(2).alias("seq")),
        F.struct((start + days + 60).alias("day"), F.expr("substr(h, 8, 1) < '8'").alias("adds"), F.lit(3).alias("seq")),
    )
    return known.select("pattern", category.alias("category"), F.explode(dated).alias("e")).select("pattern", "category", "e.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.withColumn("day", F.lit(FIRST) + F.pmod(F.col("page_id") * 7919, F.lit(DAYS)))
    return evaluate(captures, listed(pages)).withColumn("n_active", F.col("n_active").cast("long"))


SQL = rf"""
WITH k AS (
  SELECT page_id, url, {FIRST} + ((page_id * 7919) % {DAYS} + {DAYS}) % {DAYS} AS day,
         rtrim(lower(coalesce(regexp_extract(url, '{_HOST}', 1), '')), '.') AS host, coalesce(regexp_extract(url, '{_PART}', 1), '') AS part
  FROM pages),
l AS (SELECT *, CASE WHEN host = '' THEN 0 ELSE greatest(len(string_split(host, '.')) - 1, 1) END AS n FROM k),
c AS (
  SELECT page_id, day, array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.') AS pattern
  FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM l)
  UNION ALL SELECT page_id, day, host || '/' || part FROM l WHERE host <> '' AND part <> ''),
h AS (SELECT pattern, md5(pattern) AS h FROM (SELECT DISTINCT pattern FROM c)),
s AS (
  SELECT pattern, CASE WHEN substr(h, 7, 1) < '8' THEN 'malware' ELSE 'spam' END AS category, substr(h, 8, 1) < '8' AS again,
         {FIRST} + CAST('0x' || substr(h, 2, 3) AS BIGINT) % {DAYS} AS a, CAST('0x' || substr(h, 5, 2) AS BIGINT) + 30 AS days
  FROM h WHERE substr(h, 1, 1) < '6'),
i AS (
  SELECT pattern, category, a AS since, a + days AS until FROM s
  UNION ALL SELECT pattern, category, a + days + 60, NULL FROM s WHERE again),
m AS (SELECT c.page_id, c.day, c.pattern, i.category, i.since FROM c JOIN i ON c.pattern = i.pattern AND i.since <= c.day AND (i.until IS NULL OR c.day < i.until)),
b AS (SELECT page_id, count(*) AS n_active, max({{'n': length(pattern), 'pattern': pattern, 'category': category, 'since': since}}) AS best FROM m GROUP BY page_id)
SELECT l.page_id, l.url, l.day, l.host, coalesce(b.n_active, 0) AS n_active, b.best.pattern AS pattern, b.best.category AS category,
       b.best.since AS listed_on, b.page_id IS NOT NULL AS blocked
FROM l LEFT JOIN b ON l.page_id = b.page_id
"""
