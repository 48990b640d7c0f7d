"""Operator 5, URL filters with redirect equivalence.

A rule names a host and a path prefix; it fits the host with all its subdomains, and the longest rule that fits
wins.  Pages that redirect or name another page as canonical are aliases: the connected components of these
links share a decision.  A page that no rule fits takes its component's: allowed where a rule allows one of its
addresses, else blocked where a rule blocks one, else allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithograph.llm.common import components, cut, table

#: The contract's rules, as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MOST_RULES = 1000


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ?, # or end, A to Z lower-cased; empty for null and without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to the next ?, # or end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _address(url: Column) -> Column:
    """What makes two urls one page: host, path and query; null without a host."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), F.when(rest == "", F.lit("/")).otherwise(rest)))


def _ruling(host: Column, path: Column, rules) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null; equal lengths: the first listed."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    out = F.lit(None)
    for verdict, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _without_dots(path: Column) -> Column:
    """A path that begins with / without its dot segments, as RFC 3986 removes them."""
    parts = F.split(F.substring(path, 2, 1 << 30), "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x))),
    )
    ends = F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0)
    return F.when(path.contains("/."), F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(ends, F.lit("/")).otherwise(F.lit("")))).otherwise(path)


def resolved(url: Column, to: Column) -> Column:
    """What the reference `to` in the page at url names, by RFC 3986; null where that has no host."""
    scheme, origin, path = F.regexp_extract(url, r"^([^:]*:)//", 1), F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), path_of(url)
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"(?s)^(.*/)", 1))
    whole = (
        F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.when(to.contains("://"), to))
        .when(to.startswith("//"), F.concat(scheme, to))
        .when(origin == "", F.lit(None))
        .when(to.startswith("/"), F.concat(origin, to))
        .when(to.startswith("?"), F.concat(origin, path, to))
        .when(to.startswith("#"), F.concat(origin, path, query, to))
        .when(to != "", F.concat(origin, folder, to))
    )
    rest = F.regexp_extract(whole, r"(?s)^.*?://[^?#]*([?#].*)$", 1)
    return F.when(path_of(whole) == "", whole).otherwise(F.concat(F.regexp_extract(whole, r"(?s)^(.*?://[^/?#]*)", 1), _without_dots(path_of(whole)), rest))


#: A tag with its attributes as HTML reads them: a > within a quoted value does not end it, and one that nothing ends takes the rest.
_TAGS = r"""(?i)(<(?:link|meta|base)(?=[\s/])(?:[^>=]++|=\s*+(?:"[^"]*+"?|'[^']*+'?)?+)*+>?)"""
_WHOLE = r"""(?i)^<[a-z]+(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])))*+>$"""
#: An attribute with a value: its name, and the value with its quotes.
_ATTRIBUTE = r"""(?<![^\s"'<>/=])([^\s"'<>/=]++)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)"""


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's first attribute of that name, without quotes; null where there is none."""
    names = F.transform(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), 1), F.lower)
    value = F.get(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), 2), F.array_position(names, name).cast("int") - 1)
    return F.trim(F.regexp_replace(F.regexp_replace(value, r"""(?s)^(["'])(.*)\1$""", "$2"), "&(amp|#38|#x26);", "&"))


def _worked_out(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are worked out once, however often what follows names them: they come out of a generator."""
    return df.select("*", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_")).select(*df.columns, "_.*")


def links(pages: DataFrame) -> DataFrame:
    """(source, target): each page's url and the url that a canonical link or a refresh in its html names.

    rel is a list of words, names and attributes are found in any case, and references count from the page's first <base href>.
    """
    known = _worked_out(pages.where("url is not null").select("url", "html"), tags=F.filter(F.regexp_extract_all("html", F.lit(_TAGS), 1), lambda t: t.rlike(_WHOLE))).drop("html")
    bases = F.filter(F.transform("tags", lambda t: F.when(t.rlike(r"(?i)^<base[\s/]"), _attribute(t, "href"))), lambda b: b != "")
    known = _worked_out(known, first=F.get(bases, F.lit(0)))
    known = _worked_out(known, base=F.coalesce(resolved(F.col("url"), F.col("first")), F.col("url")))
    named = F.transform("tags", lambda t: F.when(t.rlike(r"(?i)^<link[\s/]"), F.struct(F.split(F.lower(_attribute(t, "rel")), r"\s+").alias("rel"), _attribute(t, "href").alias("to"))).when(
        t.rlike(r"(?i)^<meta[\s/]"), F.struct(F.array(F.lower(_attribute(t, "http-equiv"))).alias("rel"), F.regexp_extract(_attribute(t, "content"), r"""(?i)(?:^|[\s;,])url\s*=\s*["']?([^"'\s]+)""", 1).alias("to"))
    ))
    tags = known.select("url", "base", F.explode(F.arrays_zip(named.alias("n"), F.col("tags").alias("t"))).alias("x"))
    says = F.when(F.col("x.t").rlike("(?i)^<link"), F.array_contains("x.n.rel", "canonical")).otherwise(F.array_contains("x.n.rel", "refresh"))
    found = tags.where(F.col("x.n").isNotNull() & says).select("url", "base", F.col("x.n.to").alias("to"))
    return found.select(F.col("url").alias("source"), resolved(F.col("base"), F.col("to")).alias("target")).where("target <> ''")


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """The verdict on every page: page_id, host, path, rule (null where none fits) and verdict, one row per row of pages.

    pages has page_id, url and html; redirects, if given, has source and target urls beside what html says.  A null
    url, or one without ://, has empty host and path, no rule and no aliases.  Null html names no alias.  Links to
    addresses outside the table count: they may carry a rule.  An address is a host, a path, `/` where it is empty, and a
    query; rules are held against addresses, so that the order of rows has no say.  A component may be as large as the table.
    Repeated rows give a row each; an empty table gives none; other columns are not looked at.
    """
    found = links(pages)
    if redirects is not None:
        found = found.union(redirects.select("source", "target"))
    ends = found.select(_address(F.col("source")).alias("s"), _address(F.col("target")).alias("t")).where("s is not null and t is not null and s <> t").distinct()
    # written, so that an address keeps its number
    names = cut(ends.select(F.col("s").alias("address")).union(ends.select("t")).distinct().withColumn("id", F.monotonically_increasing_id()))
    numbered = ends.join(names.select(F.col("address").alias("s"), F.col("id").alias("a")), "s").join(names.select(F.col("address").alias("t"), F.col("id").alias("b")), "t")
    stars = components(numbered.select("a", "b")).join(names, "id")
    here = F.concat(F.lit("://"), F.col("address"))
    ruled = stars.withColumn("v", _ruling(host_of(here), path_of(here), rules)["verdict"])
    decided = ruled.groupBy("component").agg(F.min("v").alias("shared")).where("shared is not null")  # allow comes before block
    aliases = stars.join(decided, "component").select("address", "shared")
    out = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), _address(F.col("url")).alias("address"))
    out = out.withColumn("r", _ruling(F.col("host"), F.col("path"), rules)).join(aliases, "address", "left")
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", "shared", F.lit("allow")).alias("verdict"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


_RULED = "CASE " + " ".join(
    f"WHEN ({{h}} = '{h}' OR {{h}} LIKE '%.{h}') AND starts_with({{p}}, '{p}') THEN '{v} {h}{p}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
) + " END"
#: A url's parts in SQL, each by its own expression.
_SQL_PARTS = r"""lower(split_part({u}, '://', 1)) AS scheme, contains({u}, '://') AS whole, translate(regexp_extract({u}[strpos({u}, '://') + 3:], '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract({u}[strpos({u}, '://') + 3:], '(?s)^[^/?#]*([^?#]*)', 1) AS path, regexp_extract({u}[strpos({u}, '://') + 3:], '(?s)^[^?#]*(\?[^#]*)', 1) AS query"""

def _sql_resolved(name: str, rows: str) -> str:
    """CTEs that end with `name`: (u, h, host, path, query) of what t names seen from the address a, for rows (u, h, a, t)."""
    return rf"""{name}_r AS (SELECT u, h, a, t, regexp_extract(t, '^[^?#]*') AS rp, regexp_extract(t, '^[^?#]*(\?[^#]*)', 1) AS rq FROM {rows} WHERE t <> ''
), {name}_b AS (SELECT a, {_SQL_PARTS.format(u="a")} FROM (SELECT DISTINCT a FROM {name}_r)
), {name}_m AS (
  SELECT u, h, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN starts_with(t, '//') THEN NULL WHEN b.whole THEN b.host END AS host,
    CASE WHEN starts_with(rp, '/') THEN rp WHEN rp = '' THEN b.path WHEN b.path = '' THEN '/' || rp ELSE regexp_extract(b.path, '(?s)^.*/') || rp END AS path,
    CASE WHEN rp = '' AND rq = '' THEN b.query ELSE rq END AS query,
    CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN CASE WHEN contains(t, '://') THEN t END WHEN starts_with(t, '//') THEN 'x:' || t END AS other
  FROM {name}_r r LEFT JOIN {name}_b b USING (a)
), {name}_a AS (SELECT u, h, {_SQL_PARTS.format(u="other")} FROM {name}_m WHERE other IS NOT NULL
), {name}_s AS (SELECT *, string_split(path[2:], '/') AS segments FROM (SELECT u, h, host, path, query FROM {name}_m WHERE other IS NULL UNION ALL SELECT u, h, host, path, query FROM {name}_a) WHERE host <> ''
), {name} AS (
  SELECT u, h, host, query, CASE WHEN path = '' THEN '/' WHEN NOT contains(path, '/.') THEN path ELSE '/' || array_to_string(kept, '/') || CASE WHEN segments[-1] IN ('.', '..') AND len(kept) > 0 THEN '/' ELSE '' END END AS path
  FROM (SELECT *, list_reduce([CAST([] AS VARCHAR[])] || [[x] FOR x IN segments], lambda a, x: CASE WHEN x = ['..'] THEN a[:greatest(len(a) - 1, 0)] WHEN x = ['.'] THEN a ELSE a || x END) AS kept FROM {name}_s)
)"""


#: The same in SQL: the links of the html, resolved by RFC 3986's steps, who reaches whom, and the decision of what is reached.
SQL = rf"""
WITH RECURSIVE urls AS (SELECT DISTINCT url AS u FROM pages WHERE contains(url, '://')
), base AS (SELECT u, {_SQL_PARTS.format(u="u")} FROM urls
), tag AS (SELECT DISTINCT url AS u, html AS h, unnest(regexp_extract_all(html, '(?is)<(?:link|meta|base)[\s/](?:[^>=]|=\s*"[^"]*"|=\s*''[^'']*''|=\s*[^\s"''>])*(?:=\s*)?>')) AS tag FROM pages WHERE url IS NOT NULL
), att AS (SELECT u, h, strpos(h, tag) AS place, lower(regexp_extract(tag, '^<([A-Za-z]+)', 1)) AS kind,
    [lower(x) FOR x IN regexp_extract_all(tag, '([^\s"''<>/=]+)\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>][^\s>]*)', 1)] AS names,
    [trim(regexp_replace(CASE WHEN x[1] IN ('"', '''') THEN x[2:-2] ELSE x END, '&(amp|#38|#x26);', '&', 'g')) FOR x IN regexp_extract_all(tag, '([^\s"''<>/=]+)\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>][^\s>]*)', 2)] AS vals FROM tag
), val AS (SELECT *, vals[list_position(names, 'href')] AS href, vals[list_position(names, 'rel')] AS rel, vals[list_position(names, 'http-equiv')] AS equiv, vals[list_position(names, 'content')] AS content FROM att
), doc AS (SELECT u, h, u AS a, arg_min(href, place) AS t FROM val WHERE kind = 'base' AND href <> '' GROUP BY ALL
), {_sql_resolved("start", "doc")}, named AS (
  SELECT v.u, v.h, coalesce('x://' || d.host || d.path || d.query, v.u) AS a, CASE WHEN kind = 'link' AND list_contains(string_split_regex(lower(rel), '\s+'), 'canonical') THEN href
    WHEN kind = 'meta' AND lower(equiv) = 'refresh' THEN regexp_extract(content, '(?i)(?:^|[\s;,])url\s*=\s*["'']?([^"''\s]+)', 1) END AS t FROM val v LEFT JOIN start d ON d.u = v.u AND d.h = v.h
), {_sql_resolved("clean", "named")}, edges AS (
  SELECT DISTINCT b.host || CASE WHEN b.path = '' THEN '/' ELSE b.path END || b.query AS s, c.host || c.path || c.query AS t FROM clean c JOIN base b ON b.u = c.u WHERE b.host <> ''
), both_ways AS (SELECT s, t FROM edges WHERE s <> t UNION SELECT t, s FROM edges WHERE s <> t
), reach AS (SELECT s, t FROM both_ways UNION SELECT r.s, b.t FROM reach r JOIN both_ways b ON r.t = b.s
), nodes AS (SELECT DISTINCT t AS a, {_RULED.format(h="regexp_extract(t, '^[^/?]*')", p="regexp_extract(t, '(?s)^[^/?]*([^?]*)', 1)")} AS r FROM both_ways
), shared AS (SELECT s, min(split_part(r, ' ', 1)) AS v FROM reach JOIN nodes ON a = t WHERE r IS NOT NULL GROUP BY s
), mine AS (SELECT page_id, {_SQL_PARTS.format(u="url")} FROM pages
), judged AS (SELECT page_id, coalesce(CASE WHEN whole THEN host END, '') AS host, coalesce(CASE WHEN whole THEN path END, '') AS path, host || CASE WHEN path = '' THEN '/' ELSE path END || query AS a FROM mine
), held AS (SELECT *, {_RULED.format(h="host", p="path")} AS r FROM judged)
SELECT page_id, host, path, split_part(r, ' ', 2) AS rule, coalesce(split_part(r, ' ', 1), CASE WHEN host <> '' THEN v END, 'allow') AS verdict
FROM held LEFT JOIN shared ON shared.s = held.a AND host <> ''
"""

QUERIES = {"op5_urls": op5_urls}
ORACLES = {"op5_urls": SQL}
