r"""URL filters: rules by host and path, and a list of URLs behind a blocked Bloom filter. DataFrame functions alone.

A listed URL sets eight bits of one block of 256 (four words of 64), so a look-up touches one row of the filter. The filter is
a table of at most one row a block; it is broadcast while it has at most MAX_BLOCKS blocks and meets the rows in a shuffled join
beyond. What passes it, listed URLs and a few false positives, goes to an exact hash join with the list; the other rows are not
shuffled at all. The result never depends on the filter's hashes.

Canonical form of a URL (null without `://`): no scheme, fragment, user, default port, final dot of the host or leading
`www.`; host with A-Z lower-cased; path without final slashes; query parameters sorted, without empty ones and TRACKING.
Percent signs stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

BITS_PER_URL = 16
#: Of 256 bits, in a hash table some 100 bytes each.
MAX_BLOCKS = 1 << 17
MAX_RULES = 1000
TRACKING = "^(utm_[^=]*|gclid|fbclid|ref)(=|$)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host/path) of op13_url_filter.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: Hosts with this label are on the list of op13_url_filter.
LISTED_LABEL = "cheap-pills"


def _rest(url: Column) -> Column:
    """What follows the first `://`; empty for null and where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    """Between `://` and the next `/`, `?`, `#` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    """From the host's end to `?`, `#` or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """See above."""
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(host(url), "^[^@]*@", ""), ":(80|443)?$", ""), r"\.$", "")
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    text = F.concat(F.regexp_replace(name, r"^www\.", ""), F.regexp_replace(path(url), "/+$", ""), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(F.instr(url, "://") > 0, text)


def fitting_rule(host_: Column, path_: Column, rules: list[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, or null. A rule `host/path` fits its host and all subdomains where the
    path starts with its own; of equally long ones the first given wins."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules: put whole URLs on the list")
    out = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        if verdict not in ("allow", "block"):
            raise ValueError(f"no such verdict: {verdict!r}")
        name, slash, rest = rule.partition("/")
        name = name.translate(str.maketrans(UPPER, LOWER))
        fits = ((host_ == name) | F.endswith(host_, F.lit(f".{name}"))) & F.startswith(path_, F.lit(slash + rest))
        out = (F.when if out is None else out.when)(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")))
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _bits(url: Column) -> list[Column]:
    """Four masks of two bits each, from a second hash of the URL."""
    h = F.xxhash64(url, F.lit(1))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int"))
    return [bit(2 * i).bitwiseOR(bit(2 * i + 1)) for i in range(4)]


def _block(url: Column, blocks: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(url), 24).bitwiseAND(blocks - 1)


def blocks_for(urls: int, bits: int = BITS_PER_URL) -> int:
    """The power of two that gives each URL so many bits, at least."""
    return 1 << max(0, (max(1, urls) * bits - 1) // 256).bit_length()


def bloom_blocks(urls: DataFrame, blocks: int, url: str = "canonical") -> DataFrame:
    """Rows (block, b0, b1, b2, b3): the filter of a column of URLs. One row for each block that has a bit; mergeable by bit_or."""
    masks = [m.alias(f"b{i}") for i, m in enumerate(_bits(F.col(url)))]
    return urls.select(_block(F.col(url), blocks).alias("block"), *masks).groupBy("block").agg(*[F.bit_or(f"b{i}").alias(f"b{i}") for i in range(4)])


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]] | None = None, url: str = "url", listed_url: str = "url", max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """Rows (page_, host, path, rule, verdict, listed, possible), one for each row of pages: page_ holds its columns.

    The verdict is that of the longest rule that fits; without one it is block for a URL whose canonical form is listed, else
    allow. listed and possible (the filter's answer) are false where a rule decides. A URL that is null or has no `://` has an
    empty host and path, fits no rule and is allowed. Repeated rows each give a row; URLs of any length are read whole;
    an empty table gives an empty result, an empty list blocks nothing. A listed URL that many pages share is a hot key of the
    exact join, a left join that AQE splits. All columns of pages stay inside page_, whatever their names.
    """
    wanted = written(listed.select(canonical(F.col(listed_url)).alias("canonical")).filter(F.col("canonical").isNotNull()).distinct())
    blocks = blocks_for(wanted.count())
    bloom = bloom_blocks(wanted, blocks)
    if blocks <= max_blocks:
        bloom = F.broadcast(bloom)  # at most max_blocks rows of five numbers
    rows = pages.select(F.struct(*pages.columns).alias("page_"), F.col(url).alias("u_")).withColumns({"host": host(F.col("u_")), "path": path(F.col("u_"))})
    rows = rows.withColumn("r_", fitting_rule(F.col("host"), F.col("path"), rules or [])).withColumn("c_", F.when(F.col("r_").isNull(), canonical(F.col("u_"))))
    rows = rows.withColumn("block", _block(F.col("c_"), blocks)).join(bloom, "block", "left")
    passes = F.coalesce(F.col("c_").isNotNull(), F.lit(False))
    for i, m in enumerate(_bits(F.col("c_"))):
        passes = passes & F.coalesce(F.col(f"b{i}").bitwiseAND(m) == m, F.lit(False))
    rows = rows.withColumn("possible", passes).select("page_", "host", "path", "r_", "c_", "possible")
    exact = wanted.select(F.col("canonical").alias("c_"), F.lit(True).alias("listed"))
    hits = rows.filter("possible").join(exact, "c_", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    every = rows.filter(~F.col("possible")).withColumn("listed", F.lit(False)).unionByName(hits)
    verdict = F.coalesce(F.col("r_.verdict"), F.when(F.col("listed"), "block").otherwise("allow"))
    return every.select("page_", "host", "path", F.col("r_.rule").alias("rule"), verdict.alias("verdict"), "listed", "possible")


def without_blocked(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]] | None = None, url: str = "url", listed_url: str = "url") -> DataFrame:
    """pages without those that judge() blocks; all columns stay."""
    return judge(pages, listed, rules, url, listed_url).filter(F.col("verdict") == "allow").select("page_.*")


OP13_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest, instr(url, '://') > 0 AS good FROM pages),
p AS (SELECT page_id, good, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS query FROM u),
c AS (SELECT *, list_sort(list_filter(string_split(query, '&'), lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[^=]*|gclid|fbclid|ref)(=|$)'))) AS kept,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':(80|443)?$', ''), '\.$', ''), '^www\.', '') AS name FROM p),
k AS (SELECT page_id, host, path, CASE WHEN good THEN name || regexp_replace(path, '/+$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canonical FROM c),
listed AS (SELECT DISTINCT canonical FROM k WHERE list_contains(string_split(host, '.'), 'cheap-pills') AND canonical IS NOT NULL),
rules(verdict, rule, h, p) AS (VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'), ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
best AS (SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict FROM k JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT k.page_id, host, path, rule, coalesce(verdict, CASE WHEN listed.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM k LEFT JOIN best ON k.page_id = best.page_id LEFT JOIN listed ON k.canonical = listed.canonical
"""


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on every page's URL: four rules, then the list of the URLs of hosts with the label LISTED_LABEL."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.filter(F.array_contains(F.split(host(F.col("url")), r"\."), LISTED_LABEL)).select("url")
    return judge(pages, listed, RULES).select("page_.page_id", "host", "path", "rule", "verdict")
