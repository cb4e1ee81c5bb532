"""Empirical-Bayes host reputation: labelled page outcomes shrunk from host to registered domain to suffix.

Every level has a beta prior whose mean is the posterior mean of the level above
(the overall rate above the suffixes) and whose strength is fitted by moments to
the spread between its members. A host is blocked when the lower bound of its
posterior rate of bad pages, ``mean - z * deviation``, exceeds ``max_bad``; a host
without labelled pages is judged by its domain's prior. Listed rules come first.

Only counts move: pages are combined to one row per host before any shuffle. Everything is DataFrame work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import settle
from .text import read

MAX_BAD, Z = 0.5, 1.645
MIN_STRENGTH, MAX_STRENGTH = 1.0, 10_000.0

#: The rules of the registered query (action, host/path).
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://`` or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


#: Suffixes of two labels under which unrelated owners register; all others have one label. Not the whole public list.
SUFFIXES = [f"{second}.{top}" for top, seconds in {
    "uk": "co org ac gov ltd plc me net", "au": "com net org edu gov", "nz": "co net org ac govt", "jp": "co ne or ac go", "kr": "co or go ac",
    "br": "com net org gov", "cn": "com net org gov edu", "tw": "com org gov", "in": "co net org gov ac", "za": "co org ac gov", "mx": "com org gob",
    "ar": "com org gob", "tr": "com org gov edu", "il": "co org ac", "sg": "com edu gov", "hk": "com org gov",
    "io": "github gitlab", "com": "blogspot wordpress herokuapp", "app": "netlify vercel web", "dev": "pages workers",
}.items() for second in seconds.split()]


def _bare(host: Column) -> Column:
    """The host without its port."""
    return F.regexp_replace(host, r":[0-9]*$", "")


def _is_ip(name: Column) -> Column:
    return name.rlike(r"^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*\])$")


def domain_of(host: Column) -> Column:
    """Registered domain: one label below the suffix; an IP address is its own."""
    name = _bare(host)
    longer = F.substring_index(name, ".", -2).isin(SUFFIXES)
    return F.when(_is_ip(name), name).when(longer, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))


def suffix_of(host: Column) -> Column:
    """Longest listed suffix, else the last label; IP addresses share one, ``(ip)``."""
    name, two = _bare(host), F.substring_index(_bare(host), ".", -2)
    return F.when(_is_ip(name), F.lit("(ip)")).when(two.isin(SUFFIXES), two).otherwise(F.substring_index(name, ".", -1))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """(action, rule) of the longest rule that fits, else null. One map look-up per host suffix, whatever the number of rules."""
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for action, rule in rules:
        name, slash, rest = rule.partition("/")
        by_host.setdefault(name, []).append((action, rule, slash + rest))
    entry = "array<struct<action:string,rule:string,path:string>>"
    table = F.create_map(*[x for name, rows in by_host.items() for x in (
        F.lit(name), F.array(*[F.struct(F.lit(a).alias("action"), F.lit(r).alias("rule"), F.lit(p).alias("path")) for a, r, p in rows]).cast(entry))])
    parts = F.split(host, r"\.")
    names = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    fits = F.filter(F.flatten(F.transform(names, lambda n: F.coalesce(F.try_element_at(table, n), F.array().cast(entry)))), lambda r: path.startswith(r["path"]))
    # Fitting rules of one url differ in length or are the same rule twice.
    longest = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["rule"]).alias("n"), r["rule"].alias("rule"), r["action"].alias("action"))))
    return F.when(F.size(fits) > 0, longest)


def _strength(level: DataFrame, above: DataFrame, key: list[str]) -> float:
    """Prior strength of a level's members, by moments: their spread around the rate of the member above them, less what chance gives."""
    both = level.where("n > 0").join(above.select(*key, F.col("n").alias("_n"), (F.col("bad") / F.col("n")).alias("_m")).where("_n > 0"), key)
    chance = F.col("_m") * (1 - F.col("_m"))
    row = both.agg(
        F.sum(F.pow(F.col("bad") - F.col("n") * F.col("_m"), 2) / F.col("n") - chance * (1 - F.col("n") / F.col("_n"))).alias("spread"),
        F.sum(chance * (F.col("n") - F.col("n") * F.col("n") / F.col("_n"))).alias("room"),
    ).first()
    if not row.room or row.spread <= 0:
        return MAX_STRENGTH
    return min(MAX_STRENGTH, max(MIN_STRENGTH, row.room / row.spread - 1))


def host_reputation(pages: DataFrame, max_bad: float = MAX_BAD, z: float = Z) -> DataFrame:
    """One row per host of ``pages`` (url, bad: 0, 1 or null): counts, posterior mean, bound and ``reputed`` (allow or block).

    Rows with null ``bad`` are not labelled but their hosts are judged too. The empty
    host is a host like others. Without any label every host is allowed.
    """
    bad = F.col("bad").cast("long")
    hosts = pages.groupBy(url_host(F.col("url")).alias("host")).agg(F.count(bad).alias("n"), F.coalesce(F.sum(bad), F.lit(0)).alias("bad"))
    # Read by every level's fit and by the result: the pages are gone through once.
    hosts = settle(hosts.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "bad"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    everything = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.lit("all").alias("all"))
    top = everything.first()
    rate = float(top.bad) / top.n if top.n else 0.0
    strengths = {
        "suffix": _strength(suffixes.withColumn("all", F.lit("all")), everything, ["all"]),
        "domain": _strength(domains, suffixes, ["suffix"]), "host": _strength(hosts, domains, ["domain"]),
    }

    def shrunk(prior: Column, level: str) -> Column:
        k = strengths[level]
        return (F.col("bad") + prior * k) / (F.col("n") + k)

    suffixes = suffixes.select("suffix", shrunk(F.lit(rate), "suffix").alias("suffix_mean"))
    domains = domains.join(suffixes, "suffix").select("domain", shrunk(F.col("suffix_mean"), "domain").alias("domain_mean"))
    k = strengths["host"]
    mean = shrunk(F.col("domain_mean"), "host")
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + k + 1))
    return (
        hosts.join(domains, "domain").withColumn("mean", mean).withColumn("bound", F.col("mean") - z * deviation)
        .select("host", "n", "bad", "mean", "bound", F.when(F.col("bound") > max_bad, "block").otherwise("allow").alias("reputed"))
    )


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], max_bad: float = MAX_BAD, z: float = Z) -> DataFrame:
    """``pages`` (url, bad, any other columns) with host, path, rule, verdict and the host's labelled counts.

    The longest fitting rule decides, else the host's reputation. Null urls have
    the empty host. Rows may repeat, each gets its verdict; columns named like an
    added one are replaced, all others keep their values. An empty table gives an empty one.
    """
    added = ["host", "path", "rule", "verdict", "n_labelled", "n_bad"]
    own = [c for c in pages.columns if c not in added]
    row = F.struct(*[F.col(c) for c in own]).alias("_row")
    # Hosts are few against pages; Spark broadcasts them below its size limit and splits a hot host's pages above it.
    reputed = host_reputation(pages.select("url", "bad"), max_bad, z).select(F.col("host").alias("_host"), F.col("n").alias("n_labelled"), F.col("bad").alias("n_bad"), "reputed")
    rows = pages.select(row, url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    rows = rows.withColumn("_rule", matching_rule(F.col("host"), F.col("path"), rules))
    return rows.join(reputed, F.col("host") == F.col("_host"), "left").select(
        *[F.col("_row")[c].alias(c) for c in own], "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.action", "reputed").alias("verdict"), "n_labelled", "n_bad",
    )


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcome of each page: bad when the document it was rendered from (number in its path) is toxic or of low quality."""
    number = F.expr("try_cast(regexp_extract(path, '^/[a-z]+/([0-9]+)', 1) AS long)")
    outcome = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_doc")).agg(F.max((F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))).cast("int")).alias("bad"))
    rows = pages.select("page_id", "url", url_path(F.col("url")).alias("path")).withColumn("_doc", number)
    return rows.join(outcome, "_doc", "left").select("page_id", "url", "bad")


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    """Verdict on every page url under the fixed rules and the hosts' reputations."""
    pages = labelled_pages(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"))
    return filter_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict", "n_labelled", "n_bad")


def _fit(level: str, above: str, key: str) -> str:
    return f"""fit_{level} AS (SELECT CASE WHEN room > 0 AND spread > 0 THEN least({MAX_STRENGTH}e0, greatest({MIN_STRENGTH}e0, room / spread - 1)) ELSE {MAX_STRENGTH}e0 END AS k FROM (
  SELECT sum((bad - n * m) * (bad - n * m) / n - m * (1 - m) * (1 - n / nn)) AS spread, sum(m * (1 - m) * (n - n * n / nn)) AS room
  FROM {level}s JOIN (SELECT {key}, n AS nn, bad / n AS m FROM {above} WHERE n > 0) USING ({key}) WHERE n > 0))"""


_SUFFIX_LIST = ", ".join(f"'{s}'" for s in SUFFIXES)

ORACLE = rf"""
WITH o AS (SELECT doc_id, max(CASE WHEN coalesce(toxic = 1, false) OR coalesce(quality = 0, false) THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host, coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
q AS (SELECT p.*, o.bad FROM p LEFT JOIN o ON o.doc_id = TRY_CAST(regexp_extract(path, '^/[a-z]+/([0-9]+)', 1) AS BIGINT)),
named AS (SELECT host, count(bad) AS n, sum(bad) AS bad, regexp_replace(host, ':[0-9]*$', '') AS bare FROM q GROUP BY host),
parts AS (SELECT *, string_split(bare, '.') AS w, array_to_string(string_split(bare, '.')[-2:], '.') AS two, regexp_matches(bare, '^([0-9]{{1,3}}(\.[0-9]{{1,3}}){{3}}|\[.*\])$') AS ip FROM named),
hosts AS (SELECT host, CASE WHEN ip THEN bare WHEN two IN ({_SUFFIX_LIST}) THEN array_to_string(w[-3:], '.') ELSE two END AS domain,
  CASE WHEN ip THEN '(ip)' WHEN two IN ({_SUFFIX_LIST}) THEN two ELSE w[-1] END AS suffix, CAST(n AS DOUBLE) AS n, CAST(coalesce(bad, 0) AS DOUBLE) AS bad FROM parts),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixs AS (SELECT suffix, 1 AS "all", sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix),
everything AS (SELECT 1 AS "all", sum(n) AS n, sum(bad) AS bad FROM suffixs),
{_fit("suffix", "everything", '"all"')}, {_fit("domain", "suffixs", "suffix")}, {_fit("host", "domains", "domain")},
sm AS (SELECT suffix, (s.bad + coalesce(e.bad / nullif(e.n, 0), 0) * k) / (s.n + k) AS suffix_mean FROM suffixs s, everything e, fit_suffix),
dm AS (SELECT domain, (bad + suffix_mean * k) / (n + k) AS domain_mean FROM domains JOIN sm USING (suffix), fit_domain),
hm AS (SELECT host, n, bad, (bad + domain_mean * k) / (n + k) AS mean, k FROM hosts JOIN dm USING (domain), fit_host),
rules(action, rule, rhost, rpath) AS (VALUES {", ".join(f"('{a}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for a, r in RULES)}),
best AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action FROM (SELECT DISTINCT host, path FROM q), rules
  WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path)
SELECT page_id, q.host, q.path, rule, coalesce(action, CASE WHEN mean - {Z}e0 * sqrt(mean * (1 - mean) / (n + k + 1)) > {MAX_BAD}e0 THEN 'block' ELSE 'allow' END) AS verdict,
  CAST(n AS BIGINT) AS n_labelled, CAST(hm.bad AS BIGINT) AS n_bad
FROM q JOIN hm ON q.host = hm.host LEFT JOIN best ON q.host = best.host AND q.path = best.path
"""
