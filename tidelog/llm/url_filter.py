"""URL filters: rules by host and path, and for all other pages the reputation of their host.

Reputation is an empirical-Bayes estimate of a host's share of bad pages. Labelled pages are counted for each host,
registered domain and public suffix. A beta prior is passed down: the suffix's mean is shrunk towards the corpus's, the
domain's towards the suffix's, the host's towards the domain's; how strongly is estimated for each level by the method of
moments from how much the members of a level differ beyond what chance explains. A host is blocked if the lower end of its
posterior (mean less Z standard deviations) exceeds MAX_BAD: it is surely bad, not just little known.

Defined results: a null URL or one without :// has an empty host and path, fits no rule, and is judged by the empty host's
own pages; rows that repeat a page_id are rows of their own; hosts without labelled pages have their domain's or suffix's
posterior; without any label all such pages are allowed; an empty table gives an empty result; other columns are ignored.
Hot hosts: counts are aggregated before they are shuffled, and adaptive execution splits the join that returns them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import table, written

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
MAX_BAD = 0.5
Z = 2.0
#: Least and greatest weight of a prior, in pages.
WEIGHT = (2.0, 1000.0)
#: Suffixes under which names are registered one level further down; a parameter, for the list grows.
SECOND_LEVEL = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "com.br", "com.cn", "co.nz", "co.in", "co.za", "co.kr", "com.mx", "com.tr", "com.tw")
#: Names of hosts of which every page counts as bad: what public block lists of words have in common. A parameter in kind.
BAD_NAMES = ("ads", "adult", "bets", "betting", "casino", "pills", "poker", "porn", "sex", "spam", "tracker", "track", "viagra", "xxx")
#: A page is bad if it has more than one symbol of these for four words.
_SYMBOLS = "#*$%&|<>"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(rule: str, host: Column, path: Column) -> Column:
    name, _, rest = rule.partition("/")
    return ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits; of equally long ones the first in order of text; null if none does."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        out = F.when(fits(rule, host, path), F.lit(rule)).otherwise(out)
    return out


def suffix_of(host: Column, second=SECOND_LEVEL) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*second), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, second=SECOND_LEVEL) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*second), F.substring_index(host, ".", -3)).otherwise(two)


def _weight(groups: DataFrame, prior: str) -> float:
    """Method of moments: the prior weight at which members of a level vary around their parents as they do. One number."""
    chance = F.sum(F.col(prior) * (1 - F.col(prior)))
    excess = F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col(prior), 2)) - chance
    scale = F.sum(F.col("n") * F.col(prior) * (1 - F.col(prior))) - chance
    excess, scale = groups.filter("n > 0").agg(excess, scale).first()
    if excess is None:
        return WEIGHT[0]
    spread = max(excess / max(scale, 1e-9), 1e-6)
    return min(max(WEIGHT[0], 1 / spread - 1), WEIGHT[1])


def reputation(outcomes: DataFrame, second=SECOND_LEVEL) -> DataFrame:
    """outcomes (host, n, bad: labelled pages and bad ones) -> host, n, bad, alpha, beta: the posterior of each host's bad share.

    outcomes is read once for each level and should be a table. The driver gets a few numbers for each level.
    """
    hosts = outcomes.withColumns({"domain": domain_of(F.col("host"), second), "suffix": suffix_of(F.col("host"), second)})
    mean = outcomes.agg((F.coalesce(F.sum("bad"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1.0)).first()[0]

    def shrunk(groups: DataFrame, prior: str, name: str) -> DataFrame:
        weight = _weight(groups, prior)
        return groups.withColumn(f"w_{name}", F.lit(weight)).withColumn(f"mean_{name}", (F.col(prior) * weight + F.col("bad")) / (weight + F.col("n")))

    sums = F.sum("n").alias("n"), F.sum("bad").alias("bad")
    suffixes = shrunk(hosts.groupBy("suffix").agg(*sums).withColumn("mean_all", F.lit(mean)), "mean_all", "suffix")
    domains = hosts.groupBy("suffix", "domain").agg(*sums).join(suffixes.select("suffix", "mean_suffix"), "suffix")
    domains = shrunk(domains, "mean_suffix", "domain").select("suffix", "domain", "mean_domain")
    each = shrunk(hosts.join(domains, ["suffix", "domain"]), "mean_domain", "host")
    a = F.col("mean_domain") * F.col("w_host") + F.col("bad")
    b = (1 - F.col("mean_domain")) * F.col("w_host") + F.col("n") - F.col("bad")
    return each.select("host", "n", "bad", a.alias("alpha"), b.alias("beta"))


def judge(pages: DataFrame, bad: Column | None, rules=RULES, max_bad: float = MAX_BAD, z: float = Z, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """Per row of pages: page_id, host, path, rule, verdict, and the host's posterior mean and lower bound (null if unknown).

    bad: a boolean column of pages, the labelled outcome; null where a page has no label; None where there are no labels.
    """
    label = F.lit(None).cast("boolean") if bad is None else bad
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), label.alias("_bad"))
    outcomes = written(rows.groupBy("host").agg(F.count("_bad").alias("n"), F.count_if("_bad").alias("bad")), "outcomes")
    a, b = F.col("alpha"), F.col("beta")
    mean = a / (a + b)
    low = F.greatest(mean - z * F.sqrt(a * b / (F.pow(a + b, 2) * (a + b + 1))), F.lit(0.0))
    known = reputation(outcomes).select("host", F.round(mean, 9).alias("bad_share"), F.round(low, 9).alias("bad_low"))
    verdicts = dict(rules)
    rule = matched_rule(F.col("host"), F.col("path"), rules)
    out = rows.drop("_bad").join(known, "host", "left").withColumn("rule", rule)
    by_rule = F.lit(None).cast("string")
    for name, verdict in verdicts.items():
        by_rule = F.when(F.col("rule") == name, F.lit(verdict)).otherwise(by_rule)
    verdict = F.coalesce(by_rule, F.when(F.col("bad_low") > max_bad, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "bad_share", "bad_low")


#: What isn't visible in a page. Spelt without back references, for SQL engines differ in them.
_UNSEEN = r"(?s)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>|&nbsp;"


def bad_page(url: Column, html: Column) -> Column:
    """The labelled outcome of the query, as its tables have no labels for pages: a page is bad if a part of its host's
    name is one of BAD_NAMES, or if its visible words carry many symbols. Null html has no label.
    """
    words = F.regexp_replace(html, _UNSEEN, " ")
    symbols = F.length(words) - F.length(F.translate(words, _SYMBOLS, ""))
    named = F.arrays_overlap(F.split(host_of(url), "[^a-z0-9]+"), F.array(*map(F.lit, BAD_NAMES)))
    return F.when(html.isNotNull(), named | (symbols * 4 > F.length(words) / 6))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, bad_page(F.col("url"), F.col("html")))


def _shrunk_sql(name: str, groups: str, prior: str) -> str:
    """The weight and means of a level, as reputation() has them."""
    return f"""
w_{name} AS (
    SELECT CASE WHEN count(*) = 0 THEN {WEIGHT[0]}::DOUBLE ELSE least(greatest({WEIGHT[0]}::DOUBLE, 1 / greatest(
        (sum(n * pow(bad / n - {prior}, 2)) - sum({prior} * (1 - {prior})))
        / greatest(sum(n * {prior} * (1 - {prior})) - sum({prior} * (1 - {prior})), 1e-9), 1e-6) - 1), {WEIGHT[1]}::DOUBLE) END AS w
    FROM {groups} WHERE n > 0
)"""


SQL = f"""
WITH rows AS (
    SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz') AS host,
           coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
           regexp_replace(html, '{_UNSEEN[4:]}', ' ', 'gs') AS words
    FROM pages
), labelled AS (
    SELECT *, CASE WHEN words IS NOT NULL THEN list_has_any(string_split_regex(host, '[^a-z0-9]+'), [{', '.join(f"'{x}'" for x in BAD_NAMES)}])
           OR (length(words) - length(translate(words, '{_SYMBOLS}', ''))) * 4 > length(words) / 6 END AS is_bad FROM rows
), outcomes AS (
    SELECT host, count(is_bad) AS n, count(*) FILTER (is_bad) AS bad, string_split(host, '.') AS parts,
           array_to_string(parts[-2:], '.') AS two, two IN ({', '.join(f"'{x}'" for x in SECOND_LEVEL)}) AS deep,
           CASE WHEN deep THEN two ELSE parts[-1] END AS suffix,
           CASE WHEN deep THEN array_to_string(parts[-3:], '.') ELSE two END AS domain
    FROM labelled GROUP BY host
), overall AS (SELECT (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1.0) AS mean_all FROM outcomes),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(mean_all) AS mean_all FROM outcomes, overall GROUP BY suffix),
{_shrunk_sql("suffix", "suffixes", "mean_all")},
domains AS (
    SELECT o.suffix, domain, sum(o.n) AS n, sum(o.bad) AS bad, any_value((mean_all * w + s.bad) / (w + s.n)) AS mean_suffix
    FROM outcomes o JOIN suffixes s USING (suffix), w_suffix GROUP BY o.suffix, domain
), {_shrunk_sql("domain", "domains", "mean_suffix")},
hosts AS (
    SELECT o.host, o.n, o.bad, (mean_suffix * w + d.bad) / (w + d.n) AS mean_domain
    FROM outcomes o JOIN domains d USING (suffix, domain), w_domain
), {_shrunk_sql("host", "hosts", "mean_domain")},
posterior AS (SELECT host, mean_domain * w + bad AS a, (1 - mean_domain) * w + n - bad AS b FROM hosts, w_host),
known AS (
    SELECT host, round(a / (a + b), 9) AS bad_share,
           round(greatest(a / (a + b) - {Z} * sqrt(a * b / (pow(a + b, 2) * (a + b + 1))), 0), 9) AS bad_low
    FROM posterior
), ruled AS (
    SELECT page_id, host, path, CASE
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
        WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
        WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
        WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
    FROM labelled
)
SELECT page_id, host, path, rule, bad_share, bad_low,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN bad_low > {MAX_BAD} THEN 'block' ELSE 'allow' END AS verdict
FROM ruled JOIN known USING (host)
"""
