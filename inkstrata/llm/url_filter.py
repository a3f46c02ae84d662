"""URL filters by empirical-Bayes host reputation.

Labelled page outcomes (bad: toxic, or of quality 0) are counted for each host,
registered domain and public suffix. Rates are shrunk down the tree with
beta-binomial priors: all pages are the suffix's prior, the suffix is the
domain's, the domain is the host's. The strength of each level's prior is
estimated from the spread of its members around their parents (method of
moments), so sparse hosts lean on their domain and well-known hosts on
themselves. A page stays if the upper bound of its host's posterior bad rate,
mean plus ``Z`` standard deviations, is at most ``MAX_BAD``.

All of it is grouped aggregation: pages are scanned twice for two columns, once
for the counts of hosts, which are written to the checkpoint folder, and once
for the result; everything between works on the hosts alone. A hot host is
counted by partial sums, and joined as skewed by the adaptive planner; rows
without a host or document number are spread over ``SALTS`` keys.

Suffixes follow the rules of a file in the form of the public suffix list
(``public_suffixes.txt`` or the ``path`` parameter): plain, ``*.`` and ``!``.
Labels belong to documents; a page's document is the number in its URL's path.
Defined results: the scheme of a URL may be missing before ``//``, and before a
name with a dot as well; addresses of numbers (IPv4, IPv6 in brackets) are their
own domain and suffix; a URL that is null or has no host has null host and rates
and isn't kept; pages without a label count as unlabelled; repeated labels of a
document count as one, bad if any is; repeated pages repeat and count in their
host as often; no labels at all leave the prior ``NO_DATA`` bad, ``NO_DATA_PAGES``
strong.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.llm.textvec import ensure_checkpoint, table

Z = 1.645
MAX_BAD = 0.35
NO_DATA, NO_DATA_PAGES = 0.1, 2.0
#: Bounds of a prior's strength in pages.
MIN_STRENGTH, MAX_STRENGTH = 1.0, 1000.0
#: Keys over which rows without a key of their own are spread.
SALTS = 256
SUFFIX_FILE = str(Path(__file__).with_name("public_suffixes.txt"))
_HOST = r"^(?:(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?)?(\[[0-9A-Fa-f:.]+\]|[^/?#@:\[\]]+)"
#: Without ``//`` only a name with a dot, ended by nothing, a port or a path, is a host.
_BARE = r"^(?:(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//|[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+(?::[0-9]+)?(?:[/?#]|$))"
_IP = r"^(?:[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+|\[.*\])$"
_DOC = r"^[^?#]*/([0-9]{1,18})(?:\.html)?/?(?:[?#]|$)"


@dataclass(frozen=True)
class Rules:
    """Suffixes by their number of labels; of ``any`` the label before is one more; ``none`` are exceptions."""

    plain: dict[int, tuple[str, ...]]
    any: dict[int, tuple[str, ...]]
    none: dict[int, tuple[str, ...]]


@lru_cache(maxsize=4)
def suffix_rules(path: str = SUFFIX_FILE) -> Rules:
    out: tuple[dict, dict, dict] = ({}, {}, {})
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        rule = line.strip().lower()
        if not rule or rule.startswith("//"):
            continue
        kind = 1 if rule.startswith("*.") else 2 if rule.startswith("!") else 0
        name = rule.removeprefix("*.").removeprefix("!")
        out[kind].setdefault(name.count(".") + 1, []).append(name)
    return Rules(*({k: tuple(v) for k, v in d.items()} for d in out))


def cases(rules: Rules) -> list[tuple[int, tuple[str, ...], int]]:
    """(labels of the host's tail, tails, labels of the suffix), the first that fits counts; a suffix of one label otherwise."""
    out = [(k, v, k - 1) for k, v in sorted(rules.none.items(), reverse=True)]
    size = [(k, k, v) for k, v in rules.plain.items() if k > 1] + [(k + 1, k, v) for k, v in rules.any.items()]
    return out + [(k, v, n) for n, k, v in sorted(size, reverse=True)]


def host_of(url: Column) -> Column:
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"\.+$", "")
    return F.when(url.rlike(_BARE) & (host != ""), host)


def _tail_of(host: Column, rules: Rules, more: int) -> Column:
    tail = lambda k: F.substring_index(host, ".", -k)
    out = F.when(host.rlike(_IP), host)
    for k, names, size in cases(rules):
        out = out.when(tail(k).isin(*names), tail(size + more))
    return out.otherwise(tail(1 + more))


def suffix_of(host: Column, path: str = SUFFIX_FILE) -> Column:
    """The public suffix; an address of numbers is its own."""
    return _tail_of(host, suffix_rules(path), 0)


def domain_of(host: Column, path: str = SUFFIX_FILE) -> Column:
    """The registered domain: the suffix and one label more."""
    return _tail_of(host, suffix_rules(path), 1)


def document_of(url: Column) -> Column:
    return F.regexp_extract(url, _DOC, 1).try_cast("bigint")


def _strength(groups: DataFrame, n: str, bad: str, mean: Column) -> float:
    """The prior strength at which the groups' spread around ``mean`` is what it is."""
    m = mean
    rho = F.sum((F.col(bad) - F.col(n) * m) ** 2 - F.col(n) * m * (1 - m)) / F.nullif(F.sum(F.col(n) * (F.col(n) - 1) * m * (1 - m)), F.lit(0.0))
    found = groups.agg(rho).first()[0]
    return MAX_STRENGTH if found is None or found <= 0 else max(MIN_STRENGTH, min(MAX_STRENGTH, 1 / found - 1))


def host_counts(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host, n labelled pages and n bad ones; one scan of the pages."""
    marks = labels.where(F.col("doc_id").isNotNull() & (F.col("toxic").isNotNull() | F.col("quality").isNotNull()))
    marks = marks.groupBy(F.col("doc_id").cast("bigint").alias("doc")).agg(F.max(((F.coalesce(F.col("toxic"), F.lit(0)) == 1) | (F.coalesce(F.col("quality"), F.lit(1)) == 0)).cast("int")).alias("mark"))
    seen = pages.select(host_of(F.col("url")).alias("host"), document_of(F.col("url")).alias("doc")).where("host is not null")
    seen = seen.groupBy("host", "doc").agg(F.count("*").alias("c"))
    seen = seen.withColumn("salt", F.when(F.col("doc").isNull(), F.pmod(F.xxhash64("host"), F.lit(SALTS))).otherwise(0))
    rows = seen.join(marks.withColumn("salt", F.lit(0).cast("bigint")), ["doc", "salt"], "left")
    return rows.groupBy("host").agg(F.sum(F.when(F.col("mark").isNull(), 0).otherwise(F.col("c"))).cast("double").alias("n"), F.sum(F.coalesce(F.col("c") * F.col("mark"), F.lit(0))).cast("double").alias("bad"))


def reputations(pages: DataFrame, labels: DataFrame, path: str = SUFFIX_FILE) -> DataFrame:
    """host, domain, suffix, n labelled pages, n bad, posterior alpha and beta of every host."""
    ensure_checkpoint(pages.sparkSession)
    hosts = host_counts(pages, labels).select("host", domain_of(F.col("host"), path).alias("domain"), suffix_of(F.col("host"), path).alias("suffix"), "n", "bad").checkpoint()
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("bad").alias("dbad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dbad").alias("sbad"))
    n, bad = (x or 0.0 for x in hosts.agg(F.sum("n"), F.sum("bad")).first())
    p0 = F.lit((bad + NO_DATA * NO_DATA_PAGES) / (n + NO_DATA_PAGES))
    k = _strength(suffixes, "sn", "sbad", p0)
    domains = domains.join(suffixes.select("suffix", ((F.col("sbad") + k * p0) / (F.col("sn") + k)).alias("p1")), "suffix")
    k = _strength(domains, "dn", "dbad", F.col("p1"))
    hosts = hosts.join(domains.select("domain", ((F.col("dbad") + k * F.col("p1")) / (F.col("dn") + k)).alias("p2")), "domain")
    k = _strength(hosts, "n", "bad", F.col("p2"))
    return hosts.select("host", "domain", "suffix", "n", "bad", (F.col("bad") + k * F.col("p2")).alias("alpha"), (F.col("n") - F.col("bad") + k * (1 - F.col("p2"))).alias("beta"))


def filter_urls(pages: DataFrame, labels: DataFrame, path: str = SUFFIX_FILE) -> DataFrame:
    """Host, posterior bad rate, its upper bound and the verdict for every page."""
    total = F.col("alpha") + F.col("beta")
    mean = F.col("alpha") / total
    bound = mean + Z * F.sqrt(mean * (1 - mean) / (total + 1))
    rates = reputations(pages, labels, path).select("host", "domain", "suffix", F.col("n").cast("bigint").alias("labelled"), mean.alias("mean"), bound.alias("bound"), F.lit(0).cast("bigint").alias("salt"))
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"))
    rows = rows.withColumn("salt", F.when(F.col("host").isNull(), F.pmod(F.xxhash64("page_id"), F.lit(SALTS))).otherwise(0)).join(rates, ["host", "salt"], "left")
    return rows.select("page_id", "host", "domain", "suffix", "labelled", F.round("mean", 6).alias("bad_rate"), F.round("bound", 6).alias("bad_bound"), F.coalesce(F.col("bound") <= MAX_BAD, F.lit(False)).alias("keep"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def _tail(n: int) -> str:
    return f"array_to_string(string_split(host, '.')[-{n}:], '.')"


def _sql_tail(more: int) -> str:
    whens = " ".join(f"WHEN {_tail(k)} IN ({', '.join(repr(x) for x in names)}) THEN {_tail(size + more)}" for k, names, size in cases(suffix_rules()))
    return f"CASE WHEN regexp_matches(host, '{_IP}') THEN host {whens} ELSE {_tail(1 + more)} END"


def _k(groups: str, n: str, bad: str, mean: str) -> str:
    return f"""SELECT CASE WHEN rho IS NULL OR rho <= 0 THEN {MAX_STRENGTH} ELSE greatest({MIN_STRENGTH}, least({MAX_STRENGTH}, 1 / rho - 1)) END AS k FROM (
  SELECT sum(({bad} - {n} * {mean}) ^ 2 - {n} * {mean} * (1 - {mean})) / nullif(sum({n} * ({n} - 1) * {mean} * (1 - {mean})), 0) AS rho FROM {groups})"""


ORACLE = f"""
WITH marks AS (SELECT doc_id, max(CASE WHEN coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0 THEN 1 ELSE 0 END) AS bad FROM labels
  WHERE doc_id IS NOT NULL AND (toxic IS NOT NULL OR quality IS NOT NULL) GROUP BY doc_id),
seen AS (SELECT page_id, CASE WHEN regexp_matches(url, '{_BARE}') THEN nullif(rtrim(lower(regexp_extract(url, '{_HOST}', 1)), '.'), '') END AS host, try_cast(nullif(regexp_extract(url, '{_DOC}', 1), '') AS BIGINT) AS doc_id FROM pages),
h0 AS (SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad FROM seen LEFT JOIN marks USING (doc_id) WHERE host IS NOT NULL GROUP BY host),
h AS (SELECT *, {_sql_tail(0)} AS suffix, {_sql_tail(1)} AS domain FROM h0),
d AS (SELECT domain, suffix, sum(n) AS dn, sum(bad) AS dbad FROM h GROUP BY ALL),
s0 AS (SELECT suffix, sum(dn) AS sn, sum(dbad) AS sbad FROM d GROUP BY ALL),
s AS (SELECT *, (SELECT (coalesce(sum(sbad), 0) + {NO_DATA * NO_DATA_PAGES}) / (coalesce(sum(sn), 0) + {NO_DATA_PAGES}) FROM s0) AS p0 FROM s0),
k1 AS ({_k("s", "sn", "sbad", "p0")}),
s2 AS (SELECT suffix, (sbad + k * p0) / (sn + k) AS p1 FROM s, k1),
d1 AS (SELECT d.*, p1 FROM d JOIN s2 USING (suffix)),
k2 AS ({_k("d1", "dn", "dbad", "p1")}),
d2 AS (SELECT domain, (dbad + k * p1) / (dn + k) AS p2 FROM d1, k2),
h1 AS (SELECT h.*, p2 FROM h JOIN d2 USING (domain)),
k3 AS ({_k("h1", "n", "bad", "p2")}),
r AS (SELECT host, domain, suffix, n, bad + k * p2 AS alpha, n - bad + k * (1 - p2) AS beta FROM h1, k3),
m AS (SELECT *, alpha / (alpha + beta) AS mean FROM r),
b AS (SELECT *, mean + {Z} * sqrt(mean * (1 - mean) / (alpha + beta + 1)) AS bound FROM m)
SELECT page_id, seen.host, domain, suffix, n::BIGINT AS labelled, round(mean, 6) AS bad_rate, round(bound, 6) AS bad_bound, coalesce(bound <= {MAX_BAD}, false) AS keep FROM seen LEFT JOIN b ON seen.host = b.host"""
