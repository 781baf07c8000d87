"""URL filters: pattern rules indexed by their rarest literal token.

Every rule becomes one regular expression and a set of literal tokens that any
URL it fits must contain whole. The rule is filed under the token that the
fewest URLs of the table have. A URL looks up its own tokens, and only the rules
filed there run their expressions; rules without a usable token run on all URLs.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host and path prefix): the rules that the contract names.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: (verdict, pattern): what decides where no rule above fits; * stands for any text. Else a URL is allowed.
PATTERNS = (("block", "*/ads/*"), ("block", "*/banner/*"), ("block", "ad.*/*"), ("allow", "*/ads/about/*"))

TOKEN = re.compile(r"[A-Za-z0-9]+")
PARTS = re.compile(r"://([^/?#]*)([^?#]*)")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Rules, or tokens, that go to the workers at once; more are applied in further passes.
BLOCK = 100_000


class Rule(NamedTuple):
    first: bool  # a host rule, which goes before patterns
    verdict: str
    text: str
    regex: str
    tokens: frozenset


def host_rule(verdict: str, text: str) -> Rule:
    """Fits the host, its subdomains, and paths that start with the rule's."""
    host, _, path = text.partition("/")
    path = "/" + path if "/" in text else ""
    whole = [m[0] for m in TOKEN.finditer(host)] + [m[0] for m in TOKEN.finditer(path) if m.end() < len(path)]
    return Rule(True, verdict, text, r"(?:[^/]*\.)?" + re.escape(host) + ("(?=/|$)" if not path else re.escape(path)), frozenset(whole))


def pattern_rule(verdict: str, text: str) -> Rule:
    """Fits if host and path are the pattern, * standing for any text."""
    whole = [m[0] for m in TOKEN.finditer(text) if text[m.start() - 1 : m.start()] != "*" and text[m.end() : m.end() + 1] != "*"]
    return Rule(False, verdict, text, "(?s:" + ".*".join(map(re.escape, text.split("*"))) + r")\Z", frozenset(whole))


def split(url: str | None) -> tuple[str, str]:
    m = PARTS.search(url or "")
    return (m[1].translate(LOWER), m[2]) if m else ("", "")


def token_counts(urls: DataFrame, tokens: Iterable[str]) -> dict[str, int]:
    """How many rows of urls (url) have each of the tokens: as many rows as rules have tokens."""
    spark, names, counts = urls.sparkSession, sorted(tokens), {}
    own = F.explode(F.array_distinct(F.regexp_extract_all(F.regexp_replace("url", "[?#].*", ""), F.lit("([A-Za-z0-9]+)")))).alias("token")
    lower = F.translate("token", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = urls.select(own).select(F.explode(F.array_distinct(F.array("token", lower))).alias("token"))
    for i in range(0, len(names), BLOCK):
        wanted = spark.createDataFrame([(t,) for t in names[i : i + BLOCK]], "token string")
        counts |= {r.token: r["count"] for r in found.join(F.broadcast(wanted), "token").groupBy("token").count().collect()}
    return counts


def index(rules: Iterable[Rule], counts: dict[str, int]) -> dict[str | None, list[Rule]]:
    """Rules by the token that is rarest in the table; None has those that no token stands for."""
    out = defaultdict(list)
    for r in rules:
        out[min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=None)].append(r)
    return dict(out)


def judge(host: str, path: str, filed: dict, compiled: dict) -> Rule | None:
    """The longest rule that fits; host rules go before patterns."""
    url = host + path
    best = None
    for t in {None, *TOKEN.findall(url)}:
        for r in filed.get(t, ()):
            if (best is None or (r.first, len(r.text), r.text) > (best.first, len(best.text), best.text)) and compiled[r.regex].match(url):
                best = r
    return best


def url_filter(pages: DataFrame, rules=RULES, patterns=PATTERNS, default: str = "allow", key: str = "page_id") -> DataFrame:
    """Judge every url of pages (key, url): key, host, path, rule, verdict, pattern.

    rules are (verdict, host and path) and fit the host and all subdomains, if
    the path starts with the rule's; the longest wins. patterns decide where no
    rule fits, the longest first, and default where nothing does. rule is null
    unless a rule of the first kind fits; pattern likewise.

    A null url, or one without ://, has an empty host and path and gets the
    default. Repeated rows are judged alike, one by one. No rules, or an empty
    table, are fine. Other columns are ignored.
    """
    everything = [host_rule(*r) for r in rules] + [pattern_rule(*r) for r in patterns]
    urls = pages.select(F.col(key), F.col("url"))
    counts = token_counts(urls, set().union(*(r.tokens for r in everything))) if everything else {}
    out = urls
    blocks = [everything[i : i + BLOCK] for i in range(0, len(everything), BLOCK)] or [[]]
    for n, block in enumerate(blocks):
        out = out.withColumn(f"f{n}", _finder(index(block, counts))("url"))
    found = F.array_max(F.array(*(F.col(f"f{n}.best") for n in range(len(blocks))))) if len(blocks) > 1 else F.col("f0.best")
    first = F.col("best.first")
    return out.withColumn("best", found).select(
        key, "f0.host", "f0.path", F.when(first, F.col("best.text")).alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.when(~first, F.col("best.text")).alias("pattern")
    )


def _finder(filed: dict):
    @F.pandas_udf("host string, path string, best struct<first:boolean,size:int,text:string,verdict:string>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compiled = {r.regex: re.compile(r.regex) for rules in filed.values() for r in rules}
        for urls in batches:
            rows = []
            for url in urls:
                host, path = split(url)
                r = judge(host, path, filed, compiled) if host or path else None
                rows.append((host, path, r and {"first": r.first, "size": len(r.text), "text": r.text, "verdict": r.verdict}))
            yield pd.DataFrame(rows, columns=["host", "path", "best"])

    return find


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))


SQL = r"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
patterns(verdict, t, re) AS (VALUES ('block', '*/ads/*', '(?s)^.*/ads/.*$'), ('block', '*/banner/*', '(?s)^.*/banner/.*$'), ('block', 'ad.*/*', '(?s)^ad\..*/.*$'), ('allow', '*/ads/about/*', '(?s)^.*/ads/about/.*$')),
judged AS (
  SELECT page_id, host, path,
    (SELECT arg_max(h || p || ' ' || verdict, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS best,
    (SELECT arg_max(t || ' ' || verdict, length(t)) FROM patterns WHERE host || path <> '' AND regexp_matches(host || path, re)) AS other
  FROM parts)
SELECT page_id, host, path, split_part(best, ' ', 1) AS rule, coalesce(split_part(best, ' ', 2), split_part(other, ' ', 2), 'allow') AS verdict,
  CASE WHEN best IS NULL THEN split_part(other, ' ', 1) END AS pattern
FROM judged
"""
