"""URL filter: host rules first, then a weighted vocabulary matched by an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panemill.llm.common import ascii_lower, table

#: One of these condemns a URL.
STRICT_TERMS = (
    "camgirl", "camgirls", "cheap-pills", "cialis", "cracked-software", "darknet-market", "escort", "escorts", "fake-passport", "free-porn",
    "gore", "hentai", "keygen", "milf", "nsfw", "online-casino", "payday-loan", "phishing", "porn", "porno", "pornhub", "replica-watches",
    "serial-key", "sexcam", "sextube", "sportsbook", "viagra", "warez", "webcam-sex", "xnxx", "xvideos", "xxx",
)
#: So do several different ones of these.
SOFT_TERMS = (
    "adult", "bet", "betting", "bingo", "blackjack", "bonus", "casino", "cheap", "coupon", "crack", "credit", "dating", "deal", "deals",
    "discount", "download", "erotic", "free", "gambling", "girls", "hot", "jackpot", "lingerie", "loan", "loans", "lottery", "mp3", "naked",
    "nude", "pharmacy", "pills", "poker", "promo", "replica", "roulette", "serial", "sex", "sexy", "singles", "slots", "spam", "steroids",
    "torrent", "torrents", "uncensored", "webcam", "win", "winner",
)
SOFT_LIMIT = 2
#: (action, rule): the rule is a host and a path prefix.
HOST_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def url_host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What stands after the host up to ``?``, ``#`` or the end; empty for a null or a URL without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_rule(host: Column, path: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """The longest fitting rule as struct(action, rule), or null. A rule fits its host and all subdomains.

    Of two fitting rules of one length the one that sorts first wins.
    """
    fitting = []
    for action, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        on, slash, prefix = rule.partition("/")
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(slash + prefix)
        fitting.append(F.when(fits, F.struct(F.lit(action).alias("action"), F.lit(rule).alias("rule"))))
    return F.coalesce(*fitting, F.lit(None).cast("struct<action: string, rule: string>"))


@lru_cache(maxsize=8)
def _automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton | None:
    """The automaton of all terms; none where there are no terms."""
    found = ahocorasick.Automaton()
    for terms, weight in ((soft, 0), (strict, 1)):
        for term in terms:
            found.add_word(term, (term, weight))
    if not len(found):
        return None
    found.make_automaton()
    return found


def term_hits(url: str, strict: tuple[str, ...], soft: tuple[str, ...]) -> tuple[int, int]:
    """How many strict terms and how many different soft terms stand in a URL as whole words.

    A term counts where no ASCII letter or digit stands directly before or after it.
    """
    text = url.translate(_LOWER)
    hard, found = 0, set()
    automaton = _automaton(strict, soft)
    for last, (term, weight) in automaton.iter(text) if automaton else ():
        first = last - len(term) + 1
        if (first and text[first - 1] in _INSIDE) or text[last + 1 : last + 2] in _INSIDE:
            continue
        if weight:
            hard += 1
        else:
            found.add(term)
    return hard, len(found)


_INSIDE = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_LOWER = {upper: upper + 32 for upper in range(ord("A"), ord("Z") + 1)}


def vocabulary_hits(url: Column, strict: tuple[str, ...] = STRICT_TERMS, soft: tuple[str, ...] = SOFT_TERMS) -> Column:
    """struct(strict_hits, soft_hits) of a URL; a null URL has none."""

    @F.pandas_udf("strict_hits int, soft_hits int")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for urls in batches:
            rows = [term_hits(u, strict, soft) if u else (0, 0) for u in urls]
            yield pd.DataFrame(rows, columns=["strict_hits", "soft_hits"])

    return hits(url)


def filter_urls(pages: DataFrame, *, rules: Iterable[tuple[str, str]] = HOST_RULES, strict: tuple[str, ...] = STRICT_TERMS, soft: tuple[str, ...] = SOFT_TERMS, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """Judge ``pages`` (page_id, url); columns page_id, host, path, rule, verdict, strict_hits, soft_hits.

    A host rule decides where one fits. Elsewhere a URL is blocked for one strict term or for ``soft_limit``
    different soft terms. A null or empty URL and one without a host have no rule and no hits in a host; they are
    allowed unless their text holds terms. Repeated rows are judged one by one; extra columns are left out; an empty
    table gives an empty result. Without rules the terms decide, without terms all that no rule blocks is allowed. URLs are
    read whole, whatever their length. Every row is judged alone, so nothing is shuffled.
    """
    judged = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), vocabulary_hits(F.col("url"), strict, soft).alias("hits"))
    judged = judged.withColumn("chosen", host_rule(F.col("host"), F.col("path"), rules))
    by_terms = F.when((F.col("hits.strict_hits") > 0) | (F.col("hits.soft_hits") >= soft_limit), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("chosen.rule").alias("rule"), F.coalesce(F.col("chosen.action"), by_terms).alias("verdict"), "hits.strict_hits", "hits.soft_hits")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def _sql() -> str:
    def hit(term: str) -> str:
        return f"regexp_matches(low, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')"

    def count(term: str) -> str:
        # a second occurrence may share its boundary with the first: split at the term and look at both sides
        return f"(SELECT count(*) FROM range(1, length(low) + 1) AS spot(i) WHERE substr(low, i, {len(term)}) = '{term}' AND NOT regexp_matches(substr(low, i - 1, CASE WHEN i = 1 THEN 0 ELSE 1 END), '[a-z0-9]') AND NOT regexp_matches(substr(low, i + {len(term)}, 1), '[a-z0-9]'))"

    cases = []
    for action, rule in sorted(HOST_RULES, key=lambda r: (-len(r[1]), r[1])):
        on, slash, prefix = rule.partition("/")
        cases.append((f"(host = '{on}' OR ends_with(host, '.{on}')) AND starts_with(path, '{slash}{prefix}')", action, rule))
    return f"""
WITH parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path,
    coalesce(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS low
  FROM pages),
hits AS (
  SELECT page_id, host, path, CAST({" + ".join(count(t) for t in STRICT_TERMS)} AS INTEGER) AS strict_hits,
    CAST({" + ".join(f"CASE WHEN {hit(t)} THEN 1 ELSE 0 END" for t in SOFT_TERMS)} AS INTEGER) AS soft_hits
  FROM parts)
SELECT page_id, host, path, strict_hits, soft_hits,
  CASE {" ".join(f"WHEN {c} THEN '{r}'" for c, _, r in cases)} END AS rule,
  CASE {" ".join(f"WHEN {c} THEN '{a}'" for c, a, _ in cases)} WHEN strict_hits > 0 OR soft_hits >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict
FROM hits"""


SQL = _sql()
