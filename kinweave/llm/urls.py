"""URL filter: host and path rules, and a weighted vocabulary found by Aho-Corasick.

Terms count where no letter a-z or digit stands beside them. A url whose distinct terms weigh the limit or
more is rejected: one strict term, or several distinct soft ones.

Cases: a null url, or one without "://", has an empty host and path and no rule; its verdict is the
vocabulary's (a null url holds no terms: allow). Repeated rows give repeated results.
"""

from __future__ import annotations

import ahocorasick
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lower_ascii, map_texts

#: (host, path, verdict)
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
STRICT = ["casino", "malware", "phishing", "porn", "spam", "viagra", "warez", "xxx"]
SOFT = ["adult", "bet", "bonus", "cheap", "click", "dating", "discount", "farm", "free", "loan", "lottery", "pills", "win"]
LIMIT = 2


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(_rest(url), "^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """A struct of the longest fitting rule's text and verdict, or null."""
    found = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found


def term_finder(strict=STRICT, soft=SOFT) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for terms, kind in ((soft, "soft"), (strict, "strict")):
        for term in terms:
            found.add_word(term, (term, kind))
    found.make_automaton()
    return found


def _letter(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def terms_in(url: str | None, finder: ahocorasick.Automaton) -> dict[str, str]:
    """Distinct terms of the url with their kind."""
    if not url:
        return {}
    low = url.translate(_LOWER)
    found = {}
    for end, (term, kind) in finder.iter(low):
        begin = end - len(term) + 1
        if (begin == 0 or not _letter(low[begin - 1])) and (end + 1 == len(low) or not _letter(low[end + 1])):
            found[term] = kind
    return found


_LOWER = {c: c + 32 for c in range(65, 91)}


def filter_urls(
    df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, strict=STRICT, soft=SOFT, limit: int = LIMIT
) -> DataFrame:
    """One row per row of df: host, path, rule (or null), verdict, the terms found and their weight.

    A strict term weighs `limit`, a soft one 1.
    """

    def start():
        finder = term_finder(strict, soft)

        def work(ids, urls):
            found = [terms_in(u, finder) for u in urls]
            return {
                id_col: ids,
                "url": urls,
                "n_strict": [sum(k == "strict" for k in x.values()) for x in found],
                "n_soft": [sum(k == "soft" for k in x.values()) for x in found],
                "terms": [",".join(sorted(x)) for x in found],
            }

        return work

    long, text = T.LongType(), T.StringType()
    fields = [T.StructField("url", text), T.StructField("n_strict", long), T.StructField("n_soft", long), T.StructField("terms", text)]
    scored = map_texts(df, id_col, url_col, start, fields)
    url = F.coalesce(F.col("url"), F.lit(""))
    parsed = scored.select("*", host_of(url).alias("host"), path_of(url).alias("path"))
    ruled = parsed.withColumn("__rule", rule_of(F.col("host"), F.col("path"), rules))
    weight = F.col("n_strict") * limit + F.col("n_soft")
    return ruled.select(
        id_col, "url", "host", "path", F.col("__rule.rule").alias("rule"),
        F.coalesce(F.col("__rule.verdict"), F.when(weight >= limit, "block").otherwise("allow")).alias("verdict"),
        "n_strict", "n_soft", "terms",
    )


def oracle(rules=RULES, strict=STRICT, soft=SOFT, limit: int = LIMIT) -> str:
    def lower(x: str) -> str:
        return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def hits(terms: list[str]) -> str:
        return " + ".join(f"regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::BIGINT" for t in terms)

    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, _ in ordered]
    rule = " ".join(f"{f} THEN '{h}{p}'" for f, (h, p, _) in zip(fits, ordered, strict=True))
    verdict = " ".join(f"{f} THEN '{v}'" for f, (_, _, v) in zip(fits, ordered, strict=True))
    return f"""
WITH a AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
b AS (SELECT page_id, {lower('url')} AS low,
  CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM a),
c AS (SELECT page_id, low, {lower("regexp_extract(rest, '^[^/?#]*')")} AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM b),
d AS (SELECT *, {hits(strict)} AS n_strict, {hits(soft)} AS n_soft FROM c)
SELECT page_id, host, path, CASE {rule} END AS rule,
  CASE {verdict} WHEN n_strict * {limit} + n_soft >= {limit} THEN 'block' ELSE 'allow' END AS verdict,
  n_strict, n_soft FROM d"""
