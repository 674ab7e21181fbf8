"""URL filter: pattern rules, each indexed by the rarest literal token it needs.

A rule says whether to allow or block, and is a regular expression over ``host#path``.  Whatever it
matches holds its literal tokens; of these the one that the fewest URLs of the corpus hold is its entry
in the index.  The tokens of a URL fetch the candidate rules, and only those run their expressions.
Site rules (a host with its subdomains, and the beginning of a path) decide first, the longest of
them; pattern rules decide the rest, where any block wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    name: str
    block: bool
    pattern: str
    tokens: tuple[str, ...]  # whole tokens of the host and path that any match holds
    site: bool = False


def site_rule(verdict: str, host: str, path: str = "/") -> Rule:
    """A host and all its subdomains, and paths that begin with ``path``."""
    # a token at the end of the path may go on in a URL, so it is not a whole one
    sure = _TOKEN.findall(host.lower()) + _TOKEN.findall(re.sub(r"[A-Za-z0-9]+$", "", path).lower())
    return Rule(host + path, verdict == "block", rf"(?:[^#]*\.)?{re.escape(host)}#{re.escape(path)}", tuple(sure), True)


def word_rule(word: str) -> Rule:
    """Blocks hosts with a label that has this word between hyphens."""
    return Rule(word, True, rf"(?:[^#]*[.-])?{re.escape(word)}(?:[.-][^#]*)?#", (word,))


#: The rules of the query, in the order they are given.
SITES = (site_rule("allow", "org"), site_rule("block", "example.org", "/es/"), site_rule("block", "example.org", "/en/1"), site_rule("allow", "com", "/fr/"), site_rule("block", "com", "/de/"))
#: Words in hosts of spam, gambling, tracking and adult sites.
WORDS = tuple(map(word_rule, ("pills", "casino", "adult", "ads", "spam", "bets", "porn", "poker", "viagra", "xxx", "track", "banner", "doubleclick", "escort", "lottery")))


def parts(url: str | Column) -> tuple[Column, Column]:
    """(host, path) of a URL column: the host (A-Z in lower case) from the first ``://`` up to ``/``, ``?``
    or ``#``, the path up to ``?`` or ``#``; both empty for null or without ``://``."""
    c = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    cut = F.locate("://", c)
    rest = F.when(cut > 0, F.substr(c, cut + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws("#", host, path)), F.lit("[a-z0-9]+"), F.lit(0)))


def index(urls: DataFrame, rules: tuple[Rule, ...]) -> dict[str, list[Rule]]:
    """Rules under their rarest token, from the number of ``urls`` (url) that hold each token of a rule.
    As many counts reach the driver as the rules have tokens; a rule without a token is under ''."""
    asked = sorted({t for r in rules for t in r.tokens})
    held = F.array_intersect(_tokens(*parts("url")), F.array(*map(F.lit, asked)) if asked else F.array().cast("array<string>"))
    count = {r[0]: r[1] for r in urls.select(F.explode(held).alias("t")).groupBy("t").count().toLocalIterator()}
    out: dict[str, list[Rule]] = {}
    for r in rules:
        out.setdefault(min(r.tokens, key=lambda t: (count.get(t, 0), t), default=""), []).append(r)
    return out


def judge(host: str, path: str, by_token: dict[str, list[tuple[Rule, re.Pattern]]]) -> tuple[str | None, str]:
    """(name of the site rule that decides, or null; verdict)."""
    best, blocked, text = None, False, f"{host}#{path}"
    for token in {"", *_TOKEN.findall(text.lower())}:
        for rule, pattern in by_token.get(token, ()):
            if pattern.match(text):
                if rule.site:
                    if best is None or len(rule.name) > len(best.name):
                        best = rule
                else:
                    blocked |= rule.block
    if best:
        return best.name, "block" if best.block else "allow"
    return None, "block" if blocked else "allow"


def judged(host: Column, path: Column, rules: dict[str, list[Rule]]) -> Column:
    @F.pandas_udf("rule string, verdict string")
    def verdicts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        ready = {t: [(r, re.compile(r.pattern, re.S)) for r in own] for t, own in rules.items()}
        for hosts, paths in batches:
            yield pd.DataFrame([judge(h, p, ready) for h, p in zip(hosts, paths, strict=True)], columns=["rule", "verdict"])

    return verdicts(host, path)


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = SITES + WORDS) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url).  A URL that is null or
    has no ``://`` has neither host nor path and is allowed."""
    host, path = parts("url")
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    return split.select("page_id", "host", "path", judged(F.col("host"), F.col("path"), index(pages.select("url"), rules)).alias("j")).select("page_id", "host", "path", "j.*")
