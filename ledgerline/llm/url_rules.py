"""Operator 7: URL filter rules indexed by their rarest literal token.

A rule names literal tokens (runs of A-Z, a-z, 0-9) that every URL it fits must hold as whole
tokens. How many URLs of the table hold each rule token is counted first; a rule is filed
under its rarest one. A URL's own tokens fetch the rules filed under them, and only those
run their regular expression. Rules without a literal token run on every URL.

Two kinds of rules: site rules (a host with all its subdomains, and a path prefix; the longest
that fits decides) and patterns, which decide where no site rule does.

The index goes to every task, so a rule list is limited to ``MOST_RULES``; a longer one is
refused. Defined results: a null url, or one without ``://``, has an empty host and path and
is allowed unless a pattern fits the empty string; repeated rows get the same result; a null
page_id is judged like any other; a very long url is judged whole; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.shipping import shipped

MOST_RULES = 200_000
TOKEN = re.compile("[0-9A-Za-z]+")

SCHEMA = "page_id long, host string, path string, rule string, verdict string, pattern string, rules_run int"


@dataclass(frozen=True)
class Rule:
    """verdict for URLs whose host and path, joined, the expression matches from their beginning."""

    name: str
    verdict: str
    expression: str
    tokens: tuple[str, ...] = field(default=())
    site: bool = False


def site_rule(verdict: str, name: str) -> Rule:
    """``host/path``: the host with its subdomains, and paths that start with ``/path``."""
    host, slash, path = name.partition("/")
    whole = TOKEN.findall(host)
    rest = slash + path
    # The last token of the path may go on in the URL, unless something ends it.
    whole += [m[0] for m in TOKEN.finditer(rest) if m.end() < len(rest)]
    return Rule(name, verdict, rf"(?:[^/]*\.)?{re.escape(host)}{'' if slash else '(?:/|$)'}{re.escape(rest)}", tuple(whole), True)


def word_rule(verdict: str, words: str) -> Rule:
    """URLs that hold some words, with other signs than letters and numbers between and around them, in any case of A-Z.

    Case is ASCII's alone: a letter such as the long s is none of a token's, so it must be none of the expression's.
    """
    expression = "[^0-9a-z]+".join(map(re.escape, words.split()))
    return Rule(words, verdict, rf"(?ai)(?:.*[^0-9a-z])?{expression}(?:[^0-9a-z]|$)", tuple(words.lower().split()))


#: Site rules (fixed values).
SITES = (site_rule("block", "com/en/"), site_rule("allow", "example.com/en/7"), site_rule("allow", "net/de/"), site_rule("block", "example.net/de/8"), site_rule("block", "org/es/"))
#: Words of sites that hold no text worth learning from (fixed values).
UNWANTED = ("adult", "betting", "casino", "escort", "poker", "porn", "slots", "torrent", "viagra", "xxx")
#: Words that say so together only (fixed values).
UNWANTED_TOGETHER = ("buy essay online", "cgi bin", "download free crack", "keyword spam", "link farm", "mail order bride", "payday loan", "wp login php")
PATTERN_WORDS = UNWANTED + UNWANTED_TOGETHER
PATTERNS = tuple(word_rule("block", w) for w in PATTERN_WORDS)


def tokens_of(host: str, path: str) -> set[str]:
    """Whole tokens, as they stand and in lower case."""
    found = TOKEN.findall(f"{host} {path}")
    return {*found, *map(str.lower, found)}


_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def host_and_path(url: str | None) -> tuple[str, str]:
    _, there, rest = (url or "").partition("://")
    if not there:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(_LOWER), re.match(r"[^?#]*", rest[len(host) :])[0]


class RuleIndex:
    def __init__(self, rules: Iterable[Rule], counts: dict[str, int]):
        self.rules = list(rules)
        if len(self.rules) > MOST_RULES:
            raise ValueError(f"more than {MOST_RULES} rules")
        self.filed: dict[str, list[int]] = defaultdict(list)
        self.everywhere: list[int] = []
        self.compiled: dict[int, re.Pattern] = {}
        for k, rule in enumerate(self.rules):
            if rule.tokens:
                self.filed[min(rule.tokens, key=lambda t: (counts.get(t, 0), t))].append(k)
            else:
                self.everywhere.append(k)

    def judge(self, host: str, path: str) -> tuple[str | None, str, str | None, int]:
        """The site rule's name, the verdict, the pattern's name and how many expressions ran."""
        key = host + path
        candidates = {k for t in tokens_of(host, path) for k in self.filed.get(t, ())}
        candidates.update(self.everywhere)
        site = pattern = None
        for k in sorted(candidates):
            rule = self.rules[k]
            if k not in self.compiled:
                self.compiled[k] = re.compile(rule.expression, re.DOTALL)
            if self.compiled[k].match(key):
                if rule.site and (site is None or len(rule.name) > len(site.name)):
                    site = rule
                elif not rule.site and pattern is None:
                    pattern = rule
        verdict = (site or pattern).verdict if site or pattern else "allow"
        return site and site.name, verdict, pattern and pattern.name, len(candidates)


def token_counts(pages: DataFrame, rules: Iterable[Rule]) -> dict[str, int]:
    """How many URLs hold each of the rules' tokens, in any case; as many counts as the rules have tokens."""
    wanted = sorted({t.lower() for r in rules for t in r.tokens})
    if not wanted:
        return {}
    found = F.array_intersect(F.split(F.lower("url"), "[^0-9a-z]+"), F.array(*map(F.lit, wanted)))
    counts = {r["token"]: r["n"] for r in pages.select(F.explode(found).alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()}
    return {t: counts.get(t.lower(), 0) for r in rules for t in r.tokens}


def filter_urls(pages: DataFrame, rules: Iterable[Rule] = SITES + PATTERNS) -> DataFrame:
    """Host, path, site rule, verdict and pattern of every page; a count of tokens, then one pass without a shuffle."""
    rules = list(rules)
    index = RuleIndex(rules, token_counts(pages, rules))

    def run(batches):
        for batch in batches:
            split = [host_and_path(u.as_py()) for u in batch.column(1)]
            judged = [index.judge(*x) for x in split]
            columns = [batch.column(0), *[pa.array([x[i] for x in split], pa.string()) for i in range(2)], *[pa.array([x[i] for x in judged], pa.string()) for i in range(3)], pa.array([x[3] for x in judged], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])

    return shipped(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url")).mapInArrow(run, SCHEMA)
