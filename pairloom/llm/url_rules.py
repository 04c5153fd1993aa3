"""URL filters: pattern rules found by their rarest literal token.

Host rules come first and the longest fitting one decides. For other URLs, each whole alphanumeric token of the URL
fetches the pattern rules indexed under it, and only their regular expressions run. Rules without a whole literal
token are always tried. A null URL, or one without ://, has an empty host and path, fits no host rule and is allowed
unless a pattern rule blocks it. Rows are judged one by one, so repeated rows give repeated results; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class HostRule:
    host: str
    path: str
    action: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    """* stands for any text, ^ for an end or a character that is neither letter nor digit; case is ignored."""

    pattern: str
    action: str = "block"

    def regex(self) -> str:
        return "".join({"*": ".*", "^": "(?:^|$|[^a-z0-9])"}.get(c) or re.escape(c) for c in self.pattern.lower())

    def literals(self) -> list[str]:
        """The tokens that any fitting URL has as whole tokens: those that no wildcard or open end touches."""
        return [m[0] for m in re.finditer("[a-z0-9]+", self.pattern.lower()) if m.start() and m.end() < len(self.pattern) and self.pattern[m.start() - 1] != "*" and self.pattern[m.end()] != "*"]


HOST_RULES = (
    HostRule("com", "/", "allow"),
    HostRule("example.com", "/en/", "block"),
    HostRule("www.example.com", "/en/", "allow"),
    HostRule("net", "/es/", "block"),
    HostRule("net", "/fr/", "block"),
)
PATTERN_RULES = tuple(
    PatternRule(p)
    for p in (
        "^casino^", "^poker^", "^free-bets^", "^betting^", "^lottery^", "^jackpot^",
        "^adult^", "^porn^", "^xxx^", "^escort^",
        "^cheap-pills^", "^viagra^", "^cialis^", "^pharma^discount^",
        "^spam-farm^", "^link-farm^", "^warez^", "^torrent^", "^keygen^",
        "^ads-track^", "^adserver^", "^doubleclick^", "^popunder^", "^phish*login^",
    )
)


def host_and_path(url: str | None) -> tuple[str, str]:
    if not url or (at := url.find("://")) < 0:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url[at + 3 :])
    return re.sub("[A-Z]+", lambda c: c[0].lower(), m[1]), m[2]


class HostIndex:
    """Rules by host and path; a host's paths are tried by their lengths, not one by one."""

    def __init__(self, rules: Iterable[HostRule]):
        self.by_host: dict[str, tuple[dict[str, HostRule], set[int]]] = {}
        for r in rules:
            paths, lengths = self.by_host.setdefault(r.host, ({}, set()))
            paths.setdefault(r.path, r)
            lengths.add(len(r.path))

    def find(self, host: str, path: str) -> HostRule | None:
        """The longest rule for host or a parent of it whose path begins the given one."""
        best, labels = None, host.split(".")
        for i in range(len(labels)):
            paths, lengths = self.by_host.get(".".join(labels[i:]), ({}, ()))
            r = next((paths[path[:n]] for n in sorted(lengths, reverse=True) if n <= len(path) and path[:n] in paths), None)
            if r and (best is None or (len(r.name), r.name) > (len(best.name), best.name)):
                best = r
        return best


class PatternIndex:
    """frequency: in how many URLs a token occurs; each rule is filed under its rarest literal. Rules are compiled when a
    URL first fetches them."""

    def __init__(self, rules: Iterable[PatternRule], frequency: dict[str, int]):
        self.by_token: dict[str, list[tuple[int, PatternRule]]] = {}
        self.always: list[tuple[int, PatternRule]] = []
        self.compiled = lru_cache(50_000)(lambda rule: re.compile(rule.regex(), re.S))
        for i, r in enumerate(rules):
            rarest = min(r.literals(), key=lambda t: (frequency.get(t, 0), t), default=None)
            (self.always if rarest is None else self.by_token.setdefault(rarest, [])).append((i, r))

    def candidates(self, url: str) -> list[tuple[int, PatternRule]]:
        """The rules whose expression must run, in the order given."""
        near = [e for t in set(re.findall("[a-z0-9]+", url)) for e in self.by_token.get(t, ())]
        return sorted(near + self.always, key=lambda e: e[0])

    def find(self, url: str | None) -> str | None:
        """The action of the first rule, in the order given, that fits; None if none does."""
        url = (url or "").lower()
        return next((r.action for _, r in self.candidates(url) if self.compiled(r).search(url)), None)


def rules_of(rules: DataFrame, most: int = 5_000_000) -> tuple[list[HostRule], list[PatternRule]]:
    """Rules from a table (host, path, pattern, action), in the order of its columns; rows with a pattern are pattern rules.

    Rules are held by the driver and by each worker, so more than `most` are refused. Rows without host and pattern, or
    without an action, are left out.
    """
    rows = rules.select("host", "path", "pattern", "action").where("action is not null and (host is not null or pattern is not null)").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules")
    rows.sort(key=lambda r: (r.pattern or "", r.host or "", r.path or "", r.action))
    return [HostRule(r.host, r.path or "/", r.action) for r in rows if r.pattern is None], [PatternRule(r.pattern, r.action) for r in rows if r.pattern is not None]


def literal_frequency(pages: DataFrame, rules: Iterable[PatternRule]) -> dict[str, int]:
    """In how many URLs each literal of the rules occurs; one row for each literal comes to the driver."""
    known = sorted({t for r in rules for t in r.literals()})
    if not known:
        return {}
    literals = pages.sparkSession.createDataFrame([(t,) for t in known], "token string")
    tokens = pages.select(F.explode(F.array_distinct(F.split(F.lower("url"), "[^a-z0-9]+"))).alias("token"))
    # as large as the rules, which each worker holds anyway
    return {r.token: r["count"] for r in tokens.join(F.broadcast(literals), "token").groupBy("token").count().collect()}


def judge_urls(pages: DataFrame, host_rules: Iterable[HostRule] = HOST_RULES, pattern_rules: Iterable[PatternRule] = PATTERN_RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict for each row of pages (page_id, url). The rules travel with the tasks."""
    host_rules, pattern_rules = tuple(host_rules), tuple(pattern_rules)
    sent = pages.sparkSession.sparkContext.broadcast((host_rules, pattern_rules, literal_frequency(pages, pattern_rules)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hosts, patterns = HostIndex(sent.value[0]), PatternIndex(*sent.value[1:])
        for b in batches:
            rows = []
            for url in b["url"]:
                host, path = host_and_path(url)
                if r := hosts.find(host, path):
                    rows.append((host, path, r.name, r.action))
                else:
                    rows.append((host, path, None, patterns.find(url) or default))
            out = pd.DataFrame(rows, columns=["host", "path", "rule", "verdict"], dtype=object)
            out.insert(0, "page_id", b["page_id"].array)
            yield out

    return pages.select("page_id", "url").mapInPandas(run, "page_id long, host string, path string, rule string, verdict string")


def oracle(host_rules: Iterable[HostRule] = HOST_RULES, pattern_rules: Iterable[PatternRule] = PATTERN_RULES) -> str:
    """DuckDB SQL that tries every rule on every URL."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rules = ", ".join(f"('{r.host}', '{r.path}', '{r.action}')" for r in host_rules)
    fits = " or ".join("regexp_matches(lower(coalesce(url, '')), '{}', 's')".format(r.regex().replace("'", "''")) for r in pattern_rules)
    return f"""
with rules(r_host, r_path, r_action) as (values {rules}),
rest as (select row_number() over () rid, page_id, url, case when strpos(coalesce(url, ''), '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
parts as (select rid, page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}') host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') path from rest),
best as (select rid, arg_max(r_host || r_path, length(r_host || r_path)) rule, arg_max(r_action, length(r_host || r_path)) r_action
  from parts join rules on (host = r_host or ends_with(host, '.' || r_host)) and starts_with(path, r_path) group by rid)
select page_id, host, path, rule, coalesce(r_action, case when {fits} then 'block' else 'allow' end) verdict
from parts left join best using (rid)"""
