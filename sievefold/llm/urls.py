"""Verdicts on URLs: rules by host and path, and patterns found by their rarest literal token."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievefold.llm.shared import keep_columns

#: What URLs and patterns are cut into; everything else separates.
TOKEN = "[a-z0-9]+"
#: What ``^`` stands for in a pattern: one character that can't go on a name, or the end.
SEPARATOR = r"(?:[^a-z0-9_.%-]|\z)"
#: A host after its scheme, up to the start of one of its labels.
LABEL_START = r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?"
#: Rules go to every task, so their number is bounded.
MOST_RULES = 1_000_000


@dataclass(frozen=True)
class HostRule:
    """Fits a host and its subdomains where the URL's path starts with ``path``."""

    host: str
    path: str
    action: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Pattern:
    """A filter line. ``*`` is any run, ``^`` a separator or the end, ``|`` at an end the URL's own
    end, ``||`` in front the start of a host's label; ``@@`` in front allows, other lines block.
    The case of A-Z doesn't count."""

    line: str

    @property
    def action(self) -> str:
        return "allow" if self.line.startswith("@@") else "block"

    def _parts(self) -> tuple[str, str, bool]:
        """(what it starts with, the body in lower case, whether it ends at the URL's end)."""
        body = ascii_lower(self.line.removeprefix("@@"))
        start = "||" if body.startswith("||") else "|" if body.startswith("|") else ""
        body = body[len(start) :]
        return start, body.removesuffix("|"), body.endswith("|")

    @property
    def expression(self) -> str:
        """The regular expression, as RE2 and DuckDB write it."""
        start, body, ends = self._parts()
        inner = "".join("(?s:.*)" if c == "*" else SEPARATOR if c == "^" else re.escape(c) for c in body)
        return {"||": LABEL_START, "|": "^", "": ""}[start] + inner + (r"\z" if ends else "")

    @property
    def tokens(self) -> list[str]:
        """Tokens that every URL which it fits holds whole: those with a literal or a bound on both sides."""
        start, body, ends = self._parts()
        whole = lambda at, bound: bound if not 0 <= at < len(body) else body[at] != "*"
        return [m[0] for m in re.finditer(TOKEN, body) if whole(m.start() - 1, bool(start)) and whole(m.end(), ends)]


def ascii_lower(text: str) -> str:
    return text.lower() if text.isascii() else re.sub("[A-Z]+", lambda m: m[0].lower(), text)


#: Patterns for URLs without a host rule: names of hosts, paths and queries of pages that are no text.
PATTERNS = tuple(
    map(
        Pattern,
        """
        ||casino-win. ||cheap-pills. ||adult-x. ||spam-farm. ||*-casino. ||casino. ||poker- ||*-poker. ||porn ||xxx. ||viagra- ||*-viagra. ||payday-loan ||replica-watches. ||torrent. ||free-download.
        /wp-login.php^ /wp-admin/ /xmlrpc.php^ /cgi-bin/ /cart/checkout^ /search?*&page= /tag/*/feed/ .exe| .zip| .apk| ?replytocom= ?add-to-cart= &sessionid= ?phpsessid= /calendar/*?month=
        @@||archive.*/web/ @@||museum. @@||library.
        """.split(),
    )
)

HOST_RULES = (HostRule("com", "/", "allow"), HostRule("example.com", "/en/", "block"), HostRule("www.example.com", "/en/", "allow"), HostRule("net", "/es/", "block"), HostRule("net", "/fr/", "block"))


def host_and_path(url: str | None) -> tuple[str, str]:
    """What lies between the first :// and the next of / ? #, its A-Z lower-cased, and then up to ? or #."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.match("[^/?#]*", rest)[0]
    return ascii_lower(host), re.match("[^?#]*", rest[len(host) :])[0]


def token_counts(urls: DataFrame, url_col: str, tokens: Sequence[str]) -> dict[str, int]:
    """In how many URLs each of the given tokens stands, over all rows; a row for each token reaches the driver.

    Partial sums are formed before the shuffle, so a token of every URL costs no more than another.
    Null URLs have no tokens; tokens of no URL are missing.
    """
    lower = F.translate(F.col(f"`{url_col}`"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    wanted = F.array(*map(F.lit, sorted(tokens))) if tokens else F.array().cast("array<string>")
    held = F.array_intersect(F.regexp_extract_all(lower, F.lit(TOKEN), F.lit(0)), wanted)
    return {r["token"]: r["n"] for r in urls.select(F.explode(held).alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()}


class Index:
    """Rules as a task holds them. Patterns stand under one token each, those without one are always tried."""

    def __init__(self, hosts: Sequence[HostRule], patterns: Sequence[Pattern], counts: dict[str, int]):
        self.by_host: dict[str, list[HostRule]] = defaultdict(list)
        for rule in hosts:
            self.by_host[ascii_lower(rule.host)].append(rule)
        self.patterns = list(patterns)
        self.matchers = [re.compile(p.expression.replace(r"\z", r"\Z")) for p in patterns]
        self.by_token: dict[str, list[int]] = defaultdict(list)
        self.loose: list[int] = []
        for k, p in enumerate(patterns):
            if tokens := p.tokens:
                self.by_token[min(tokens, key=lambda t: (counts.get(t, 0), -len(t), t))].append(k)
            else:
                self.loose.append(k)

    def rule(self, host: str, path: str) -> HostRule | None:
        """The longest that fits; of equally long ones that with the longer host, then a blocking one."""
        fits, at = [], 0
        while self.by_host:
            fits += [r for r in self.by_host.get(host[at:], ()) if path.startswith(r.path)]
            dot = host.find(".", at)
            if dot < 0:
                break
            at = dot + 1
        return max(fits, key=lambda r: (len(r.text), len(r.host), r.action == "block"), default=None)

    def pattern(self, url: str) -> tuple[int | None, int]:
        """(the first pattern that allows, else the first that blocks, else none; how many were tried)."""
        lower = ascii_lower(url)
        tried = [*self.loose, *(k for t in self.by_token.keys() & set(re.findall(TOKEN, lower)) for k in self.by_token[t])]
        hits = [k for k in tried if self.matchers[k].search(lower)]
        return min(hits, key=lambda k: (self.patterns[k].action != "allow", k), default=None), len(tried)


def judge_urls(urls: DataFrame, id_col: str = "page_id", url_col: str = "url", hosts: Sequence[HostRule] = HOST_RULES, patterns: Sequence[Pattern] = PATTERNS) -> DataFrame:
    """(id, host, path, rule, verdict, pattern, tried) of each row.

    A host rule decides if one fits; else the patterns do, allowing ones before blocking ones in
    their order, and what none fits is allowed. ``tried`` counts the expressions that ran on the
    URL: those whose rarest token, by its count over all URLs, the URL holds, and those without a token.
    Two scans and one small aggregate; rows are not shuffled. A null URL, an empty one and one without ://
    have empty host and path, so no host rule fits; patterns are tried on the text there is, a null as
    empty. Texts are taken whole. Null ids and repeated rows are judged each; other columns are ignored; an empty
    table gives an empty result. More than ``MOST_RULES`` rules raise.
    """
    if len(hosts) + len(patterns) > MOST_RULES:
        raise ValueError(f"{len(hosts) + len(patterns)} rules; {MOST_RULES} at most are sent to tasks")
    hosts, patterns = list(hosts), list(patterns)
    counts = token_counts(urls, url_col, sorted({t for p in patterns for t in p.tokens}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(hosts, patterns, counts)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for url in batch.column("url").to_pylist():
                host, path = host_and_path(url)
                rule, hit, tried = index.rule(host, path), None, 0
                if not rule:
                    hit, tried = index.pattern(url or "")
                verdict = rule.action if rule else "allow" if hit is None else patterns[hit].action
                for column, value in zip(out, (host, path, rule and rule.text, verdict, None if hit is None else patterns[hit].line, tried), strict=True):
                    column.append(value)
            kinds = [pa.string()] * 5 + [pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, out, kinds)], names=["id", "host", "path", "rule", "verdict", "pattern", "tried"])

    inner = keep_columns(urls, {"id": id_col, "url": url_col})
    kind = inner.schema["id"].dataType.simpleString()
    return inner.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string, pattern string, tried int").withColumnRenamed("id", id_col)
