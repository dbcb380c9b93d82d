"""URL filter: host and path rules first, then a weighted vocabulary found by an Aho-Corasick automaton.

A term counts once, where no letter or digit stands next to it. The weights of a url's distinct terms are summed, and a
sum of `limit` or more blocks it: one strict term, which weighs as much by itself, or several soft ones. The vocabulary
is a parameter, a mapping of terms to weights or a table of them; the automaton is built once in each task.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from vecspark.llm.shared import load

#: Terms by what they weigh, strict ones first. A table of one's own takes their place.
LIMIT = 4
STRICT = (
    "adult", "bestiality", "blackjack", "bondage", "camgirl", "camgirls", "casino", "casinos", "cialis", "escort", "escorts", "fetish", "hardcore", "hentai", "incest", "jackpot",
    "keygen", "keylogger", "malware", "milf", "nsfw", "phishing", "porn", "porno", "pornography", "ransomware", "sexcam", "slots", "spam-farm", "sportsbook", "viagra", "warez", "xvideos", "xxx",
)
#: Two of these are enough.
SOFT = (
    "ads", "bet", "bets", "betting", "bonus", "cheap", "click", "crack", "deals", "farm", "free", "gambling", "hacked", "hot", "loan", "loans", "nude", "payday", "pharmacy",
    "pills", "poker", "prize", "replica", "serial", "sex", "sexy", "spam", "torrent", "track", "win", "winner",
)
#: Four of these.
WEAK = ("best", "buy", "coupon", "discount", "download", "hotdeal", "offer", "online", "promo", "sale", "shop", "today")
VOCABULARY = dict.fromkeys(WEAK, 1) | dict.fromkeys(SOFT, 2) | dict.fromkeys(STRICT, LIMIT)
#: (host and path, verdict)
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
WORD = frozenset("0123456789abcdefghijklmnopqrstuvwxyz")


def ascii_lower(text: str) -> str:
    return text.encode().lower().decode()


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path; both empty without ://."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url[at + 3 :], re.DOTALL).groups()
    return ascii_lower(host), path


class RuleBook:
    """Finds the longest rule for a host and its parents."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, rule, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        found, parent = [], host
        while parent:
            found += [(rule, verdict) for start, rule, verdict in self.by_host.get(parent, ()) if path.startswith(start)]
            parent = parent.partition(".")[2]
        return max(found, key=lambda r: len(r[0]), default=None)


class Vocabulary:
    """Weighted terms in one automaton."""

    def __init__(self, terms: Mapping[str, int], limit: int):
        self.automaton, self.limit = ahocorasick.Automaton(), limit
        for term, weight in terms.items():
            self.automaton.add_word(term, (term, weight))
        if terms:
            self.automaton.make_automaton()

    def hits(self, text: str) -> tuple[int, int, int]:
        """Of the distinct terms of a lower-cased text: strict ones, others, and the weight of all."""
        found = {}
        for end, (term, weight) in self.automaton.iter(text) if len(self.automaton) else ():
            start = end + 1 - len(term)
            if (start == 0 or text[start - 1] not in WORD) and (end + 1 == len(text) or text[end + 1] not in WORD):
                found[term] = weight
        strict = sum(weight >= self.limit for weight in found.values())
        return strict, len(found) - strict, sum(found.values())


def read_vocabulary(table: DataFrame) -> dict[str, int]:
    """The terms of a table(term, weight), lower-cased; one that repeats has its largest weight. It is collected, as
    each task holds the automaton: a million terms at most."""
    if table.count() > 1_000_000:
        raise ValueError("more than a million terms")
    out: dict[str, int] = {}
    for term, weight in table.select("term", "weight").where("term is not null and term != '' and weight > 0").collect():
        out[ascii_lower(term)] = max(weight, out.get(ascii_lower(term), 0))
    return out


def filter_urls(pages: DataFrame, vocabulary: Mapping[str, int] = VOCABULARY, limit: int = LIMIT, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, strict_hits, soft_hits, weight) of every row of pages(page_id, url).

    The longest rule that fits decides; else the vocabulary, over the whole url, however long. A null or empty url, or
    one without ://, has an empty host and path; null has no hits and is allowed. Repeated rows, and rows that repeat a
    page_id or have none, are judged each on its own; an empty table has no rows; other columns are ignored.
    """

    def scan(batches):
        book, known = RuleBook(rules), Vocabulary(vocabulary, limit)
        for batch in batches:
            out: list[tuple] = []
            for url in batch.column("url").to_pylist():
                host, path = split_url(url)
                n_strict, n_soft, weight = known.hits(ascii_lower(url or ""))
                rule, verdict = book.find(host, path) or (None, "block" if weight >= limit else "allow")
                out.append((host, path, rule, verdict, n_strict, n_soft, weight))
            kinds = (pa.string(),) * 4 + (pa.int64(),) * 3
            columns = zip(*out, strict=True) if out else [()] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))],
                names=["page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits", "weight"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url").mapInArrow(
        scan, f"page_id {kind}, host string, path string, rule string, verdict string, strict_hits long, soft_hits long, weight long"
    )


def op5(spark, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return filter_urls(load(spark, sf_dir, "pages"))


def _hits_sql(terms: Iterable[str]) -> str:
    return " + ".join(f"regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::BIGINT" for t in terms)


def _rule_sql(rule: str) -> str:
    host, slash, path = rule.partition("/")
    return f"(host = '{host}' OR suffix(host, '.{host}')) AND starts_with(path, '{slash}{path}')"


OP5_SQL = f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), cut AS (
  SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), found AS (
  SELECT *, CASE {" ".join(f"WHEN {_rule_sql(r)} THEN '{r}'" for r, _ in sorted(RULES, key=lambda x: -len(x[0])))} END AS rule,
         {_hits_sql(STRICT)} AS strict_hits, {_hits_sql(SOFT)} AS two, {_hits_sql(WEAK)} AS one FROM cut
), weighed AS (SELECT *, two + one AS soft_hits, {LIMIT} * strict_hits + 2 * two + one AS weight FROM found
)
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in RULES)}
         WHEN weight >= {LIMIT} THEN 'block' ELSE 'allow' END AS verdict, strict_hits, soft_hits, weight FROM weighed
"""
