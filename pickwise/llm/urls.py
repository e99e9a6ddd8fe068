"""Operator 6: URL filter with a weighted vocabulary.

Host rules first (longest rule wins); every other URL is judged by terms. An Aho-Corasick
automaton finds all vocabulary terms in host and path in one pass; a hit counts only
between boundaries (no letter or digit next to it). One strict term, or ``soft_limit``
distinct soft terms, block the URL. The vocabulary and the rules are parameters of a few
dozen entries; the work is a narrow map over the URLs, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickwise.llm.common import prepare

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# Fixed vocabulary of the default filter.
STRICT = ("porn", "xxx", "casino", "viagra", "escort", "hentai", "adult-x", "spam-farm", "warez", "camgirl", "sexcam")
SOFT = ("ads", "adult", "bet", "bets", "bonus", "buy", "cheap", "coupon", "crack", "discount", "farm", "free", "gambling", "jackpot",
        "keygen", "loan", "loans", "lottery", "payday", "pharma", "pill", "pills", "poker", "promo", "sex", "slots", "spam", "torrent",
        "track", "tracker", "win", "winner")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Rules of the registered query.
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
         Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def split_url(url: str | None) -> tuple[str, str]:
    """Host (ASCII lower case) and path; both empty for null or without ``://``."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    stop = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    tail = rest[stop:]
    cut = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return rest[:stop].translate(ASCII_LOWER), tail[:cut]


class RuleTable:
    """Rules by host, so that a URL looks up only the suffixes of its own host."""

    def __init__(self, rules):
        self.by_host: dict[str, list[Rule]] = {}
        for r in rules:
            self.by_host.setdefault(r.host, []).append(r)
        for own in self.by_host.values():
            own.sort(key=lambda r: (-len(r.path), r.verdict))

    def find(self, host: str, path: str) -> Rule | None:
        """The longest fitting rule: longest host and path together; ties go to the longer host, then to block."""
        best = None
        labels = host.split(".")
        for i in range(len(labels)):
            for r in self.by_host.get(".".join(labels[i:]), ()):
                if path.startswith(r.path):
                    key = (len(r.name), len(r.host), r.verdict == "block")
                    if best is None or key > best[0]:
                        best = (key, r)
        return best[1] if best else None


class Terms:
    def __init__(self, strict, soft, soft_limit: int):
        self.soft_limit = soft_limit
        self.machine = ahocorasick.Automaton()
        for term in soft:
            self.machine.add_word(term, (term, False))
        for term in strict:
            self.machine.add_word(term, (term, True))
        self.any = bool(len(self.machine))
        if self.any:
            self.machine.make_automaton()

    def hits(self, text: str) -> tuple[set[str], set[str]]:
        """Distinct strict and soft terms between boundaries."""
        strict: set[str] = set()
        soft: set[str] = set()
        for end, (term, hard) in self.machine.iter(text) if self.any else ():
            start = end - len(term) + 1
            if (start == 0 or not text[start - 1].isalnum()) and (end + 1 == len(text) or not text[end + 1].isalnum()):
                (strict if hard else soft).add(term)
        return strict, soft


def judge(df: DataFrame, url_col: str = "url", rules=RULES, strict=STRICT, soft=SOFT, soft_limit: int = 2,
          keep: list[str] | None = None) -> DataFrame:
    """Append host, path, rule, verdict, n_strict, n_soft to the columns ``keep`` (all).

    Null URLs and URLs without ``://`` have empty host and path, fit no rule and are
    allowed (no term can hit). Terms are looked for in host and path, lower-cased in
    ASCII. Columns of the same names are replaced; repeated rows get equal verdicts."""
    prepare(df.sparkSession)
    new = ["host", "path", "rule", "verdict", "n_strict", "n_soft"]
    keep = [c for c in (keep or df.columns) if c not in new]
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(url_col).cast("string").alias("__url"))
    schema = rows.drop("__url").schema
    for name in new:
        schema = schema.add(name, "long" if name.startswith("n_") else "string")
    rules, strict, soft = tuple(rules), tuple(strict), tuple(soft)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, terms = RuleTable(rules), Terms(strict, soft, soft_limit)
        for batch in batches:
            out = []
            for v in batch.column(len(keep)):
                host, path = split_url(v.as_py())
                hard, light = terms.hits(host + path.translate(ASCII_LOWER))
                rule = book.find(host, path)
                verdict = rule.verdict if rule else "block" if hard or len(light) >= soft_limit else "allow"
                out.append((host, path, rule.name if rule else None, verdict, len(hard), len(light)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.string()] * 4 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                                             names=[*keep, *new])

    return rows.mapInArrow(run, schema)
