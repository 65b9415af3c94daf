"""URL filter: longest host/path rule first, else a weighted vocabulary found by Aho-Corasick.

A term counts only between boundaries (no ASCII letter or digit beside it).  One strict term, or
``soft_limit`` distinct soft terms, reject a URL.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

STRICT = {"casino": 3.0, "porn": 3.0, "xxx": 3.0, "viagra": 3.0, "spam": 2.0, "malware": 3.0, "phishing": 3.0}
SOFT = {"ads": 1.0, "bets": 1.0, "bet": 1.0, "cheap": 1.0, "farm": 0.5, "free": 0.5, "pills": 1.0, "poker": 1.0, "track": 0.5, "win": 0.5}
SOFT_LIMIT = 2
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
SCHEMA = "host string, path string, rule string, verdict string, strict_hits long, soft_hits long, weight double"
_HOST, _PATH = re.compile("[^/?#]*"), re.compile("[^?#]*")
_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    head, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = _HOST.match(rest)[0]
    return host.translate(_LOWER), _PATH.match(rest, len(host))[0]


class Judge:
    """The compiled rules and vocabulary; built once a task, its size is that of the configuration."""

    def __init__(self, rules, strict, soft, soft_limit):
        import ahocorasick

        self.rules: dict[str, list[tuple[str, str]]] = {}
        for host, path, verdict in rules:
            self.rules.setdefault(host, []).append((path, verdict))
        self.strict, self.soft, self.soft_limit = strict, soft, soft_limit
        self.automaton = ahocorasick.Automaton()
        for term in {*strict, *soft}:
            self.automaton.add_word(term, term)
        self.automaton.make_automaton()

    def rule(self, host: str, path: str) -> tuple[str | None, str | None]:
        """Walks the host's suffixes; the longest rule wins, by its whole length and then its host's."""
        best: tuple = ()
        labels = host.split(".")
        for k in range(len(labels)):
            suffix = ".".join(labels[k:])
            for start, verdict in self.rules.get(suffix, ()):
                if path.startswith(start):
                    best = max(best, (len(suffix) + len(start), len(suffix), suffix + start, verdict))
        return (best[2], best[3]) if best else (None, None)

    def hits(self, url: str) -> set[str]:
        low, found = url.translate(_LOWER), set()
        free = lambda k: not (0 <= k < len(low) and low[k].isascii() and low[k].isalnum())
        for end, term in self.automaton.iter(low):
            if free(end + 1) and free(end - len(term)):
                found.add(term)
        return found

    def __call__(self, url: str | None) -> tuple:
        host, path = split_url(url)
        rule, verdict = self.rule(host, path)
        found = self.hits(url or "")
        strict, soft = found & self.strict.keys(), found & self.soft.keys()
        if verdict is None:
            verdict = "block" if strict or len(soft) >= self.soft_limit else "allow"
        weight = sum(self.strict[t] for t in sorted(strict)) + sum(self.soft[t] for t in sorted(soft))
        return host, path, rule, verdict, len(strict), len(soft), weight


def judge_urls(
    pages: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    rules=RULES,
    strict=STRICT,
    soft=SOFT,
    soft_limit: int = SOFT_LIMIT,
) -> DataFrame:
    """One row per input row: its id and the judgement.

    Null or empty URLs have empty host and path, fit no rule and are allowed.  Repeated rows are
    judged each.  URLs of any length are scanned whole.  Of the input only the two named columns
    are read, so other columns, also of the result's names, do no harm.  No shuffle.
    """
    common.small_batches(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(rules, strict, soft, soft_limit)
        names = ["host", "path", "rule", "verdict", "strict_hits", "soft_hits", "weight"]
        kinds = [pa.string()] * 4 + [pa.int64()] * 2 + [pa.float64()]
        for batch in batches:
            rows = list(zip(*map(judge, batch.column(1).to_pylist()), strict=True)) or [()] * 7
            out = [pa.array(c, k) for c, k in zip(rows, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *out], [id_col, *names])

    return pages.select(F.col(id_col), F.col(url_col).alias("_url")).mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")
