"""Secret scans by one automaton.

All rules are compiled into a single minimal automaton that reads each byte of a text once and names
the rules that end there. A hit is then widened: the rule's reversed automaton finds the leftmost
start, its anchored one the longest end. What is found is checked by the rule's exact regex.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .automaton import Dfa, Parser, reverse
from .common import table


@dataclass(frozen=True)
class Rule:
    """A kind of secret: spans are leftmost, longest and disjoint matches of `pattern`; those that `check` doesn't match as a whole are dropped.

    `trigger` is the shortest beginning that tells a match; without one it is the pattern with one or the least number of the characters that end it. The combined automaton looks for
    triggers, as what may go on without end would multiply its states.
    """

    kind: str
    pattern: str
    check: str
    fold: bool = False
    base: bool = False
    trigger: str = ""


#: Base rules in their listed order, then this scanner's own.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=\-]+""", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}""", fold=True, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{12,}", r"[0-9a-f]{24,}", base=True),  # shorter runs are dropped anyway
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9\-]+", r"xox[abprs]-[A-Za-z0-9-]{20,}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]+", r"sk_live_[A-Za-z0-9]{20,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_\-]+", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("npm", r"npm_[A-Za-z0-9]+", r"npm_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[A-Za-z0-9_\-]+", r"AIza[A-Za-z0-9_-]{35,}"),
    # the key's lines belong to it, up to its END line if there is one
    Rule(
        "private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(\x0d?\x0a[A-Za-z0-9+/=]{16,})*((\x0d?\x0a[A-Za-z0-9+/=]+)?\x0d?\x0a-----END [A-Z ]*PRIVATE KEY-----)?",
        r"-----BEGIN ([A-Z]+ ){0,2}PRIVATE KEY-----(\r?\n[A-Za-z0-9+/=]+)*(\r?\n-----END ([A-Z]+ ){0,2}PRIVATE KEY-----)?",
        trigger=r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    ),
)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        nodes = [Parser(r.trigger or re.sub(r"(\{\d+),\}$", r"\1}", r.pattern.removesuffix("+")), r.fold).parse() for r in rules]
        self.all = Dfa(nodes, anchored=False)
        self.ends = [Dfa([Parser(r.pattern, r.fold).parse()], anchored=True) for r in rules]
        self.starts = [Dfa([reverse(n)], anchored=True) for n in nodes]
        self.checks = [re.compile(r.check) for r in rules]

    @staticmethod
    def _longest(dfa: Dfa, data) -> int:
        """Length of the longest prefix of data that the anchored automaton accepts; -1 without one."""
        row, dead, best = dfa.rows[0], dfa.rows[dfa.dead] if dfa.dead >= 0 else None, -1
        for n, b in enumerate(data, 1):
            row = row[b]
            if row[256]:
                best = n
            elif row is dead:
                break
        return best

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, by start, then rule."""
        row, done, found = self.all.rows[0], [0] * len(self.rules), []
        view = memoryview(data)
        for i, b in enumerate(data):
            row = row[b]
            if row[256]:
                mask, k = row[256], 0
                while mask:
                    if mask & 1 and i >= done[k]:
                        back = self._longest(self.starts[k], view[done[k] : i + 1][::-1])
                        if back >= 0:
                            start = i + 1 - back
                            end = start + self._longest(self.ends[k], view[start:])
                            done[k] = end
                            if self.checks[k].fullmatch(data[start:end].decode("ascii")):
                                found.append((start, k, end))
                    mask, k = mask >> 1, k + 1
        return sorted(found)

    def __call__(self, text: str | None) -> list[tuple[int, int, int]]:
        """(start, rule, end) in code points."""
        data = (text or "").encode("utf-8", "replace")
        found = self.scan(data)
        if len(data) == len(text or ""):
            return found
        if not found:
            return found
        at = np.concatenate([[0], np.cumsum(np.frombuffer(data, np.uint8) & 0xC0 != 0x80)])  # code points before each byte, for all spans
        return [(int(at[a]), k, int(at[b])) for a, k, b in found]


@cache
def scanner() -> Scanner:
    return Scanner()


def secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' doc_id and `found`: array of (kind, base, start, end), code points with exclusive ends, by start and then by the rules' order.

    Null and empty texts have none. Repeated rows stay and ids may be null. Other columns are ignored.
    """

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scan = scanner()
        for part in parts:
            yield pd.Series([[{"kind": scan.rules[k].kind, "base": scan.rules[k].base, "start": a, "end": b} for a, k, b in scan(t)] for t in part])

    find = F.pandas_udf(run, "array<struct<kind: string, base: boolean, start: long, end: long>>")
    return docs.select("doc_id", find(F.col(text)).alias("found"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(table(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, ("assign", "access", "hex")),
        F.sha2(listed(F.filter("found", lambda s: s.base)), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"),
    )
