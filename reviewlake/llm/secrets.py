"""Secret scan: all rules in one minimal automaton, one pass over the bytes.

A rule is a head, a class of body bytes, repeated,, and minimum
lengths. All rules together are compiled by subset construction and minimised
(:mod:`dfa`); a pass over the bytes of a batch marks where each rule accepts.
Accepting positions are rare. From each run of them a reversed automaton walks
back to the leftmost start, not crossing the previous match of that rule, so
matches are leftmost, longest and non-overlapping per rule, as a greedy regex
finds them. Rules must keep that shape: the body class and the end of the head
do not overlap in a way that gives two readings of one match.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.functions import pandas_udf

from reviewlake.llm.common import bounded_batches, chunks
from reviewlake.llm.dfa import Dfa, compile_rules, parse, reverse, scan


@dataclass(frozen=True)
class Rule:
    kind: str
    head: str
    body: str
    min_total: int = 0
    min_body: int = 0
    #: Body bytes the automaton itself asks for: over 1 only without a head, where
    #: leaving short runs out changes no other match.
    least: int = 1

    @property
    def pattern(self) -> str:
        return f"{self.head}{self.body}{{{self.least},}}"


def either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


# The three base rules of the scan's contract.
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
BASE = (
    Rule("assign", "(" + "|".join(map(either_case, KEYWORDS)) + """)["']?\\x20*[:=]\\x20*["']?""", "[A-Za-z0-9+/_.=\\-]", min_body=6),
    Rule("access", "AKIA", "[A-Z0-9]", min_total=20),
    Rule("hex", "", "[0-9a-f]", least=24),
)
# Public token formats.
FURTHER = (
    Rule("forge", "gh[pousr]_", "[A-Za-z0-9]", min_total=40),
    Rule("maps", "AIza", "[A-Za-z0-9_\\-]", min_total=39),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY----", "[\\-]"),
)
RULES = BASE + FURTHER
#: Bytes scanned at a time; a longer text is scanned alone.
CHUNK = 1 << 20


@lru_cache(maxsize=4)
def automata(rules: tuple[Rule, ...]) -> tuple[Dfa, list[Dfa], list[Dfa]]:
    """The combined search automaton, and per rule the reversed rule and its head."""
    whole = [parse(r.pattern) for r in rules]
    return (
        compile_rules(whole, search=True),
        [compile_rules([reverse(t)], search=False) for t in whole],
        [compile_rules([parse(r.head)], search=False) for r in rules],
    )


def accept_runs(accepting: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end (exclusive) of each run of true values."""
    edge = np.diff(np.r_[False, accepting, False].astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def scan_texts(texts: list[bytes], rules: tuple[Rule, ...]) -> list[list[tuple[int, int, int]]]:
    """Matches of each text as (start, rule number, end) in bytes, before the length filter.

    Texts are joined with a byte that no UTF-8 text has and no rule contains.
    """
    search, backward, _ = automata(rules)
    joined = b"\xff".join(texts) + b"\xff"
    states = scan(search, np.frombuffer(joined, dtype=np.uint8))
    accept = search.accept.astype(np.uint8)[states]
    bounds = np.cumsum([len(t) + 1 for t in texts])
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not accept.any():
        return found
    for k in range(len(rules)):
        done, last_doc = 0, -1
        for end in accept_runs((accept >> k & 1).astype(bool))[1]:
            doc = int(np.searchsorted(bounds, end - 1, side="right"))
            base = int(bounds[doc - 1]) if doc else 0
            if doc != last_doc:
                done, last_doc = base, doc
            length = backward[k].longest(joined, range(end - 1, done - 1, -1))
            if length > 0:
                found[doc].append((int(end) - length - base, k, int(end) - base))
                done = int(end)
    for spans in found:
        spans.sort()
    return found


def code_points(text: bytes, offsets: list[int]) -> list[int]:
    """Byte offsets as code point offsets."""
    if text.isascii():
        return offsets
    lead = (np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80
    before = np.r_[0, np.cumsum(lead)]
    return [int(before[o]) for o in offsets]


def kept_spans(text: bytes, spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> list[tuple[str, int, int]]:
    """Matches that are long enough, by start and then rule order, in code points."""
    heads = automata(rules)[2]
    out = []
    for start, k, end in spans:
        rule = rules[k]
        if end - start < rule.min_total:
            continue
        if rule.min_body and end - start - heads[k].longest(text, range(start, end)) < rule.min_body:
            continue
        out.append((rule.kind, start, end))
    points = code_points(text, [x for _, a, b in out for x in (a, b)])
    return [(kind, points[2 * i], points[2 * i + 1]) for i, (kind, _, _) in enumerate(out)]


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: its id and ``spans``, a list of (kind, start, end).

    Offsets are code points, the end exclusive. A null text is an empty text and
    has no spans; empty tables give no rows; repeated rows are scanned each; other
    columns of the table are not read. Texts are scanned whole.
    """
    bounded_batches(df.sparkSession)

    @pandas_udf("array<struct<kind:string,start:bigint,end:bigint>>")
    def spans(texts: pd.Series) -> pd.Series:
        data = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        found: list[list[dict]] = []
        for a, b in chunks(data, CHUNK):
            for text, raw in zip(data[a:b], scan_texts(data[a:b], rules)):
                found.append([{"kind": k, "start": s, "end": e} for k, s, e in kept_spans(text, raw, rules)])
        return pd.Series(found, index=texts.index, dtype=object)

    return df.select(df[id_col].alias(id_col), spans(df[text_col].cast("string")).alias("spans"))
