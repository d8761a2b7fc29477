"""Operator 5: secret scans with multipart credential linking.

Strong spans come from three patterns: values assigned to a secret's name, access key ids and long hex
runs. Weak candidates (short assigned values, account names, endpoints) are only reported if a complementary part
lies in the same scope, SCOPE code points around it: the parts of a document are sorted by place and joined
as intervals, an account name or endpoint with any secret, a short secret with any identifier or endpoint.

Defined results: null text is the empty text, without spans; texts are read whole; spans are offsets in code
points, the end exclusive; repeated rows are scanned each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm.common import sliced, whole_text

SCOPE = 200
#: Order of kinds that start at one place.
KINDS = ("assign", "access", "hex", "weak_secret", "weak_id", "endpoint")
# Fixed patterns, on UTF-8 bytes; the names of secrets in either case of ASCII letters.
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
ACCOUNT = re.compile(rb"""(?i:access_?key_?id|client_?id|user_?name|user|login|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@=-]{3,})""")
ENDPOINT = re.compile(rb"(?i:https?|ftp|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp)://[^\x00-\x20\"'<>]+")
ASSIGN_LEAST, ACCESS_LEAST, WEAK_LEAST = 12, 18, 6
#: One of these is in every match of ASSIGN and of ACCOUNT, in lower case.
_ASSIGN_NAMES, _ACCOUNT_NAMES = (b"pass", b"secret", b"token", b"api"), (b"access", b"client", b"user", b"login", b"account")
_IDENTIFIERS, _SECRETS = {"access", "weak_id", "endpoint"}, {"assign", "hex", "weak_secret"}


def strong_and_weak(data: bytes) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Byte spans (start, end, kind): the strong ones, and weak candidates not yet linked."""
    low = data.lower()
    strong, weak = [], []
    if (b"=" in data or b":" in data) and any(n in low for n in _ASSIGN_NAMES):
        for m in ASSIGN.finditer(data):
            n = len(m[1])
            if n >= ASSIGN_LEAST:
                strong.append((m.start(), m.end(), "assign"))
            elif n >= WEAK_LEAST:
                weak.append((m.start(), m.end(), "weak_secret"))
    if b"AKIA" in data:
        for m in ACCESS.finditer(data):
            (strong if m.end() - m.start() >= ACCESS_LEAST else weak).append((m.start(), m.end(), "access" if m.end() - m.start() >= ACCESS_LEAST else "weak_id"))
    strong += [(m.start(), m.end(), "hex") for m in HEX.finditer(data)]
    if (b"=" in data or b":" in data) and any(n in low for n in _ACCOUNT_NAMES):
        weak += [(m.start(), m.end(), "weak_id") for m in ACCOUNT.finditer(data)]
    if b"://" in data:
        weak += [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(data)]
    return strong, weak


def linked(strong: list[tuple[int, int, str]], weak: list[tuple[int, int, str]], scope: int = SCOPE) -> list[tuple[int, int, str]]:
    """Weak candidates with a complementary part whose span meets theirs, widened by scope, and doesn't overlap theirs.

    Spans of one side are sorted by start with a running maximum of their ends, so each candidate looks at
    the few near it and not at all pairs.
    """
    sides = {}
    for name, kinds in (("id", _IDENTIFIERS), ("secret", _SECRETS)):
        own = sorted(x for x in (*strong, *weak) if x[2] in kinds)
        sides[name] = ([x[0] for x in own], sorted(x[1] for x in own))
    out = []
    for start, end, kind in weak:
        starts, ends = sides["id" if kind == "weak_secret" else "secret"]
        after = bisect_right(starts, end + scope) - bisect_left(starts, end)
        before = bisect_right(ends, start) - bisect_left(ends, start - scope)
        if after > 0 or before > 0:
            out.append((start, end, kind))
    return out


def scan(text: str, scope: int = SCOPE) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(strong, linked) spans of a text in code points."""
    data = text.encode()
    strong, weak = strong_and_weak(data)
    if not strong and not weak:
        return [], []
    if len(data) != len(text):
        at, chars, done = {}, 0, 0
        for p in sorted({p for s in (*strong, *weak) for p in s[:2]}):
            chars += len(data[done:p].decode())
            at[p], done = chars, p
        strong, weak = ([(at[s], at[e], k) for s, e, k in spans] for spans in (strong, weak))
    order = lambda x: (x[0], KINDS.index(x[2]), x[1])
    return sorted(strong, key=order), sorted(linked(strong, weak, scope), key=order)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


SPANS = "doc_id long, strong array<struct<start:int,stop:int,kind:string>>, linked array<struct<start:int,stop:int,kind:string>>"
RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, strong, linked): the spans themselves."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = [scan(t, scope) for t in b.column(1).to_pylist()]
            lists = [[[dict(start=s, stop=e, kind=k) for s, e, k in f[i]] for f in found] for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, span) for x in lists)], ["doc_id", "strong", "linked"])

    return docs.select(docs["doc_id"].cast("long"), whole_text().alias("text")).mapInArrow(run, SPANS)


def report(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row for each document: counts of the strong kinds, the digest of their spans, and all spans (see RESULT)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for strong, weak in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                base, more = ([(x["start"], x["stop"], x["kind"]) for x in spans] for spans in (strong, weak))
                kinds = [k for _, _, k in base]
                rows.append((*map(kinds.count, KINDS[:3]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()] * 2, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return find(docs, scope).mapInArrow(run, RESULT)
