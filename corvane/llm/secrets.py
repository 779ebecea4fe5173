"""Secret scans with multipart credential linking.

Strong parts are found on their own: ``assign`` (a value assigned to a name that says it is secret),
``access`` (an access-key identifier) and ``hex`` (a long hexadecimal string). Weak parts mean nothing
alone: ``ident`` (user names, client and account ids), ``opaque`` (a mixed string of 20 characters or more with no
name, or with one that says nothing), ``endpoint`` (URL, host:port, or resource name) and ``keyed`` (a value assigned
to a name such as secret_access_key, which the strong names don't cover). An interval join within each text links
parts: a part's interval is its span widened by ``reach`` code points, cut at the scope it lies in
(scopes end at blank lines), and two parts are linked when one's interval meets the other's span.
Parts that are linked together form a credential; a weak part is reported only in a credential whose
parts are complementary: an identifier or endpoint with a secret, or an opaque string with an
identifier *and* its place. Long texts cost time in proportion: parts are swept in order of start.

A null text counts as empty and gives a row without spans. Repeated rows give repeated results. Extra
columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import map_batches, prepare

KINDS = ("assign", "access", "hex", "ident", "opaque", "endpoint", "keyed")
ORDER = {k: i for i, k in enumerate(KINDS)}
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a maximal run, as of [0-9a-f]+, with its least length
IDENT = re.compile(r"""(?:user(?:name)?|login|client_?id|account_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.I | re.A)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])[A-Za-z0-9+/]{20,}={0,2}(?![A-Za-z0-9+/=_-])")
KEYED = re.compile(r"""(?:(?:secret|private|auth|account|storage|shared|encryption|signing|master)_?(?:access_?)?key|(?<![A-Za-z0-9])access_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{8,})""", re.I | re.A)
ENDPOINT = re.compile(r"(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?)://[^\s\"'<>|]+|arn:aws[A-Za-z-]*:[^\s\"'<>]+|[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.amazonaws\.com", re.A)
_BLANK = re.compile(r"\n[ \t\r]*\n")
_SCHEMES = ("://", "arn:aws", "amazonaws")
_NAMES = ("user", "login", "client", "account", "access")

Span = tuple[int, int, str]


def strong_spans(text: str) -> list[Span]:
    """The spans of the three strong kinds, each leftmost and non-overlapping within its kind."""
    out: list[Span] = []
    low = text.lower()
    if "api" in low or "secret" in low or "token" in low or "passw" in low:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def weak_spans(text: str, strong: list[Span]) -> list[Span]:
    out: list[Span] = []
    low = text.lower()
    if any(x in low for x in _NAMES):
        out += [(m.start(), m.end(), "ident") for m in IDENT.finditer(text)]
    if any(x in text for x in _SCHEMES):
        out += [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text)]
    if "key" in low:
        out += [(m.start(), m.end(), "keyed") for m in KEYED.finditer(text)]
    # a value that another kind has already is no further part, but for the plain form of 40 characters
    taken = sorted((a, b) for a, b, _ in out + strong)
    starts, ends = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    for m in OPAQUE.finditer(text):
        a, b = m.span()
        at = bisect_left(starts, b)
        plain = b - a == 40 and not m[0].endswith("=") and text[a - 1 : a] != "="
        if plain or not at or ends[at - 1] <= a:
            out.append((a, b, "opaque"))
    return out


def link(text: str, parts: list[Span], reach: int) -> list[list[Span]]:
    """Credentials: groups of parts that intervals within one scope connect, in order of start."""
    ends = [m.start() for m in _BLANK.finditer(text)]
    groups: list[list[Span]] = []
    limit, scope = -1, -1
    for part in sorted(parts, key=lambda s: (s[0], ORDER[s[2]], s[1])):
        at = bisect_left(ends, part[0])
        if groups and at == scope and part[0] <= limit:
            groups[-1].append(part)
            limit = max(limit, part[1] + reach)
        else:
            groups.append([part])
            limit, scope = part[1] + reach, at
    return groups


def complementary(kinds: set[str]) -> bool:
    """Whether the parts together could open something: a secret with whom or where it is for."""
    if kinds & {"assign", "hex", "keyed"}:
        return bool(kinds & {"access", "ident", "endpoint"})
    return "opaque" in kinds and ("access" in kinds or {"ident", "endpoint"} <= kinds)


def scan(text: str, reach: int = 200) -> tuple[list[Span], list[Span], list[list[Span]]]:
    """Strong spans, all spans reported, and the credentials (linked, complementary groups)."""
    strong = strong_spans(text)
    by = lambda s: (s[0], ORDER[s[2]], s[1])
    strong.sort(key=by)
    weak = weak_spans(text, strong)
    if not weak and len(strong) < 2:
        return strong, strong, []
    found = [g for g in link(text, strong + weak, reach) if len(g) > 1 and complementary({k for _, _, k in g})]
    extra = [s for g in found for s in g if ORDER[s[2]] > 2]
    return strong, sorted(strong + extra, key=by), found


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", reach: int = 200) -> DataFrame:
    """One row for each row of ``docs``: key, n_assign, n_access, n_hex (long), ``base`` and ``spans``
    array<struct<kind, start, end>> (code points, end exclusive), base_written and spans_written (kind:start:end,
    comma-joined) and ``credentials`` array<array<struct>>: the linked groups."""
    prepare(docs.sparkSession)
    src = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    kind = src.schema["k"].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [scan(t, reach) for t in batch.column("t").to_pylist()]
        rows = lambda spans: [{"kind": k, "start": a, "end": b} for a, b, k in spans]
        counts = [pa.array([sum(s[2] == k for s in f[0]) for f in found], pa.int64()) for k in KINDS[:3]]
        return pa.RecordBatch.from_arrays(
            [batch.column("k"), *counts, pa.array([rows(f[0]) for f in found], pa.list_(span)), pa.array([rows(f[1]) for f in found], pa.list_(span)), pa.array([[rows(g) for g in f[2]] for f in found], pa.list_(pa.list_(span))), pa.array([written(f[0]) for f in found]), pa.array([written(f[1]) for f in found])],
            ["k", "n_assign", "n_access", "n_hex", "base", "spans", "credentials", "base_written", "spans_written"],
        )

    s = "array<struct<kind:string,start:bigint,end:bigint>>"
    return map_batches(src, run, f"k {kind}, n_assign long, n_access long, n_hex long, base {s}, spans {s}, credentials array<{s}>, base_written string, spans_written string").withColumnRenamed("k", key)


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
