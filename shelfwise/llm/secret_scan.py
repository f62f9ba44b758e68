"""Operator 1: secret scans with multipart credential linking.

Two tiers of findings. Base spans are strong by themselves: assignments, access keys, long hex runs.
Weak candidates are worth reporting only together: an identifier (user, client id, account), a secret
of a plain key name or a token-like string, and an endpoint (URL with a host, ``host:port``, bucket).
They are linked by an interval join: each candidate is the interval of its span widened by ``reach``
code points, cut at the borders of its scope (a block of text between blank lines), and two parts of
different roles link if the intervals of the one holds the other's span. A weak candidate is reported
if the linked parts make a credential: a secret with an identifier or an endpoint. An access key or
an assignment counts as the identifier or secret of its neighbourhood, so a weak secret beside an
access key is reported as well. Base spans are always reported, and no weak span that overlaps a base
one: of a candidate that does, the parts that no base span covers.

The join runs on the positions of one text, sorted, by binary search for the nearest part on either
side (before it, the one that ends last): a text with many candidates costs n log n, not all pairs. All roles of a text lie in one row,
so Spark moves nothing between tasks.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .base import texts

# --- fixed values: the patterns of the base spans and the least lengths
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # the runs of AKIA[A-Z0-9]+ of 20 characters and more
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ of 24 characters and more
# --- end of fixed values

# A keyword can only begin at these letters; looking for one of these words first is much faster.
HINT = re.compile(r"passw|secret|token|api_?key", re.ASCII | re.IGNORECASE)

# Values and the blanks around a sign have no longest length: whatever is left out would stay in the redacted text.
IDENTIFIER = re.compile(r"""(?<![A-Za-z0-9_])(?:user(?:name|_id)?|login|account(?:_id)?|client_?id|access_?key(?:_?id)?|tenant(?:_id)?)["']?[\x20\t]*[:=][\x20\t]*["']?([A-Za-z0-9@._-]{3,})""", re.ASCII | re.IGNORECASE)
SECRET = re.compile(r"""(?<![A-Za-z0-9_])(?:pwd|pass|key|auth|bearer|credential|signature|private_?key|access_?secret)["']?(?:[\x20\t]*[:=][\x20\t]*|[\x20\t]+)["']?([A-Za-z0-9+/_=.~-]{8,})""", re.ASCII | re.IGNORECASE)
DIGIT = re.compile("[0-9]")
KEYWORD = 16  # characters that a keyword of SECRET and its sign have at most
ENDPOINT = re.compile(r"""(?:https?|ftp|s3|jdbc:[a-z]{2,12}|postgres(?:ql)?|mysql|mongodb|redis|amqp)://([^\s"'<>]{4,})|(?<![A-Za-z0-9_])(?:host|endpoint|server|bucket|region)["']?[\x20\t]*[:=][\x20\t]*["']?([A-Za-z0-9.:_-]{3,})""", re.ASCII | re.IGNORECASE)
# Each needs one of these: texts without are not searched with the long patterns.
WEAK_HINT = re.compile(r"://|[:=]|bearer|auth", re.ASCII | re.IGNORECASE)
BLANK_LINE = re.compile(r"\n[ \t\r]*\n")

KINDS = ("assign", "access", "hex", "link_identifier", "link_secret", "link_endpoint")
REACH = 240


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base spans, each kind leftmost and non-overlapping."""
    out = [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    if HINT.search(text):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    return sorted(out)


def secrets(text: str) -> list[tuple[int, int, int]]:
    """(start, start of the value, end) of the weak secrets: values with a digit.

    Without one, nothing within the value has one; only a keyword at its end may go on behind it.
    """
    out, at = [], 0
    while m := SECRET.search(text, at):
        if DIGIT.search(text, m.start(1), m.end()):
            out.append((m.start(), m.start(1), m.end()))
            at = m.end()
        else:
            at = max(m.start() + 1, m.end() - KEYWORD)
    return out


def weak_candidates(text: str) -> list[tuple[int, int, int, int]]:
    """(start, start of the value, end, kind) of identifiers, endpoints and weak secrets."""
    found = [(m.start(), m.start(m.lastindex), m.end(), k) for k, pattern in ((3, IDENTIFIER), (5, ENDPOINT)) for m in pattern.finditer(text)]
    return found + [(*x, 4) for x in secrets(text)]


def uncovered(weak: list[tuple[int, int, int, int]], base: list[tuple[int, int, int]]) -> dict[tuple[int, int, int], list[tuple[int, int]]]:
    """What base spans leave of each candidate, for its value alone: (start, end, kind) -> pieces."""
    starts, ends = [s for s, _, _ in base], []
    most = 0
    for _, e, _ in base:  # the furthest end so far: base spans of different kinds may overlap
        ends.append(most := max(most, e))
    left = {}
    for s, value, e, k in weak:
        pieces, at = [], s
        for i in range(bisect_right(ends, s), bisect_left(starts, e)):
            if value < starts[i]:
                pieces.append((at, starts[i]))
            at = value = max(at, ends[i])
        left[s, e, k] = [*pieces, (at, e)] if value < e else pieces
    return left


def role_parts(left: dict, base: list[tuple[int, int, int]]) -> dict[int, list[tuple[int, int]]]:
    """The parts of each role by their start: weak pieces, and base spans as identifiers or secrets."""
    return {r: sorted([*(x for (_, _, k), v in left.items() if k == r for x in v), *((s, e) for s, e, k in base if r == (3 if k == 1 else 4))]) for r in (3, 4, 5)}


class Meeting:
    """Which spans have a part of a role within reach, with no border between.

    Of the parts that begin before a span, the one that ends last is the nearest,
    whatever lies between: base spans may lie within others. Of those behind, it
    is the one that begins first.
    """

    def __init__(self, parts: dict[int, list[tuple[int, int]]], borders: list[int], reach: int):
        self.parts, self.borders, self.reach = parts, borders, reach
        self.starts = {r: [s for s, _ in v] for r, v in parts.items()}
        self.furthest = {r: list(accumulate((e for _, e in v), max)) for r, v in parts.items()}

    def close(self, s: int, e: int, s2: int, e2: int) -> bool:
        lo, hi = min(e, e2), max(s, s2)
        return hi - lo <= self.reach and bisect_left(self.borders, lo) == bisect_left(self.borders, max(hi, lo))

    def met(self, s: int, e: int, role: int) -> bool:
        at = bisect_left(self.starts[role], s)
        if at and self.close(s, e, self.starts[role][at - 1], self.furthest[role][at - 1]):
            return True
        while at < len(self.parts[role]) and self.parts[role][at] == (s, e):  # itself, as another kind
            at += 1
        return at < len(self.parts[role]) and self.close(s, e, *self.parts[role][at])


NEEDS = {3: (4,), 4: (3, 5), 5: (4,)}


def linked_spans(text: str, base: list[tuple[int, int, int]], reach: int = REACH) -> list[tuple[int, int, int]]:
    """The weak candidates whose complement lies in reach and in the same scope."""
    if not WEAK_HINT.search(text):
        return []
    weak = weak_candidates(text)
    if not weak:
        return []
    left = uncovered(weak, base)
    meeting = Meeting(role_parts(left, base), [m.start() for m in BLANK_LINE.finditer(text)], reach)
    return [(s, e, k) for (*whole, k), v in left.items() if any(meeting.met(*whole, r) for r in NEEDS[k]) for s, e in v]


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def scan_secrets(df: DataFrame, reach: int = REACH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, spans array<struct<kind, start, end>>, base array<...>``: a row for each input row.

    Places count code points, ends are exclusive. A null or empty text has no spans; null ids and
    repeated rows come back as they are; other columns are not read; an empty table gives an empty
    one. Spans of different kinds that begin at one place stand in the order of ``KINDS``.
    """
    return _mapped(df, doc_id, text, reach, lambda base, every: {
        "spans": [[{"kind": KINDS[k], "start": s, "end": e} for s, e, k in x] for x in every],
        "base": [[{"kind": KINDS[k], "start": s, "end": e} for s, e, k in x] for x in base]},
        "spans array<struct<kind:string,start:int,end:int>>, base array<struct<kind:string,start:int,end:int>>")


def secret_digests(df: DataFrame, reach: int = REACH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and digests of the spans of ``scan_secrets``; the same cases."""
    count = lambda base, kind: [sum(k == kind for _, _, k in x) for x in base]
    return _mapped(df, doc_id, text, reach, lambda base, every: {
        "n_assign": count(base, 0), "n_access": count(base, 1), "n_hex": count(base, 2),
        "base_sha256": [hashlib.sha256(joined(x).encode()).hexdigest() for x in base], "spans": [joined(x) for x in every]},
        "n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_secrets(df: DataFrame, reach: int = REACH, mark: str = "[secret]", text: str = "text") -> DataFrame:
    """The rows of ``df``, all columns as they are but ``text``: each run of overlapping spans gives way to ``mark``.

    A null text stays null, other rows without spans stay as they are; an empty table gives an empty one.
    """
    from .base import ship_package

    ship_package(df.sparkSession)
    at = df.columns.index(text)

    def run(batches):
        for b in batches:
            out = []
            for t in b.column(at).to_pylist():
                if t:
                    base = base_spans(t)
                    spans = sorted([*base, *linked_spans(t, base, reach)])
                    if spans:
                        t = redacted(t, spans, mark)
                out.append(t)
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(out, b.schema.field(at).type), *b.columns[at + 1:]], schema=b.schema)

    return df.mapInArrow(run, df.schema)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    kept, at = [], 0
    for s, e, _ in spans:
        if s >= at:
            kept += [text[at:s], mark]
        at = max(at, e)
    return "".join([*kept, text[at:]])


def _mapped(df, doc_id, text, reach, columns, ddl) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = to_arrow_schema(StructType.fromDDL("doc_id long, " + ddl))

    def run(batches):
        for b in batches:
            base, every = [], []
            for t in b.column("text").to_pylist():
                found = base_spans(t)
                base.append(found)
                every.append(sorted([*found, *linked_spans(t, found, reach)]))
            made = columns(base, every)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(made[f.name], f.type) for f in list(fields)[1:])], schema=fields)

    return texts(df, doc_id, text).mapInArrow(run, "doc_id long, " + ddl)
