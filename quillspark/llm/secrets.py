r"""Secret scans with multipart credential linking.

Strong patterns find secrets that need no company. Weak ones find parts that mean
little alone: access identifiers (``user=...``), values that look random, endpoints
(URLs, hosts with ports). Weak parts are reported only where they complete a
credential: a secret part linked to an identifier or an endpoint within the same
scope. Scopes are the paragraphs of a text; the link is an interval join of the parts'
positions, each widened by ``REACH``. Both sides are sorted by start, so nearest partners
come from binary search and a document with k parts costs k log k.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import lean, slices

#: Kinds every scan reports, in the order of ties; then what linking adds.
BASE = ("assign", "access", "hex")
ADDED = ("identifier", "value", "endpoint")
KINDS = BASE + ADDED
ROLE = {"assign": "secret", "hex": "secret", "value": "secret", "access": "identifier", "identifier": "identifier", "endpoint": "endpoint"}

# What the kinds look like.
ASSIGN = re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
IDENTIFIER = re.compile(r"(?<!(?ai:secret))(?<!(?ai:secret)[_-])((?ai:access_?key_?id|access_?key|client_?id|account|username|user|login))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.@=-]{3,})")
#: Names of the secret side that ASSIGN does not know; they make a value of what does not look random, too.
NAMED = re.compile(r"(?ai:secret[_-]?access[_-]?key|secret[_-]?key|access[_-]?secret|account_?key|private_?key|shared_?key|auth_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]{8,})")
VALUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
ENDPOINT = re.compile(r"(?:https?|jdbc|postgres|mysql|mongodb|redis|amqp|s3)[:+a-z]{0,20}://[^\s\"'<>]+|(?ai:endpoint|host)\x20*[:=]\x20*[A-Za-z0-9.-]+(?::[0-9]{2,5})?")
SCOPE_BREAK = re.compile(r"\n[ \t\r]*\n")
#: How far apart, in code points, parts of one credential may stand.
REACH = 200


@dataclass(frozen=True, order=True)
class Part:
    start: int
    rank: int
    end: int
    #: Start of the first linked partner; -1 for a part that stands alone.
    partner: int = -1

    @property
    def kind(self) -> str:
        return KINDS[self.rank]


def strong_parts(text: str) -> list[Part]:
    found = [Part(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8] if "=" in text or ":" in text else []
    if "AKIA" in text:
        found += [Part(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return found + [Part(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def _random_looking(value: str) -> bool:
    """Letters in both cases and digits, or two of these in 32 characters or more."""
    classes = sum((any("a" <= c <= "z" for c in value), any("A" <= c <= "Z" for c in value), any("0" <= c <= "9" for c in value)))
    return len(set(value)) >= 10 and (classes == 3 or classes == 2 and len(value) >= 32)


def weak_parts(text: str, taken: list[Part]) -> list[Part]:
    """Weak candidates that overlap none of ``taken``. A name with a random-looking value is a value, unless it says id."""
    found = []
    if "=" in text or ":" in text:
        for m in IDENTIFIER.finditer(text):
            secret = not m[1].lower().endswith("id") and len(m[2]) >= 20 and _random_looking(m[2])
            found.append(Part(m.start(), 4 if secret else 3, m.end()))
        found += [Part(m.start(), 4, m.end()) for m in NAMED.finditer(text)]
    found += [Part(m.start(), 4, m.end()) for m in VALUE.finditer(text) if _random_looking(m[0])]
    found += [Part(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    taken = sorted(taken)
    starts, out, reach = [p.start for p in taken], [], []
    for p in taken:
        reach.append(max(p.end, reach[-1] if reach else 0))
    for p in sorted(found):
        i = bisect_left(starts, p.end)
        if (not i or reach[i - 1] <= p.start) and (not out or out[-1].end <= p.start):
            out.append(p)
    return out


def link(text: str, parts: list[Part]) -> list[Part]:
    """``parts`` with each one's nearest complementary partner, where there is one.

    A secret part pairs with an identifier or an endpoint of its scope at most REACH away.
    """
    breaks = [m.start() for m in SCOPE_BREAK.finditer(text)]
    scope = lambda p: bisect_right(breaks, p.start)
    sides = {True: sorted(p for p in parts if ROLE[p.kind] == "secret"), False: sorted(p for p in parts if ROLE[p.kind] != "secret")}
    starts = {k: [p.start for p in v] for k, v in sides.items()}
    latest: dict[bool, list[int]] = {}  # of the parts up to each, the one that ends last
    for k, v in sides.items():
        latest[k] = []
        for i, p in enumerate(v):
            latest[k].append(i if not i or p.end >= v[latest[k][-1]].end else latest[k][-1])
    out = []
    for p in sorted(parts):
        other = ROLE[p.kind] != "secret"
        i = bisect_left(starts[other], p.start)
        near = [sides[other][latest[other][i - 1]]] if i else []
        near += sides[other][i : i + 1]
        near = [q for q in near if scope(q) == scope(p) and max(p.start, q.start) - min(p.end, q.end) <= REACH]
        nearest = min(near, key=lambda q: (max(p.start, q.start) - min(p.end, q.end), q), default=None)
        out.append(Part(p.start, p.rank, p.end, nearest.start if nearest else -1))
    return out


def scan_text(text: str | None) -> list[Part]:
    """Strong parts, and weak ones that have a partner, by start."""
    if not text:
        return []
    strong = strong_parts(text)
    weak = weak_parts(text, strong)
    if not strong and len(weak) < 2:
        return []
    return [p for p in link(text, strong + weak) if p.rank < len(BASE) or p.partner >= 0]


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("partner", pa.int64())])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and ``secrets`` (array of start, end, kind, partner; by start, then kind) for each row of ``docs``.

    ``docs``: doc_id and text; other columns are not read. Positions are code points, end
    exclusive; ``partner`` is the start of the linked part, -1 if none. Spans that begin together go in
    the order of KINDS, and of partners equally near the first is taken. Texts of any length are scanned
    whole, one at a time. A null or empty text has none; repeated rows are scanned each; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [[{"start": p.start, "end": p.end, "kind": p.kind, "partner": p.partner} for p in scan_text(t)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, pa.list_(_SPAN))], ["doc_id", "secrets"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, secrets array<struct<start:bigint,end:bigint,kind:string,partner:bigint>>")


def redact_text(text: str | None) -> str | None:
    """``text`` with every reported span replaced by ``[kind]``; of overlapping spans the first is named."""
    spans = scan_text(text)
    if not spans:
        return text
    out, at = [], 0
    for p in spans:
        if p.start >= at:
            out += [text[at : p.start], f"[{p.kind}]"]
        at = max(at, p.end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` (text, n_chars and any others) with secrets redacted and n_chars of the new text.

    Null texts stay null (n_chars too), rows that repeat are redacted alike, texts of any length whole;
    all other columns stay, whatever their names; an empty table stays empty.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.set_column(at, b.schema.field(at), pa.array([redact_text(t) for t in b.column(at).to_pylist()], b.schema.field(at).type))

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # mapInArrow takes names without dots only
    clean = plain.mapInArrow(lean(run), plain.schema)
    if "n_chars" in docs.columns:
        n = f"c{docs.columns.index('n_chars')}"
        clean = clean.withColumn(n, F.length(f"c{at}").cast(plain.schema[n].dataType))
    return clean.toDF(*docs.columns)
