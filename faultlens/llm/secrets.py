"""Secret scans with multipart credential linking.

A scan finds strong secrets by their form alone (assignments, access
identifiers, long hex strings) and weak parts that mean little by themselves:
client identifiers, random-looking tokens and service endpoints. Each part has
a scope, its own interval widened by ``SCOPE`` code points; a sweep over the
sorted intervals joins the parts of a document, and a weak part is reported
only where complementary parts fall into one scope.

All of it happens row by row inside one Arrow pass: no shuffle, and memory is
bounded by a batch of texts and the parts of one text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm import graph  # noqa: F401  ships this package's code with the tasks
from faultlens.llm.words import in_batches

#: Fixed patterns of the strong kinds, in their order of listing.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "identifier", "token", "endpoint"]

#: Weak parts, of any length. A token needs three kinds of characters and some entropy.
IDENTIFIER = re.compile(r"\b(?:client|account|tenant|app|user|access|key)[_-]?(?:id|name)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@._-]{3,}+", re.I | re.A)
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+", re.A)
ENDPOINT = re.compile(r"\b(?:https?|ftp|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp|s3)://[^\s\"'<>|]{3,}+", re.I | re.A)
SCOPE, TOKEN_BITS = 200, 3.5

_ROW = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([
    ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))])


def strong_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of assignments, access identifiers and hex strings."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _random_looking(s: str) -> bool:
    if not (any(map(str.isdigit, s)) and any(map(str.islower, s)) and any(map(str.isupper, s))):
        return False
    return -sum(c / len(s) * log2(c / len(s)) for c in map(s.count, set(s))) >= TOKEN_BITS


def _free(spans: list, taken: list) -> list:
    """Spans that overlap none of ``taken``; both sorted by start."""
    out, k = [], 0
    for s in spans:
        while k < len(taken) and taken[k][2] <= s[0]:
            k += 1
        if k == len(taken) or taken[k][0] >= s[2]:
            out.append(s)
    return out


def _near(part: tuple, starts: list[int], others: list, scope: int) -> bool:
    """Whether one of ``others`` (disjoint, sorted) lies within ``scope`` of ``part``."""
    k = bisect_left(starts, part[0])
    return (k < len(others) and others[k][0] - part[2] <= scope) or (k > 0 and part[0] - others[k - 1][2] <= scope)


def linked_spans(text: str, strong: list[tuple[int, int, int]], scope: int = SCOPE) -> list[tuple[int, int, int]]:
    """Weak parts that are reported: a token with an identifier (weak or access)
    or an endpoint in its scope, and an identifier or an endpoint with a secret
    (a reported token, an assignment or a hex string) in its scope."""
    taken, reach = [], -1  # disjoint union of the strong intervals
    for s, k, e in strong:
        if s < reach:
            reach = max(reach, e)
            taken[-1] = (taken[-1][0], k, reach)
        else:
            taken.append((s, k, e))
            reach = e
    endpoints = [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)] if "://" in text else []
    endpoints = _free(endpoints, taken)
    blocked = sorted(taken + endpoints)
    identifiers = _free([(m.start(), 3, m.end()) for m in IDENTIFIER.finditer(text)], blocked) if ":" in text or "=" in text else []
    tokens = _free([(m.start(), 4, m.end()) for m in TOKEN.finditer(text) if _random_looking(m[0])], sorted(blocked + identifiers))
    if not (endpoints or identifiers or tokens):
        return []
    access = [s for s in strong if s[1] == 1]
    marks = sorted(identifiers + access + endpoints)
    starts = [m[0] for m in marks]
    tokens = [t for t in tokens if _near(t, starts, marks, scope)]
    hidden = sorted(tokens + [s for s in taken if s[1] != 1])
    starts = [h[0] for h in hidden]
    return tokens + [p for p in identifiers + endpoints if _near(p, starts, hidden, scope)]


def _scanned(batches: Iterator[pa.RecordBatch], scope: int) -> Iterator[pa.RecordBatch]:
    def rows(batch):
        for k, doc_id in enumerate(batch.column(0).to_pylist()):
            text = batch.column(1)[k].as_py() or ""
            strong = strong_spans(text)
            yield doc_id, [{"kind": KINDS[x[1]], "start": x[0], "end": x[2]} for x in sorted(strong + linked_spans(text, strong, scope))]

    for batch in batches:
        yield from in_batches(rows(batch), _ROW, 1024)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """``doc_id, spans`` for every row: spans are ``(kind, start, end)`` in code
    points, end exclusive, by start and then kind as in ``KINDS``.

    Strong kinds are always reported; ``identifier``, ``token`` and
    ``endpoint`` only where complementary parts co-occur within ``scope`` code
    points. Null and empty texts have no spans. Ids may be null or repeat;
    every row is scanned by itself, whole. Empty tables give no rows; other
    columns are not looked at.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(lambda it: _scanned(it, scope), "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def redact(text: str, spans: list) -> str:
    """``text`` with every span, or overlapping run of spans, as ``[kind]`` of its first."""
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at:s["start"]], f"[{s['kind']}]"]
        at = max(at, s["end"])
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """``docs`` with every reported span of ``text_col`` replaced by its kind in
    brackets. Null texts stay null; all rows and other columns stay as they are."""
    at, schema = docs.columns.index(text_col), docs.schema

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for value in batch.column(at):
                text = value.as_py()
                if text:
                    strong = strong_spans(text)
                    spans = sorted(strong + linked_spans(text, strong, scope))
                    text = redact(text, [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]) if spans else text
                texts.append(text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(clean, schema)


def span_digest(strong: DataFrame) -> DataFrame:
    """Counts, SHA-256 of the strong spans and all spans as text, from ``scan_secrets``."""
    written = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(KINDS[:3]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return strong.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
                         F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
