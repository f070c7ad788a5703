"""Operator 10: secret scans by patterns and sliding-window entropy.

Fixed patterns give the base spans. The method adds spans of kind ``entropy``: in
every candidate string (a long run of characters that keys are written with) a
window slides for each character class, its Shannon entropy kept up to date from
counts as one character enters and one leaves. Runs of windows at or above the
class's threshold are a span, unless an allow-list pattern suppresses it. Base spans
are cut out of a candidate first, and each part that remains is looked at by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame

#: The base patterns, and the shortest match that counts.
BASE = (
    ("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
KINDS = ("assign", "access", "hex", "entropy")

#: (class, its characters, window, bits at or above which a window is suspect). A
#: window also needs a digit and a letter, which words don't have.
CLASSES = (
    ("base64", "A-Za-z0-9+/_=-", 24, 3.9),
    ("base32", "A-Z2-7", 24, 3.7),
    ("hexadecimal", "0-9A-Fa-f", 24, 3.2),
)
CANDIDATE = r"[A-Za-z0-9+/_=-]{24,}"
#: Candidates that are no secrets: paths and words joined by signs, one repeated part, dates and numbers, UUIDs.
ALLOW = (
    r"(?:[A-Za-z]+|[0-9]{1,8})(?:[+/_=-]+(?:[A-Za-z]+|[0-9]{1,8}))*",
    r"(.{1,8}?)\1{2,}.{0,8}",
    r"[0-9+/_=-]+",
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
)


def window_runs(text: str, size: int, bits: float) -> list[tuple[int, int]]:
    """Unions of the windows of ``size`` characters whose entropy is at least ``bits``."""
    if len(text) < size:
        return []
    cost = [0.0] + [c * log2(c) for c in range(1, size + 1)]
    counts: dict[str, int] = {}
    total, runs, digits, letters = 0.0, [], 0, 0
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += cost[n + 1] - cost[n]
        digits += c.isdigit()
        letters += c.isalpha()
        if i >= size:
            old = text[i - size]
            n = counts[old]
            counts[old] = n - 1
            total += cost[n - 1] - cost[n]
            digits -= old.isdigit()
            letters -= old.isalpha()
        if i >= size - 1 and digits and letters and log2(size) - total / size >= bits - 1e-9:
            start = i - size + 1
            if runs and start <= runs[-1][1]:
                runs[-1] = runs[-1][0], i + 1
            else:
                runs.append((start, i + 1))
    return runs


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of the spans, in order; those that touch are one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


class Scanner:
    def __init__(self, allow: tuple[str, ...] = ALLOW) -> None:
        self.base = [(k, re.compile(p), g, n) for k, p, g, n in BASE]
        self.candidate = re.compile(CANDIDATE)
        self.classes = [(re.compile(f"[{chars}]{{{size},}}"), size, bits) for _, chars, size, bits in CLASSES]
        self.allow = [re.compile(p) for p in allow]

    def spans(self, text: str) -> list[tuple[int, str, int]]:
        """(start, kind, end) in code points, by start and then by kind as listed."""
        out = [(m.start(), k, m.end()) for k, p, g, n in self.base for m in p.finditer(text) if m.end(g) - m.start(g) >= n]
        taken = _joined([(s, e) for s, _, e in out])
        first = 0  # of the base spans, the first that ends behind the start of the candidate
        for m in self.candidate.finditer(text):
            if any(p.fullmatch(m[0]) for p in self.allow):
                continue
            parts, at = [], m.start()  # what base spans leave of the candidate
            while first < len(taken) and taken[first][1] <= m.start():
                first += 1
            i = first
            while i < len(taken) and taken[i][0] < m.end():
                parts.append((at, taken[i][0]))
                at = taken[i][1]
                i += 1
            for left, right in [*parts, (at, m.end())]:
                own = text[left:right]
                if left >= right or any(p.fullmatch(own) for p in self.allow):
                    continue
                found: list[tuple[int, int]] = []
                for chars, size, bits in self.classes:
                    for part in chars.finditer(own):
                        found += [(part.start() + s, part.start() + e) for s, e in window_runs(part[0], size, bits)]
                out += [(left + s, "entropy", left + e) for s, e in _joined(found)]
        return sorted(out, key=lambda x: (x[0], KINDS.index(x[1])))


def _scan(allow: tuple[str, ...]):
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(allow)
        for batch in batches:
            found = [[{"kind": k, "start": s, "end": e} for s, k, e in scanner.spans(t.as_py() or "")] for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(item))], names=[*batch.schema.names[:-1], "spans"])

    return run


def scan(docs: DataFrame, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """``doc_id, spans array<struct<kind, start, end>>`` for every row.

    Positions are code points, ends exclusive; spans are ordered by start and then by
    kind. A null or empty text has no spans; repeated rows are scanned again; a null
    doc_id stays null; other columns are ignored.
    """
    return docs.select("doc_id", "text").mapInArrow(_scan(allow), "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def _redact(allow: tuple[str, ...], mark: str, at: int, schema: pa.Schema | None = None):
    def clean(scanner: Scanner, text: str | None) -> str | None:
        if not text:
            return text
        out, done = [], 0
        for start, _, end in scanner.spans(text):
            if end > done:
                out += [text[done:start], mark] if start >= done else []
                done = end
        return "".join(out) + text[done:] if done else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(allow)
        for batch in batches:
            texts = pa.array([clean(scanner, t.as_py()) for t in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return run


def redact(docs: DataFrame, mark: str = "[SECRET]", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """The same rows with every secret span of ``text`` replaced by ``mark``; overlapping spans by one mark.

    A null or empty text stays as it is; repeated rows are treated alike; all other
    columns, whatever their names, are kept; an empty table stays empty.
    """
    return docs.mapInArrow(_redact(allow, mark, docs.columns.index("text")), docs.schema)
