"""Secret scans: base patterns, and weak parts of credentials that are linked where complementary parts co-occur.

Three base kinds are found in every text. The method adds parts: access identifiers
(user names, key ids), weak secrets (values too plain to report alone) and endpoints
(URLs, hosts). A scope is a stretch of characters around a part; an interval join
links parts whose scopes meet, and a weak part is reported only when a part of a
complementary kind lies within its scope.

Defined results: a null or empty text has no spans. Equal rows give equal results.
An empty table gives an empty result. Columns besides the id and the text are not
read, so their names cannot clash. Spans are in code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import column

# The base patterns and the least length of what they keep.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run of 24 or more is what [0-9a-f]+ matches
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "ident", "weak", "endpoint")

# Keys of parts that count only together. A part is a key, a sign and a value, so only the signs are looked at.
SIGN = re.compile(r"[:=]")
KEYS = re.compile(
    r"""\b(?:(user(?:name)?|login|account|client_?id|access_?(?:key_?)?id)|(pass|pwd|pw|auth|credential|signing_?key|private_?key|bearer)|(host|server|endpoint)|(https?|ftp|ssh|postgres(?:ql)?|mysql|mongodb|redis|amqp))["']?\x20{0,4}\Z""",
    re.IGNORECASE | re.ASCII,
)
LEAD = re.compile(r"""\x20{0,4}["']?""")
#: By kind (6: what follows a URL's //) the signs of a value, and its least length; it goes on as far as they do.
VALUES = {3: (re.compile(r"[A-Za-z0-9@._-]*"), 3), 4: (re.compile(r"""[^\s"',;]*"""), 4), 5: (re.compile(r"[A-Za-z0-9.-]*"), 3), 6: (re.compile(r"""[^\s"'<>]*"""), 3)}
KEY_WIDTH = 24

#: Kinds that complement each other.
LINKS = {"ident": {"assign", "weak", "hex", "access"}, "weak": {"ident", "access", "endpoint"}, "endpoint": {"assign", "weak", "hex", "access", "ident"}}
SCOPE = 240


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base kinds: leftmost non-overlapping of each kind, failing matches dropped."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found.sort()
    return found


def _parts(text: str) -> list[tuple[int, int, int]]:
    found = []
    ends = dict.fromkeys(VALUES, 0)  # of the last run of a kind's signs: what starts within it ends with it, and isn't read again
    for sign in SIGN.finditer(text):
        at = sign.start()
        key = KEYS.search(text, max(0, at - KEY_WIDTH), at)
        if key:
            kind = 2 + key.lastindex
            if kind == 6 and not text.startswith("//", at + 1):
                continue
            start = at + 3 if kind == 6 else LEAD.match(text, at + 1).end()
            signs, least = VALUES[kind]
            if start >= ends[kind]:
                ends[kind] = signs.match(text, start).end()
            if ends[kind] - start >= least:
                found.append((key.start(), min(kind, 5), ends[kind]))
    return found


def linked_spans(text: str, base: list[tuple[int, int, int]], scope: int = SCOPE) -> list[tuple[int, int, int]]:
    """Weak parts with a complementary part in scope: a sweep over the sorted intervals.

    A pair is linked when the gap between its spans is at most the scope. Each part
    only has to know its nearest complementary part before and after it, so the sweep
    keeps one last end for each kind and is linear in the number of parts.
    """
    weak = _parts(text)
    if not weak:
        return []
    parts = sorted(weak + base)
    kept = set()
    reach: dict[int, int] = {}
    for at, kind, end in parts:
        name = KINDS[kind]
        if kind >= 3 and any(at - last <= scope and KINDS[k] in LINKS[name] for k, last in reach.items()):
            kept.add((at, kind, end))
        reach[kind] = max(reach.get(kind, -scope - 1), end)
    head: dict[int, int] = {}
    for at, kind, end in reversed(parts):
        name = KINDS[kind]
        if kind >= 3 and any(first - end <= scope and KINDS[k] in LINKS[name] for k, first in head.items()):
            kept.add((at, kind, end))
        head[kind] = at  # parts come by falling start, so the last is the nearest
    return sorted(kept)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    empty = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        ids, counts, digests, every, linked = column(batch, "_id"), ([], [], []), [], [], []
        for value in column(batch, "_text"):
            text = value.as_py() or ""
            base = base_spans(text)
            more = linked_spans(text, base)
            for k in range(3):
                counts[k].append(sum(s[1] == k for s in base))
            digests.append(hashlib.sha256(_joined(base).encode()).hexdigest() if base else empty)
            every.append(_joined(sorted(base + more)))
            linked.append(len(more))
        yield pa.RecordBatch.from_arrays(
            [ids, *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(every, pa.string()), pa.array(linked, pa.int64())],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"],
        )


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: doc_id, counts of the base kinds, the digest of the base spans, all spans, and how many were linked.

    No shuffle: each text is read where it lies, whole, and only its spans leave.
    """
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long"
    return df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).mapInArrow(_scan, schema)


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for value in column(batch, "_text"):
            text = value.as_py()
            if text:
                base = base_spans(text)
                more = linked_spans(text, base)
                pieces, at = [], 0
                for first, kind, last in sorted(base + more):
                    if last <= at:
                        continue
                    pieces.append(text[at : max(first, at)])
                    if first >= at:
                        pieces.append(f"<{KINDS[kind].upper()}>")
                    at = last
                text = "".join(pieces) + text[at:]
            out.append(text)
        names = [n for n in batch.schema.names if n != "_text"]
        yield pa.RecordBatch.from_arrays([*(column(batch, n) for n in names), pa.array(out, pa.string())], names=[*names, "_text"])


def mask_secrets(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with every span that scan_secrets finds replaced by its kind in angle brackets; null texts stay null."""
    names = df.columns
    others = [n for n in names if n != text_col]
    at = {n: f"_c{i}" for i, n in enumerate(others)}
    inner = df.select(*(F.col(f"`{n}`").alias(at[n]) for n in others), F.col(f"`{text_col}`").alias("_text"))
    out = inner.mapInArrow(_mask, inner.schema)
    return out.select(*(F.col("_text" if n == text_col else at[n]).alias(n) for n in names))
