"""Secret scans: keyword automaton, anchored patterns at its hits, checksums inside tokens.

One Aho-Corasick pass over the lower-cased bytes of each whole text finds keywords; a pattern is only tried at the place of a hit. Runs of
hexadecimal digits have no keyword and are found as runs over the byte buffer. Tokens that carry a checksum (``github``, ``npm``) are
reported only if it holds. Spans are code points, end exclusive.

Matches of one kind are leftmost and never overlap: a match that is too short still uses up its text.

Defined cases: a null or empty text has no spans; texts of any length are scanned whole; repeated rows and ids are scanned one by one; an empty
table gives no rows; further columns are ignored unless named in ``keep``.
"""
from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame

from promptloom.llm.spans import emit, slices

#: The base kinds, their patterns, least lengths and order.
ASSIGN = rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = rb"AKIA[A-Z0-9]+"
KEYWORDS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",),
            "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "npm": ("npm_",)}
KINDS = ("assign", "access", "hex", "github", "npm")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
#: Fixed format of a token with a checksum: prefix, 30 random characters, 6 base-62 digits of their CRC-32.
CHECKED = {"github": rb"gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z])", "npm": rb"npm_[0-9A-Za-z]{36}(?![0-9A-Za-z])"}
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True


def checksum_holds(body: bytes) -> bool:
    """Whether the last six characters are the base-62 CRC-32 of those before."""
    value = 0
    for c in body[-6:].decode():
        value = value * 62 + _DIGITS.index(c)
    return value == zlib.crc32(body[:-6])


def hex_runs(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``LEAST_HEX`` or more hexadecimal digits; runs end with their text."""
    held = np.zeros(len(data) + 2, bool)
    held[1:-1] = _HEX[data]
    starts = held[1:-1] & ~held[:-2]
    ends = held[1:-1] & ~held[2:]
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    starts[inner] = held[1:-1][inner]
    ends[inner - 1] = held[1:-1][inner - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    long = ends - starts >= LEAST_HEX
    return starts[long], ends[long]


def scan(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Counts, digest and all spans of every row."""
    keep = keep or ["doc_id"]

    def run(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for kind, words in KEYWORDS.items():
            for word in words:
                automaton.add_word(word, (kind, len(word)))
        automaton.make_automaton()
        assign = re.compile(ASSIGN, re.IGNORECASE).match
        access = re.compile(ACCESS).match
        checked = {kind: re.compile(pattern).match for kind, pattern in CHECKED.items()}

        def keyword_spans(text: bytes) -> list[tuple[str, int, int]]:
            found, free = [], dict.fromkeys(KEYWORDS, 0)
            # One character for each byte, so places in the decoded text are byte places.
            hits = [(end + 1 - n, kind) for end, (kind, n) in automaton.iter(text.lower().decode("latin-1"))]
            for start, kind in sorted(hits):
                if start < free[kind]:
                    continue
                match = assign(text, start) if kind == "assign" else access(text, start) if kind == "access" else checked[kind](text, start)
                if not match:
                    continue
                free[kind] = match.end()
                if kind == "assign":
                    good = match.end(2) - match.start(2) >= LEAST_ASSIGN
                elif kind == "access":
                    good = match.end() - start >= LEAST_ACCESS
                else:
                    good = checksum_holds(match[0][4:])
                if good:
                    found.append((kind, start, match.end()))
            return found

        for batch, texts in slices(batches):
            starts, ends = hex_runs(texts.data, texts.bounds)
            first = np.searchsorted(starts, texts.bounds)
            counts = {kind: np.zeros(texts.rows, np.int64) for kind in ("assign", "access", "hex")}
            digests, listed = [], []
            for row in range(texts.rows):
                low = texts.bounds[row]
                spans = keyword_spans(texts.bytes_of(row))
                spans += [("hex", int(a - low), int(b - low)) for a, b in zip(starts[first[row]:first[row + 1]], ends[first[row]:first[row + 1]])]
                if spans:
                    spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
                    place = np.concatenate([[0], np.cumsum((texts.data[low:texts.bounds[row + 1]] & 0xC0) != 0x80)])
                    spans = [(kind, place[a], place[b]) for kind, a, b in spans]
                for kind, _, _ in spans:
                    if kind in counts:
                        counts[kind][row] += 1
                base = ",".join(f"{k}:{a}:{b}" for k, a, b in spans if k in counts)
                digests.append(hashlib.sha256(base.encode()).hexdigest())
                listed.append(",".join(f"{k}:{a}:{b}" for k, a, b in spans))
            yield emit(batch, keep, n_assign=counts["assign"], n_access=counts["access"], n_hex=counts["hex"], base_sha256=digests, spans=listed)

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)
