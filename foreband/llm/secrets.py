"""Secret scans (operator 2): an Aho-Corasick keyword prefilter, anchored patterns at its hits only, checksums last.

Kinds, in the order that ties at one start take:
assign (password, passwd, secret, token, api_key or apikey assigned a value of 6+ characters), access (AKIA and capitals, 20+),
hex (24+ digits), github and npm (prefix, 30 characters, 6 of base-62 CRC-32 of those 30), jwt (header and claims must decode as
JSON, with an algorithm named), pem (a private key block whose body is base64). Hexadecimal runs have no keyword; one pattern finds them.
Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import itertools
import json
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreband.llm.common import prepare

KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
MASK = "[SECRET]"

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
# Runs are possessive: none is read twice from one start.
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]++)\.(eyJ[A-Za-z0-9_-]++)\.[A-Za-z0-9_-]++")
JWT_RUN = re.compile(r"[A-Za-z0-9_-]++")
PEM_HEAD = re.compile(r"-----BEGIN ((?:[A-Z]++ )*?PRIVATE KEY)-----")
PEM_BODY = re.compile(r"[A-Za-z0-9+/=\s]*+")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "api_key": "assign", "apikey": "assign", "AKIA": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm", "eyJ": "jwt", "-----BEGIN ": "pem",
}


def base62_crc(body: str) -> str:
    """Six base-62 digits of the CRC-32 of a token's random part."""
    n, out = binascii.crc32(body.encode()), ""
    while n:
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out.rjust(6, "0")


def _decoded(part: str) -> dict | None:
    try:
        out = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, RecursionError):
        return None
    return out if isinstance(out, dict) else None


@lru_cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        cases = itertools.product(*[(c.lower(), c.upper()) if kind == "assign" and c.isalpha() else (c,) for c in word])
        for case in cases:
            found.add_word("".join(case), (kind, len(word)))
    found.make_automaton()
    return found


def _pem(text: str, start: int) -> tuple[int, bool] | None:
    """A private key block: head, white space, base64 up to the next dashes, and the matching end."""
    head = PEM_HEAD.match(text, start)
    if not head:
        return None
    body = PEM_BODY.match(text, head.end())
    end = f"-----END {head[1]}-----"
    if not body[0][:1].isspace() or not text.startswith(end, body.end()):
        return body.end(), False  # no later block can begin within what was read
    size = len("".join(body[0].split()))
    return body.end() + len(end), size >= 64 and size % 4 == 0


def _at(kind: str, text: str, start: int) -> tuple[int, bool] | None:
    """End of what the kind's pattern has read, anchored at a hit, and whether it is a secret. A failed token or key block also says
    how far it was read, as no other can begin there; so a text is read a bounded number of times."""
    if kind == "pem":
        return _pem(text, start)
    pattern = {"assign": ASSIGN, "access": ACCESS, "jwt": JWT}.get(kind, CHECKED)
    m = pattern.match(text, start)
    if not m:
        return (JWT_RUN.match(text, start).end(), False) if kind == "jwt" else None
    if kind == "assign":
        good = len(m[2]) >= ASSIGN_LEAST
    elif kind == "access":
        good = m.end() - start >= ACCESS_LEAST
    elif kind == "jwt":
        good = "alg" in (_decoded(m[1]) or {}) and _decoded(m[2]) is not None
    else:
        good = base62_crc(m[1][:30]) == m[1][30:]
    return m.end(), good


def spans(text: str | None) -> list[tuple[int, int, str]]:
    """All (start, end, kind), by start and then kind; matches of one kind never overlap."""
    if not text:
        return []
    out, ends = [], dict.fromkeys(KINDS, 0)
    hits = sorted({(end + 1 - size, kind) for end, (kind, size) in _automaton().iter(text)})
    for start, kind in hits:
        if start >= ends[kind] and (found := _at(kind, text, start)):
            ends[kind] = found[0]
            if found[1]:
                out.append((start, found[0], kind))
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def masked(text: str | None) -> str | None:
    """The text with every secret replaced; of an assignment only the value goes."""
    if not text or not (found := spans(text)):
        return text
    parts, at = [], 0
    for start, end, kind in found:
        if kind == "assign":
            start = ASSIGN.match(text, start).start(2)
        if start >= at:
            parts += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def _scan(batches):
    for b in batches:
        rows = [spans(t) for t in b.column("text").to_pylist()]
        told = [[f"{k}:{s}:{e}" for s, e, k in r] for r in rows]
        base = [",".join(x for x, (_, _, k) in zip(t, r, strict=True) if k in KINDS[:3]) for t, r in zip(told, rows, strict=True)]
        counts = [pa.array([sum(k == kind for _, _, k in r) for r in rows], pa.int64()) for kind in KINDS]
        digests = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base])
        names = ["id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"]
        yield pa.RecordBatch.from_arrays([b.column("id"), *counts, digests, pa.array([",".join(t) for t in told], pa.string())], names)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, n_<kind> for each kind, base_sha256 of the spans of the first three kinds, spans.

    A null text counts as empty. Rows are independent: repeated rows give repeated rows, null ids stay.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(_scan, f"id long, {counts}, base_sha256 string, spans string").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every secret in text_col masked; all rows and columns stay."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            column = pa.array([masked(t) for t in b.column(at).to_pylist()], b.schema.field(at).type)
            yield b.set_column(at, b.schema.field(at), column)

    return docs.mapInArrow(run, docs.schema)
