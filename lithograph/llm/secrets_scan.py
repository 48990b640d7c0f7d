"""Operator 3, secret scans with structural confirmation.

Three base patterns find assignments, access keys and hexadecimal runs.  The method goes on to candidates in
base64 and hexadecimal and reports those whose decoded bytes have the structure of a key: a PEM block, a DER
encoding whose nested lengths add up, an OpenSSH key, or a signed token whose header names an algorithm.
Line breaks within a key may be real or escaped, as in JSON and .env files, and a key may begin within a run of the alphabet.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lithograph.llm.common import small_batches, table

#: The contract's patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "pem", "der", "openssh", "token")
LEAST = {"assign": 8, "access": 16}

_ASSIGN_WORDS = ("pass", "secret", "token", "api")
_BREAK = re.compile(r"(?:(?:\\+[rn]|\r?\n)[\x20\t]*)+")
_ENCODED = re.compile(rf"[A-Za-z0-9+/_-]{{16,}}(?:{_BREAK.pattern}[A-Za-z0-9+/_-]+)*={{0,2}}")
# how the first bytes of a sequence (0x30), of an OpenSSH name's length and of OpenSSH's magic are written
_START = re.compile(r"(?=M[A-P]|AAAA|b3BlbnNzaC)")
_HEX_ANY = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){16,}(?![0-9A-Fa-f])")
_PEM_MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
_PEM_BODY = re.compile(r"(?:[A-Za-z0-9+/=\s:,-]++|\\++[rnt/])*+")
_PEM_LINE = re.compile(r"\\+[rn]|[\r\n]+")
_SIGNED = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")


def _unbase64(s: str) -> bytes | None:
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_fits(raw: bytes) -> bool:
    """Whether raw is one DER value whose lengths nest exactly; sequences and sets are entered, however deep they lie."""
    if _der_end(raw, 0, len(raw)) != len(raw):
        return False
    todo = [(0, len(raw))]
    while todo:
        at, stop = todo.pop()
        if raw[at] in (0x30, 0x31):
            i = _der_body(raw, at)
            while i < stop:
                j = _der_end(raw, i, stop)
                if j is None:
                    return False
                if raw[i] in (0x30, 0x31):
                    todo.append((i, j))
                i = j
    return True


def _der_body(raw: bytes, at: int = 0) -> int:
    return at + 2 + (raw[at + 1] & 0x7F if raw[at + 1] & 0x80 else 0)


def _der_end(raw: bytes, at: int, stop: int) -> int | None:
    if stop - at < 2:
        return None
    n = raw[at + 1]
    body = at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or body + k > stop:
            return None
        n = int.from_bytes(raw[body : body + k], "big")
        body += k
    return body + n if body + n <= stop else None


def _der_size(head: bytes) -> int | None:
    """How long the value is that begins with head, its own head included."""
    if len(head) < 6:
        return None
    n, k = head[1], head[1] & 0x7F
    if n < 0x80:
        return 2 + n
    return 2 + k + int.from_bytes(head[2 : 2 + k], "big") if 1 <= k <= 4 else None


_SSH = (b"ssh-", b"ecdsa-", b"sk-")
_JSON = json.JSONDecoder()


def key_kind(raw: bytes | None) -> str | None:
    """der or openssh where raw is a whole key encoding, else None."""
    if not raw or len(raw) < 16:
        return None
    if raw.startswith(b"openssh-key-v1\0"):
        return "openssh"
    n = int.from_bytes(raw[:4], "big")
    if 7 <= n <= 40 and raw[4 : 4 + n].startswith(_SSH):
        i, fields = 0, 0  # length-prefixed fields to the end
        while i + 4 <= len(raw):
            i += 4 + int.from_bytes(raw[i : i + 4], "big")
            fields += 1
        return "openssh" if i == len(raw) and fields >= 2 else None
    # a key is a sequence that begins with a version or with another sequence
    if raw[0] == 0x30 and der_fits(raw) and raw[_der_body(raw)] in (0x02, 0x30):
        return "der"
    return None


_JSON_MARKS = re.compile(r'(\\*)"|[{}\[\]]')


def _last_object(chars: str) -> int | None:
    """Where the object begins that the last } closes; one pass back from the end, which lies outside of all strings.

    In JSON backslashes stand in strings only, so a quote bounds a string if an even number of them precedes it.
    """
    depth, inside = 0, False
    for m in reversed(list(_JSON_MARKS.finditer(chars))):
        c = chars[m.end() - 1]
        if c == '"':
            inside ^= len(m[1]) % 2 == 0
        elif not inside:
            depth += 1 if c in "}]" else -1
            if depth == 0:
                return m.start() if c == "{" else None
    return None


def signed_header(s: str) -> int | None:
    """Where in s the JSON header of a signed token begins that goes on to the end of s, however long it is."""
    for shift in range(min(4, len(s))):
        raw = _unbase64(s[shift:])
        if raw is None or not raw.rstrip().endswith(b"}"):
            continue
        chars = raw.decode("latin-1")
        at = _last_object(chars)
        if at is not None and at % 3 == 0:
            try:
                head, end = _JSON.raw_decode(chars, at)
                if not chars[end:].strip() and isinstance(head.get("alg"), str):
                    return shift + at // 3 * 4
            except (ValueError, RecursionError):
                pass
    return None


def _length_at(clean: str, i: int, k: int) -> int | None:
    """The four bytes at byte k of what is encoded from i on, as a number; None past the end."""
    at = i + k // 3 * 4
    raw = _unbase64(clean[at : at + 8][: (len(clean[at : at + 8]) // 4) * 4 or 0]) or b""
    raw = raw[k % 3 : k % 3 + 4]
    return int.from_bytes(raw, "big") if len(raw) == 4 else None


class _Values:
    """Heads of DER values in encoded text, read where they stand; each row of values is walked once, and later rows that run into it share it."""

    def __init__(self, clean: str):
        self.clean = clean
        self.rows: list[tuple[dict[int, int], tuple[int, int] | None]] = []  # a row's places with their numbers, and the row and place where it goes on
        self.row: dict[tuple[int, int], int] = {}

    def size(self, shift: int, at: int) -> int | None:
        """How long the value at byte `at` is, counted in fours of characters from `shift` on."""
        a = shift + at // 3 * 4
        part = self.clean[a : a + 12]
        head = (_unbase64(part[: len(part) // 4 * 4]) or b"")[at % 3 :][:6]
        return _der_size(head + bytes(6 - len(head))) if len(head) >= 2 else None

    def lead_to(self, shift: int, at: int, stop: int) -> bool:
        """Whether the values that follow one another from `at` on end exactly at `stop`."""
        new: dict[int, int] = {}
        link = None
        while True:
            if (shift, at) in self.row:
                link = (self.row[shift, at], at)
                break
            new[at] = len(new)
            size = self.size(shift, at)
            if size is None:
                break
            at += size
        if new:
            self.row.update(dict.fromkeys(((shift, i) for i in new), len(self.rows)))
            self.rows.append((new, link))
            link = (len(self.rows) - 1, next(iter(new)))
        while link is not None:
            number, since = link
            places, link = self.rows[number]
            if places.get(stop, -1) >= places[since]:
                return True
        return False


def _openssh_end(clean: str, i: int) -> int | None:
    """Where the OpenSSH key ends that begins at i, by its own lengths; None where they don't fit."""
    k = 15
    for _ in range(3):
        size = _length_at(clean, i, k)
        if size is None:
            return None
        k += 4 + size
    keys = _length_at(clean, i, k)
    if keys is None or not 1 <= keys <= 64:
        return None
    k += 4
    for _ in range(keys + 1):
        size = _length_at(clean, i, k)
        if size is None:
            return None
        k += 4 + size
    j = i + (4 * k + 2) // 3
    return j if j <= len(clean) else None


def _encoded_keys(run: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of the keys within a run of the alphabet that may have line breaks, each as decoding finds it.

    A key begins anywhere in the run, and ends at the end of a line or of the run or before one of + / - _.
    """
    if not _START.search(run):
        return
    done = 0
    bare = run.rstrip("=")
    breaks = [m.span() for m in _BREAK.finditer(bare)] if "\n" in bare or "\\" in bare else []
    clean, place, ends, at = "", [], set(), 0
    if breaks:
        parts = []
        for a, b in [*breaks, (len(bare), len(bare))]:
            parts.append(bare[at:a])
            place += range(at, a)
            ends.add(len(place))
            at = b
        clean = "".join(parts)
    else:
        clean, place, ends = bare, range(len(bare)), {len(bare)}
    values = _Values(clean)
    stop = lambda i: i in ends or clean[i : i + 1] in tuple("+/-_")
    for m in _START.finditer(clean):
        i = m.start()
        if i < done:
            continue
        head = _unbase64(clean[i : i + 64][: len(clean[i : i + 64]) // 4 * 4]) or b""
        found = None
        if head[:1] == b"0":
            size = _der_size(head)
            j = i + (4 * size + 2) // 3 if size else 0
            if size and j <= len(clean) and stop(j):
                first = 2 + (head[1] & 0x7F if head[1] & 0x80 else 0)
                byte = i // 4 * 3
                # only what ends where its values end is decoded as a whole
                if head[first : first + 1] in (b"\x02", b"\x30") and values.lead_to(i % 4, byte + first, byte + size) and key_kind(_unbase64(clean[i:j])) == "der":
                    found = (j, "der")
        elif head.startswith(b"openssh-key-v1\0"):
            found = (_openssh_end(clean, i) or len(clean), "openssh")
        elif 7 <= int.from_bytes(head[:4], "big") <= 40 and head[4:].startswith(_SSH):
            k, fields = 0, 0
            while (size := _length_at(clean, i, k)) is not None and (j := i + (4 * (k + 4 + size) + 2) // 3) <= len(clean):
                k += 4 + size
                fields += 1
                if fields >= 2 and stop(j):
                    found = (j, "openssh")
        if found:
            done = found[0]
            last = place[done - 1] + 1
            yield place[i], len(run) if last == len(bare) else last, found[1]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the three base patterns, leftmost first within each kind."""
    out = []
    low = text.lower() if text.isascii() else None
    if low is None or any(w in low for w in _ASSIGN_WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def _pem_blocks(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, name, body) of each BEGIN mark that the next mark ends; one pass over the text."""
    begun = None
    for m in _PEM_MARK.finditer(text):
        if begun and m[1] == "END" and m[2] == begun[2] and _PEM_BODY.fullmatch(text, begun.end(), m.start()):
            yield begun.start(), m.end(), m[2], text[begun.end() : m.start()]
        begun = m if m[1] == "BEGIN" else None


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of candidates whose decoded structure confirms a key or signed token."""
    out = []
    if "-----BEGIN" in text:
        for a, b, name, inside in _pem_blocks(text):
            lines = _PEM_LINE.split(re.sub(r"\\+/", "/", re.sub(r"\\+t", " ", inside)).strip())
            body = "".join(x.strip() for x in lines if ":" not in x and "," not in x)
            raw = _unbase64(body)
            if raw and ("ENCRYPTED" in name or any(":" in x for x in lines) or key_kind(raw)):
                out.append((a, b, "pem"))
    for m in _SIGNED.finditer(text):
        if (at := signed_header(m[1])) is not None:
            out.append((m.start() + at, m.end(), "token"))
    for m in _ENCODED.finditer(text):
        out += [(m.start() + a, m.start() + b, kind) for a, b, kind in _encoded_keys(m[0])]
    for m in _HEX_ANY.finditer(text):
        if m[0][:2] == "30" or m[0].lower().startswith(("6f70656e737368", "000000")):
            if kind := key_kind(bytes.fromhex(m[0])):
                out.append((m.start(), m.end(), kind))
    inside = [(a, b) for a, b, k in out if k == "pem"]
    return [x for x in out if x[2] == "pem" or not any(a <= x[0] and x[1] <= b for a, b in inside)]


def spans(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans), each by start, then kind as listed; code points, end exclusive."""
    if not text:
        return [], []
    key = lambda x: (x[0], KINDS.index(x[2]), x[1])
    base = sorted(base_spans(text), key=key)
    return base, sorted({*base, *confirmed_spans(text)}, key=key)


def _joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Find the secrets of every whole text: one row per row of docs, with the spans as (kind, start, end).

    Returns key, n_assign, n_access, n_hex, base_sha256 and spans_text, and spans (array of structs).  A null or
    empty text has no spans; repeated rows give a row each; other columns are not looked at.
    """
    kind = docs.schema[key].dataType.simpleString()
    shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "t"):
            found = [spans(t) for t in batch.column("t").to_pylist()]
            count = lambda k: pa.array([sum(s[2] == k for s in base) for base, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("k"),
                    count("assign"),
                    count("access"),
                    count("hex"),
                    pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found], pa.string()),
                    pa.array([_joined(every) for _, every in found], pa.string()),
                    pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in every] for _, every in found], shape),
                ],
                names=["k", "n_assign", "n_access", "n_hex", "base_sha256", "spans_text", "spans"],
            )

    return (
        docs.select(docs[key].alias("k"), docs[text].alias("t"))
        .mapInArrow(run, f"k {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans_text string, spans array<struct<kind:string,start:int,end:int>>")
        .withColumnRenamed("k", key)
    )


def masked(text: str | None, mask: str = "[{}]") -> str | None:
    """The text with each secret, or run of overlapping secrets, put out of sight."""
    if not text:
        return text
    found = spans(text)[1]
    out, at = [], 0
    i = 0
    while i < len(found):
        a, b, k = found[i]
        i += 1
        while i < len(found) and found[i][0] < b:
            b = max(b, found[i][1])
            i += 1
        out += [text[at:a], mask.format(k)]
        at = b
    return "".join([*out, text[at:]])


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("spans").withColumnRenamed("spans_text", "spans")


QUERIES = {"op3_secrets": op3_secrets}
ORACLES: dict[str, str] = {}
