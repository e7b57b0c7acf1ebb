"""Secrets: fixed formats, and encoded keys confirmed by their structure.

Three fixed formats give the base spans.  Beyond them, runs of base64 or hex
are decoded and reported only when what they decode to is a key or token by
its own structure: a signed token with a JSON header that names an algorithm,
a DER key whose nested lengths add up to its size, or a private key container
with its magic bytes and length-prefixed fields.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

# Fixed formats; letters of the first in either case.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex")
MIN_VALUE = 8

# Blocks to search for keys: runs of one alphabet, and those on the lines that follow directly, indented or not.
# A key may begin anywhere in a block, so it does not matter what stands before one.
ENCODED = re.compile(r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_.-]{16,}(?:[\t\x20]*\r?\n[\t\x20]*[A-Za-z0-9+/_.-]+)*")
ESCAPED = re.compile(r"\\+r\\+n|\\+n")  # a line end written as an escape
RUN = re.compile(r"[A-Za-z0-9+/_.-]+")
# Where a key may begin in a block: a DER sequence or the magic bytes, in base64 or hex.
DER_64, DER_HEX = re.compile(r"M(?=[A-P])"), re.compile(r"30(?=[0-9A-Fa-f]{2})")
SSH_64, SSH_HEX = re.compile(r"b3BlbnNzaC1rZXktdjEA"), re.compile(r"(?i)6f70656e7373682d6b65792d763100")
SIGNATURE = re.compile(r"[A-Za-z0-9_-]+")
SIGNATURE_CHARS = {"HS256": (43,), "HS384": (64,), "HS512": (86,), "ES256": (86,), "ES384": (128,), "ES512": (176,),
                   "EdDSA": (86, 152), **{f"{kind}{size}": (342, 512, 683) for kind in ("RS", "PS")
                                          for size in (256, 384, 512)}}
JSON_SPACE = b" \t\r\n"
BRACKETS = re.compile(rb'"\\*|[][{}]')
DASHES = "-----"
PADDING = re.compile("={0,2}")
ADDED = ("jwt", "der_key", "ssh_key")
SSH_MAGIC = b"openssh-key-v1\x00"
ALGORITHM_OIDS = (  # fixed values: RSA, elliptic curve, Ed25519, X25519 in DER
    bytes.fromhex("06092a864886f70d010101"), bytes.fromhex("06072a8648ce3d0201"),
    bytes.fromhex("06032b6570"), bytes.fromhex("06032b656e"))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed formats that hold, per kind in the order listed, then by start."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def _decoded(run: str, is_hex: bool) -> bytes | None:
    """Bytes of a hex or base64 run (either alphabet, not padded); null if it is neither."""
    try:
        if is_hex:
            return bytes.fromhex(run)
        return base64.b64decode(run.replace("-", "+").replace("_", "/") + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _chars(size: int, is_hex: bool) -> int:
    """Characters that ``size`` bytes take, without padding."""
    return 2 * size if is_hex else -(-4 * size // 3)


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tag and content of the DER items that fill ``data`` exactly; null if the lengths do not add up."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, length = data[at], data[at + 1]
        at += 2
        if length >= 0x80:
            size = length & 0x7F
            if not 1 <= size <= 4 or at + size > len(data):
                return None
            length = int.from_bytes(data[at:at + size], "big")
            at += size
        if at + length > len(data):
            return None
        items.append((tag, data[at:at + length]))
        at += length
    return items


def is_der_key(data: bytes) -> bool:
    """PKCS#1, SEC 1 or PKCS#8 private key: nested lengths hold and the members have the right kinds."""
    outer = der_items(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    members = der_items(outer[0][1])
    if not members or members[0][0] != 0x02 or len(members[0][1]) != 1:
        return False
    tags = [tag for tag, _ in members]
    if len(tags) >= 9 and set(tags[:9]) == {0x02}:  # version and eight numbers
        return len(members[1][1]) >= 32
    if len(tags) >= 2 and tags[1] == 0x04:  # version and secret of an elliptic curve
        return members[0][1] == b"\x01" and len(members[1][1]) >= 20
    if len(tags) >= 3 and tags[1] == 0x30 and tags[2] == 0x04:  # version, algorithm, wrapped key
        return members[1][1].startswith(ALGORITHM_OIDS) and len(members[2][1]) >= 32
    return False


def is_ssh_key(data: bytes) -> bool:
    """Private key container: magic bytes, then cipher, method and options with lengths, then a key count."""
    if not data.startswith(SSH_MAGIC):
        return False
    at = len(SSH_MAGIC)
    for _ in range(3):
        length = int.from_bytes(data[at:at + 4], "big")
        at += 4 + length
        if at + 4 > len(data):
            return False
    return 1 <= int.from_bytes(data[at:at + 4], "big") <= 64


def der_size(data: bytes) -> int | None:
    """Size of the DER sequence that ``data`` begins with, by its own length; null if it is none."""
    if len(data) < 2 or data[0] != 0x30:
        return None
    if data[1] < 0x80:
        return 2 + data[1]
    size = data[1] & 0x7F
    return 2 + size + int.from_bytes(data[2:2 + size], "big") if 1 <= size <= 4 and len(data) >= 2 + size else None


def ssh_size(data: bytes) -> int | None:
    """Size of the private key container that ``data`` begins with, by its own lengths; null if they do not fit."""
    at, cipher = len(SSH_MAGIC), b""
    for field in range(3):
        length = int.from_bytes(data[at:at + 4], "big")
        cipher = cipher if field else data[at + 4:at + 4 + length]
        at += 4 + length
    keys = int.from_bytes(data[at:at + 4], "big")
    at += 4
    for _ in range(keys + 1):  # the public keys and the private part
        if at + 4 > len(data):
            return None
        at += 4 + int.from_bytes(data[at:at + 4], "big")
    at += 16 if cipher.endswith(b"@openssh.com") else 0  # tag of an authenticated cipher
    return at if at <= len(data) else None


def _object(part: str) -> dict | None:
    """The JSON object that a base64url part decodes to, if any."""
    try:
        value = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (binascii.Error, ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _last_object(data: bytes) -> int | None:
    """Where the JSON object begins that ends with ``data``, by its brackets alone.

    Read from the end, a quote closes a string that the nearest quote before
    it opens that is not escaped, so one pass finds the bracket that matches
    the last one.
    """
    end = len(data.rstrip(JSON_SPACE)) - 1
    if end < 0 or data[end] != ord("}"):
        return None
    depth, in_string = 0, False
    for match in BRACKETS.finditer(data[end::-1]):
        mark = match[0][:1]
        if mark == b'"':
            if not in_string or (len(match[0]) - 1) % 2 == 0:  # behind it, in this direction, its backslashes
                in_string = not in_string
        elif not in_string:
            depth += 1 if mark in b"}]" else -1
            if depth == 0:
                return end - match.start() if mark == b"{" else None
    return None


class _Block:
    """The characters of a block without its line ends, and where each line begins, in them and in the text."""

    def __init__(self, text: str, start: int, stop: int):
        self.lines, self.places, parts, size = [], [], [], 0
        for run in RUN.finditer(text, start, stop):
            self.lines.append(size)
            self.places.append(run.start())
            parts.append(run[0])
            size += len(run[0])
        self.chars = "".join(parts)

    def place(self, at: int) -> int:
        line = bisect.bisect_right(self.lines, at) - 1
        return self.places[line] + at - self.lines[line]

    def line_end(self, at: int) -> int:
        """First end of a line at ``at`` or later."""
        line = bisect.bisect_left(self.lines, at)
        return self.lines[line] if line < len(self.lines) else len(self.chars)

    def ends(self, at: int) -> bool:
        """Whether no character of the alphabet follows in the line; dashes may close a key block."""
        return self.line_end(at) == at or self.chars[at] == "." or self.chars.startswith(DASHES, at)

    def end(self, at: int) -> int:
        """First place at ``at`` or later where a key can end."""
        stop = self.line_end(at)
        marks = [mark for mark in (self.chars.find(".", at, stop), self.chars.find(DASHES, at, stop)) if mark >= 0]
        return min(marks, default=stop)

    def der_key(self, at: int, is_hex: bool) -> int | None:
        """End of the DER key that begins at ``at``; its own length says where that is."""
        size = der_size(_decoded(self.chars[at:at + _chars(6, is_hex)], is_hex) or b"")
        upto = at + _chars(size or 0, is_hex)
        if not size or upto > len(self.chars) or not self.ends(upto):
            return None
        return upto if is_der_key(_decoded(self.chars[at:upto], is_hex) or b"") else None

    def ssh_key(self, at: int, upto: int, is_hex: bool) -> int | None:
        """End of the key container that begins at ``at``, at the end of a line; ``upto`` where it is cut off."""
        part = re.match(r"[0-9A-Fa-f]+" if is_hex else r"[A-Za-z0-9+/_-]+", self.chars[at:upto])[0]
        dashes = part.find(DASHES)
        part = part if dashes < 0 else part[:dashes]
        data = _decoded(part[:len(part) - (len(part) % 2 if is_hex else len(part) % 4 == 1)], is_hex)
        if not data or not is_ssh_key(data):
            return None
        size = ssh_size(data)
        return at + len(part) if size is None else min(self.end(at + _chars(size, is_hex)), at + len(part))

    def header(self, start: int, dot: int) -> tuple[int, dict] | None:
        """The last place from ``start`` on, and the JSON object with an algorithm that is written from there to ``dot``.

        Every place has one of four alignments; the text is decoded once for
        each, and only one bracket of it can open an object that ends at the
        dot, so the work is linear in the text.
        """
        found = []
        for base in range(start, min(start + 4, dot)):
            data = _decoded(self.chars[base:dot], False)
            opened = _last_object(data) if data else None
            if opened is None:
                continue
            at = self._written_from(data, base, opened, start)
            if at is not None and (value := _object(self.chars[at:dot])) and isinstance(value.get("alg"), str):
                found.append((at, value))
        return max(found, key=lambda place: place[0], default=None)

    def _written_from(self, data: bytes, base: int, opened: int, start: int) -> int | None:
        """The character that the object at byte ``opened`` is written from; white space may lead a line or the block."""
        if opened % 3 == 0:
            return base + opened // 3 * 4
        space = opened - len(data[:opened]) + len(data[:opened].rstrip(JSON_SPACE))
        for byte in range(opened // 3 * 3, space - 1, -3):
            at = base + byte // 3 * 4
            line = bisect.bisect_left(self.lines, at)
            if at == start or (line < len(self.lines) and self.lines[line] == at):
                return at
        return None

    def token(self, dots: list[int], k: int, low: int) -> tuple[int, int] | None:
        """Start and end of the signed token with its first dot at ``dots[k]``, not before ``low``."""
        if _object(self.chars[dots[k] + 1:dots[k + 1]]) is None:
            return None
        place = self.header(max(low, dots[k - 1] + 1 if k else 0), dots[k])
        if place is None:
            return None
        at, header = place
        signature = SIGNATURE.match(self.chars, dots[k + 1] + 1)
        if not signature:
            return None
        for size in SIGNATURE_CHARS.get(header["alg"], ()):  # a signature over several lines
            upto = signature.start() + size
            if upto <= signature.end() and self.line_end(upto) == upto:
                return at, upto
        return at, min(self.line_end(signature.start() + 1), signature.end())

    def keys(self) -> Iterator[tuple[str, int, int]]:
        """Kind, start and end of the keys and tokens, one after the other."""
        found = []
        for pattern, is_hex in ((DER_64, False), (DER_HEX, True)):
            low = 0
            for match in pattern.finditer(self.chars):
                if match.start() >= low and (upto := self.der_key(match.start(), is_hex)):
                    low = upto
                    found.append(("der_key", match.start(), upto))
        for pattern, is_hex in ((SSH_64, False), (SSH_HEX, True)):
            starts = [match.start() for match in pattern.finditer(self.chars)]
            for at, limit in zip(starts, [*starts[1:], len(self.chars)]):
                if upto := self.ssh_key(at, limit, is_hex):
                    found.append(("ssh_key", at, upto))
        dots = [match.start() for match in re.finditer(r"\.", self.chars)]
        low = 0
        for k in range(len(dots) - 1):
            if dots[k] > low and (token := self.token(dots, k, low)):
                low = token[1]
                found.append(("jwt", *token))
        return iter(sorted(found, key=lambda span: span[1:]))


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """Encoded runs that decode to a key or token.

    A key tells its own length, and a token is made of JSON objects, so each
    is cut out of its block exactly, whatever lines come before and after;
    the search goes on behind it.  Lines may be indented, and line ends may be
    written as escapes.
    """
    if "\\" in text:  # as many characters, so that places stay
        text = ESCAPED.sub(lambda match: "\n".rjust(len(match[0])), text)
    found = []
    for match in ENCODED.finditer(text):
        block = _Block(text, *match.span())
        for kind, at, upto in block.keys():
            end = block.place(upto - 1) + 1
            found.append((kind, block.place(at), end + len(PADDING.match(text, end)[0])))
    return found


def _written(spans: list[tuple[str, int, int]]) -> str:
    order = {kind: rank for rank, kind in enumerate(KINDS + ADDED)}
    return ",".join(f"{kind}:{at}:{upto}" for kind, at, upto in sorted(spans, key=lambda s: (s[1], order[s[0]])))


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc, text in zip(batch.doc_id, batch.text, strict=True):
            base = base_spans(text)
            kinds = [kind for kind, _, _ in base]
            rows.append((doc, *[kinds.count(kind) for kind in KINDS],
                         hashlib.sha256(_written(base).encode()).hexdigest(),
                         _written(base + confirmed_spans(text))))
        yield pd.DataFrame(rows, columns=["doc_id", *[f"n_{kind}" for kind in KINDS], "base_sha256", "spans"]
                           ).astype({"doc_id": "Int64"})


def secrets(docs: DataFrame) -> DataFrame:
    """One row per document: counts per fixed format, a digest of its base spans, and all spans.

    Whole texts are searched, in time linear in their length; null counts as
    empty and has no span.  Texts reach Python in batches that Spark bounds by
    bytes.  Spans of different kinds may overlap; those with one start go in the order of the
    kinds.  Rows that repeat an id are searched one by one; an empty table
    gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(_scan, "doc_id long, n_assign long, n_access long, n_hex long, "
                                   "base_sha256 string, spans string")
