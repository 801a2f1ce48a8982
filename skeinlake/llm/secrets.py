"""Secret scanning with structural confirmation.

Three base patterns give candidate spans that are always reported. The method then decodes base64 and hex candidates
and parses what comes out: DER key encodings with nested lengths, the OpenSSH key container, SSH public-key
length-prefixed fields, and signed tokens whose header is JSON with an algorithm. Only what parses adds a span, of
kinds ``pem``, ``der``, ``ssh`` and ``jwt``. Line breaks inside a key may be real or escaped, as in a JSON string; lines
of one width without armour, the last one shorter or not, are one candidate; hex may mix cases. A key may stand anywhere
in a longer run of base64 characters, as behind a path: its own lengths say where it ends.

``ssh`` spans are public keys: they are listed, but not redacted, as they aren't secret. Public keys in DER aren't
reported. The content of a PKCS#8 key's octets depends on the algorithm and isn't parsed; encrypted PEM bodies are
confirmed by their header lines and whole cipher blocks. A token whose JSON nests deeper than the parser goes is not
confirmed.

Defined edge results: null and empty texts have no spans and the digest of the empty string; overlapping spans of
different kinds are all kept; a text of any length is scanned whole; null ids keep their rows; repeated rows are
reported each; equal spans of one kind are one; an empty table gives no rows; extra columns are not read by the scan and
are kept by the redaction, whatever their names.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, map_rows

#: The patterns of the base kinds, in their listed order.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "pem", "der", "ssh", "jwt")

#: An escaped line break or slash, as JSON writes them; backslashes may be doubled by nesting.
_ESCAPE = r"\\++(?:[nr/]|u000[aAdD])"
#: An escaped line end; runs of backslashes that are looked at again and again are bounded.
_LINE_END = r"\\{1,16}(?:[nr]|u000[aAdD])"
#: Header lines such as Proc-Type and DEK-Info may come before the body. A header's value ends at its line end, real or
#: escaped, and what is matched once is not tried another way, so a text is walked once whatever it holds.
PEM = re.compile(
    rf"-----BEGIN ([A-Z0-9 ]{{0,40}}PRIVATE KEY)-----((?:(?:\s|{_ESCAPE})*+[A-Za-z][A-Za-z0-9-]{{1,31}}+: (?:(?!{_LINE_END})[ -~]){{1,200}}+(?:\r|\n|{_LINE_END}))*+)((?:[A-Za-z0-9+/=\s]|{_ESCAPE}){{16,}}+)-----END \1-----"
)
SSH = re.compile(r"(?a:\b)(ssh-rsa|ssh-ed25519|ssh-dss|ecdsa-sha2-nistp\d{3}) +(AAAA[A-Za-z0-9+/]{16,}={0,2})")
#: A candidate starts where a run starts, or behind an escaped line break, so a text is walked once.
JWT = re.compile(r"(?:(?<![A-Za-z0-9_-])|(?<=\\[nrt])|(?<=\\u000[aAdD]))eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
BLOB = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
HEXBLOB = re.compile(r"(?:[0-9a-f]{2}){32,}|(?:[0-9A-F]{2}){32,}")
#: Whole runs of hex digits of any case.
HEXRUN = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}")
_BREAK = r"(?:[ \t]*(?:\r\n|\n|\r)[ \t]*|(?:\\+(?:[nr]|u000[aAdD]))+)"
LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
#: Lines of base64 or hex characters; a block starts where a run does, or behind an escaped line break.
WRAPPED = re.compile(rf"(?:(?<![A-Za-z0-9+/_\\-])|(?<=\\[nrt]))[A-Za-z0-9+/_-]{{16,}}+(?:{_BREAK}[A-Za-z0-9+/_-]++)+={{0,2}}")
BREAK = re.compile(_BREAK)
MAGIC = b"openssh-key-v1\x00"


def unbase64(text: str) -> bytes | None:
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """The items (tag, content) that fill ``data`` exactly, or None if a length doesn't fit."""
    at, out = 0, []
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            width = n & 0x7F
            if not 1 <= width <= 4 or at + width > len(data):
                return None
            n = int.from_bytes(data[at : at + width], "big")
            at += width
        if at + n > len(data):
            return None
        out.append((tag, data[at : at + n]))
        at += n
    return out


def is_der_key(data: bytes) -> bool:
    """A DER SEQUENCE laid out as a PKCS#1, PKCS#8, SEC1 or subject-public-key structure, lengths nested exactly."""
    top = der_items(data)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    body = der_items(top[0][1])
    if not body or len(body) < 2:
        return False
    tags = [t for t, _ in body]
    if tags[0] == 0x30:  # AlgorithmIdentifier, BIT STRING
        algorithm = der_items(body[0][1])
        return tags[:2] == [0x30, 0x03] and len(body) == 2 and bool(algorithm) and algorithm[0][0] == 0x06
    if tags[0] != 0x02:
        return False
    if len(body) >= 9 and all(t == 0x02 for t in tags[:9]):  # PKCS#1
        return len(body[1][1]) >= 32
    if len(body) >= 3 and tags[1:3] == [0x30, 0x04]:  # PKCS#8
        algorithm = der_items(body[1][1])
        return bool(algorithm) and algorithm[0][0] == 0x06
    return tags[1] == 0x04 and body[0][1] == b"\x01" and len(body[1][1]) in (20, 24, 28, 32, 48, 66)  # SEC1


def ssh_fields(data: bytes) -> list[bytes] | None:
    """Length-prefixed fields that fill ``data`` exactly."""
    at, out = 0, []
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data) or n > 1 << 20:
            return None
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def is_openssh(data: bytes) -> bool:
    """The OpenSSH container: magic, cipher, kdf, kdf options, and key count that parse by their lengths."""
    if not data.startswith(MAGIC):
        return False
    at = len(MAGIC)
    for _ in range(3):
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return False
        at += 4 + n
    return 1 <= int.from_bytes(data[at : at + 4], "big") <= 16


def is_key(data: bytes | None) -> bool:
    """A private key: any DER key encoding but the public one, or an OpenSSH container."""
    return bool(data) and (is_der_key(data) and der_items(data)[0][1][:1] == b"\x02" or is_openssh(data))


class Run:
    """Bytes of a run of base64 characters read from one of its places on, decoded only where they are looked at."""

    def __init__(self, text: str, start: int):
        self.text, self.start, self.room = text, start, (len(text) - start) * 3 // 4

    def read(self, at: int, n: int) -> bytes | None:
        """``n`` bytes from byte ``at``, or None if the run is shorter."""
        if at + n > self.room:
            return None
        first = at // 3
        piece = self.text[self.start + 4 * first : self.start + 4 * -(-(at + n) // 3)]
        return unbase64(piece)[at - 3 * first :][:n]

    def head(self, at: int) -> tuple[int, int, int] | None:
        """(tag, first byte of the content, byte behind the content) of the DER item at byte ``at``."""
        got = self.read(at, 2)
        if got is None:
            return None
        tag, n = got
        at += 2
        if n & 0x80:
            width = n & 0x7F
            more = self.read(at, width) if 1 <= width <= 4 else None
            if more is None:
                return None
            at, n = at + width, int.from_bytes(more, "big")
        return (tag, at, at + n) if at + n <= self.room else None

    def der_end(self) -> int | None:
        """Bytes of the private key that starts here, if the heads of its items fit into each other."""
        top = self.head(0)
        if top is None or top[0] != 0x30 or self.read(top[1], 2) != b"\x02\x01":
            return None
        at, count = top[1], 0
        while at < top[2]:
            item = self.head(at)
            if item is None or item[2] > top[2]:
                return None
            at, count = item[2], count + 1
            if count > 16:
                return None
        return top[2] if count > 1 else None

    def openssh_end(self) -> int | None:
        """Bytes of the OpenSSH container that starts here, by the lengths of its fields."""
        at = len(MAGIC)
        if self.read(0, at) != MAGIC:
            return None
        for k in range(4):
            size = self.read(at, 4)
            if size is None:
                return None
            n = int.from_bytes(size, "big")
            if k == 3:
                count, at = n, at + 4
                break
            at += 4 + n
        if not 1 <= count <= 16:
            return None
        for _ in range(count + 1):
            size = self.read(at, 4)
            if size is None:
                return None
            at += 4 + int.from_bytes(size, "big")
        return at if at <= self.room else None


#: Where the encoding of a DER sequence (byte 0x30) or of the OpenSSH magic can start.
KEY_START = re.compile(r"M[A-P]|b3BlbnNzaC1rZXktdjEA")


def keys_inside(run: str) -> list[tuple[int, int]]:
    """Places (start, end) of private keys inside a run of base64 characters, left to right without overlap.

    Heads are walked before anything longer is decoded, so a run with many places to start costs little for each.
    """
    out, at = [], 0
    while m := KEY_START.search(run, at):
        here = Run(run, m.start())
        n = here.der_end() if m[0][0] == "M" else here.openssh_end()
        if n is not None and is_key(here.read(0, n)):
            at = m.start() + 4 * (n // 3) + (0, 2, 3)[n % 3]
            tail = run[at : at + 2]
            at += min(len(tail) - len(tail.lstrip("=")), -n % 3)
            out.append((m.start(), at))
        else:
            at = m.start() + 1
    return out


def inner_kind(data: bytes | None) -> str | None:
    """What a decoded candidate holds: a key, or a text form of a key or signed token that was encoded once more."""
    if is_key(data):
        return "der"
    if data and data.startswith((b"-----BEGIN ", b"eyJ")):
        text = data.decode("latin-1")
        if (m := PEM.match(text)) and is_pem(m[1], m[3], m[2]):
            return "pem"
        if (m := JWT.match(text)) and is_jwt(m[0]):
            return "jwt"
    return None


def is_pem(label: str, body: str, head: str = "") -> bool:
    data = unbase64(re.sub(rf"\s+|{_ESCAPE}", lambda m: "/" if m[0].endswith("/") else "", body))
    if data is None:
        return False
    if "ENCRYPTED" in head and "DEK-Info" in head:
        return len(data) >= 16 and len(data) % 8 == 0
    if label == "ENCRYPTED PRIVATE KEY":
        top = der_items(data)
        inner = der_items(top[0][1]) if top and len(top) == 1 and top[0][0] == 0x30 else None
        return bool(inner) and [t for t, _ in inner] == [0x30, 0x04]
    return is_key(data)


def is_ssh(kind: str, body: str) -> bool:
    fields = ssh_fields(unbase64(body) or b"\0")
    return bool(fields) and len(fields) >= 2 and fields[0] == kind.encode()


def is_jwt(token: str) -> bool:
    head, body, _ = token.split(".", 2)
    try:
        header = json.loads(unbase64(head) or b"")
        payload = unbase64(body)
        if not isinstance(header, dict) or not isinstance(header.get("alg"), str):
            return False
        return "enc" in header or isinstance(json.loads(payload or b""), dict)
    except (ValueError, UnicodeDecodeError, RecursionError):
        return False


def decoded_kind(blob: str) -> str | None:
    """The kind of what a run holds, read as base64, or as hex where it is hex."""
    if kind := inner_kind(unbase64(blob)):
        return kind
    return inner_kind(binascii.unhexlify(blob)) if len(blob) % 2 == 0 and HEXRUN.fullmatch(blob) else None


def der_length(line: str) -> int | None:
    """Bytes of the DER sequence whose encoding starts with this line, by its outer length."""
    data = unbase64(line[:12]) if len(line) >= 12 else None
    if not data or data[0] != 0x30:
        return None
    if data[1] < 0x80:
        return 2 + data[1]
    width = data[1] & 0x7F
    return 2 + width + int.from_bytes(data[2 : 2 + width], "big") if 1 <= width <= 4 else None


def wrapped_spans(text: str) -> list[tuple[int, int, str]]:
    """Keys and tokens in lines of one width that parse once the lines are joined."""
    out = []
    for m in WRAPPED.finditer(text):
        lines, at = [], m.start()
        while line := LINE.match(text, at, m.end()):
            lines.append((line.start(), line.end(), line[0]))
            gap = BREAK.match(text, line.end(), m.end())
            at = gap.end() if gap else m.end()
        k = 0
        while k < len(lines):
            width = len(lines[k][2])
            same = k + 1
            while same < len(lines) and len(lines[same][2]) == width:
                same += 1
            ends = [same + 1, same] if same < len(lines) and len(lines[same][2]) < width else [same]
            if (n := der_length(lines[k][2])) is not None:  # keys of full lines may follow each other
                ends.append(k - (-4 * ((n + 2) // 3) // width))
            found = False
            for e in dict.fromkeys(ends):
                if k + 1 < e <= ends[0] and (kind := decoded_kind("".join(x for _, _, x in lines[k:e]))):
                    out.append((lines[k][0], lines[e - 1][1], kind))
                    k, found = e, True
                    break
            # A line that opens a DER sequence may stand behind lines of its own width.
            k = k if found else next((j for j in range(k + 1, same) if lines[j][2][0] == "M" and der_length(lines[j][2]) is not None), same)
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of the base patterns, by start, then kind as listed."""
    out = []
    small = text.lower()
    if "passw" in small or "secret" in small or "token" in small or "api" in small:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    out.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return out


class Cover:
    """Whether a place lies in one of the spans."""

    def __init__(self, spans: list[tuple[int, int, str]]):
        self.starts, self.ends, end = [], [], 0
        for a, b, _ in sorted(spans):
            end = max(end, b)
            self.starts.append(a)
            self.ends.append(end)

    def has(self, at: int) -> bool:
        k = bisect_right(self.starts, at)
        return k > 0 and at < self.ends[k - 1]


def added_spans(text: str) -> list[tuple[int, int, str]]:
    """What the structural confirmation adds; every reported span has parsed."""
    out = []
    if "-----BEGIN " in text:
        out += [(m.start(), m.end(), "pem") for m in PEM.finditer(text) if is_pem(m[1], m[3], m[2])]
    if "AAAA" in text:
        out += [(m.start(), m.end(), "ssh") for m in SSH.finditer(text) if is_ssh(m[1], m[2])]
    if "eyJ" in text:
        out += [(m.start(), m.end(), "jwt") for m in JWT.finditer(text) if is_jwt(m[0])]
    if "\n" in text or "\r" in text or "\\" in text:
        inside = Cover(out)
        out += [x for x in wrapped_spans(text) if not inside.has(x[0])]
    inside = Cover(out)
    for m in BLOB.finditer(text):
        if inside.has(m.start()):
            continue
        if kind := inner_kind(unbase64(m[0])):
            out.append((m.start(), m.end(), kind))
        elif m[0][0] in "nrt" and m.start() and text[m.start() - 1] == "\\" and (kind := inner_kind(unbase64(m[0][1:]))):
            out.append((m.start() + 1, m.end(), kind))
        else:
            out += [(m.start() + a, m.start() + b, "der") for a, b in keys_inside(m[0])]
    for m in HEXRUN.finditer(text):
        # The run itself, or without a digit before or after it that isn't part of it.
        n = len(m[0])
        cuts = [(a, b) for a in (0, 1) for b in (n, n - 1) if (b - a) % 2 == 0] + [h.span() for h in HEXBLOB.finditer(m[0])]
        for a, b in dict.fromkeys(cuts):
            if kind := inner_kind(binascii.unhexlify(m[0][a:b])):
                out.append((m.start() + a, m.start() + b, kind))
    return sorted(set(out), key=lambda s: (s[0], KINDS.index(s[2])))


def all_spans(text: str | None) -> tuple[list, list]:
    if not text:
        return [], []
    base = base_spans(text)
    more = sorted([*base, *added_spans(text)], key=lambda s: (s[0], KINDS.index(s[2])))
    return base, more


def join_spans(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


RESULT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_assign", "n_access", "n_hex", "n_confirmed")]
    + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts, digest of the base spans, all spans. Map-only."""

    def make():
        def fn(texts):
            out = {f.name: [] for f in RESULT.fields}
            for text in texts:
                base, every = all_spans(text)
                kinds = [k for _, _, k in base]
                for n in ("assign", "access", "hex"):
                    out[f"n_{n}"].append(kinds.count(n))
                out["n_confirmed"].append(len(every) - len(base))
                out["base_sha256"].append(hashlib.sha256(join_spans(base).encode()).hexdigest())
                out["spans"].append(join_spans(every))
            return out

        return fn

    return map_rows(docs, [id_col], text_col, make, RESULT)


def redact_text(text: str | None) -> str | None:
    """The text with every reported span but public keys (overlaps merged) replaced by a marker of its first kind."""
    spans = [s for s in all_spans(text)[1] if s[2] != "ssh"]
    if not spans:
        return text
    out, at = [], 0
    merged: list[list] = []
    for a, b, k in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, k])
    for a, b, k in merged:
        out += [text[at:a], f"<{k}-removed>"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns, with reported spans replaced; ``n_chars``, if there, follows the new text."""
    keys = [c for c in docs.columns if c != text_col]
    new = free_name(docs.columns, "new")

    def make():
        return lambda texts: {new: [redact_text(t) for t in texts]}

    got = map_rows(docs, keys, text_col, make, T.StructType([T.StructField(new, T.StringType())]))
    size = F.char_length(F.col(f"`{new}`"))
    out = {text_col: F.col(f"`{new}`")} | ({"n_chars": size.cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return got.select(*[out.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def op2_query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
