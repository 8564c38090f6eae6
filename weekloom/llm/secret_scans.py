"""Secrets in texts: base patterns, and encoded secrets confirmed by their structure.

Base kinds are found by pattern alone: ``assign`` (a name, a sign and a value), ``access`` (access
key ids) and ``hex`` (long runs of hex digits). The method adds kinds that are decoded and parsed
before they are reported:

* ``key``: private keys in PEM, in bare base64 (one line, or lines of one width) or in hex. The
  bytes are parsed as DER (RSA, DSA, EC, PKCS#8 and encrypted PKCS#8) or as the OpenSSH format.
  Every nested length must fit exactly, and the outermost length says where a bare key ends.
* ``token``: signed tokens of three parts or encrypted ones of five, whose header decodes to a
  JSON object that names a known algorithm.
* ``wrapped``: base64 or hex runs that decode to printable text with any of the other kinds but
  ``hex`` in it, also through several encodings.

A text is scanned whole. A scan takes time in proportion to the text, as each pattern starts at
run boundaries only.

Defined cases: a null or empty text has no spans; very long texts are scanned like any other; of
spans with one start the kind listed first comes first, then the shorter one; repeated rows give
repeated results; further columns are not looked at; an empty table gives an empty result.
"""

import base64
import binascii
import json
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.llm.common import documents, schema_after

KINDS = ("assign", "access", "hex", "key", "token", "wrapped")
BASE = KINDS[:3]
LEAST = {"assign": 6, "access": 20, "hex": 24}
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
DEPTH = 3
MAX_KEY = 1 << 14
FINDINGS = "findings array<struct<kind:string,start:long,end:long,detail:string>>"

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                    r"([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
PEM = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}")
HEX_RUN = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){16,}(?![0-9A-Fa-f])")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])e[wy][A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*){2,4}"
                   r"(?![A-Za-z0-9_-])")
FIELD = re.compile(r"[A-Za-z-]+: [^\n]*\n(?: [^\n]*\n)*")
PRINTABLE = re.compile(rb"[\x09\x0A\x0D\x20-\x7E]+")

# fixed values of the formats
OPENSSH = b"openssh-key-v1\0"
ALGORITHMS = {"HS256", "HS384", "HS512", "RS256", "RS384", "RS512", "PS256", "PS384", "PS512",
              "ES256", "ES256K", "ES384", "ES512", "EdDSA"}
RSA_OID = bytes.fromhex("2a864886f70d010101")
EC_OID = bytes.fromhex("2a8648ce3d0201")
DSA_OID = bytes.fromhex("2a8648ce380401")
EDWARDS_OIDS = {bytes.fromhex("2b65" + x) for x in ("6e", "6f", "70", "71")}
PASSWORD_OIDS = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
INTEGER, BITS, OCTETS, OID, SEQUENCE = 0x02, 0x03, 0x04, 0x06, 0x30


class Finding(NamedTuple):
    kind: str
    start: int
    end: int
    detail: str


# --- nested lengths ---------------------------------------------------------------------

def der_head(data: bytes, at: int = 0) -> tuple[int, int, int] | None:
    """(tag, begin, end) of the element at ``at``; its length must be in shortest form."""
    if at + 2 > len(data):
        return None
    tag, n, begin = data[at], data[at + 1], at + 2
    if n >= 0x80:
        more = n & 0x7F
        if not 1 <= more <= 4 or begin + more > len(data):
            return None
        n = int.from_bytes(data[begin:begin + more])
        if n < 0x80 or n < 1 << (8 * (more - 1)):
            return None
        begin += more
    return tag, begin, begin + n


def der_items(data: bytes, tag: int = SEQUENCE) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the elements inside one element that fills ``data``."""
    head = der_head(data)
    if head is None or head[0] != tag or head[2] != len(data):
        return None
    at, found = head[1], []
    while at < len(data):
        item = der_head(data, at)
        if item is None or item[2] > len(data) or len(found) > 12:
            return None
        found.append((item[0], data[item[1]:item[2]]))
        at = item[2]
    return found


def numbers(items: list[tuple[int, bytes]]) -> list[int] | None:
    """The values of items that are all integers in shortest form and not negative."""
    found = []
    for tag, body in items:
        if tag != INTEGER or not body or body[0] >= 0x80 or (
                len(body) > 1 and body[0] == 0 and body[1] < 0x80):
            return None
        found.append(int.from_bytes(body))
    return found


def plain_key(data: bytes, items: list[tuple[int, bytes]]) -> str | None:
    tags = [t for t, _ in items]
    if len(items) == 9 and (values := numbers(items)) and values[0] == 0:
        bits = [v.bit_length() for v in values]
        if bits[1] >= 512 and min(bits[2:]) > 0 and 0 <= bits[4] + bits[5] - bits[1] <= 1:
            return "rsa"
    if len(items) == 6 and (values := numbers(items)) and values[0] == 0:
        bits = [v.bit_length() for v in values]
        if bits[1] >= 512 and 160 <= bits[2] < bits[1] and max(bits[3:5]) <= bits[1]:
            return "dsa"
    if tags[:2] == [INTEGER, OCTETS] and items[0][1] == b"\x01" and 16 <= len(items[1][1]) <= 72 \
            and tags[2:] in ([], [0xA0], [0xA1], [0xA0, 0xA1]):
        inner = [der_head(b) for _, b in items[2:]]
        fit = all(h and h[2] == len(b) for h, (_, b) in zip(inner, items[2:]))
        if fit and all(h[0] in (OID, SEQUENCE) if t == 0xA0 else h[0] == BITS
                       for h, t in zip(inner, tags[2:])):
            return "ec"
    return None


def der_key(data: bytes) -> str | None:
    """What private key a DER encoding is, or nothing."""
    items = der_items(data)
    if not items:
        return None
    found = plain_key(data, items)
    if found:
        return found
    tags = [t for t, _ in items]
    if tags[:3] == [INTEGER, SEQUENCE, OCTETS] and items[0][1] in (b"\x00", b"\x01") \
            and set(tags[3:]) <= {0xA0, 0x81, 0xA1}:
        named, inner = der_head(items[1][1]), items[2][1]
        if named is None or named[0] != OID or named[2] > len(items[1][1]):
            return None
        oid = items[1][1][named[1]:named[2]]
        within = der_items(inner)
        kind = plain_key(inner, within) if within else None
        if oid == RSA_OID and kind == "rsa" or oid == EC_OID and kind == "ec":
            return f"pkcs8-{kind}"
        head = der_head(inner)
        whole = head is not None and head[2] == len(inner)
        if whole and oid in EDWARDS_OIDS and head[0] == OCTETS and head[2] - head[1] in (
                32, 56, 57):
            return "pkcs8-edwards"
        if whole and oid == DSA_OID and head[0] == INTEGER and head[2] - head[1] >= 20:
            return "pkcs8-dsa"
    if tags == [SEQUENCE, OCTETS] and len(items[1][1]) >= 16:
        named = der_head(items[0][1])
        if named and named[0] == OID and items[0][1][named[1]:named[2]].startswith(PASSWORD_OIDS):
            return "pkcs8-encrypted"
    return None


def openssh_key(data: bytes) -> str | None:
    """The OpenSSH format: length-prefixed strings that fill the data."""
    if not data.startswith(OPENSSH):
        return None
    at = len(OPENSSH)

    def string():
        nonlocal at
        n = int.from_bytes(data[at:at + 4])
        body = data[at + 4:at + 4 + n]
        at += 4 + n
        return body if at <= len(data) and len(body) == n else None

    cipher, kdf, options = string(), string(), string()
    count = int.from_bytes(data[at:at + 4])
    at += 4
    if None in (cipher, kdf, options) or not 1 <= count <= 16:
        return None
    keys = [string() for _ in range(count)]
    secret = string()
    if None in keys or not secret or at != len(data):
        return None
    if cipher == b"none" and secret[:4] != secret[4:8]:
        return None
    return "openssh"


def key_of(data: bytes) -> str | None:
    return openssh_key(data) or der_key(data)


# --- decoding ---------------------------------------------------------------------------

def unbase64(text: str) -> bytes | None:
    """Bytes of base64 text in either alphabet, padded or not."""
    bare = text.rstrip("=")
    if len(bare) % 4 == 1:
        return None
    try:
        return base64.b64decode(bare.replace("-", "+").replace("_", "/") + "=" * (-len(bare) % 4),
                                validate=True)
    except (binascii.Error, ValueError):
        return None


def pem_keys(text: str):
    """PEM blocks: a begin and an end of one label with nothing of the kind between them."""
    opened = None
    for m in PEM.finditer(text):
        if m[1] == "BEGIN":
            opened = m
            continue
        if opened is not None and opened[2] == m[2]:
            body = text[opened.end():m.start()].replace("\\r", "").replace("\\n", "\n")
            body = body.replace("\r", "").lstrip("\n")
            at = 0
            while field := FIELD.match(body, at):
                at = field.end()
            fields, data = body[:at], unbase64("".join(body[at:].split()))
            kind = key_of(data) if data else None
            if data and "DEK-Info:" in fields and len(data) % 8 == 0:
                kind = "encrypted"
            if kind:
                yield Finding("key", opened.start(), m.end(), f"pem {kind}")
        opened = None


def bare_key(text: str, start: int, end: int) -> tuple[int, str] | None:
    """(end, kind) of a key in base64 from ``start``; lines after the first have its width.

    At most ``MAX_KEY`` bytes are gathered, which no key encoding exceeds, so that a start costs
    a bounded time.
    """
    head = unbase64(text[start:min(end, start + 32)].rstrip("=")[:24])
    if head is None:
        return None
    if head[0] == SEQUENCE:
        found = der_head(head)
        if found is None or found[2] > MAX_KEY:
            return None
        asked, most = -(-found[2] * 4 // 3), -(-found[2] * 4 // 3)
    elif head[:17] == OPENSSH + b"\0\0":
        asked, most = None, MAX_KEY * 4 // 3
    else:
        return None
    width = end - start
    line = re.compile(r"\r?\n([A-Za-z0-9+/_-]{1,%d})(={0,2})(?![A-Za-z0-9+/_=-])" % width)
    parts, at = [text[start:end].rstrip("=")], end
    have = last = len(parts[0])
    while have < most and last == width and (m := line.match(text, at)):
        last = len(m[0].strip())
        parts.append(m[1])
        have += len(m[1])
        at = m.end()
    if asked is not None and have != asked:
        return None
    data = unbase64("".join(parts))
    kind = key_of(data) if data else None
    return (at, kind) if kind else None


def token_kind(text: str) -> str | None:
    """The algorithm of a token whose header and parts decode."""
    parts = text.split(".")
    header = unbase64(parts[0])
    try:
        fields = json.loads(header) if header else None
    except (ValueError, RecursionError):
        return None
    if not isinstance(fields, dict) or not isinstance(fields.get("alg"), str):
        return None
    rest = [unbase64(p) for p in parts[1:]]
    if len(parts) == 3 and fields["alg"] in ALGORITHMS and rest[0] is not None \
            and rest[1] and len(rest[1]) >= 16:
        return fields["alg"]
    if len(parts) == 5 and isinstance(fields.get("enc"), str) and None not in rest and rest[2]:
        return fields["alg"]
    return None


def base_spans(text: str):
    low = text.lower()
    if any(n in low for n in NAMES):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= LEAST["assign"]:
                yield Finding("assign", m.start(), m.end(), m[1].lower())
    for kind, pattern in (("access", ACCESS), ("hex", HEX)):
        for m in pattern.finditer(text):
            yield Finding(kind, m.start(), m.end(), "")


def added_spans(text: str, depth: int = 0):
    """Spans that decoding confirms."""
    blocks = list(pem_keys(text)) if "PRIVATE KEY-----" in text else []
    yield from blocks
    if "." in text:
        for m in TOKEN.finditer(text):
            kind = token_kind(m[0])
            if kind:
                yield Finding("token", m.start(), m.end(), kind)
    done, ahead = -1, 0
    for m in RUN.finditer(text):
        # what a block or a key of several lines holds is reported with it
        while ahead < len(blocks) and blocks[ahead].end <= m.start():
            ahead += 1
        if m.start() < done or ahead < len(blocks) and blocks[ahead].start <= m.start():
            continue
        found = bare_key(text, m.start(), m.end()) if m[0][0] in "Mb" else None
        if found:
            done = found[0]
            yield Finding("key", m.start(), done, f"base64 {found[1]}")
        elif depth < DEPTH and (inner := inside(unbase64(m[0]), depth)):
            yield Finding("wrapped", m.start(), m.end(), f"base64 {inner}")
    for m in HEX_RUN.finditer(text):
        data = bytes.fromhex(m[0])
        kind = key_of(data)
        if kind:
            yield Finding("key", m.start(), m.end(), f"hex {kind}")
        elif depth < DEPTH and (inner := inside(data, depth)):
            yield Finding("wrapped", m.start(), m.end(), f"hex {inner}")


def inside(data: bytes | None, depth: int) -> str | None:
    """The first kind that decoded bytes hold, if they are printable text."""
    if not data or not PRINTABLE.fullmatch(data):
        return None
    text = data.decode("ascii")
    found = [f for f in base_spans(text) if f.kind != "hex"]
    found = found or list(added_spans(text, depth + 1))
    return min(found, key=order).kind if found else None


def order(f: Finding) -> tuple:
    return f.start, KINDS.index(f.kind), f.end


def scan(text: str | None) -> list[Finding]:
    """All spans of a text in code points, by start and kind."""
    if not text:
        return []
    return sorted([*base_spans(text), *added_spans(text)], key=order)


def secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, findings): the spans of every document."""
    def run(batches):
        for batch in batches:
            found = [[f._asdict() for f in scan(t.as_py())] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.list_(pa.struct(
                    [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                     ("detail", pa.string())])))], ["doc_id", "findings"])

    return docs.select("doc_id", "text").mapInArrow(
        run, schema_after(docs, ["doc_id"], FINDINGS))


def op11_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(documents(spark, sf_dir))
    joined = lambda spans: F.array_join(F.transform(spans, lambda f: F.concat_ws(
        ":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
    base = F.filter("findings", lambda f: f["kind"].isin(*BASE))
    counts = [F.size(F.filter("findings.kind", F.lit(k).__eq__)).cast("long").alias(f"n_{k}")
              for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("findings")).alias("spans"))
