"""Secret scans: base patterns, and candidates confirmed by their structure.

Base kinds are plain patterns. The structural kinds decode base64 or hex runs and report them only
if the bytes parse: `der` (nested lengths of a key's encoding, all consistent), `openssh` (the magic
and length-prefixed names of a private key file), `jwt` (a signed token's header and claims). Keys may be wrapped over
lines, written with escaped line ends, or glued to a path or a name: a key's own header tells its length.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import itertools
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Base patterns; group 2 of `assign`, and the whole match of the others, has a least length.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6
#: Candidates for decoding. Each begins where its run of characters begins, so that no run is read more than once;
#: lines of a wrapped run are joined, whether their ends are real or written as escapes.
_END = r"(?:\r?\n[ \t]*|(?:\\r)?\\n)"
_CODE, _HEX = "[A-Za-z0-9+/_-]", "[0-9A-Fa-f]"
BASE64 = re.compile(rf"(?<!{_CODE}){_CODE}{{32,}}(?:{_END}{_CODE}{{32,}})*(?:{_END}{_CODE}+)?={{0,2}}")
HEX_ANY = re.compile(rf"(?<!{_HEX}){_HEX}{{48,}}(?:{_END}{_HEX}{{48,}})*(?:{_END}{_HEX}+)?")
DOTTED = re.compile(r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_.-]{16,}")
LINE_END = re.compile(_END)
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}KEY)-----((?:[A-Za-z0-9+/=\s]|\\[nr]){16,}?)-----END \1-----")
#: A key's SEQUENCE in base64, or the magic of a private key file; the beginning of an object in base64.
KEY_START = re.compile("M[A-P]|b3BlbnNzaC1rZXktdjE")
OBJECT_START = re.compile("ey[A-J]")
#: Values in a key's encoding at most, at all levels together; the formats of private keys have a few dozen.
VALUES = 32
KINDS = ("assign", "access", "hex", "der", "openssh", "jwt")
SCHEMA = pa.schema([
    ("doc_id", pa.int64()),
    ("text", pa.string()),
    ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))),
])


def decoded(run: str) -> bytes | None:
    """base64 in either alphabet, padding optional, white space and escaped line ends left out."""
    run = re.sub(r"\s+|\\[nr]", "", run).rstrip("=").replace("-", "+").replace("_", "/")
    if len(run) % 4 == 1:
        return None
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the value at `at`, if its length stays within `end`."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n & 0x80:
        width = n & 0x7F
        if not 1 <= width <= 4 or at + width > end:
            return None
        n, at = int.from_bytes(data[at : at + width], "big"), at + width
    return (tag, at, at + n) if at + n <= end else None


def is_der_key(data: bytes, start: int = 0, end: int | None = None) -> bool:
    """One SEQUENCE over the bytes from start to end, of at least two values with nested lengths that add up, holding an INTEGER, OID or BIT STRING.

    Read in place, and given up at the first value that doesn't fit, or after VALUES of them: no key's encoding has as many.
    """
    end = len(data) if end is None else end
    left = VALUES

    def fits(start: int, end: int, depth: int) -> bool:
        nonlocal left
        outer = tlv(data, start, end)
        if outer is None or outer[0] != 0x30 or outer[2] != end or depth > 8:
            return False
        at, seen, known = outer[1], 0, False
        while at < end:
            inner, left = tlv(data, at, end), left - 1
            if left < 0 or inner is None or inner[0] not in (0x02, 0x03, 0x04, 0x05, 0x06, 0x30, 0x31, 0xA0, 0xA1):
                return False
            if inner[0] == 0x30 and inner[2] > inner[1] and not fits(at, inner[2], depth + 1):
                return False
            known |= inner[0] in (0x02, 0x03, 0x06)
            at, seen = inner[2], seen + 1
        return known and (seen >= 2 or depth > 0)

    return end - start >= 24 and fits(start, end, 0)


def is_openssh_key(data: bytes) -> bool:
    """The file's magic, then length-prefixed cipher and key derivation names of plain characters."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)
    for _ in range(2):
        n = int.from_bytes(data[at : at + 4], "big")
        name = data[at + 4 : at + 4 + n]
        if len(name) != n or not 1 <= n <= 64 or not re.fullmatch(rb"[\w@.+-]+", name):
            return False
        at += 4 + n
    return True


def object_at(data: bytes, at: int = 0) -> tuple[dict, int] | None:
    """The JSON object that begins at a byte, and its end (beyond the data: the data end before it does). Looks no further than the object, or its first error, goes."""
    size = 256
    while True:
        part = data[at : at + size].decode("latin-1")
        try:
            found, end = json.JSONDecoder().raw_decode(part)
            return (found, at + end) if isinstance(found, dict) else None
        except RecursionError:  # nested too deeply to be a token's
            return None
        except ValueError as e:
            if e.pos < len(part) - 8 and not e.msg.startswith("Unterminated"):
                return None
            if at + size >= len(data):
                return {}, len(data) + 1
            size *= 2


def header_of(run: str) -> bool:
    """The run, whole, encodes a JSON object that names an algorithm; a broken one is told by its beginning."""
    size = 512
    while True:
        raw = decoded(run[:size])
        found = object_at(raw) if raw else None
        if not found or size >= len(run) or found[1] <= len(raw):
            return bool(found) and size >= len(run) and found[1] == len(raw) and isinstance(found[0].get("alg"), str)
        size *= 4


def tokens_in(run: str) -> Iterator[tuple[int, int]]:
    """Places of header.claims.signature in a run of dotted segments: the first two are JSON objects and the header names an algorithm."""
    parts = run.split(".")
    at = 0
    for header, claims, signature in zip(parts, parts[1:], parts[2:], strict=False):
        starts = OBJECT_START.finditer(header) if len(claims) >= 2 else iter(())
        first = next(starts, None)
        if first and (raw := decoded(claims)) and (found := object_at(raw)) and found[1] == len(raw):
            for m in itertools.chain([first], starts):
                if header_of(header[m.start() :]):
                    yield at + m.start(), at + len(header) + len(claims) + len(signature) + 2
                    break
        at += len(header) + 1


def der_size(data: bytes) -> int:
    """Bytes of the SEQUENCE that begins here, by its header, if its first value's header fits; else 0. Eighteen bytes tell."""
    outer = tlv(data, 0, 1 << 32) if len(data) >= 18 else None
    if outer is None or outer[0] != 0x30 or outer[2] < 24:
        return 0
    inner = tlv(data, outer[1], outer[2])
    return outer[2] if inner and inner[0] in (0x02, 0x03, 0x04, 0x06, 0x30) else 0


class Run:
    """A candidate with its line ends taken out, and where each of its characters lies in the text."""

    def __init__(self, m: re.Match):
        self.starts, pieces, at, size = [(0, m.start())], [], 0, 0
        for e in LINE_END.finditer(m[0]):
            pieces.append(m[0][at : e.start()])
            size, at = size + e.start() - at, e.end()
            self.starts.append((size, m.start() + at))
        self.text = "".join([*pieces, m[0][at:]])

    def place(self, i: int) -> int:
        """The text's place of the character i."""
        base, own = self.starts[bisect.bisect_right(self.starts, (i, 1 << 62)) - 1]
        return own + i - base

    def span(self, a: int, b: int) -> tuple[int, int]:
        return self.place(a), self.place(b - 1) + 1


def keys_in(run: Run) -> Iterator[tuple[int, int, str]]:
    """Keys in base64: where one may begin, its own header tells where it ends, so that it may be glued to other characters.

    The run is decoded once for each place modulo 4 at which a header fits, however many headers there are.
    """
    code = run.text.rstrip("=")
    at, whole = 0, {}
    while m := KEY_START.search(code, at):
        a, at = m.start(), m.start() + 1
        if m[0][0] == "b":
            if is_openssh_key(decoded(code[a : a + 240]) or b""):
                yield a, len(run.text), "openssh"
                return
        elif size := der_size(decoded(code[a : a + 24]) or b""):
            b, shift = a + (size * 4 + 2) // 3, a % 4
            if b > len(code):
                continue
            if shift not in whole:
                own = code[shift:]
                whole[shift] = decoded(own[: len(own) - (len(own) % 4 == 1)]) or b""
            first = (a - shift) // 4 * 3
            if is_der_key(whole[shift], first, first + size):
                at = b
                yield a, b + (len(run.text) - b if b == len(code) else 0), "der"


def hex_in(run: Run) -> Iterator[tuple[int, int, str]]:
    """Keys, tokens and token headers in hex, at either alignment."""
    for shift in (0, 1):
        code = run.text[shift:]
        data = bytes.fromhex(code[: len(code) // 2 * 2])
        at = 0
        while (a := data.find(0x30, at)) >= 0:
            at, size = a + 1, der_size(data[a : a + 18])
            if size and a + size <= len(data) and is_der_key(data, a, a + size):
                at = a + size
                yield shift + 2 * a, shift + 2 * at, "der"
        if data.startswith(b"openssh-key-v1\0") and is_openssh_key(data):
            yield shift, shift + 2 * len(data), "openssh"
        at = 0
        while (a := data.find(b'{"', at)) >= 0:
            found = object_at(data, a)
            at = found[1] if found else a + 1
            if found and isinstance(found[0].get("alg"), str):
                yield shift + 2 * a, shift + 2 * at, "jwt"
        if b"ey" in data:
            for m in DOTTED.finditer(data.decode("latin-1")):
                yield from ((shift + 2 * (m.start() + a), shift + 2 * (m.start() + b), "jwt") for a, b in tokens_in(m[0]))


def key_kind(data: bytes | None) -> str | None:
    return None if not data else "der" if is_der_key(data) else "openssh" if is_openssh_key(data) else None


def structural(text: str) -> dict[tuple[int, int], str]:
    """Kind by span of all that its structure confirms."""
    added = {}
    if OBJECT_START.search(text):
        for m in DOTTED.finditer(text):
            added |= {(m.start() + a, m.start() + b): "jwt" for a, b in tokens_in(m[0])}
    armoured = []
    if "-----BEGIN" in text:
        for m in PEM.finditer(text):
            if kind := key_kind(decoded(m[2])):
                added[m.span()] = kind
                armoured.append(m.span())
    for m in BASE64.finditer(text):
        k = bisect.bisect_right(armoured, (m.start(), 1 << 62)) - 1
        if k < 0 or m.end() > armoured[k][1]:
            run = Run(m)
            added |= {run.span(a, b): kind for a, b, kind in keys_in(run)}
    for m in HEX_ANY.finditer(text):
        run = Run(m)
        added |= {run.span(a, b): kind for a, b, kind in hex_in(run)}
    return added


def scan(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) in code points, by start and then by the order of KINDS. Takes time in proportion to the text, also for one very long run."""
    found = [("assign", m.start(), m.end(), True) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += [("access", m.start(), m.end(), True) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end(), True) for m in HEX.finditer(text)]
    found += [(kind, a, b, False) for (a, b), kind in structural(text).items()]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and spans (kind, start, end, base) of every row.

    A null or empty text has no spans; repeated rows stay, each with its spans; a null id stays null.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in SCHEMA.field("spans").type.value_type]
        for part in common.slices(batches):
            texts = part.column("text")
            yield common.batch(SCHEMA, doc_id=part.column("doc_id"), text=texts.cast(pa.string()), spans=[[dict(zip(names, s, strict=True)) for s in scan(t)] for t in texts.to_pylist()])

    return common.id_text(docs, id_col, text_col).mapInArrow(work, "doc_id long, text string, spans array<struct<kind:string,start:int,end:int,base:boolean>>")


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """The rows of `docs`, all columns, with every found span of `text` replaced by the mask and n_chars, if there, set anew; spans that overlap share one mask."""
    common.small_batches(docs.sparkSession)
    at = docs.columns.index("text")
    fields = docs.schema
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            out = []
            for text in part.column(at).to_pylist():
                if text:
                    pieces, done = [], 0
                    for _, a, b, _ in scan(text):
                        if a >= done:
                            pieces += [text[done:a], mask]
                        done = max(done, b)
                    text = "".join(pieces) + text[done:] if pieces else text
                out.append(text)
            columns = list(part.columns)
            columns[at] = pa.array(out, part.schema.field(at).type)
            if count is not None:
                columns[count] = pa.array([None if x is None else len(x) for x in out], part.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(work, fields)


def digest(found: DataFrame) -> DataFrame:
    """The counts, digest and joined string that describe the spans."""
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(said(F.filter("spans", lambda s: s["base"])).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
