"""Secret scans through nested encodings.

Each text is layer 0 of a worklist. A layer is scanned by the three base
patterns; then its encoded stretches (URL escapes, Unicode escapes, HTML
references, base64, over lines too, and base64 of compressed data) are decoded,
each to a further layer, until none is left. What stands right before base64, as
the path of an address, may be of the same letters, so each run is decoded from
each of its first four letters. Compressed data are looked for anywhere in
decoded bytes (gzip with all its members, zlib with windows of any size, and
deflate without a header where it begins a run or comes after a / or the like);
streams that are cut short or broken give what they held up to there, and what
they hold is looked through for further streams. Bytes are read as UTF-8 or
UTF-16, else byte by byte, so that stray bytes hide nothing beside them. Escapes
are decoded with all that stands with them between blanks, and beyond blanks
beside : and =, so that a plain name and its escaped value meet.

A layer that has the same content from the same places as one before is not
taken up again, nor is a stream in itself, so encodings that lead back to
themselves end (they contain a compressed stretch, all of whose content has one
place), while the same content in another place is scanned there too. Every
character of a layer knows the stretch of the original text that it comes from,
so what is found at any depth is given in code points of the original.

Which documents need this is found by a few passes over the bytes of a whole
chunk (runs of hex digits or base64 letters, key words, escapes); the others
have no match at all.

Defined cases: a null text counts as empty and has no spans; ids are of any
type; equal rows give equal results, each for itself; a span found both in the
text and in a decoded layer is given once; further columns are ignored. A
compressed stretch that grows beyond ``max_layer`` bytes is unpacked and scanned
in pieces of about that size, cut at line ends or blanks that no pattern can
span; pieces of a stretch without any overlap by ``OVERLAP`` characters, and
what is encoded in such a stretch as a whole is decoded only if it is compressed
once more from its first byte on.
"""

from __future__ import annotations

import binascii
import codecs
import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator
from html.entities import html5
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(
    r"[\\%]u([dD][89abAB][0-9A-Fa-f]{2})[\\%]u([dD][c-fC-F][0-9A-Fa-f]{2})|[\\%]u([0-9A-Fa-f]{4})|\\u\{0*([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})"
)
_HTML = re.compile(r"&(?:#0*([0-9]{1,7})|#[xX]0*([0-9A-Fa-f]{1,6})|([A-Za-z][A-Za-z0-9]{1,30}));")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Lines of one encoded text, as mail wraps them.
_WRAPPED = re.compile(r"(?:[A-Za-z0-9+/_-]{16,}\r?\n[\x20\t]*)+[A-Za-z0-9+/_-]+={0,2}")
#: A layer without any of these holds no span and no further layer.
_WORTH = re.compile(r"(?i:passw|secret|token|api_?key)|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|[A-Za-z0-9+/_-]{16}|%u?[0-9A-Fa-f]{2}|\\[uUx]|&[#A-Za-z]")
#: The first bytes of gzip data and of zlib data without a dictionary, for windows of all sizes.
_HEADS = re.compile(b"\x1f\x8b\x08|" + b"|".join(re.escape(bytes((c, f))) for c in range(0x08, 0x80, 0x10) for f in range(256) if not f & 0x20 and (c << 8 | f) % 31 == 0))
#: Letters of base64 that end what stands before it.
_BEFORE = re.compile(r"[+/_-]")
#: No pattern, plain or encoded, stands in fewer bytes.
LEAST = 12
_KEYS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
_HEX_BYTE = np.array([b in b"0123456789abcdef" for b in range(256)])
_B64_BYTE = np.array([b in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-" for b in range(256)])
MAX_LAYER, OVERLAP = 16_000_000, 1 << 16
#: Places where no pattern goes on: blanks but spaces, and spaces beside neither : nor =.
_CUT = re.compile(r"[^\S\x20]|(?<=[^\s:=])\x20+(?=[^\s:=])")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _texts(data: bytes) -> Iterator[tuple[str, list[int]]]:
    """What bytes say, and the first byte of each character (one more at the end).

    UTF-16 where its zero bytes or its mark show; UTF-8, else a character for each byte: what is text in part is
    scanned in part.
    """
    little, big = data[1::2].count(0), data[0::2].count(0)
    if data[:2] in (b"\xff\xfe", b"\xfe\xff") or max(little, big) >= 0.4 * len(data):
        text = data.decode("utf-16-le" if little >= big else "utf-16-be", "replace")
        yield text, [0, *accumulate(2 * (1 + (ord(c) > 0xFFFF)) for c in text)]
    try:
        text = data.decode("utf-8")
        yield text, list(range(len(text) + 1)) if text.isascii() else [0, *accumulate(len(c.encode("utf-8")) for c in text)]
    except UnicodeDecodeError:
        yield data.decode("latin-1"), list(range(len(data) + 1))


def _slices(data: bytes, at: int) -> Iterator[bytes]:
    """The bytes from one place on, little first: most places where a stream could begin are none."""
    step = 512
    while at < len(data):
        yield data[at : at + step]
        at, step = at + step, min(2 * step, 1 << 16)


def _unpacked(feed: Iterator[bytes], bits: int, most: int):
    """Blocks of at most so many bytes of a stream; returns the bytes it took, None if it is broken or cut short."""
    unpack, held, took, rest = zlib.decompressobj(bits), bytearray(), 0, b""
    while not unpack.eof:
        if not rest:
            rest = next(feed, b"")
            took += len(rest)
        before = unpack.copy()
        try:
            out = unpack.decompress(rest, most - len(held))
        except zlib.error:
            # all that comes before the byte that breaks it
            try:
                for k in range(len(rest)):
                    held += before.decompress(rest[k : k + 1])
            except zlib.error:
                pass
            break
        if not out and not rest and not unpack.eof:
            break
        rest = unpack.unconsumed_tail
        held += out
        if len(held) >= most:
            yield bytes(held)
            held.clear()
    if held:
        yield bytes(held)
    # without a header, only what ends with the data is taken for a stream
    return took - len(unpack.unused_data) if unpack.eof and not (bits < 0 and unpack.unused_data) else None


def _stream(feed: Iterator[bytes], bits: int, most: int, seen: frozenset):
    """The texts in a stream, in pieces if it is large, and in the streams that it holds; returns the bytes it took."""
    took, blocks = [None], _unpacked(feed, bits, most)

    def read():
        took[0] = yield from blocks

    of = read()
    first = next(of, b"")
    second = next(of, None)
    mark = hashlib.blake2b(first, digest_size=16).digest()
    whole = bits > 0 or second is not None or (took[0] is not None and next(feed, None) is None)
    if len(first) < LEAST or mark in seen or not whole:
        return took[0]
    seen |= {mark}
    if second is None:
        yield from (text for text, _ in _texts(first))
        for text, _ in _streams(first, most, seen):
            yield text
    elif head := _HEADS.match(first):
        yield from _stream(chain([first, second], of), 31 if len(head[0]) == 3 else 15, most, seen)
    else:
        yield from _pieces(chain([first, second], of), most)
    return took[0]


def _streams(data: bytes, most: int, seen: frozenset = frozenset(), bare: tuple[int, ...] = ()):
    """(text, first byte) of what is compressed anywhere in bytes; bare: where deflate without a header may begin."""

    def placed(at, bits):
        texts = _stream(_slices(data, at), bits, most, seen)
        try:
            while True:
                yield next(texts), at
        except StopIteration as x:
            return x.value

    at = 0
    while m := _HEADS.search(data, at):
        took = yield from placed(m.start(), 31 if len(m[0]) == 3 else 15)
        at = m.start() + (took or 1)
    for at in bare:
        if data[at] & 6 != 6:
            yield from placed(at, -15)


def _pieces(blocks: Iterator[bytes], most: int) -> Iterator[str]:
    first = next(blocks)
    little, big = first[1::2].count(0), first[0::2].count(0)
    wide = max(little, big) >= 0.4 * len(first)
    read, held = codecs.getincrementaldecoder(("utf-16-le" if little >= big else "utf-16-be") if wide else "utf-8")("replace"), ""
    for block in chain([first], blocks):
        held += read.decode(block)
        while len(held) > most:
            end = max((m.end() for m in _CUT.finditer(held, 0, most)), default=0)
            if end:
                yield held[:end]
                held = held[end:]
            else:
                yield held[:most]
                at = most - min(OVERLAP, most // 2)
                # base64 goes on at a multiple of four
                at -= next(((at - m.start()) % 4 for m in _BASE64.finditer(held, 0, most) if m.start() <= at < m.end()), 0)
                held = held[at:]
    if held:
        yield held


def _char(code: int) -> str:
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"


def _of_url(m: re.Match) -> Iterator[tuple[str, int, int]]:
    at = m.start()
    for c in bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace"):
        to = min(m.end(), at + (3 * len(c.encode("utf-8")) if c != "�" else 3))
        yield c, at, to
        at = to


def _of_unicode(m: re.Match) -> Iterator[tuple[str, int, int]]:
    if m[1]:
        yield chr(0x10000 + ((int(m[1], 16) - 0xD800) << 10) + int(m[2], 16) - 0xDC00), m.start(), m.end()
    else:
        yield _char(int(m[3] or m[4] or m[5] or m[6], 16)), m.start(), m.end()


def _of_html(m: re.Match) -> Iterator[tuple[str, int, int]]:
    yield html5.get(m[3] + ";", m[0]) if m[3] else _char(int(m[1]) if m[1] else int(m[2], 16)), m.start(), m.end()


_ESCAPES = ((_URL, _of_url, "url"), (_UNICODE, _of_unicode, "unicode"), (_HTML, _of_html, "html"))


def _segments(text: str, escape: re.Pattern, decode) -> Iterator[tuple[int, int]]:
    """Stretches with escapes, from cut to cut."""
    joins = lambda m, k: list(decode(m))[k][0] in (":", "=")
    start = end = 0
    for m in escape.finditer(text):
        if m.start() >= end:
            if end:
                yield start, end
            # a blank before the escape is a cut unless : or = comes next
            stop = m.start() + 1 - (text[m.start() - 1 : m.start()] == " " and joins(m, 0))
            low, start, step = m.start(), None, 256
            while start is None:
                low = max(end, low - step)
                start = max((c.end() for c in _CUT.finditer(text, low, stop)), default=end if low == end else None)
                step *= 2
        at = m.end()
        if joins(m, -1):
            while text[at : at + 1] == " ":
                at += 1
        if at >= end:
            cut = _CUT.search(text, at)
            end = cut.start() if cut else len(text)
    if end:
        yield start, end


def _unescape(text: str, start: int, end: int, escape: re.Pattern, decode) -> tuple[str, list[int], list[int]]:
    """Decoded stretch of a text with the first and last + 1 place of each character's source."""
    out, first, last, at = [], [], [], start

    def plain(to):
        out.append(text[at:to])
        first.extend(range(at, to))
        last.extend(range(at + 1, to + 1))

    for m in escape.finditer(text, start, end):
        plain(m.start())
        for c, a, z in decode(m):
            out.append(c)
            first += [a] * len(c)
            last += [z] * len(c)
        at = m.end()
    plain(end)
    return "".join(out), first, last


def _layers(text: str, max_layer: int):
    """(decoded text, first, last, by) for each encoded stretch of a text."""
    for escape, decode, by in _ESCAPES:
        for start, end in _segments(text, escape, decode):
            out, first, last = _unescape(text, start, end, escape, decode)
            if out != text[start:end]:
                yield out, first, last, by
    for pattern in (_BASE64, _WRAPPED):
        for m in pattern.finditer(text):
            # places of the letters without blanks between lines
            at = range(m.start(), m.end()) if pattern is _BASE64 else [i for i, c in enumerate(m[0], m.start()) if not c.isspace()]
            letters = "".join(m[0].split()).rstrip("=")
            ends = [0, *(x.end() for x in _BEFORE.finditer(letters))]
            letters = letters.replace("-", "+").replace("_", "/")
            for skip in range(4):
                body = letters[skip : len(letters) - ((len(letters) - skip) % 4 == 1)]
                data = binascii.a2b_base64(body + "=" * (-len(body) % 4))
                if len(data) < LEAST:
                    break
                place = lambda k: at[min(len(at) - 1, skip + k * 8 // 6)]  # noqa: B023, E731
                beyond = lambda k: at[min(len(at), skip - (-k * 8 // 6)) - 1] + 1  # noqa: B023, E731
                bare = tuple((e - skip) // 4 * 3 for e in ends if e % 4 == skip and e + LEAST <= len(letters))
                for out, a in _streams(data, max_layer, bare=bare):
                    if _WORTH.search(out):
                        yield out, [place(a)] * len(out), [m.end()] * len(out), "base64+compressed"
                for out, places in _texts(data):
                    if _WORTH.search(out):
                        yield out, [place(k) for k in places[:-1]], [beyond(k) for k in places[1:]], "base64"


def find(text: str, max_layer: int = MAX_LAYER) -> tuple[list, list]:
    """(base spans, [(start, kind, end, depth, path, found text)] of deeper layers) of one text."""
    base, deep = base_spans(text), []
    plain = set(base)
    work, seen = [((text, None, None, 0, ""), _layers(text, max_layer))], set()
    while work:
        (_, first, last, depth, path), layers = work[-1]
        got = next(layers, None)
        if got is None:
            work.pop()
            continue
        out, f, l, by = got
        if not _WORTH.search(out):
            continue
        if depth:
            f, l = [first[x] for x in f], [last[x - 1] for x in l]
        key = hashlib.blake2b(out.encode("utf-8", "replace"), digest_size=16)
        for places in (f, l):
            key.update(array("q", places))
        if key.digest() in seen:
            continue
        seen.add(key.digest())
        path = f"{path}/{by}" if path else by
        deep += [(f[s], kind, l[e - 1], depth + 1, path, out[s:e]) for s, kind, e in base_spans(out) if (f[s], kind, l[e - 1]) not in plain]
        work.append(((out, f, l, depth + 1, path), _layers(out, max_layer)))
    return base, sorted(deep)


def _candidates(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Documents of a chunk in which anything can be found."""
    at = []
    for table, least in ((_HEX_BYTE, 24), (_B64_BYTE, 16)):
        s, e = C.runs(table[buf], offs)
        at.append(s[e - s >= least])
    data = buf.tobytes().lower()
    for key in (*_KEYS, b"akia", b"%", b"\\u", b"\\x", b"&"):
        p = data.find(key)
        while p >= 0:
            at.append(np.array([p]))
            # one place is enough for a document: go on with the next one
            p = data.find(key, int(offs[np.searchsorted(offs, p, "right")]))
    return np.unique(np.searchsorted(offs, np.concatenate(at), "right") - 1)


SPAN = "struct<start: int, kind: string, end: int, depth: int, path: string, found: string>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32()), ("depth", pa.int32()), ("path", pa.string()), ("found", pa.string())]))


def scan(docs: DataFrame, max_layer: int = MAX_LAYER) -> DataFrame:
    """All spans of each document: depth 0 for the base patterns, deeper for decoded layers."""

    def run(batches):
        for b in batches:
            for lo, hi, buf, offs in C.chunks(b.column("text")):
                rows = [[] for _ in range(hi - lo)]
                for d in _candidates(buf, offs).tolist():
                    text = buf[offs[d] : offs[d + 1]].tobytes().decode("utf-8", "replace")
                    base, deep = find(text, max_layer)
                    rows[d] = [dict(start=s, kind=KINDS[k], end=e, depth=0, path="", found=text[s:e]) for s, k, e in base] + [dict(start=s, kind=KINDS[k], end=e, depth=n, path=p, found=x) for s, k, e, n, p, x in deep]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(rows, _SPANS)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<{SPAN}>")


def _digest(spans: str) -> str:
    key = "named_struct('start', x.start, 'kind', CASE x.kind WHEN 'assign' THEN 0 WHEN 'access' THEN 1 ELSE 2 END, 'end', x.end, 'name', x.kind)"
    return f"array_join(transform(array_sort(array_distinct(transform({spans}, x -> {key}))), x -> concat(x.name, ':', x.start, ':', x.end)), ',')"


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(C.read(spark, sf_dir, "documents"))
    count = lambda kind: F.expr(f"cast(size(filter(spans, x -> x.depth = 0 AND x.kind = '{kind}')) as long)")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(F.expr(_digest("filter(spans, x -> x.depth = 0)")), 256).alias("base_sha256"), F.expr(_digest("spans")).alias("spans"))
