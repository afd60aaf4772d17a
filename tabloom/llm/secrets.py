"""Secrets in texts, also under nested layers of encoding.

``find`` works a list of layers off until none is new: a layer is scanned, then unwrapped. URL escapes (``%41``) and
Unicode escapes (backslash u0041, u{41}, U00000041 or x41; surrogate pairs) are undone over the whole layer; runs of base64 and of hexadecimal digits become layers of
their own, decompressed (gzip, zlib, bzip2, xz, Zstandard) as often as they can be. A layer that was seen before at the
same place is not scanned again, which ends cycles. Each character of a layer knows the span of the text that it comes from; a
hit in a layer is reported as the span of the text that holds all its characters.

Kinds, in the order of ties: assign, access, hex. Spans are in code points, the end exclusive. Base spans are those of
the text itself; layers add spans and take none away; equal (kind, start, end) count once.

A null text is empty and has no spans. Rows are independent: ties, repeated rows and empty tables need nothing special
and columns beyond the key and the text may have any name. All members of a compressed layer are read, in windows of about ``max_layer``
characters that overlap, which bounds the memory that a layer takes; texts themselves are scanned whole. Base64 that is
broken into lines is one run. Bytes that aren't UTF-8 are scanned as replacement characters.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
#: Whole runs only: from within a run, a match would be the run's own rest.
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
#: A surrogate pair is one escape.
_ESCAPE = re.compile(r"(?:%[0-9A-Fa-f]{2})+|\\u[Dd][89ABab][0-9A-Fa-f]{2}\\u[Dd][C-Fc-f][0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
_HEXRUN = re.compile(r"(?<![0-9A-Za-z])(?:[0-9A-Fa-f]{2}){12,}(?![0-9A-Za-z])")
#: Lines of base64 digits only, after one that ends with them; and one line of them.
_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:\r?\n[\x20\t]*[A-Za-z0-9+/_-]+={0,2}(?=[\x20\t]*(?:\r?\n|\Z)|[\"',;)\]}<\x20]))+")
_PIECE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
#: Where compressed data may begin within a run: how the first bytes of gzip, zlib, bzip2, xz and Zstandard look in base64.
_STARTS = re.compile(r"(?<=[/_-])(?:H4sI|eJ|eN|eA|eF|Qlpo|[/_]Td6WFo|KLUv[/_])")
_BREAK = re.compile(r"[^A-Za-z0-9+/_.=%:\\{}\"'\x20\r\n-]")
MAX_LAYER = 1 << 24
#: Windows of a large layer share so many characters. Bytes that tell a compression; bytes given to and taken from a decompressor at once.
OVERLAP, HEAD, BITE, PIECE = 1 << 16, 1 << 16, 1 << 12, 1 << 20

Span = tuple[int, int, str]


def scan(text: str) -> list[Span]:
    """(start, end, kind) of the leftmost matches that don't overlap, of each kind, in one layer."""
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return found


def unescape(text: str) -> tuple[str, list[int], list[int]] | None:
    """The text without its escapes, with each character's span in ``text``; None if there are none that decode."""
    out, first, last, at = [], [], [], 0

    def put(s: str, begin: int, end: int) -> None:
        out.append(s)
        first.extend([begin] * len(s))
        last.extend([end] * len(s))

    for m in _ESCAPE.finditer(text):
        if text[m.start()] == "%":
            s = bytes.fromhex(m[0].replace("%", "")).decode(errors="replace")
        else:
            parts = [int(x, 16) for x in re.findall(r"[0-9A-Fa-f]+", m[0].replace("\\u", " ").replace("\\U", " ").replace("\\x", " "))]
            code = parts[0] if len(parts) == 1 else 0x10000 + ((parts[0] & 0x3FF) << 10) + (parts[1] & 0x3FF)
            if not 0 < code < 0x110000 or 0xD800 <= code < 0xE000:
                continue
            s = chr(code)
        out.append(text[at : m.start()])
        first.extend(range(at, m.start()))
        last.extend(range(at + 1, m.start() + 1))
        size = len(m[0]) // len(s) if text[m.start()] == "%" and len(m[0]) == 3 * len(s) else 0
        if size:
            for i, c in enumerate(s):
                put(c, m.start() + 3 * i, m.start() + 3 * i + 3)
        else:
            put(s, m.start(), m.end())
        at = m.end()
    if not out:
        return None
    out.append(text[at:])
    first.extend(range(at, len(text)))
    last.extend(range(at + 1, len(text) + 1))
    return "".join(out), first, last


def _opener(head: bytes) -> Callable | None:
    """What makes a decompressor for data that begins like this, if it looks compressed."""
    if head[:2] == b"\x1f\x8b":
        return lambda: zlib.decompressobj(31)
    if head[:1] == b"\x78" and len(head) > 2 and not (head[0] * 256 + head[1]) % 31:
        return zlib.decompressobj
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor
    if head[:6] == b"\xfd7zXZ\0":
        return lambda: lzma.LZMADecompressor()
    if head[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return lambda: zstandard.ZstdDecompressor(max_window_size=(1 << 31) - 1).decompressobj()
    return None


def _inflated(parts: Iterator[bytes], new: Callable) -> Iterator[bytes]:
    """One layer of compression less: of all members, in pieces. Ends where the data does or stops making sense."""
    machine, fed = new(), False
    try:
        for part in parts:
            while part:
                # Small bites bound what one step of a decompressor without a limit can give.
                bite, rest = part[:BITE], part[BITE:]
                if not fed and not bite.strip(b"\0"):  # padding between members
                    part = rest
                    continue
                fed = True
                if hasattr(machine, "copy"):  # zlib
                    while True:
                        out = machine.decompress(bite, PIECE)
                        if out:
                            yield out
                        bite = machine.unconsumed_tail
                        if machine.eof or not bite and len(out) < PIECE:
                            break
                elif hasattr(machine, "needs_input"):
                    while True:
                        out = machine.decompress(bite, PIECE)
                        if out:
                            yield out
                        bite = b""
                        if machine.eof or machine.needs_input:
                            break
                else:
                    out = machine.decompress(bite)
                    if out:
                        yield out
                if machine.eof:
                    part, machine, fed = machine.unused_data + rest, new(), False
                else:
                    part = rest
    except Exception:  # noqa: BLE001  it only looked compressed, or what follows the last member isn't another one
        return


def _peeked(parts: Iterator[bytes], size: int) -> tuple[bytes, Iterator[bytes]]:
    """The first ``size`` bytes, or all there are, and the whole stream."""
    head, taken = b"", []
    for part in parts:
        taken.append(part)
        head += part
        if len(head) >= size:
            break
    return head[:size], chain(taken, parts)


def readable(raw: bytes, most: int = MAX_LAYER) -> Iterator[str]:
    """What is in ``raw`` after undoing its compression, as texts of about ``most`` characters at most that overlap.

    Bytes that aren't UTF-8 become replacement characters. A member that ends early counts as far as it goes.
    """
    seen, head, parts = {raw[:HEAD]}, raw[:HEAD], iter((raw,))
    while (new := _opener(head)) is not None:
        tried: list | None = []

        def noted(parts: Iterator[bytes] = parts) -> Iterator[bytes]:
            for part in parts:
                if tried is not None:
                    tried.append(part)
                yield part

        inner, more = _peeked(_inflated(noted(), new), HEAD)
        if not inner:  # it only looked compressed
            parts = chain(tried, parts)
            break
        tried = None
        if inner in seen:  # it unpacks to itself
            return
        seen.add(inner)
        head, parts = inner, more
    decoder, held = codecs.getincrementaldecoder("utf-8")("replace"), ""
    for part in parts:
        held += decoder.decode(part)
        while len(held) >= 2 * most:
            # A window ends where no token does, so that runs and secrets are whole in one of them; one that is longer than a window can't be.
            cut = max(m.end() for m in _BREAK.finditer(held, most, 2 * most)) if _BREAK.search(held, most, 2 * most) else 2 * most
            yield held[:cut]
            held = held[max(cut - min(OVERLAP, most // 2), 0) :]
    held += decoder.decode(b"", True)
    if held:
        yield held


def _wrapped(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, digits) of base64 that is broken into lines, with the breaks left out."""
    for m in _LINES.finditer(text):
        pieces = [(p.start(), p.end(), p[0]) for p in _PIECE.finditer(text, m.start(), m.end())]
        k = 0
        while k + 1 < len(pieces):
            # All lines are as long as the second, but for the first (which may have a name in front of it) and the last.
            size, e = len(pieces[k + 1][2]), k + 2
            while e < len(pieces) and len(pieces[e][2]) == size:
                e += 1
            ends = [e] + ([e + 1] if e < len(pieces) and len(pieces[e][2]) < size else [])
            for begin in {k, k + 1} if e - k > 2 or len(ends) > 1 else {k}:
                for end in ends:
                    yield pieces[begin][0], pieces[end - 1][1], "".join(p[2] for p in pieces[begin:end])
            k = e - 1


def runs(text: str, most: int) -> Iterator[tuple[int, int, str]]:
    """(start, end, decoded text) of the runs of ``text`` that are base64 or hexadecimal digits."""
    for m in _HEXRUN.finditer(text):
        for inner in readable(bytes.fromhex(m[0]), most):
            yield m.start(), m.end(), inner
    whole = ((m.start(), m.end(), m[0]) for m in _BASE64.finditer(text))
    for a, b, digits in chain(whole, _wrapped(text) if "\n" in text else ()):
        # A run may begin with what isn't base64 (the path of a URL, a word with a hyphen): its groups of four may begin at any of
        # four places, and what was compressed where its first bytes say so.
        glued = digits[0] != text[a] or re.search(r"[/_-]", digits[:-16])
        places = {0, *(range(1, 4) if glued else ()), *((m.start() for m in _STARTS.finditer(digits)) if glued else ())}
        for place in sorted(places):
            body = digits[place:].rstrip("=").replace("-", "+").replace("_", "/")
            body = body[: len(body) - 1] if len(body) % 4 == 1 else body
            if len(body) < 12:
                continue
            try:
                raw = base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
            except (binascii.Error, ValueError):
                continue
            for inner in readable(raw, most):
                yield a, b, inner


def find(text: str | None, most: int = MAX_LAYER) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), sorted by start, then kind, then end."""
    text = text or ""
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    base = scan(text)
    spans, seen = set(base), {(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest(), 0, len(text))}
    # A layer: its text, and the span of the whole text behind each character, as two lists or as one span for all.
    work: deque = deque([(text, None, None)])
    while work:
        layer, first, last = work.popleft()

        def origin(a: int, b: int, first=first, last=last) -> tuple[int, int]:
            if first is None:
                return a, b
            return (first[a], last[b - 1]) if isinstance(first, list) else (first, last)

        def add(inner: str, f, e) -> None:
            whole = (f[0], e[-1]) if isinstance(f, list) else (f, e)
            mark = (hashlib.sha256(inner.encode("utf-8", "surrogatepass")).digest(), *whole)
            if inner and mark not in seen:
                seen.add(mark)
                for a, b, kind in scan(inner):
                    spans.add((f[a], e[b - 1], kind) if isinstance(f, list) else (f, e, kind))
                work.append((inner, f, e))

        if ("%" in layer or "\\" in layer) and (plain := unescape(layer)) and plain[0]:
            inner, f, e = plain
            if first is None:
                add(inner, f, e)
            elif isinstance(first, list):
                add(inner, [first[a] for a in f], [last[b - 1] for b in e])
            else:
                add(inner, first, last)
        for a, b, inner in runs(layer, most):
            add(inner, *origin(a, b))
    return sorted(base, key=order), sorted(spans, key=order)


def _line(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


SPANS = "n_assign long, n_access long, n_hex long, base_spans string, spans string"


def scan_table(docs: DataFrame, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), max_layer: int = MAX_LAYER) -> DataFrame:
    """The ``keep`` columns, the numbers of base spans by kind, and both lists of spans as ``kind:start:end``, joined by commas."""
    schema = T.StructType([*[T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)], *T.StructType.fromDDL(SPANS)])
    slim = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").alias("t"))
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows = batch.column(batch.num_columns - 1), []
            for i in range(batch.num_rows):
                base, spans = find(texts[i].as_py(), max_layer)
                rows.append((*(sum(s[2] == k for s in base) for k in KINDS), _line(base), _line(spans)))
            made = [pa.array(c, pa.string() if i > 2 else pa.int64()) for i, c in enumerate(zip(*rows, strict=True))]
            if rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=names)

    return slim.mapInArrow(run, schema).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *names[len(keep) :])
