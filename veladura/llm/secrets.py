"""Secrets in texts, also inside nested URL, Unicode, base64 and compressed layers.

Every text starts a worklist of layers. A layer is scanned for the three kinds of secrets, then unwrapped: its
escapes decoded, its base64 runs opened, packed bytes unpacked; each new text is a layer of its own. The list ends
when nothing new appears: a layer whose content and place were seen before (a cycle, as a self-reproducing archive
makes one) is not entered again. A layer keeps, per character, the stretch of the original text it came from, so
every span is in code points of the original; a hit inside packed data spans the packed run.

MAX_DECODED, or GROWTH times the text's length if that is more, bounds the characters that base64 and packed layers give
for one text (an archive bomb); layers beyond it are not opened, which n_unopened counts, and redact replaces their
stretches. Decoded escapes only shrink a text and are not bounded.

A base64 run is read at all four alignments, as a path or name may stand before it; packed bytes are sought at each of
them and after every '/', '_' and '-'. Where decoded bytes are not text as a whole, their printable stretches of LEAST_TEXT
bytes (UTF-8, or UTF-16 of ASCII characters) are layers. Packed streams are read member by member; one that breaks off with an
error counts in n_unopened, and so do packed members that a single stream leaves unread.

Rows: every input row gives one row; a null text is empty; an empty text or table gives no spans or rows; repeated rows
repeat; other columns are not read by find_secrets and kept untouched by redact.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veladura.llm.common import id_and_text, portions, shipped

KINDS = ("assign", "access", "hex")
# The three patterns and the least lengths of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGNED = 12

PERCENT = re.compile(r"(?:%(?:25)*[0-9A-Fa-f]{2})+")
PERCENT_BYTE = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")
UNICODE = re.compile(r"(?:\\x[0-9A-Fa-f]{2})+|(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
WRAPPED = re.compile(r"(?:[A-Za-z0-9+/]{60,76}\r?\n)+[A-Za-z0-9+/]+={0,2}")
ALPHABETS = (re.compile(r"[A-Za-z0-9+/]{16,}={0,2}"), re.compile(r"[A-Za-z0-9_-]{16,}={0,2}"))
UNPRINTED = re.compile(r"[\x00-\x08\x0e-\x1f\x7f-\x9f�]")
MAX_DECODED = 64 << 20
GROWTH = 8
LEAST_TEXT = 16
STRETCH = re.compile(
    rb"(?:[\t-\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+"
)
WIDE = re.compile(rb"(?:[\t-\r\x20-\x7e]\x00){16,}|(?:\x00[\t-\r\x20-\x7e]){16,}")
MAGIC = (b"\x1f\x8b\x08", b"BZh", b"\xfd7zXZ\x00", b"\x28\xb5\x2f\xfd")

SPAN = "struct<kind:string,start:int,stop:int,layer:string,value:string>"
SCHEMA = f"doc_id bigint, base array<{SPAN}>, found array<{SPAN}>, n_layers int, n_unopened int"


class Layer:
    """A text and, per character, where in the original text it came from (None: it is the original)."""

    __slots__ = ("text", "starts", "stops", "path")

    def __init__(self, text: str, starts=None, stops=None, path: str = ""):
        self.text, self.starts, self.stops, self.path = text, starts, stops, path

    def outer(self, start: int, stop: int) -> tuple[int, int]:
        if self.starts is None:
            return start, stop
        return int(self.starts[start : stop].min()), int(self.stops[start : stop].max())

    def child(self, text: str, starts: np.ndarray, stops: np.ndarray, step: str) -> Layer:
        """starts, stops: per character of the new text, its stretch of this layer's text."""
        if self.starts is not None:
            starts, stops = self.starts[starts], self.stops[stops - 1]
        return Layer(text, starts, stops, f"{self.path}>{step}" if self.path else step)


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, stop) of the secrets in plain text; runs below the least lengths are consumed and dropped."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def opener(data: bytes):
    """(format, a new decompressor) of packed bytes, by their first ones."""
    if data[:2] == b"\x1f\x8b":
        return "gzip", zlib.decompressobj(31)
    if data[:1] == b"\x78" and len(data) > 2 and (data[0] << 8 | data[1]) % 31 == 0:
        return "zlib", zlib.decompressobj()
    if data[:3] == b"BZh":
        return "bz2", bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\x00":
        return "xz", lzma.LZMADecompressor(lzma.FORMAT_XZ, memlimit=256 << 20)
    if data[:4] == b"\x28\xb5\x2f\xfd":
        return "zstd", zstandard.ZstdDecompressor(max_window_size=1 << 27)
    return "", None


def unpack(data: bytes, room: int) -> tuple[bytes | None, str, bool, bool]:
    """(content, format, too large, broken off): content of all members of one packed layer, None if the bytes are not packed.

    Too large is also what wants a larger dictionary than its format's decoder may hold here.
    """
    parts, size, first, kind = [], 0, "", ""
    try:
        while True:
            kind, opened = opener(data)
            if opened is None or (first and kind != first):
                break
            if kind == "zstd":
                with opened.stream_reader(data, read_across_frames=True) as reader:
                    out, data = reader.read(room - size + 1), b""
            else:
                out = opened.decompress(data, room - size + 1)
                data = opened.unused_data if opened.eof else b""
            first, size = kind, size + len(out)
            parts.append(out)
            if size > room:
                return None, first, True, False
            data = data.lstrip(b"\x00")
    except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError) as error:
        if isinstance(error, (lzma.LZMAError, zstandard.ZstdError)) and "memory" in str(error).lower():
            return None, kind, True, False
        if not first:
            return None, "", False, False
        return b"".join(parts), first, False, True
    return (b"".join(parts), first, False, data.startswith(MAGIC)) if first else (None, "", False, False)


def as_text(data: bytes) -> str | None:
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    return text if text and not UNPRINTED.search(text) else None


def stretches(data: bytes) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(text, first byte, byte after the last, per character) of the printable stretches of bytes."""
    for m in STRETCH.finditer(data):
        if m.end() - m.start() >= LEAST_TEXT:
            text = m.group().decode()
            ends = m.start() + np.cumsum([len(c.encode()) for c in text])
            yield text, np.concatenate([[m.start()], ends[:-1]]), ends
    if b"\x00" in data:
        for m in WIDE.finditer(data):
            starts = np.arange(m.start(), m.end(), 2)
            yield m.group().replace(b"\x00", b"").decode("ascii"), starts, starts + 2


class Worklist:
    def __init__(self, text: str, max_decoded: int = MAX_DECODED):
        self.layers, self.seen, self.room = [Layer(text)], set(), max(max_decoded, GROWTH * len(text))
        self.found: dict[tuple[int, int, int], tuple[str, str]] = {}
        self.base: list[tuple[int, int, int]] = []
        self.opened = self.unopened = 0
        self.closed: list[tuple[int, int]] = []

    def run(self) -> Worklist:
        while self.layers:
            layer = self.layers.pop()
            hits = scan(layer.text)
            if layer.starts is None:
                self.base = sorted(hits)
            for start, kind, stop in hits:
                a, b = layer.outer(start, stop)
                self.found.setdefault((a, kind, b), (layer.path, layer.text[start:stop]))
            self._escapes(layer, "%", PERCENT, "url")
            self._escapes(layer, "\\&", UNICODE, "unicode")
            self._base64(layer)
        return self

    def _close(self, start: int, stop: int) -> None:
        self.unopened += 1
        self.closed.append((start, stop))

    def _add(self, layer: Layer, bounded: bool = True) -> None:
        if bounded and len(layer.text) > self.room:
            self._close(int(layer.starts.min()), int(layer.stops.max()))
            return
        key = hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest() + layer.starts[:1].tobytes() + layer.stops[-1:].tobytes()
        if key not in self.seen:
            self.seen.add(key)
            self.room -= len(layer.text) if bounded else 0
            self.opened += 1
            self.layers.append(layer)

    def _packed(self, layer: Layer, data: bytes, start: int, stop: int, step: str) -> bool:
        """Unpacks bytes that stand at start:stop of a layer, also several times; every character of theirs spans it all."""
        packed, inside = False, set()
        while True:
            out, kind, large, broken = unpack(data, self.room)
            if large:
                self._close(*layer.outer(start, stop))
                return True
            if broken:
                self._close(*layer.outer(start, stop))
            if out is None or hashlib.sha256(out).digest() in inside:
                break
            inside.add(hashlib.sha256(out).digest())
            packed, data, step = True, out, f"{step}>{kind}"
            if (text := as_text(data)) is not None:
                n = len(text)
                self._add(layer.child(text, np.broadcast_to(np.int64(start), n), np.broadcast_to(np.int64(stop), n), step))
                return True
        if packed:
            for text, _, _ in stretches(data):
                n = len(text)
                self._add(layer.child(text, np.broadcast_to(np.int64(start), n), np.broadcast_to(np.int64(stop), n), step))
        return packed

    def _escapes(self, layer: Layer, signs: str, pattern: re.Pattern, step: str) -> None:
        """One new layer: the whole text with all escapes of a kind decoded; each decoded character spans its escape."""
        text = layer.text
        if not any(s in text for s in signs):
            return
        parts, starts, stops, at = [], [], [], 0
        for m in pattern.finditer(text):
            pieces = self._decoded(layer, m, step)
            if not pieces:
                continue
            kept = np.arange(at, m.start())
            parts += [text[at : m.start()], *(c for c, _, _ in pieces)]
            starts += [kept, np.array([a for _, a, _ in pieces])]
            stops += [kept + 1, np.array([b for _, _, b in pieces])]
            at = m.end()
        if parts:
            kept = np.arange(at, len(text))
            self._add(layer.child("".join([*parts, text[at:]]), np.concatenate([*starts, kept]), np.concatenate([*stops, kept + 1]), step), bounded=False)

    def _decoded(self, layer: Layer, m: re.Match, step: str) -> list[tuple[str, int, int]]:
        """(character, start, stop) of an escape run; empty if it stands for no text."""
        run, at = m.group(), m.start()
        if step == "url" or run[:2] == "\\x":
            units = [(u.start(), u.end(), int(u.group(1), 16)) for u in PERCENT_BYTE.finditer(run)] if step == "url" else [(i, i + 4, int(run[i + 2 : i + 4], 16)) for i in range(0, len(run), 4)]
            data = bytes(b for _, _, b in units)
            if self._packed(layer, data, at, m.end(), step):
                return []
            try:
                text = data.decode()
            except UnicodeDecodeError:
                if run[:2] != "\\x":
                    return []
                text = data.decode("latin-1")
                return [(c, at + a, at + b) for c, (a, b, _) in zip(text, units, strict=True)]
            out, k = [], 0
            for c in text:
                n = len(c.encode())
                out.append((c, at + units[k][0], at + units[k + n - 1][1]))
                k += n
            return out
        if run[:2] == "\\u" and run[2] != "{":
            words = [int(run[i + 2 : i + 6], 16) for i in range(0, len(run), 6)]
            out, i = [], 0
            while i < len(words):
                n = 2 if 0xD800 <= words[i] < 0xDC00 and i + 1 < len(words) and 0xDC00 <= words[i + 1] < 0xE000 else 1
                code = 0x10000 + (words[i] - 0xD800 << 10) + words[i + 1] - 0xDC00 if n == 2 else words[i]
                out.append((chr(code) if not 0xD800 <= code < 0xE000 else "�", at + 6 * i, at + 6 * (i + n)))
                i += n
            return out
        digits = run.strip("\\uU{}&#;")
        code = int(digits[1:], 16) if digits[:1] in "xX" else int(digits, 10 if run[0] == "&" else 16)
        return [(chr(code), at, m.end())] if code < 0x110000 and not 0xD800 <= code < 0xE000 else []

    def _base64(self, layer: Layer) -> None:
        text = layer.text
        for m in BASE64.finditer(text):
            run = m.group()
            url, plain = "-" in run or "_" in run, "+" in run or "/" in run
            for sub in [m] if not (url and plain) else [x for a in ALPHABETS for x in a.finditer(text, m.start(), m.end())]:
                self._open(layer, sub.group(), np.arange(sub.start(), sub.end()))
        if "\n" in text:
            for m in WRAPPED.finditer(text):
                places = np.array([i for i in range(m.start(), m.end()) if text[i] not in "\r\n"])
                self._open(layer, re.sub(r"\s", "", m.group()), places)

    def _open(self, layer: Layer, run: str, places: np.ndarray) -> None:
        body = run.rstrip("=").replace("-", "+").replace("_", "/")
        for k in range(min(4, len(body))):
            self._aligned(layer, body[k:], places[k:], whole=k == 0)
        for m in re.finditer("[/_-]", run):
            k = m.end()
            if k > 3 and len(body) - k >= LEAST_TEXT and opener(base64.b64decode(body[k : k + 12]))[1]:
                self._packed(layer, decoded(body[k:]), int(places[k]), int(places[-1]) + 1, "base64")

    def _aligned(self, layer: Layer, body: str, places: np.ndarray, whole: bool) -> None:
        data = decoded(body)
        if self._packed(layer, data, int(places[0]), int(places[-1]) + 1, "base64"):
            return
        if whole and (text := as_text(data)) is not None:
            ends = np.cumsum([len(c.encode()) for c in text])
            found = [(text, np.concatenate([[0], ends[:-1]]), ends)]
        else:
            found = stretches(data)
        for text, first, after in found:
            self._add(layer.child(text, places[first * 4 // 3], places[np.minimum((after * 4 + 2) // 3, len(places)) - 1] + 1, "base64"))


def decoded(body: str) -> bytes:
    """Bytes of base64 without padding; a last sign that stands for no byte is left."""
    body = body[: len(body) - (len(body) % 4 == 1)]
    return base64.b64decode(body + "=" * (-len(body) % 4))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_decoded: int = MAX_DECODED) -> DataFrame:
    """Per row: base (spans of the plain text), found (spans of all layers, each once), layers opened, layers too large."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("layer", pa.string()), ("value", pa.string())]))
        for batch in portions(batches):
            base, found, opened, unopened = [], [], [], []
            for text in batch.column(1).to_pylist():
                work = Worklist(text, max_decoded).run()
                base.append([{"kind": KINDS[k], "start": a, "stop": b, "layer": "", "value": text[a:b]} for a, k, b in work.base])
                found.append([{"kind": KINDS[k], "start": a, "stop": b, "layer": path, "value": value} for (a, k, b), (path, value) in sorted(work.found.items())])
                opened.append(work.opened)
                unopened.append(work.unopened)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, kind), pa.array(found, kind), pa.array(opened, pa.int32()), pa.array(unopened, pa.int32())], ["doc_id", "base", "found", "n_layers", "n_unopened"]
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(rows, SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """Counts per kind, and the spans as text kind:start:stop joined by commas."""
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(listed("base"), 256).alias("base_sha256"), listed("found").alias("spans"), (F.size("found") - F.size("base")).cast("bigint").alias("n_added"), "n_unopened")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]", max_decoded: int = MAX_DECODED) -> DataFrame:
    """The same rows and columns; stretches that hold a secret, plain or wrapped, or stay unopened are replaced. A null text stays null."""

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        work = Worklist(text, max_decoded).run()
        for a, b in sorted([(a, b) for a, _, b in work.found] + work.closed):
            if b > at:
                out += [text[at:a], mark] if a >= at else []  # a stretch that overlaps the last one goes on with it
                at = b
        return "".join([*out, text[at:]])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            k = batch.schema.get_field_index(text_col)
            yield batch.set_column(k, batch.schema.field(k), pa.array([clean(t) for t in batch.column(k).to_pylist()], batch.schema.field(k).type))

    shipped(docs.sparkSession)
    return docs.mapInArrow(rows, docs.schema)
