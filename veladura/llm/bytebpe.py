"""Byte-level BPE of a tokenizers file, with proven whole tokens and caches by word.

A text is cut before spaces, which are always pre-token borders; the piece is the unit of the caches. What a
vocabulary string encodes to alone is proven once per file, so a pre-token found there needs no merge.

For ids, texts of plain characters are cut many at once: borders are found by classes of neighbouring bytes, pre-tokens
are numbered by Arrow's dictionary, and each distinct one is looked up once. Other texts go one by one.
"""

from __future__ import annotations

import json
import re
import string
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

# The pre-token pattern of byte-level BPE files with use_regex.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# A space between white space and white space, or the end, is no border of its own.
UNCUT = re.compile(r"\s (?!\S)")
CACHE_LIMIT = 400_000
# Bytes of texts that are cut at once; classes of bytes: what a plain text has none of, letters, digits, signs, the space, other white space.
CHUNK_BYTES = 8 << 20
ODD, LETTER, DIGIT, SIGN, BLANK, SPACE = range(6)
# The endings that the pattern names first.
ENDINGS = [b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"]


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes for themselves, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def prove_whole_tokens(source: str) -> dict[str, int]:
    """Vocabulary strings that, as a pre-token of their own, merge to exactly one token: string -> id.

    A string qualifies if it is valid UTF-8, is one pre-token, and its own merges end in one token.
    """
    tokenizer = Tokenizer.from_str(source)
    model, splitter = tokenizer.model, Splitter(tokenizer)
    byte_of = {c: b for b, c in enumerate(byte_letters())}
    proven = {}
    for token, ident in tokenizer.get_vocab(with_added_tokens=False).items():
        try:
            text = bytes(byte_of[c] for c in token).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if text and splitter.split(text) == [text] and [t.id for t in model.tokenize(token)] == [ident]:
            proven[text] = ident
    return proven


class Splitter:
    """Pre-tokens of a text. Code points that the library classes otherwise than the pattern get a stand-in for the cut."""

    def __init__(self, tokenizer: Tokenizer):
        self.parts = tokenizer.pre_tokenizer.pre_tokenize_str
        self.find = regex.compile(PRE_TOKEN)
        self.known = set(map(chr, range(128)))
        self.stand_in: dict[int, str] = {}

    def _look_up(self, c: str) -> None:
        self.known.add(c)
        for probe, kind, own in (("a", r"\p{L}", "b"), ("1", r"\p{N}", "2"), ("!", r"[^\s\p{L}\p{N}]", "?")):
            if len(self.parts(probe + c + probe)) == 1:
                if not regex.fullmatch(kind, c):
                    self.stand_in[ord(c)] = own
                return
        if not regex.fullmatch(r"\s", c):
            self.stand_in[ord(c)] = " "

    def split(self, text: str) -> list[str]:
        if not text.isascii():
            for c in set(text) - self.known:
                self._look_up(c)
            if self.stand_in and (seen := text.translate(self.stand_in)) != text:
                return [text[m.start() : m.end()] for m in self.find.finditer(seen)]
        return self.find.findall(text)


class Cutter:
    """Pre-token borders of many texts at once, in UTF-8, for texts of ASCII and Latin letters that the library classes as the pattern does."""

    def __init__(self, splitter: Splitter):
        self.kinds = np.full(256, LETTER, np.uint8)
        self.kinds[:128] = ODD
        for kind, members in ((LETTER, string.ascii_letters), (DIGIT, string.digits), (SIGN, string.punctuation), (BLANK, " "), (SPACE, "\t\n\r")):
            self.kinds[list(members.encode())] = kind
        self.latin = np.zeros(1 << 11, bool)
        for c in range(0xC0, 0x250):
            self.latin[c] = len(splitter.parts(f"a{chr(c)}a")) == 1 and splitter.find.fullmatch(f"a{chr(c)}a") is not None

    def borders(self, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places where pre-tokens begin, and places of characters that are not plain; wrong in the texts that hold such."""
        kind = self.kinds[chars]
        heads = np.flatnonzero(chars >= 0xC0)
        tails = chars[np.minimum(heads + 1, len(chars) - 1)] & 0x3F
        plain = (chars[heads] < 0xE0) & self.latin[(chars[heads].astype(np.int32) & 0x1F) << 6 | tails]
        odd = np.concatenate([np.flatnonzero(kind == ODD), heads[~plain]])
        # A space stays with the word after it; of white space before a word, the last character stands apart from the others.
        space = kind >= BLANK
        word_next = np.append(~space[1:], False)
        word_next[ends[ends > 0] - 1] = False
        border = np.empty(len(chars), bool)
        border[0] = True
        border[1:] = np.where(space[1:], ~space[:-1] | word_next[1:], (kind[1:] != kind[:-1]) & (kind[:-1] != BLANK))
        border[starts[starts < len(chars)]] = True
        signs = np.flatnonzero(border & (chars == ord("'")))
        if len(signs):
            left = ends[np.searchsorted(ends, signs, "right")] - signs
            for ending in ENDINGS:
                met = left > len(ending)
                for k, c in enumerate(ending, 1):
                    met &= chars[np.minimum(signs + k, len(chars) - 1)] == c
                after = signs[met] + len(ending) + 1
                border[signs[met] + 1] = False
                border[after[(after < len(chars)) & (kind[np.minimum(after, len(chars) - 1)] == LETTER)]] = True
        return np.flatnonzero(border), odd


class _Cache(dict):
    """make(key) for absent keys; emptied when full, so that its memory is bounded whatever the corpus."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        if len(self) >= CACHE_LIMIT:
            self.clear()
        self[key] = value = self.make(key)
        return value


class ByteBpe:
    """Token counts and ids of texts as the tokenizers library gives them, without special tokens added."""

    def __init__(self, source: str, proven: dict[str, int]):
        spec = json.loads(source)
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("a byte-level BPE file without normalizer and prefix space is needed")
        added = spec.get("added_tokens") or []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("special tokens that take spaces along are not supported")
        self.special = {t["content"]: t["id"] for t in added}
        self.special_cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        self.proven = proven
        self.tokenizer = Tokenizer.from_str(source)
        self.model, self.splitter = self.tokenizer.model, Splitter(self.tokenizer)
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        self.counts, self.spaced_counts = _Cache(self._count), _Cache(lambda p: self._count(" " + p))
        self.bytes, self.spaced_bytes = _Cache(self._id_bytes), _Cache(lambda p: self._id_bytes(" " + p))
        self.proven_bytes = {p.encode(): i.to_bytes(4, "little") for p, i in proven.items()}
        self.words = _Cache(self._word_bytes)
        self.cutter = Cutter(self.splitter)
        self.merged = 0

    def _merge(self, pre_token: str) -> list[int]:
        self.merged += 1
        return [t.id for t in self.model.tokenize(pre_token.encode().decode("latin-1").translate(self.letters))]

    def _word_bytes(self, word: bytes) -> bytes:
        known = self.proven_bytes.get(word)
        if known is not None:
            return known
        self.merged += 1
        return array("I", [t.id for t in self.model.tokenize(word.decode("latin-1").translate(self.letters))]).tobytes()

    def _count(self, unit: str) -> int:
        return sum(1 if p in self.proven else len(self._merge(p)) for p in self.splitter.split(unit))

    def _id_bytes(self, unit: str) -> bytes:
        ids: list[int] = []
        for p in self.splitter.split(unit):
            ids += [self.proven[p]] if p in self.proven else self._merge(p)
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def _sections(self, text: str):
        """(text, None) between special strings, (string, id) for those."""
        if self.special_cut is None or not any(s in text for s in self.special):
            return [(text, None)]
        return [(part, self.special.get(part)) for part in self.special_cut.split(text) if part]

    def count(self, text: str) -> int:
        total = 0
        for part, ident in self._sections(text):
            if ident is not None:
                total += 1
            elif UNCUT.search(part):
                total += sum(map(self.counts.__getitem__, self.splitter.split(part)))
            else:
                first, *rest = part.split(" ")
                total += self.counts[first] + sum(map(self.spaced_counts.__getitem__, rest))
        return total

    def id_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out = []
        for part, ident in self._sections(text):
            if ident is not None:
                out.append(ident.to_bytes(4, "little"))
            elif UNCUT.search(part):
                out.extend(map(self.bytes.__getitem__, self.splitter.split(part)))
            else:
                first, *rest = part.split(" ")
                out.append(self.bytes[first])
                out.extend(map(self.spaced_bytes.__getitem__, rest))
        return b"".join(out)


    def ids_of(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of every text of a string array, in order, as unsigned 32-bit integers."""
        texts = texts.cast(pa.large_string())
        at, ends = 0, np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        while at < len(texts):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + CHUNK_BYTES, "right")))
            yield from self._ids_of_chunk(texts.slice(at, to - at), ends[at:to] - before)
            at = to

    def _ids_of_chunk(self, texts: pa.Array, ends: np.ndarray) -> list[np.ndarray]:
        starts, size = np.concatenate([[0], ends[:-1]]), int(ends[-1])
        if not size:
            return [np.zeros(0, "<u4")] * len(texts)
        _, places, data = texts.buffers()
        data = data.slice(int(np.frombuffer(places, np.int64)[texts.offset]), size)
        chars = np.frombuffer(data, np.uint8)
        borders, odd = self.cutter.borders(chars, starts, ends)
        slow = np.zeros(len(texts), bool)
        slow[np.searchsorted(ends, odd, "right")] = True
        raw = memoryview(data)
        for special in self.special:
            places = [m.start() for m in re.finditer(re.escape(special.encode()), raw)]
            slow[np.searchsorted(ends, places, "right")] = True
        if slow.any():
            # What is encoded one by one is no word here.
            borders = borders[~slow[np.searchsorted(ends, borders, "right")]]
        if not len(borders):
            return [np.frombuffer(self.id_bytes(t), "<u4") for t in texts.to_pylist()]
        # A word ends where the next begins; before a text of another kind, with its own text.
        last = ends[np.searchsorted(ends, borders, "right")]
        stops = np.minimum(np.append(borders[1:], size), last)
        offsets = np.concatenate([borders, stops[-1:]])
        if (stops[:-1] != borders[1:]).any():
            gaps = np.flatnonzero(stops[:-1] != borders[1:])
            offsets = np.insert(offsets, gaps + 1, stops[gaps])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), data])
        if len(offsets) - 1 != len(borders):
            words = words.take(pa.array(np.searchsorted(offsets, borders)))
        told = words.dictionary_encode()
        values = pa.array(map(self.words.__getitem__, told.dictionary.to_pylist()), pa.large_binary())
        ids = np.frombuffer(values.take(told.indices).buffers()[2], "<u4")
        places = np.concatenate([[0], np.cumsum(pc.binary_length(values).to_numpy()[told.indices.to_numpy()] // 4)])
        low, high = (places[np.searchsorted(borders, x)] for x in (starts, ends))
        return [np.frombuffer(self.id_bytes(texts[i].as_py()), "<u4") if s else ids[a:b] for i, (s, a, b) in enumerate(zip(slow.tolist(), low.tolist(), high.tolist(), strict=True))]


_LOADED: dict[int, ByteBpe] = {}


def loaded(source: str, proven: dict[str, int]) -> ByteBpe:
    """One per worker process and file."""
    key = hash(source)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteBpe(source, proven)
    return _LOADED[key]
