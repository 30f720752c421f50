"""Byte-pair encoding with content-defined chunk reuse, and decoding; exact against the tokenizers library."""

from __future__ import annotations

import hashlib
import json
import sys
from array import array

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from .common import text_slices, with_columns

#: Pre-token pattern of byte-level BPE vocabularies of this family (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEGMENTS = 150_000  # segments kept by a worker for each of two caches
SEGMENT_CHARS = 48  # longer ones aren't kept
CHUNK_BYTES = 12 << 20  # text of the chunks that a worker keeps
LEAST, MOST, MASK = 512, 8192, np.uint32(0x3FF << 20)  # bytes of a chunk; a cut where the rolling hash has these bits zero: one byte in 1024
_GEAR = np.random.Generator(np.random.PCG64(77)).integers(0, 2**32, 256, dtype=np.uint32)


def byte_of_char() -> dict[str, int]:
    """The byte for each printable stand-in of the vocabulary file: printable bytes stand for themselves, others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


#: White space besides space and line feed, in Unicode's sense or Python's.
_RARE_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]


def _single(text: str) -> bool:
    """Whether no space in the text surely follows white space (a quick test; False may be wrong)."""
    return "  " not in text and "\n " not in text and not any(c in text for c in _RARE_SPACE)


class _Segments(dict):
    """Little-endian ids of a segment, made when first asked for."""

    def __init__(self, before: str, encode):
        super().__init__()
        self.before, self.encode = before, encode

    def __missing__(self, text: str) -> bytes:
        ids = _packed(self.encode(self.before + text))
        if len(text) <= SEGMENT_CHARS:
            if len(self) >= SEGMENTS:
                self.clear()
            self[text] = ids
        return ids


class Encoder:
    """Encodes and decodes with a byte-level BPE vocabulary (the JSON of the tokenizers library)."""

    def __init__(self, vocabulary: bytes):
        spec = json.loads(vocabulary)
        chars = byte_of_char()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = sorted(self.special, key=len, reverse=True)
        ranks = {bytes(chars[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        made = [spec["model"]["vocab"][a + b] for a, b in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])]
        if made != sorted(made) or spec["normalizer"] or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("a byte-level vocabulary whose ids follow its merges is needed")
        self.plain = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.bytes_of: list[bytes] = [b""] * (1 + max([*ranks.values(), *self.special.values()]))
        for token, i in ranks.items():
            self.bytes_of[i] = token
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.first, self.spaced = _Segments("", self.plain), _Segments(" ", self.plain)
        self.chunks: dict[str, tuple | None] = {}
        self.chunk_bytes = 0

    def _parts(self, parts: list[str], spaced: bool, single: bool) -> bytes:
        """Ids of parts split at spaces; spaced: a space stands before the first; single: each part ends with a character.

        A pre-token ends before each space that follows another character than white space, so such segments are encoded alone.
        """
        if not single:
            out, held, space = [], parts[0], spaced
            for x in parts[1:]:
                if held and not held[-1].isspace():
                    out.append((self.spaced if space else self.first)[held])
                    held, space = x, True
                else:
                    held += " " + x
            out.append((self.spaced if space else self.first)[held])
            return b"".join(out)
        if spaced:
            return b"".join(map(self.spaced.__getitem__, parts))
        return self.first[parts[0]] + b"".join(map(self.spaced.__getitem__, parts[1:]))

    def ordinary(self, text: str) -> bytes:
        return self._parts(text.split(" "), False, _single(text) and text[0] != " ") if text else b""

    def ids(self, text: str, encode=None) -> bytes:
        """Little-endian ids of a whole text; strings of special tokens become their ids, as in the library."""
        encode = encode or self.ordinary
        for name in self.names:
            if name in text:
                mark = np.array([self.special[name]], dtype="<u4").tobytes()
                return mark.join(self.ids(x, encode) for x in text.split(name))
        return encode(text)

    def _chunk(self, text: str) -> tuple | None:
        """(text to the 2nd safe place, ids from the 1st to the 2nd, ids to the last but one, ids from there to the last, text from the last but one).

        A safe place is a space after another character than white space. None: too few of them.
        """
        if text in self.chunks:
            return self.chunks[text]
        parts, entry = text.split(" "), None
        single = _single(text) and text[0] != " " and text[-1] != " "
        safe = range(1, len(parts)) if single else [i for i in range(1, len(parts)) if parts[i - 1] and not parts[i - 1][-1].isspace()]
        if len(safe) >= 4:
            a, b, c, d = safe[0], safe[1], safe[-2], safe[-1]
            entry = (" ".join(parts[:b]), self._parts(parts[a:b], True, single), self._parts(parts[b:c], True, single) if c > b else b"", self._parts(parts[c:d], True, single), " " + " ".join(parts[c:]))
        if self.chunk_bytes > CHUNK_BYTES:
            self.chunks.clear()
            self.chunk_bytes = 0
        self.chunks[text] = entry
        self.chunk_bytes += 3 * len(text) + 200
        return entry

    def _cuts(self, text: str) -> tuple[list[str], list[bytes]]:
        """A chunk cut at all its safe places, and the ids that each cut has in it."""
        parts = text.split(" ")
        at = [0, *[i for i in range(1, len(parts)) if parts[i - 1] and not parts[i - 1][-1].isspace()], len(parts)]
        spans = list(zip(at[:-1], at[1:], strict=True))
        return [(" " if i else "") + " ".join(parts[i:j]) for i, j in spans], [self._parts(parts[i:j], i > 0, False) for i, j in spans]

    def joined(self, chunks: list[str]) -> bytes:
        """Ids of the text that the chunks make up: each chunk's own ids, and across each join the ids of re-encoded text.

        The re-encoded bridge runs from one cut before the join to one after it, and must give both cuts the ids that they have in their
        chunks. Where it doesn't, it is widened by a cut on that side until both agree; if a chunk has no more, the whole text is encoded anew.
        """
        out, pending, left = [], "", b""
        last, begin = None, 2  # the chunk that out ends with, and the first of its cuts there
        for chunk in [*chunks, None]:
            entry = self._chunk(chunk) if chunk is not None else None
            if entry is None and chunk is not None:
                pending += chunk
                continue
            head, right, core, own, tail = entry or ("", b"", b"", b"", "")
            bridge, first = self.ordinary(pending + head), 2
            if not (bridge.startswith(left) and bridge.endswith(right)):
                wide = self._widened(last, begin, pending, chunk)
                if wide is None:
                    return self.ordinary("".join(chunks))
                bridge, a, first = wide
                if last is not None:
                    out[-1] = b"".join(self._cuts(last)[1][begin:a])
                if chunk is not None:
                    core = b"".join(self._cuts(chunk)[1][first:-2])
            out += [bridge, core]
            pending, left, last, begin = tail, own, chunk, first
        return b"".join(out)

    def _widened(self, last: str | None, begin: int, pending: str, chunk: str | None) -> tuple[bytes, int, int] | None:
        """(ids of a bridge on which both chunks agree, its first cut in the last chunk, the cut after it in this one); None if there is none.

        pending: the text from the last cut but one of the last chunk to this chunk. None for a chunk: the text begins or ends here.
        """
        before, after = self._cuts(last) if last is not None else None, self._cuts(chunk) if chunk is not None else None
        a, b = len(before[0]) - 2 if before else 0, 1
        while True:
            bridge = self.ordinary(("".join(before[0][a:-2]) if before else "") + pending + ("".join(after[0][: b + 1]) if after else ""))
            good = not before or bridge.startswith(before[1][a]), not after or bridge.endswith(after[1][b])
            if all(good):
                return bridge, a, b + 1
            a, b = a - (not good[0]), b + (not good[1])
            if (before and a < begin) or (after and b >= len(after[0]) - 2):
                return None

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


def cuts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Candidate cuts of a buffer of texts: after bytes where a rolling hash of 16 bytes has the bits of MASK zero, at characters' starts."""
    h = _GEAR[buf]
    for width in (1, 2, 4, 8):
        step = h.copy()
        step[width:] += h[:-width] << np.uint32(width)
        h = step
    at = np.flatnonzero((h & MASK) == 0) + 1
    at = at[at < len(buf)]
    for _ in range(3):
        at = np.where((at < len(buf)) & ((buf[np.minimum(at, len(buf) - 1)] & 0xC0) == 0x80), at + 1, at)
    return at


def chunked(raw: bytes, lo: int, hi: int, at: list[int]) -> list[str]:
    """The text raw[lo:hi] in chunks of LEAST bytes or more; one longer than MOST is cut there too."""
    out, begin = [], lo
    for cut in [*at, hi]:
        while cut - begin > MOST:
            end = begin + MOST
            while raw[end] & 0xC0 == 0x80:
                end += 1
            if end >= cut:
                break
            out.append(raw[begin:end].decode())
            begin = end
        if cut == hi or cut - begin >= LEAST:
            out.append(raw[begin:cut].decode())
            begin = cut
    return out


_encoders: dict[bytes, Encoder] = {}


def encoder(vocabulary: bytes) -> Encoder:
    """This worker's encoder of the vocabulary."""
    key = hashlib.sha256(vocabulary).digest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def text_ids(texts: pa.Array, enc: Encoder, reuse: bool = True):
    """Yield the little-endian ids of each text (null: empty)."""
    for _, _, buf, offsets in text_slices(texts):
        raw = buf.tobytes()
        at = cuts(buf, offsets) if reuse and len(buf) else np.zeros(0, np.int64)
        place = np.searchsorted(at, offsets, side="right")
        for d in range(len(offsets) - 1):
            lo, hi = int(offsets[d]), int(offsets[d + 1])
            text = raw[lo:hi].decode()
            if not reuse:
                yield enc.ids(text)
            elif any(x in text for x in enc.names):
                yield enc.ids(text)
            else:
                inner = at[place[d] : place[d + 1]]
                yield enc.joined(chunked(raw, lo, hi, inner[inner < hi].tolist())) if hi > lo else b""


def load_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def bpe_encode(df: DataFrame, vocabulary: bytes, text_col: str = "text", decode: bool = True) -> DataFrame:
    """Add n_tokens, ids (binary, little-endian unsigned 32-bit) and, on demand, decoded (the text decoded again) to each row.

    Texts are cut where a rolling hash of their bytes says so; equal chunks get equal cuts in any document, so a worker encodes a chunk
    once and reuses its ids (bounded caches), then re-encodes over each join of chunks. One pass without a shuffle; a lost executor
    only repeats its tasks. Null and empty texts have no tokens. Strings of special tokens in a text become those tokens, as the
    library has it. Columns of df named n_tokens, ids or decoded are replaced. The vocabulary (a fixed file) is broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def make(cols):
        enc = encoder(shared.value)
        ids = list(text_ids(cols[0], enc))
        out = [[len(x) // 4 for x in ids], ids]
        return [*out, [enc.decode(x) for x in ids]] if decode else out

    fields = [("n_tokens", "long"), ("ids", "binary")] + [("decoded", "string")] * decode
    return with_columns(df, fields, make, [text_col])


def bpe_digests(df: DataFrame, vocabulary: bytes, text_col: str = "text") -> DataFrame:
    """As bpe_encode, with digests in place of ids and text: n_tokens, ids_sha256 and decoded_sha256 (lowercase hex).

    Null and empty texts have the digests of nothing. Each of several equal rows has its result; an empty table gives an empty table.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def make(cols):
        enc = encoder(shared.value)
        rows = [(len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(enc.decode(x).encode()).hexdigest()) for x in text_ids(cols[0], enc)]
        return [list(x) for x in zip(*rows, strict=True)] if rows else [[], [], []]

    return with_columns(df, [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")], make, [text_col])
