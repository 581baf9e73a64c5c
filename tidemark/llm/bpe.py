"""BPE encoding and decoding with a public vocabulary file.

Merges run on a doubly linked list of symbols with a priority queue of (rank, place); entries whose
symbols have changed since they were queued are stale and skipped. Decoding concatenates vocabulary
strings, with the space that the file's missing decoder puts between tokens.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch

#: Strings that a worker remembers, in each of two generations. It bounds memory, not results.
REMEMBERED = 400_000
#: Bytes of text that are worked on together; longer texts are cut at spaces, which no piece reaches across.
AT_ONCE = 1 << 22
#: Characters that str.split() takes as white space but the vocabulary's normalizer doesn't.
ODD_SPACE = re.compile("[\x1c-\x1f]")
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
#: Runs that stand for themselves among byte letters.
PLAIN = re.compile(r"[\x21-\x7e]+").fullmatch
#: Lower-case runs in which the standard library's patterns can tell letters, digits and the rest as the vocabulary's does.
LATIN = re.compile(r"[\x21-\x7eß-öø-ÿ]+").fullmatch


def unassigned(text: str) -> bool:
    """Has it characters that Python's Unicode tables don't know? Pattern libraries differ on what those are."""
    return any(unicodedata.category(c) == "Cn" for c in text)


def raw_ids(ids: list[int]) -> bytes:
    """Little-endian 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable Latin-1, else from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(spare)) for b in range(256)]


def byte_kinds() -> np.ndarray:
    """Of each byte: 0 for ASCII white space, 1 for letters and all beyond ASCII, 2 for digits, 3 for the rest."""
    b = np.arange(256)
    letter = ((b | 32) >= 97) & ((b | 32) <= 122) | (b >= 128)
    return np.select([(b == 32) | (b >= 9) & (b <= 13), letter, (b >= 48) & (b <= 57)], [0, 1, 2], 3).astype(np.uint8)


KIND = byte_kinds()
#: Lead byte of the letters U+00C0 to U+00FF, and the bytes after it that aren't letters (the signs for times and division).
LATIN_LEAD, LATIN_SIGNS = 0xC3, (0x97, 0xB7)
#: Letters after an apostrophe that make a piece with it.
SHORT_ONE, SHORT_TWO = b"stmd", (b"re", b"ve", b"ll")


def cut_pieces(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, sizes, at) of the pieces of raw, which ends in a space: lower-cased bytes without white space, where each
    piece starts in them and its size, and where it starts in raw. ASCII and U+00C0 to U+00FF are told apart here, by the rules
    of the vocabulary's pattern; a run without white space that has other characters is one piece, as it is."""
    x = np.frombuffer(raw, np.uint8)
    kind = KIND[x]
    solid = kind > 0
    lead = x == LATIN_LEAD
    after = np.r_[False, lead[:-1]]
    odd = (x >= 128) & ~lead & ~(after & (x < 0xC0))
    for sign in LATIN_SIGNS:
        odd |= after & (x == sign)
    upper = (x >= 65) & (x <= 90) | after & (x >= 0x80) & (x < 0x9F)
    word = solid.copy()
    word[1:] &= ~solid[:-1]
    new = solid.copy()
    new[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    y = x + (upper.astype(np.uint8) << 5)
    mark = np.nonzero((x == 39) & new)[0]
    mark = mark[mark + 2 < len(x)]
    one, two = y[mark + 1], y[mark + 2]
    size = np.isin(one, np.frombuffer(SHORT_ONE, np.uint8)).astype(np.int64)
    for pair in SHORT_TWO:
        size[(one == pair[0]) & (two == pair[1])] = 2
    mark, size = mark[size > 0], size[size > 0]
    new[mark + 1] = False
    rest = mark + 1 + size
    new[rest[solid[rest]]] = True
    if odd.any():
        starts = np.nonzero(word)[0]
        own = np.unique(np.searchsorted(starts, np.nonzero(odd)[0], "right") - 1)
        inside = np.zeros(len(x) + 1, np.int8)
        inside[starts[own]] = 1
        gaps = np.nonzero(~solid)[0]
        inside[gaps[np.searchsorted(gaps, starts[own])]] -= 1
        odd = np.cumsum(inside[:-1]) > 0
        new[odd] = word[odd]
        y[odd] = x[odd]
    at = np.nonzero(new)[0]
    place = np.cumsum(solid)
    starts = place[at] - 1
    return y[solid], starts, np.diff(np.r_[starts, place[-1] if len(place) else 0]), at


def segments(raw: bytes) -> Iterator[bytes]:
    """raw in parts of about AT_ONCE bytes, cut where ASCII white space is; whole where there is none."""
    at = 0
    while len(raw) - at > AT_ONCE:
        cut = max(raw.rfind(b" ", at, at + AT_ONCE), raw.rfind(b"\n", at, at + AT_ONCE))
        if cut <= at:
            found = [c for c in (raw.find(b" ", at + AT_ONCE), raw.find(b"\n", at + AT_ONCE)) if c >= 0]
            if not found:
                break
            cut = min(found)
        yield raw[at:cut]
        at = cut
    yield raw[at:]


class Remembered(dict):
    """A function's results by argument; the older half is forgotten when full."""

    def __init__(self, make, size: int = REMEMBERED):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Codec:
    """Text to ids and back, as the file's own library does without truncation, padding or added special tokens."""

    def __init__(self, spec: dict):
        self.spec, self.library, self.table = spec, None, None
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = dict(zip(self.vocab.values(), self.vocab, strict=True)) | {i: s for s, i in self.special.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        v = self.vocab
        self.merges = {(v[a], v[b]): (rank, v[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.letters = byte_letters()
        steps = spec["pre_tokenizer"]["pretokenizers"]
        pattern = steps[0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern)
        self.latin = re.compile(pattern.replace(r"[\p{L}]", "[a-zß-öø-ÿ]").replace(r"\p{L}", "a-zß-öø-ÿ").replace(r"\p{N}", "0-9"))
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.marks = tuple(self.special)
        self.of_piece = Remembered(self.merge, REMEMBERED * 2 // 3)
        self.of_word = Remembered(self.word)
        self.of_cut = Remembered(self.cut_piece)

    def merge(self, piece: str) -> bytes:
        """Ids of one piece, as little-endian 32-bit integers."""
        return self.merge_letters(piece if PLAIN(piece) else "".join([self.letters[b] for b in piece.encode("utf-8", "surrogatepass")]))

    def merge_letters(self, piece: str) -> bytes:
        """Ids of one piece in byte letters."""
        letters = list(piece)
        letters[-1] += self.end
        ids = [i for i in map(self.vocab.get, letters) if i is not None]
        n, merges = len(ids), self.merges
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        queue = [(*found, k) for k, pair in enumerate(pairwise(ids)) if (found := merges.get(pair))]
        heapify(queue)
        while queue:
            rank, made, k = heappop(queue)
            right = after[k]
            if ids[k] is None or right < 0 or merges.get((ids[k], ids[right])) != (rank, made):
                continue  # stale
            ids[k], ids[right] = made, None
            after[k] = nxt = after[right]
            if nxt >= 0:
                before[nxt] = k
                if found := merges.get((made, ids[nxt])):
                    heappush(queue, (*found, k))
            if (prev := before[k]) >= 0 and (found := merges.get((ids[prev], made))):
                heappush(queue, (*found, prev))
        return raw_ids([i for i in ids if i is not None])

    def word(self, word: str) -> bytes:
        """Ids of a run without white space. No piece, and no step of the normalizer, reaches across white space."""
        if not word.isascii() and not LATIN(word.lower()) and unassigned(word):
            return self.newer_word(word)
        plain = word if word.isascii() else unicodedata.normalize("NFC", word)
        plain = plain.lower() if "Σ" not in plain else "".join(c.lower() for c in plain)  # no rule for a final sigma
        of = self.of_piece
        if plain.isalpha():  # the pattern's runs of letters
            return of[plain]
        return b"".join([of[p] for p in (self.latin if LATIN(plain) else self.pieces).findall(plain)])

    def newer_word(self, word: str) -> bytes:
        """The same where only the library's own tables can say what is a letter; merging is ours all the same."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(json.dumps(self.spec))
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(word))
        return b"".join([self.merge_letters(p) for p, _ in pieces])

    def segment(self, text: str) -> bytes:
        words = SPACE.split(text) if ODD_SPACE.search(text) else text.split()
        of = self.of_word
        return b"".join([of[w] for w in words if w])

    def encode_bytes(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.cut and any(m in text for m in self.marks):
            return b"".join(raw_ids([self.special[s]]) if s in self.special else self.segment(s) for s in self.cut.split(text))
        return self.segment(text)

    def cut_piece(self, piece: bytes) -> bytes:
        """Ids of what cut_pieces() calls a piece."""
        if piece.isalpha():  # of ASCII
            return self.merge_letters(piece.decode())
        if piece.isascii() or LATIN(text := piece.decode("utf-8", "surrogatepass")) and text == text.lower():
            return self.merge(piece.decode() if piece.isascii() else text)
        return self.segment(text)

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, and how many each has: encode_bytes() of each, but pieces are found in numpy and
        each distinct piece of a part is looked up once."""
        flat, counts = [], np.zeros(len(texts), np.int64)
        held: list[bytes] = []
        of: list[int] = []
        size = 0

        def close() -> None:
            nonlocal held, of, size
            if held:
                ids, each = self.encode_part(held)
                flat.append(ids)
                np.add.at(counts, of, each)
            held, of, size = [], [], 0

        for n, text in enumerate(texts):
            if not text:
                continue
            if any(m in text for m in self.marks):
                close()
                flat.append(np.frombuffer(self.encode_bytes(text), "<u4"))
                counts[n] = len(flat[-1])
                continue
            for part in segments(text.encode("utf-8", "surrogatepass")):
                held.append(part)
                of.append(n)
                size += len(part)
                if size >= AT_ONCE:
                    close()
        close()
        return np.concatenate(flat) if flat else np.zeros(0, "<u4"), counts

    def encode_part(self, held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw = b" ".join([*held, b""])
        body, starts, sizes, at = cut_pieces(raw)
        offsets = np.r_[starts, len(body)].astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(body)]).dictionary_encode()
        of = self.of_cut
        made = [of[p] for p in words.dictionary.to_pylist()]
        many = np.array([len(m) for m in made], np.int64) // 4
        ids, first = np.frombuffer(b"".join(made), "<u4"), np.cumsum(many) - many
        which = words.indices.to_numpy()
        each = many[which]
        upto = np.r_[0, np.cumsum(each)]
        out = ids[np.repeat(first[which] - upto[:-1], each) + np.arange(upto[-1])]
        ends = np.searchsorted(at, np.cumsum([len(h) + 1 for h in held]), "left")
        return out, np.diff(np.r_[0, upto[ends]])

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids) -> str:
        """Special tokens stay; ids outside the vocabulary give nothing."""
        return " ".join([s for i in ids if (s := self.strings.get(i)) is not None])


    def decode_all(self, ids: np.ndarray, ends: pa.Array) -> pa.Array:
        """decode() of runs of known ids, which end at `ends`."""
        if self.table is None:
            self.table = pa.array([self.strings.get(i, "") for i in range(max(self.strings) + 1)], pa.string())
        return pc.binary_join(pa.ListArray.from_arrays(ends, self.table.take(pa.array(ids))), " ")


_codecs: dict[int, Codec] = {}


def codec_of(spec: str) -> Codec:
    """One codec for each worker."""
    if (key := hash(spec)) not in _codecs:
        _codecs[key] = Codec(json.loads(spec))
    return _codecs[key]


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str | None = "decoded") -> DataFrame:
    """docs' columns, but text, with the ids of each whole text and, if asked for, the text decoded from them.

    vocabulary is a file on the driver. Null and empty texts have no ids and decode to "". Repeated rows
    are encoded each. A column of docs with the name of a new one is left out.
    """
    scratch.long_rows(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    new = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)] + ([T.StructField(decoded, T.StringType(), False)] if decoded else [])
    kept = [c for c in docs.columns if c not in (text, ids, decoded)]
    docs = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(spec.value)
        for batch in batches:
            flat, counts = codec.encode_all(batch.column(batch.num_columns - 1).to_pylist())
            ends = pa.array(np.r_[0, np.cumsum(counts)], pa.int32())
            out = [*batch.columns[:-1], pa.ListArray.from_arrays(ends, pa.array(flat.astype(np.int32)))]
            if decoded:
                out.append(codec.decode_all(flat, ends))
            yield pa.RecordBatch.from_arrays(out, names=[*kept, *(f.name for f in new)])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields[:-1], *new]))


def ids_digest(ids: Column) -> Column:
    """SHA-256 of the decimal ids joined by one space."""
    return F.sha2(F.array_join(ids.cast("array<string>"), " "), 256)
