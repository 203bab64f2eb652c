"""Byte-pair encoding and decoding by forced-boundary splitting.

A merge can only ever produce a token of the vocabulary.  So where two
neighbouring symbols (bytes, the last one of a word marked when the
vocabulary marks word ends) stand side by side inside no token at all, no
merge can cross them: a cut there is certain.  Each word is cut at all such
places, the fragments are merged independently, and their ids are
concatenated; the result equals merging the whole word.

The vocabulary file is that of a public tokenizer and is read on every
executor from ``path`` (a parameter; it must be the same on all machines).
"""

from __future__ import annotations

import heapq
import json
import re
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile.llm.common import text_slices

# Characters on which lower-casing, composition and the classes below are
# plain; a text with any other goes through the library's own normaliser.
PLAIN = regex.compile(r"[\x00-ɏ‐-‧€]*")
# The patterns that public byte-pair tokenizers cut words with,
# their classes spelled out for plain texts and what these become in lower case.
LETTER, NUMBER, SPACE = "A-Za-zªµºÀ-ÖØ-öø-ʯⱥⱦ", "0-9²³¹¼½¾", r"\t-\r\x20\x85\xA0"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+"
BYTE_WORDS = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+"
              rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

NO_RANK = 1 << 40
HEAP_FROM = 192      # symbols from which merging goes through a heap
WORD_CACHE = 500_000  # words remembered per Python worker


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary: a byte
    that is a visible Latin-1 character stands for itself, the others take
    the characters from U+0100 on."""
    visible = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


def is_plain(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return PLAIN.fullmatch(text) is not None


class WordCache(dict):
    """word -> its ids as 32-bit bytes, filled on demand by ``encode`` until it
    is full: frequent words come early and stay."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        got = array("i", self.encode(word)).tobytes()
        if len(self) < WORD_CACHE:
            self[word] = got
        return got


class BpeCodec:
    """Encoder and decoder for one vocabulary file (byte-level BPE without a
    decoder-side post-processor, with or without a word-end mark)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.path = path
        self.suffix = model.get("end_of_word_suffix") or ""
        self.lower = spec.get("normalizer") is not None
        self.byte_level_decoder = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        self.pattern = re.compile(WORDS if self.lower else BYTE_WORDS)
        self.stand_in = byte_alphabet()
        self.to_byte = {c: b for b, c in self.stand_in.items()}
        self.symbol_id = [vocab.get(self.stand_in[s & 255] + (self.suffix if s > 255 else "")) for s in range(512)]

        tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.tokens = [tokens.get(i) for i in range(max(tokens) + 1)]
        self.inside = bytearray(512 * 512)  # 1 where two symbols are neighbours inside some token
        for token in vocab:
            s = self.symbols(token)
            for a, b in zip(s, s[1:]):
                self.inside[a << 9 | b] = 1
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault(vocab[a] << 20 | vocab[b], len(self.merged))
            self.merged.append(vocab[a + b])
        self.words = WordCache(self.word_ids)
        self._library = None

    @property
    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer
            self._library = Tokenizer.from_file(self.path)
        return self._library

    def symbols(self, token: str) -> list[int]:
        ended = bool(self.suffix) and token.endswith(self.suffix) and len(token) > len(self.suffix)
        s = [self.to_byte[c] for c in (token[: -len(self.suffix)] if ended else token)]
        if ended:
            s[-1] += 256
        return s

    # ------------------------------------------------------------ encoding
    def fragments(self, symbols: list[int]) -> list[list[int]]:
        """Cut where two symbols are neighbours inside no token."""
        inside, out, start = self.inside, [], 0
        for i in range(1, len(symbols)):
            if not inside[symbols[i - 1] << 9 | symbols[i]]:
                out.append(symbols[start:i])
                start = i
        out.append(symbols[start:])
        return out

    def word_ids(self, word: str) -> list[int]:
        symbols = list(word.encode("utf-8"))
        if not symbols:
            return []
        if self.suffix:
            symbols[-1] += 256
        out: list[int] = []
        for fragment in self.fragments(symbols):
            out += self.merge(fragment)
        return out

    def merge(self, fragment: list[int]) -> list[int]:
        """Ids of one fragment: the lowest-ranked pair first, the leftmost
        where ranks tie."""
        ids = [self.symbol_id[s] for s in fragment]
        if len(ids) > HEAP_FROM:
            return self._merge_long(ids)
        get, merged = self.rank.get, self.merged
        ranks = [get(a << 20 | b, NO_RANK) for a, b in zip(ids, ids[1:])]
        while ranks:
            r = min(ranks)
            if r == NO_RANK:
                break
            i = ranks.index(r)
            ids[i:i + 2] = [merged[r]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | ids[i], NO_RANK)
            if i < len(ranks):
                ranks[i] = get(ids[i] << 20 | ids[i + 1], NO_RANK)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same merges over a linked list with a heap, n log n."""
        n = len(ids)
        get = self.rank.get
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i] if i < n else n
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], right[i] = self.merged[r], -1, right[j]
            if right[j] < n:
                left[right[j]] = i
            for p in (left[i], i):
                q = right[p] if p >= 0 else n
                if q < n and (r2 := get(ids[p] << 20 | ids[q])) is not None:
                    heapq.heappush(heap, (r2, p, ids[p], ids[q]))
        return [t for t in ids if t >= 0]

    def split_words(self, text: str) -> list[str]:
        if is_plain(text):
            return self.pattern.findall(text.lower() if self.lower else text)
        lib = self.library
        if lib.normalizer is not None:
            text = lib.normalizer.normalize_str(text)
        return [bytes(map(self.to_byte.__getitem__, w)).decode("utf-8")
                for w, _ in lib.pre_tokenizer.pre_tokenize_str(text)]

    def library_ids(self, word: str) -> list[int]:
        """Ids of one word from the library's own model."""
        if word.isascii() and word.isprintable():  # all but the space stand for themselves
            word = word.replace(" ", self.stand_in[0x20])
        else:
            word = "".join(map(self.stand_in.__getitem__, word.encode("utf-8")))
        return [t.id for t in self.library.model.tokenize(word)]

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian 32-bit bytes.  Strings of
        special tokens become those tokens, as the library does by default."""
        if not text:
            return b""
        word = self.words.__getitem__
        if "<|" not in text:
            return b"".join(map(word, self.split_words(text)))
        out, at = [], 0
        for m in self.special_split.finditer(text):
            out += map(word, self.split_words(text[at:m.start()]))
            out.append(np.array([self.special[m[0]]], dtype="<i4").tobytes())
            at = m.end()
        out += map(word, self.split_words(text[at:]))
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype="<i4").tolist()

    # ------------------------------------------------------------ decoding
    def decode(self, ids: list[int]) -> str:
        """Special tokens are kept.  A vocabulary with a byte-level decoder
        gives back the bytes; one without a decoder gives its tokens joined
        by spaces, as the library does."""
        if not self.byte_level_decoder:
            return " ".join(t for t in map(self.tokens.__getitem__, ids) if t is not None)
        out, held = [], bytearray()
        for i in ids:
            token = self.tokens[i]
            if token in self.special:
                out += [held.decode("utf-8", "replace"), token]
                held = bytearray()
            elif token is not None:
                held += bytes(map(self.to_byte.__getitem__, token))
        return "".join([*out, held.decode("utf-8", "replace")])


_CODECS: dict[tuple[str, bool], BpeCodec] = {}


def codec(path: str, library_words: bool = False) -> BpeCodec:
    """One codec per vocabulary and Python worker.  ``library_words`` takes
    the ids of words not yet remembered from the tokenizers library."""
    key = (path, library_words)
    if key not in _CODECS:
        _CODECS[key] = c = BpeCodec(path)
        if library_words:
            c.words = WordCache(c.library_ids)
    return _CODECS[key]


def id_lists(encoded: list[bytes]) -> pa.ListArray:
    """Arrow lists over the encoded bytes, without a Python object per id."""
    offsets = np.zeros(len(encoded) + 1, dtype=np.int32)
    np.cumsum([len(e) // 4 for e in encoded], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(encoded), dtype="<i4")))


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode it again.

    Returns one row per input row: ``id_col``, ``ids`` array<int>,
    ``decoded`` string.  A null or empty text has no ids and decodes to the
    empty string; null ids and repeated rows are passed through; other
    columns are not read, so their names cannot clash.  An empty table gives
    an empty result.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = src.schema["id"].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("decoded", T.StringType())])

    def run(batches):
        c = codec(path)
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                encoded = [c.encode_bytes(t) for t in texts]
                decoded = [c.decode(np.frombuffer(e, dtype="<i4").tolist()) for e in encoded]
                yield pa.RecordBatch.from_arrays([part.column("id"), id_lists(encoded), pa.array(decoded, pa.string())],
                                                 names=["id", "ids", "decoded"])

    return src.mapInArrow(run, schema).select(F.col("id").alias(id_col), "ids", "decoded")
