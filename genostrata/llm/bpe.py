"""Byte-level BPE encoding and decoding of whole texts.

A text is cut at the vocabulary's added tokens, then by its pattern into words. The symbols
of a word (its UTF-8 bytes at first) are a doubly linked list; a priority queue holds the
rank of each neighbouring pair that merges, and the entry of least rank, then leftmost, is
merged. An entry whose symbols have changed since it was queued is stale and skipped.
Decoding concatenates the strings of the vocabulary and maps their characters back to bytes.

Words repeat, so each task keeps the ids of those it has met, in a table of bounded size.
"""

from __future__ import annotations

import heapq
import json
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genostrata.llm.common import add_text_columns, fresh, read

#: The file of the machine's package of public tokenizers that the query takes.
VOCABULARY = "byte_bpe_50k.json"
#: The pattern that byte-level vocabularies of this kind cut words by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters and numbers that the pattern library has from a newer Unicode than the
#: tokenizers library, to which they are marks.
NEWER = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 "
    "10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF "
    "18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF "
    "1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
#: Words whose ids a task remembers, and the longest such word in characters.
MOST_WORDS, LONGEST_WORD = 500_000, 64
#: Characters that are cut into words at a time; a text is parted only between a word and blanks.
PIECE = 1 << 20

_NEWER = regex.compile("[" + "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in NEWER.split()) + "]")
_BORDER = regex.compile(r"(?<=\S)(?=\s)")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary's strings.

    Printable bytes of Latin-1 stand for themselves, the others for letters from U+0100 on.
    """
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


def pack_ids(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


def unpack_ids(data: bytes) -> tuple[int, ...]:
    return struct.unpack(f"<{len(data) // 4}I", data)


class Vocabulary:
    """Merges, strings and added tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        model, cut = found["model"], found["pre_tokenizer"]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or found["normalizer"] or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or not cut.get("use_regex", True):
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        added = found["added_tokens"]
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path} has added tokens with rules of their own")
        ids = model["vocab"]
        letters = byte_letters()
        self.first = [ids[c] for c in letters]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[left], ids[right]] = (rank, ids[left + right])
        self.added = {t["content"]: t["id"] for t in added}
        names = sorted(map(regex.escape, self.added), key=len, reverse=True)
        self.marks = regex.compile(f"({'|'.join(names)})") if names else None
        self.words = regex.compile(PATTERN)
        byte = {c: bytes([b]) for b, c in enumerate(letters)}
        strings = {i: s for s, i in ids.items()} | {i: s for s, i in self.added.items()}
        self.strings = {i: b"".join(byte[c] for c in s) if all(c in byte for c in s) else s.encode() for i, s in strings.items()}
        self.known: dict[str, bytes] = {}

    def merged(self, symbols: list[int]) -> list[int]:
        """The symbols of one word after all merges."""
        n, merges = len(symbols), self.merges
        queue = []
        for i, pair in enumerate(pairwise(symbols)):
            if pair in merges:
                queue.append((*merges[pair], i))
        if not queue:
            return symbols
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapq.heapify(queue)
        while queue:
            _, made, i = heapq.heappop(queue)
            j = after[i]
            if j == n or symbols[i] < 0 or merges.get((symbols[i], symbols[j]), (0, -1))[1] != made:
                continue  # stale
            symbols[i], symbols[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (pair := (made, symbols[k])) in merges:
                    heapq.heappush(queue, (*merges[pair], i))
            if (h := before[i]) >= 0 and (pair := (symbols[h], made)) in merges:
                heapq.heappush(queue, (*merges[pair], h))
        return [s for s in symbols if s >= 0]

    def of_word(self, word: str) -> bytes:
        """Ids of one word, little-endian."""
        first = self.first
        ids = pack_ids(self.merged([first[b] for b in word.encode("utf-8", "replace")]))
        if len(word) <= LONGEST_WORD and (word.isascii() or not _NEWER.search(word)):
            if len(self.known) >= MOST_WORDS:
                self.known.clear()
            self.known[word] = ids
        return ids

    def of_words(self, piece: str) -> bytes:
        """Ids of a piece of text; a word that is not known yet may have to be cut anew."""
        words, known = self.words.findall(piece), self.known
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            if not piece.isascii() and any(_NEWER.search(w) for w in words if w not in known):
                # A mark stands for each newer letter while words are found.
                found, at, words = self.words.findall(_NEWER.sub("\u20ac", piece)), 0, []
                for word in found:
                    words.append(piece[at : at + len(word)])
                    at += len(word)
            return b"".join([known.get(w) or self.of_word(w) for w in words])

    def _pieces(self, text: str) -> Iterator[str]:
        """``text`` in parts that words do not cross."""
        at = 0
        while len(text) - at > PIECE and (border := _BORDER.search(text, at + PIECE)):
            yield text[at : border.start()]
            at = border.start()
        yield text[at:] if at else text

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; a null text has none."""
        out = []
        for part in self.marks.split(text) if text and self.marks else [text or ""]:
            if part in self.added:
                out.append(pack_ids([self.added[part]]))
            else:
                out += map(self.of_words, self._pieces(part))
        return b"".join(out)

    def decode(self, ids: bytes | None) -> str:
        """The text of little-endian ids; ids that the vocabulary lacks have no text."""
        strings = self.strings
        found = unpack_ids(ids or b"")
        try:
            data = b"".join(map(strings.__getitem__, found))
        except KeyError:
            data = b"".join(strings.get(i, b"") for i in found)
        return data.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read once in each worker."""
    return Vocabulary(path)


def _n_tokens(ids: str) -> Column:
    return F.expr(f"cast(octet_length(`{ids}`) div 4 as bigint)")


def encode(docs: DataFrame, text: str = "text", *, path: str | None = None) -> DataFrame:
    """``docs`` without ``text`` plus n_tokens and ids (binary: little-endian, four bytes each).

    Whole texts are encoded as they are, added tokens in them as such, with nothing put
    before or after; null and empty texts have no tokens. Repeated rows, ties and nulls
    elsewhere do not matter; other columns pass through, and those named like the new ones
    are replaced. ``path`` must exist on all machines; the default asks each for its own.
    """
    vocabulary(path or vocabulary_path())  # a missing or unfit file is an error at once
    kept = [c for c in docs.columns if c.lower() not in ("n_tokens", "ids") or c == text]
    (plain,) = fresh(["n_tokens", "ids", *kept], "text_to_encode")

    def make():
        encoded = vocabulary(path or vocabulary_path()).encode
        return lambda texts: ([encoded(t) for t in texts],)

    rows = docs.select(*[c for c in kept if c != text], F.col(text).alias(plain))
    return add_text_columns(rows, plain, make, "ids binary").withColumn("n_tokens", _n_tokens("ids"))


def decode(rows: DataFrame, ids: str = "ids", text: str = "text", *, path: str | None = None) -> DataFrame:
    """``rows`` plus column ``text``, decoded from little-endian ``ids``.

    Null or empty ids give an empty text, bytes that are no UTF-8 the replacement character,
    ids beyond the vocabulary nothing. A column named ``text`` is replaced.
    """
    (copy,) = fresh([*rows.columns, text], "ids_to_decode")

    def make():
        decoded = vocabulary(path or vocabulary_path()).decode
        return lambda lists: ([decoded(x) for x in lists],)

    kept = [F.col(c) for c in rows.columns if c.lower() != text.lower()]
    return add_text_columns(rows.select(*kept, F.col(ids).alias(copy)), copy, make, f"`{text}` string")


def op13_bpe_codec(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text decoded from them."""
    encoded = encode(read(spark, sf_dir, "documents").select("doc_id", "text"))
    decoded = decode(encoded)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
