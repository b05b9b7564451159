"""Byte-pair encoding and decoding of whole texts (operator 4).

A word is held as a contiguous array of part boundaries and the ranks of adjacent parts; the smallest rank (the
leftmost of equals) is looked for again and again, its boundary deleted and the two neighbouring ranks refreshed.
Words of more than SCAN parts, where scanning would take quadratic time, merge in the same order from a heap.

The pattern never crosses white space, so a text's ids are those of its white-space chunks, and frequent chunks are
coded once a worker. Defined results: a null text counts as empty and has no ids; the strings of the added tokens
are those tokens wherever they stand, as in the library.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tickloom.llm.common import bounded_batches
from tickloom.llm.worker import Remembered, cache, lean

#: Longest word, in parts, that is scanned.
SCAN = 64
#: Bytes of chunks and words in each of the two generations that a worker remembers, and the longest one; bounds memory, not the result.
REMEMBERED, REMEMBERED_LENGTH = 32 << 20, 60
#: Texts in one Arrow batch that goes back.
SLICE = 256
NONE = 1 << 60
#: A pattern by which a stretch of letters is one word.
LETTERS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: From here on the tokenizer's own character tables decide, which are of another version than Python's.
BEYOND = "\u0500"
#: Bits of an id in a packed pair, and in a packed (rank, merged id).
ID = 20
# White space as the library's pattern \s has it.
SPACE = r"\p{White_Space}"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 bytes stand for themselves, the rest follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Memory:
    """Ids by text, as int32 bytes: the generation that fills, and the one before it."""

    def __init__(self, most: int):
        self.most, self.known, self.older = most, Remembered(2 * most), {}

    def put_all(self, new: dict[str, bytes]) -> None:
        """Those of a text together; so many that they would fill a generation alone aren't kept."""
        if max(map(len, new)) > REMEMBERED_LENGTH:
            new = {key: ids for key, ids in new.items() if len(key) <= REMEMBERED_LENGTH}
        size = sum(map(len, new)) + sum(map(len, new.values())) + len(new) * Remembered.ENTRY
        if size > self.most:
            return
        if self.known.taken > self.most:
            self.known, self.older = Remembered(2 * self.most), self.known
        self.known.update(new)  # what a generation takes stays at the bound at which it would empty itself
        self.known.taken += size


class Bpe:
    """A tokenizer file of the word-end kind: NFC, white space to one blank, lower case, pattern, byte letters, BPE."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*vocab.values(), *self.added.values()]))
        for token, i in [*vocab.items(), *self.added.items()]:
            self.tokens[i] = token
        self.ranks: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[a] << ID | vocab[b]] = rank << ID | vocab[a + b]
        letters = byte_letters()
        self.byte = {x: b for b, x in enumerate(letters)}
        self.inner = [vocab[x] for x in letters]
        self.last = [vocab[x + self.end] for x in letters]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.letters = pattern == LETTERS
        self.pieces = regex.compile(pattern.replace(r"\s", SPACE))
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.marks = list(self.added)
        self.leads = tuple({x[0] for x in self.marks})
        # Of the pairs of bytes that a word begins with, what `ranks` has: inside the word and at its end.
        pair = self.ranks.get
        self.inside, self.ending = ([[pair(a << ID | b, NONE) for b in second] for a in self.inner] for second in (self.inner, self.last))
        self.space = regex.compile(f"[{SPACE}]+")
        self.cutter_spec = {**spec, "added_tokens": [], "post_processor": None, "model": {**model, "vocab": {}, "merges": []}}
        self.cutter = None
        self.table = np.array(self.tokens, object)
        self.chunks, self.fresh = Memory(REMEMBERED), {}  # fresh: words of the text that is being coded

    def word(self, data: bytes) -> list[int]:
        """Ids of one word, given as its bytes."""
        inner, n = self.inner, len(data)
        parts = [inner[b] for b in data]
        parts[-1] = self.last[data[-1]]
        if n > SCAN:
            return self._heap(parts)
        inside = self.inside
        ranks = [inside[a][b] for a, b in zip(data, data[1:-1], strict=False)]
        if n > 1:
            ranks.append(self.ending[data[-2]][data[-1]])
        return self._scan(parts, ranks)

    def _scan(self, parts: list[int], ranks: list[int]) -> list[int]:
        """ranks: of each part with the one behind it."""
        find = self.ranks.get
        while ranks and (best := min(ranks)) != NONE:
            i = ranks.index(best)
            merged = best & (1 << ID) - 1
            parts[i] = merged
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = find(parts[i - 1] << ID | merged, NONE)
            if i < len(ranks):
                ranks[i] = find(merged << ID | parts[i + 1], NONE)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after, before, alive = [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n
        queue = [(f, i, parts[i], parts[i + 1]) for i in range(n - 1) if (f := self.ranks.get(parts[i] << ID | parts[i + 1]))]
        heapq.heapify(queue)
        while queue:
            best, i, a, b = heapq.heappop(queue)
            j = after[i]
            if not alive[i] or j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j] = best & (1 << ID) - 1, False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (f := self.ranks.get(parts[x] << ID | parts[y])):
                    heapq.heappush(queue, (f, x, parts[x], parts[y]))
        return [p for p, live in zip(parts, alive, strict=True) if live]

    def part(self, word: str | bytes) -> bytes:
        """Ids of a normalised word, as int32 bytes. As a chunk it has the same ones, so both are remembered together."""
        ids = self.fresh.get(word) or self.chunks.known.get(word) or self.chunks.older.get(word)
        if ids is None:
            ids = array("i", self.word(word.encode() if isinstance(word, str) else word)).tobytes()
        self.fresh[word] = ids
        return ids

    def chunk(self, chunk: str) -> bytes:
        """Ids, as int32 bytes, of a stretch of text without white space."""
        for x in self.leads:
            if x in chunk:
                break
        else:
            if self.letters and chunk.isalpha() and (word := self.lettered(chunk)):
                return array("i", self.word(word.encode())).tobytes() if word == chunk else self.part(word)  # the chunk itself wasn't known
            return b"".join(map(self.part, self.words(chunk)))
        if any(x in chunk for x in self.marks):
            return b"".join([array("i", [self.added[x]]).tobytes() if x in self.added else b"".join(map(self.part, self.words(x))) for x in self.special.split(chunk)])
        return b"".join(map(self.part, self.words(chunk)))

    @staticmethod
    def lettered(part: str) -> str:
        """A stretch of letters as the one normalised word that it is; nothing where that takes a closer look."""
        if part.isascii():
            return part.lower()
        if max(part) < BEYOND:
            word = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            return word if word.isalpha() else ""
        return ""

    def words(self, part: str) -> list:
        """Normalised words of a stretch. Those with rarer characters are cut by the library's own steps before BPE, made from the same file."""
        if part.isascii():
            return self.pieces.findall(part.lower())
        if max(part) < BEYOND:
            return self.pieces.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())  # letter by letter: no final sigma
        if self.cutter is None:
            from tokenizers import Tokenizer

            self.cutter = Tokenizer.from_str(json.dumps(self.cutter_spec))
        return [bytes([self.byte[x] for x in word]) for word, _ in self.cutter.pre_tokenizer.pre_tokenize_str(self.cutter.normalizer.normalize_str(part))]

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        chunks = text.split() if not any(x in text for x in "\x1c\x1d\x1e\x1f") else self.space.split(text)
        found = list(map(self.chunks.known.get, chunks))
        if None in found:
            new = {c: None for c, f in zip(chunks, found, strict=True) if f is None}
            older, code = self.chunks.older.get, self.chunk
            for c in new:
                new[c] = older(c) or code(c)
            self.chunks.put_all(self.fresh | new)
            self.fresh.clear()
            found = [new[c] if f is None else f for c, f in zip(chunks, found, strict=True)]
        return np.frombuffer(b"".join(found), np.int32)

    def decode(self, ids) -> str:
        """Without a decoder in the file the library joins the tokens with blanks."""
        return " ".join(self.table[np.asarray(ids, np.int64)].tolist())


def bpe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, path: str | None = None, decode: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: its id, the columns to keep, ids (array of int) and decoded (text; null unless asked for)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(path or default_path(), encoding="utf-8") as f:
        held = spark.sparkContext.broadcast(f.read())
    key = zlib.crc32(held.value.encode())
    kept = [id_col, *keep]
    cols = [f"c{i} {kind}" for i, (_, kind) in enumerate(docs.select(*kept).dtypes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Bpe = cache("bpe", key, lambda: Bpe(held.value))
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                coded = [model.encode(t) for t in part.column(len(cols)).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in coded])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(coded)))
                texts = pa.array([model.decode(x) if decode else None for x in coded], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(cols)], ids, texts], names=[*(c.split(" ")[0] for c in cols), "ids", "decoded"])

    coded = docs.select(*kept, text_col).mapInArrow(lean(run), ", ".join([*cols, "ids array<int>", "decoded string"]))
    return coded.toDF(*kept, "ids", "decoded")
