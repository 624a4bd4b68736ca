"""BPE with word ends, encoded between forced boundaries, and its decoding.

Two bytes side by side in a word can only end up in one token if some token of the vocabulary holds them side by side
(with the word's end, if the second is its last). Where no token does, no merge can ever cross, so the word is cut
there, fragments are encoded independently and their ids put one after another. A worker remembers the ids of fragments
and words that it met; nothing is shuffled, a document is encoded where it is read.
"""

from __future__ import annotations

import heapq
import json
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, text_or_empty

FILE = "word_bpe_49k.json"
REMEMBERED = 300_000  # distinct words, and fragments, that a worker remembers, of at most LONGEST bytes
LONGEST = 64
_SHORT = 64  # bytes up to which a plain scan for the best pair is quicker than a heap
_OUT_IDS = 1 << 19  # ids in a batch that is handed back, about

# Fixed value: the split pattern of the vocabulary file.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Fixed value: what marks the last symbol of a word.
END = "</w>"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in token names: itself if it is printable, else the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def splitter() -> regex.Pattern:
    """SPLIT with white space by its Unicode property, as the tokenizers library takes it. Which letters there are follows
    the regex library's Unicode version, so characters assigned after the tokenizers library's version are split apart."""
    return regex.compile(SPLIT.replace(r"\s", r"\p{White_Space}"))


class Vocabulary:
    """Tokens, merges and forced boundaries of a vocabulary file of this kind; ValueError for files of another."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END or model["dropout"] or model["unk_token"] or model["ignore_merges"] or spec["decoder"]:
            raise ValueError("another kind of vocabulary")
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*ids.values(), *self.special.values()]))
        for t, i in [*ids.items(), *self.special.items()]:
            self.tokens[i] = t
        letters = byte_letters()
        self.inner, self.last = ([ids[c + end] for c in letters] for end in ("", END))
        held = {i: (bytes([b]), end) for end, some in enumerate((self.inner, self.last)) for b, i in enumerate(some)}  # bytes of a token, and whether it ends a word
        #: pairs as first << bits | second, and for each rank << bits | token, so the smallest is the one of lowest rank
        self.bits, self.merges = len(self.tokens).bit_length(), {}
        for rank, (a, b) in enumerate(model["merges"]):
            a, b, c = ids[a], ids[b], ids[a + b]
            self.merges.setdefault(a << self.bits | b, rank << self.bits | c)
            held[c] = (held[a][0] + held[b][0], held[b][1])
        joined = np.zeros((2, 256, 256), np.uint8)
        for part, end in held.values():
            for i in range(len(part) - 1):
                joined[int(end and i == len(part) - 2), part[i], part[i + 1]] = 1
        #: [x << 8 | y]: some token holds bytes x, y side by side, y not being the last of its word, or being it
        self.joined, self.joined_last = joined[0].tobytes(), joined[1].tobytes()
        special = "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))
        self.special_split = regex.compile(f"({special})") if special else None
        self.words = splitter().findall

    def fragments(self, word: bytes) -> list[tuple[bytes, bool]]:
        """The word cut at its forced boundaries, and whether a fragment ends the word."""
        out, at, joined = [], 0, self.joined
        for i in range(1, len(word) - 1):
            if not joined[word[i - 1] << 8 | word[i]]:
                out.append((word[at:i], False))
                at = i
        if len(word) > 1 and not self.joined_last[word[-2] << 8 | word[-1]]:
            out.append((word[at:-1], False))
            at = len(word) - 1
        out.append((word[at:], True))
        return out

    def merged(self, fragment: bytes, ends: bool) -> list[int]:
        """Ids of a fragment: again and again the adjacent pair of lowest rank is joined, the leftmost of equals."""
        parts = [self.inner[b] for b in fragment]
        if ends:
            parts[-1] = self.last[fragment[-1]]
        if len(parts) > _SHORT:
            return self._merged_long(parts)
        get, bits, none = self.merges.get, self.bits, 1 << 62
        ranks = [get(a << bits | b, none) for a, b in zip(parts, parts[1:])]  # noqa: B905
        while ranks and (best := min(ranks)) != none:
            i = ranks.index(best)
            parts[i : i + 2] = [best & (1 << bits) - 1]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get(parts[i] << bits | parts[i + 1], none)
            if i:
                ranks[i - 1] = get(parts[i - 1] << bits | parts[i], none)
        return parts

    def _merged_long(self, parts: list[int]) -> list[int]:
        """The same with a heap and links to the neighbours, so that long fragments don't cost their square."""
        n, bits = len(parts), self.bits
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        found = [self.merges.get(a << bits | b, 0) for a, b in zip(parts, parts[1:])] + [0]  # noqa: B905
        heap = [(f >> bits, i) for i, f in enumerate(found) if f]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if not found[i] or found[i] >> bits != rank:
                continue
            j = after[i]
            parts[i], parts[j], after[i], found[j] = found[i] & (1 << bits) - 1, -1, after[j], 0
            if after[i] < n:
                before[after[i]] = i
            for x in (i, before[i]):
                if x >= 0:
                    found[x] = self.merges.get(parts[x] << bits | parts[after[x]], 0) if after[x] < n else 0
                    if found[x]:
                        heapq.heappush(heap, (found[x] >> bits, x))
        return [p for p in parts if p >= 0]


class _Known(dict):
    """Packed ids by word; what isn't known is cut, its fragments encoded, and remembered while there is room."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.pieces = vocabulary, {}

    def __missing__(self, word: str) -> bytes:
        raw = word.encode()
        packed = b"".join(map(self.piece, self.vocabulary.fragments(raw)))
        if len(raw) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = packed
        return packed

    def piece(self, key: tuple[bytes, bool]) -> bytes:
        packed = self.pieces.get(key)
        if packed is None:
            ids = self.vocabulary.merged(*key)
            packed = struct.pack(f"<{len(ids)}I", *ids)
            if len(key[0]) <= LONGEST:
                if len(self.pieces) >= REMEMBERED:
                    self.pieces.clear()
                self.pieces[key] = packed
        return packed


def normal(text: str) -> str:
    """Composed (NFC) and lower-cased letter by letter, so a capital sigma never becomes the final form."""
    text = text if text.isascii() else unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


def packed_ids(text: str, known: _Known) -> bytes:
    """Ids of a text as packed little-endian unsigned 32-bit numbers; names of special tokens in it stand for these."""
    v = known.vocabulary
    if not v.special_split or not v.special_split.search(text):
        return b"".join(map(known.__getitem__, v.words(normal(text))))
    return b"".join(struct.pack("<I", v.special[p]) if i % 2 else b"".join(map(known.__getitem__, v.words(normal(p)))) for i, p in enumerate(v.special_split.split(text)))


_WORKER: dict = {}  # what a Python worker keeps from task to task: the words of the last vocabulary


def _known(vocabulary: Vocabulary, key: str) -> _Known:
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = _Known(vocabulary)
    return _WORKER[key]


def _encoded(batches, vocabulary: Vocabulary, key: str) -> Iterator[tuple[int | None, bytes]]:
    known = _known(vocabulary, key)
    for b in batches:
        for i, t in zip(b.column(0), b.column(1), strict=True):  # one text at a time
            yield i.as_py(), packed_ids(t.as_py(), known)


def _batches(rows, decoded: list[str] | None) -> Iterator[pa.RecordBatch]:
    """(doc_id, packed ids) as record batches of a bounded number of ids, with the decoded text if tokens are given."""
    names = ["doc_id", "ids", "decoded"][: 2 if decoded is None else 3]

    def batch(held):
        ends = np.cumsum([0, *(len(p) // 4 for _, p in held)]).astype(np.int32)
        ids = np.frombuffer(b"".join(p for _, p in held), "<u4").astype(np.int32)
        columns = [pa.array([i for i, _ in held], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))]
        if decoded is not None:
            columns.append(pa.array([" ".join(map(decoded.__getitem__, ids[a:b].tolist())) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string()))
        return pa.RecordBatch.from_arrays(columns, names)

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1]) // 4
        if size >= _OUT_IDS or len(held) >= 4096:
            yield batch(held)
            held, size = [], 0
    if held:
        yield batch(held)


def _texts(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id long, ids array<int>) of each row of docs (doc_id, text), its whole text encoded without added tokens.

    Null text is empty and has no ids; repeated rows come back each; an empty table gives no rows; other columns are
    left out. `path` is the vocabulary file on the driver, which is broadcast, about 10 MB whatever the documents.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))
    return _texts(docs).mapInArrow(lambda batches: _batches(_encoded(batches, vocabulary.value, path), None), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded string) of (doc_id, ids array<int>): token names with a space between, special ones too.

    Null ids give a null text; an id outside the vocabulary fails the job.
    """
    tokens = encoded.sparkSession.sparkContext.broadcast(Vocabulary(path).tokens)

    def run(batches):
        for b in batches:
            names = [None if ids is None else " ".join(map(tokens.value.__getitem__, ids)) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string())], ["doc_id", "ids", "decoded"])

    small_batches(encoded.sparkSession)
    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded): decode() of encode() in one worker for each task instead of two, which takes less memory."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))
    return _texts(docs).mapInArrow(lambda batches: _batches(_encoded(batches, vocabulary.value, path), vocabulary.value.tokens), "doc_id long, ids array<int>, decoded string")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(FILE))
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return d.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
