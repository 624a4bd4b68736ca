"""Byte-level BPE encoding and decoding with a given rank file.

Texts are cut by PATTERN, and each distinct piece is merged once for as long as its worker remembers it; ids are kept
as packed little-endian unsigned 32-bit numbers. Nothing is shuffled: a document is encoded where it is read.

`fold_words` is the same merge as a fold of Spark's higher-order functions over the byte arrays of distinct words.
"""

from __future__ import annotations

import base64
import heapq
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, text_or_empty

RANK_FILE = "byte_bpe_multi_50k.tiktoken"
REMEMBERED = 200_000  # distinct pieces that a worker remembers, of at most LONGEST characters
LONGEST = 48
_SHORT = 100  # bytes up to which a plain scan for the best pair is quicker than a heap
_OUT_BYTES = 2 << 20


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, in order of their ids, which must be 0, 1, 2 and so on."""
    with open(path, "rb") as f:
        pairs = [(int(b), base64.b64decode(a)) for a, b in (line.split() for line in f if line.strip())]
    pairs.sort()
    if [i for i, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ids aren't 0, 1, 2 and so on")
    return [t for _, t in pairs]


def splitter(pattern: str = public_tokenizers.PATTERN) -> regex.Pattern:
    """PATTERN with white space by its Unicode property, as the tiktoken library takes it (Python also counts 28 to 31)."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: again and again the adjacent pair of lowest rank is joined, the leftmost of equals."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) > _SHORT:
        return _merged_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    none = len(ranks)
    costs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]  # noqa: B905
    while costs and (best := min(costs)) < none:
        i = costs.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del costs[i]
        if i < len(costs):
            costs[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            costs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _merged_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap of (rank, start) and links to the neighbours, so that long runs don't cost their square."""
    n = len(piece)
    end, back = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at i: its end, the start before
    cost = [ranks.get(piece[i : i + 2]) for i in range(n - 1)] + [None]
    heap = [(c, i) for i, c in enumerate(cost) if c is not None]
    heapq.heapify(heap)

    def weigh(i: int) -> None:
        j = end[i]
        cost[i] = ranks.get(piece[i : end[j]]) if j < n else None
        if cost[i] is not None:
            heapq.heappush(heap, (cost[i], i))

    while heap:
        c, i = heapq.heappop(heap)
        if cost[i] != c:
            continue
        j = end[i]
        end[i], cost[j] = end[j], None
        if end[i] < n:
            back[end[i]] = i
        weigh(i)
        if back[i] >= 0:
            weigh(back[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class _Pieces(dict):
    """Packed ids by piece; merges what it doesn't have, and remembers it while there is room."""

    def __init__(self, tokens: list[bytes]):
        super().__init__()
        self.ranks = {t: i for i, t in enumerate(tokens)}

    def __missing__(self, piece: str) -> bytes:
        ids = merged(piece.encode(), self.ranks)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = packed
        return packed


_WORKER: dict = {}  # what a Python worker keeps from task to task: the pieces of the last vocabulary


def _pieces(tokens: list[bytes], key: str) -> _Pieces:
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = _Pieces(tokens)
    return _WORKER[key]


def _batches(names, schema, rows):
    """Rows as record batches of a few MB, so that no batch grows with the length of texts."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes | str))
        if size >= _OUT_BYTES or len(held) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema, strict=True)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema, strict=True)], names)


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id long, ids binary) of each row of docs (doc_id, text): packed ids of the whole text, no special tokens.

    Null text is empty and has no ids; repeated rows come back each; empty table: no rows. `path` is the rank file on
    the driver; its tokens, as many as the vocabulary has, are broadcast.
    """
    small_batches(docs.sparkSession)
    tokens = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches):
        pieces, split = _pieces(tokens.value, path), splitter(pattern)
        rows = ((i, b"".join(map(pieces.__getitem__, split.findall(t)))) for b in batches for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        yield from _batches(["doc_id", "ids"], [pa.int64(), pa.binary()], rows)

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded binary): the bytes of each id of `encoded` (doc_id long, ids binary), one after another."""
    tokens = encoded.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches):
        known = tokens.value
        rows = ((i, ids, b"".join(map(known.__getitem__, np.frombuffer(ids, "<u4").tolist()))) for b in batches for i, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        yield from _batches(["doc_id", "ids", "decoded"], [pa.int64(), pa.binary(), pa.binary()], rows)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, ids, decoded): decode() of encode(), in one worker for each task instead of two, which takes less memory."""
    small_batches(docs.sparkSession)
    tokens = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches):
        known = tokens.value
        pieces, split = _pieces(known, path), splitter(pattern)
        both = ((i, b"".join(map(pieces.__getitem__, split.findall(t)))) for b in batches for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        rows = ((i, ids, b"".join(map(known.__getitem__, np.frombuffer(ids, "<u4").tolist()))) for i, ids in both)
        yield from _batches(["doc_id", "ids", "decoded"], [pa.int64(), pa.binary(), pa.binary()], rows)

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, ids binary, decoded binary")


_SLOTS = 4096


def _rank_table(tokens: list[bytes]) -> Column:
    """A literal rank map in slots by CRC-32, as looking a key up in one map reads it from its start."""
    slots: list[dict] = [{} for _ in range(_SLOTS)]
    for i, t in enumerate(tokens):
        slots[zlib.crc32(t) % _SLOTS][t.hex().upper()] = i
    return F.from_json(F.lit(json.dumps(slots)), "array<map<string,int>>")


def fold_words(words: DataFrame, path: str) -> DataFrame:
    """(word, ids array<int>) of distinct words (column word): a fold that joins the pair of lowest rank each time."""
    ranks = _rank_table(read_ranks(path))
    rank = lambda b: ranks[(F.crc32(b) % _SLOTS).cast("int")][F.hex(b)]
    w = F.encode("word", "utf-8")
    single = F.transform(F.sequence(F.lit(1), F.octet_length("word")), lambda i: F.substring(w, i, F.lit(1)))

    def step(parts: Column, _: Column) -> Column:
        costs = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p, i: rank(F.concat(p, parts[i + 1])))
        join = lambda c: F.transform(F.array(F.array_position(c, F.array_min(c)).cast("int")), lambda at: F.when(at > 0, F.concat(F.slice(parts, F.lit(1), at - 1), F.array(F.concat(parts[at - 1], parts[at])), F.slice(parts, at + 2, F.size(parts)))).otherwise(parts))[0]
        return F.when(F.size(parts) > 1, F.transform(F.array(costs), lambda c: F.when(F.array_min(c).isNull(), parts).otherwise(join(c)))[0]).otherwise(parts)

    folded = F.aggregate(F.sequence(F.lit(1), F.octet_length("word")), single, step)
    return words.select("word", F.transform(folded, rank).alias("ids"))


def digests(docs: DataFrame) -> DataFrame:
    path = public_tokenizers.path(RANK_FILE)
    d = round_trip(docs, path)
    return d.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
