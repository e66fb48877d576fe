"""Problem 7: texts encoded with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.spread import spread

#: Ranks of byte_bpe_50k: one line per token, its bytes in base 64 and its rank.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern by which this vocabulary cuts text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of more bytes are merged with a heap, which takes n log n steps where the array takes n squared.
SHORT = 128
#: Words whose ids a worker remembers.
REMEMBERED = 400_000

_NEVER = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class WordEncoder:
    """Ids of single words by a vocabulary of merge ranks."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self._ranks = ranks

    def encode(self, word: bytes) -> list[int]:
        whole = self._ranks.get(word)
        if whole is not None:
            return [whole]
        bounds = self._by_array(word) if len(word) <= SHORT else self._by_heap(word)
        return [self._ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]

    def _by_array(self, word: bytes) -> list[int]:
        """Contiguous rank array: part boundaries and, beside them, the rank of each part merged with the next.

        The lowest rank (the leftmost of equal ones) is found by a scan, the boundary between its two parts is deleted, and the
        ranks of the two neighbours are looked up anew.
        """
        rank = self._ranks.get
        bounds = list(range(len(word) + 1))
        ranks = [rank(word[i : i + 2], _NEVER) for i in range(len(word) - 1)]
        while ranks:
            lowest = min(ranks)
            if lowest == _NEVER:
                break
            i = ranks.index(lowest)
            del bounds[i + 1]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank(word[bounds[i] : bounds[i + 2]], _NEVER)
            if i:
                ranks[i - 1] = rank(word[bounds[i - 1] : bounds[i + 1]], _NEVER)
        return bounds

    def _by_heap(self, word: bytes) -> list[int]:
        """The same boundaries for long words: candidate merges in a heap, parts in a linked list."""
        rank, n = self._ranks.get, len(word)
        after, before, alive = list(range(1, n + 2)), list(range(-1, n)), bytearray(b"\1") * n
        stop = n

        def pair(i: int) -> int:
            j = after[i]
            return _NEVER if j >= stop else rank(word[i : after[j]], _NEVER)

        current = [pair(i) for i in range(n)]
        heap = [(r, i) for i, r in enumerate(current) if r != _NEVER]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if not alive[i] or current[i] != r:
                continue
            j = after[i]
            alive[j] = 0
            after[i] = after[j]
            if after[i] < stop:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0:
                    current[k] = pair(k)
                    if current[k] != _NEVER:
                        heapq.heappush(heap, (current[k], k))
        return [i for i in range(n) if alive[i]] + [n]


_encoders: dict[str, tuple[WordEncoder, dict]] = {}


def _encoder(path: str) -> tuple[WordEncoder, dict]:
    """A worker reads a vocabulary once; with it goes what it remembers of words."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(read_ranks(path)), {}
    return _encoders[path]


def encode_text(text: str, words: WordEncoder, known: dict[str, list[int]], find) -> list[int]:
    ids: list[int] = []
    for word in find(text):
        got = known.get(word)
        if got is None:
            got = words.encode(word.encode())
            if len(word) <= 32:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[word] = got
        ids += got
    return ids


def encoded(documents: DataFrame, ranks: str = RANKS) -> DataFrame:
    """``doc_id, ids``: the token ids of every text, without special tokens.

    Method, contiguous rank array: a text is cut into words by the vocabulary's pattern; per word the part boundaries lie in one
    array and the ranks of adjacent parts in another, which is scanned for its minimum until none is left. Long words use a
    heap with the same result. Words repeat, so a worker remembers the ids of up to ``REMEMBERED`` short words.

    ``ranks`` is the vocabulary's path, the same on every executor; it is read there and never shipped. Defined cases: null and
    empty texts give an empty list; strings that look like special tokens are ordinary text; white space is encoded as it
    stands; repeated rows and ids give a row each. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = _encoder(ranks)
        find = regex.compile(PATTERN).findall
        for batch in batches:
            ids, ends = array("i"), [0]
            for text in batch.column(1).to_pylist():
                if text:
                    ids.extend(encode_text(text, words, known, find))
                ends.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(ids, np.int32) if ids else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "ids"])

    return spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).mapInArrow(run, "doc_id bigint, ids array<int>")
