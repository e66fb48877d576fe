"""Problem 8: evaluation texts that leak into training text."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.spread import spread
from trackloom.llm.words import HashTable, chunks, counted, cut
from trackloom.session import durable


def words_of(text: str) -> list[str]:
    """NFKC, format characters (category Cf) dropped, case folded; maximal runs of letters and digits."""
    c = cut([text], plain=True)
    return [c.text[a:b] for a, b in zip(c.starts.tolist(), c.stops.tolist())]


@dataclass(frozen=True)
class LeakRules:
    """``words``: size of a window. ``max_edits``: words by which a window may differ from an item's (inserted, dropped or
    changed). ``recall``: wanted share of such window pairs that become candidates, for every kind of edit. ``sampled``: positions
    of the embedding that one table samples. ``sample``: pairs of each kind on which the recall is measured. ``most_tables``: beyond so
    many tables the search gives up with an error. ``block_chars``: characters of passages that one index holds; more take more
    passes over the texts."""

    words: int = 12
    max_edits: int = 2
    recall: float = 0.995
    sampled: int = 5
    sample: int = 2000
    most_tables: int = 400
    block_chars: int = 4_000_000
    seed: int = 7


@dataclass
class _Table:
    """One repetition: the walk, the sampled positions with their odd factors, and the items' windows by hash."""

    walk: np.ndarray
    positions: np.ndarray
    odd: np.ndarray
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    order: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


@dataclass
class _Index:
    """One block of items: codes of their words, their distinct windows and who holds them, their short pieces, and the tables."""

    rules: LeakRules
    vocabulary: HashTable
    n_words: int
    items: list[str]
    windows: np.ndarray
    holder: np.ndarray
    held_from: np.ndarray
    pieces: list[tuple[int, int, HashTable]]
    tables: list[_Table]
    measured: dict[str, float]

    @property
    def nbytes(self) -> int:
        """Bytes that a broadcast of this index takes, for the most part."""
        tables = sum(t.walk.nbytes + t.hashes.nbytes + t.order.nbytes for t in self.tables)
        known = sum(h.nbytes for h in [self.vocabulary, *(p for _, _, p in self.pieces)])
        return tables + known + self.windows.nbytes + self.holder.nbytes + self.held_from.nbytes + sum(map(len, self.items))


def cgk(windows: np.ndarray, walk: np.ndarray, steps: int | None = None) -> np.ndarray:
    """The random-walk embedding of rows of word codes: 3 n symbols from n.

    At step j the walk stands on a word, writes its code and goes on to the next word if the random bit of (j, code) says so;
    behind the last word it writes 0. Equal rows walk alike; rows at a small edit distance fall into step again, so their
    embeddings have a small Hamming distance. ``steps``: compute only so many symbols.
    """
    rows, n = windows.shape
    padded = np.zeros((rows, n + 1), windows.dtype)
    padded[:, :n] = windows
    flat, base = padded.reshape(-1), np.arange(rows) * (n + 1)
    at = np.zeros(rows, np.int64)
    out = np.empty((steps or 3 * n, rows), windows.dtype)
    for j in range(len(out)):
        symbol = flat[base + at]
        out[j] = symbol
        at += walk[j][symbol]
        np.minimum(at, n, out=at)
    return out.T


def _hashes(windows: np.ndarray, table: _Table) -> np.ndarray:
    embedded = cgk(windows, table.walk, int(table.positions[-1]) + 1)[:, table.positions].astype(np.uint64)
    mixed = (embedded + np.uint64(1)) * table.odd
    mixed ^= mixed >> np.uint64(29)
    return np.bitwise_xor.reduce(mixed, axis=1) * np.uint64(0x9E3779B97F4A7C15)


def _table(rng: np.random.Generator, r: LeakRules, codes: int) -> _Table:
    # A walk over n words ends after 2 n steps on average and writes nothing but 0 then; one position is drawn from each of
    # ``sampled`` equal parts before that, so that no table samples only what all windows share.
    edges = np.linspace(0, 2 * r.words, min(r.sampled, 2 * r.words) + 1)
    positions = np.unique(np.floor(edges[:-1] + rng.random(len(edges) - 1) * np.diff(edges)).astype(np.int64))
    odd = rng.integers(1, 1 << 62, len(positions), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return _Table(rng.integers(0, 2, (3 * r.words, codes), dtype=np.int8), positions, odd)


#: Kinds of edits on which the recall is measured, as in running text: what is dropped lets the next word in, what is put in
#: pushes the last word out.
KINDS = ("changed", "dropped", "added", "mixed")


def edited(windows: np.ndarray, following: np.ndarray, kind: str, r: LeakRules, codes: int, rng: np.random.Generator) -> np.ndarray:
    """Rows within ``max_edits`` of the given ones, by edits of one kind. ``following``: the words after each window.

    In windows of equal size a dropped or an added word costs two edits, one for itself and one at the window's end, so with an odd
    number of edits one more word is changed (and with one edit no word can be dropped or added).
    """
    out = windows.copy()
    for i, row in enumerate(windows):
        words, after, left = list(row), list(following[i]), r.max_edits
        while left:
            act = kind if kind != "mixed" else ("changed", "dropped", "added")[rng.integers(3)]
            if left < 2 or act == "changed":
                words[int(rng.integers(len(words)))] = int(rng.integers(1, codes))
                left -= 1
            elif act == "dropped":
                del words[int(rng.integers(len(words)))]
                words.append(after.pop(0) if after else int(rng.integers(1, codes)))
                left -= 2
            else:
                words.insert(int(rng.integers(len(words))), int(rng.integers(1, codes)))
                words.pop()
                left -= 2
        out[i] = words
    return out


def _piece_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` successive codes."""
    n = max(0, len(codes) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out + codes[k : k + n].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def build_index(items: list[tuple[str, str]], rules: LeakRules) -> _Index:
    """Index of (item_id, passage) rows; passages of fewer words than a window hold none.

    Tables are added until, on a sample of windows edited in every kind, the wanted share of pairs meets in some table.
    """
    r = rules
    rows = sorted({(name, passage) for name, passage in items if name is not None and passage})
    spelt, owners, of_text = [], [], []
    names = sorted({name for name, _ in rows})
    number = {name: i for i, name in enumerate(names)}
    for begin, end in chunks([p for _, p in rows]):
        c = cut([p for _, p in rows[begin:end]], plain=True)
        spelt.append(c.hashes)
        of_text.append(c.owner + begin)
        owners.append(np.array([number[name] for name, _ in rows[begin:end]], np.int64)[c.owner])
    hashes, text, owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (spelt, of_text, owners))
    known = np.unique(hashes).astype(np.uint64)
    vocabulary = HashTable(known, np.arange(1, len(known) + 1))
    codes = vocabulary.find(hashes.astype(np.uint64)).astype(np.int64)
    starts = np.arange(max(0, len(codes) - r.words + 1))
    starts = starts[text[starts] == text[starts + r.words - 1]] if len(starts) else starts
    every = codes[starts[:, None] + np.arange(r.words)].reshape(-1, r.words)
    windows, which = np.unique(every, axis=0, return_inverse=True) if len(every) else (every, np.zeros(0, np.int64))
    held = np.unique(np.stack([which.reshape(-1), owner[starts]], axis=1), axis=0) if len(every) else np.zeros((0, 2), np.int64)
    held_from = np.searchsorted(held[:, 0], np.arange(len(windows) + 1))

    # A window within max_edits of an item's keeps so many of its pieces (each edit touches at most as many as a piece has words).
    pieces = []
    for size in range(2, r.words + 1):
        least = r.words - size + 1 - r.max_edits * size
        if least >= 1:
            of = _piece_hashes(codes, size)
            inside = text[: len(of)] == text[size - 1 :]
            keys = np.unique(of[inside])
            pieces.append((size, least, HashTable(keys, np.zeros(len(keys), np.int32))))
    index = _Index(r, vocabulary, len(known) + 2, names, windows, held[:, 1], held_from, pieces, [], {})
    if len(windows):
        _add_tables(index, every, codes, starts, text)
    return index


def _add_tables(index: _Index, every: np.ndarray, codes: np.ndarray, starts: np.ndarray, text: np.ndarray) -> None:
    r = index.rules
    rng = np.random.default_rng(r.seed)
    pick = rng.choice(len(every), min(r.sample, len(every)), replace=False)
    behind = starts[pick, None] + r.words + np.arange(max(1, r.max_edits))
    inside = (behind < len(codes)) & (text[np.minimum(behind, len(codes) - 1)] == text[starts[pick]][:, None])
    following = np.where(inside, codes[np.minimum(behind, len(codes) - 1)], rng.integers(1, index.n_words, behind.shape))
    kinds = KINDS if r.max_edits > 1 else KINDS[: r.max_edits]
    close = {kind: edited(every[pick], following, kind, r, index.n_words, rng) for kind in kinds}
    met = {kind: np.zeros(len(pick), bool) for kind in kinds}
    while not index.tables or any(m.mean() < r.recall for m in met.values()):
        if len(index.tables) >= r.most_tables:
            raise ValueError(f"{r.most_tables} tables reach a recall of {min(m.mean() for m in met.values()):.3f} only; sample fewer positions")
        table = _table(rng, r, index.n_words)
        hashes = _hashes(index.windows, table)
        table.order = np.argsort(hashes, kind="stable")
        table.hashes = hashes[table.order]
        index.tables.append(table)
        own = _hashes(every[pick], table)
        for kind in kinds:
            met[kind] |= own == _hashes(close[kind], table)
    index.measured = {kind: float(m.mean()) for kind, m in met.items()}


def edit_distance(a: np.ndarray, b: np.ndarray, most: int | None = None) -> np.ndarray:
    """Levenshtein distance of the rows of two equal-sized arrays of word codes; ``most + 1`` wherever it is more than ``most``."""
    rows, n = a.shape
    k = n if most is None else most
    left, right = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    last = np.full((n + 2, rows), k + 1, np.int8)  # row j + 1 stands for the first j words of b; row 0 and what is off the band are too far
    last[1 : k + 2] = np.arange(min(k, n) + 1, dtype=np.int8)[:, None]
    for i in range(n):
        now = np.full_like(last, k + 1)
        if i < k:
            now[1] = i + 1
        for j in range(max(0, i - k), min(n, i + k + 1)):
            now[j + 2] = np.minimum(np.minimum(last[j + 2], now[j + 1]) + 1, last[j + 1] + (left[i] != right[j]))
        last = now
    return np.minimum(last[n + 1], k + 1).astype(np.int64)


def _spans(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every i the numbers from low[i] up to high[i]: (i, number)."""
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def _candidates(codes: np.ndarray, owner: np.ndarray, index: _Index) -> np.ndarray:
    """Starts of the windows that can lie within max_edits of some item's; none that does is lost."""
    r = index.rules
    starts = np.arange(max(0, len(codes) - r.words + 1))
    if not len(starts):
        return starts
    strange = np.concatenate([[0], np.cumsum(codes == 0, dtype=np.int32)])
    fits = (owner[starts] == owner[starts + r.words - 1]) & (strange[starts + r.words] - strange[starts] <= r.max_edits)
    for size, least, known in index.pieces:
        starts = starts[fits[: len(starts)]] if size == index.pieces[0][0] else starts[fits]
        if not len(starts):
            return starts
        # Only pieces of windows that are still in question are looked up.
        asked = np.zeros(len(codes) + 1, np.int32)
        np.add.at(asked, starts, 1)
        np.add.at(asked, starts + r.words - size + 1, -1)
        places = np.flatnonzero(np.cumsum(asked) > 0)
        places = places[places + size <= len(codes)]
        hit = np.zeros(len(codes) + 1, np.int32)
        of = np.zeros(len(places), np.uint64)
        for k in range(size):
            of = (of + codes[places + k].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            of ^= of >> np.uint64(32)
        hit[places + 1] = known.find(of) >= 0
        np.cumsum(hit, out=hit)
        fits = hit[starts + r.words - size + 1] - hit[starts] >= least
    return starts[fits]


def search(texts: list[str | None], index: _Index, pairs_at_once: int = 200_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, item number, fewest edits) of every leak, each pair once."""
    r = index.rules
    best: dict[tuple[int, int], int] = {}
    for begin, end in chunks([t or "" for t in texts]) if index.tables else ():
        c = cut([t or "" for t in texts[begin:end]], plain=True)
        codes = np.maximum(index.vocabulary.find(c.hashes), 0).astype(np.int64)
        starts = _candidates(codes, c.owner, index)
        if not len(starts):
            continue
        # Copies of a window are searched for once. Words that no item holds are one code, which differs from all others.
        rows = codes[starts[:, None] + np.arange(r.words)]
        windows, copy_of = np.unique(rows, axis=0, return_inverse=True)
        copy_of = copy_of.reshape(-1)
        windows = np.where(windows == 0, index.n_words - 1, windows)
        kept, waiting, n_waiting = [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int64)], 0

        def verify() -> None:
            pairs = counted(np.concatenate(waiting))[0]
            left, right = pairs // len(index.windows), pairs % len(index.windows)
            edits = edit_distance(windows[left], index.windows[right], r.max_edits)
            kept.append(np.stack([pairs, edits], axis=1)[edits <= r.max_edits])
            waiting[:] = [np.zeros(0, np.int64)]

        for table in index.tables:
            h = _hashes(windows, table)
            low, high = np.searchsorted(table.hashes, h, "left"), np.searchsorted(table.hashes, h, "right")
            hit = np.flatnonzero(high > low)
            cuts = np.flatnonzero(np.diff(np.cumsum(high[hit] - low[hit]) // pairs_at_once)) + 1
            for some in np.split(hit, cuts):  # so many pairs are held at a time, and a window's own ones
                which, position = _spans(low[some], high[some])
                waiting.append(some[which] * len(index.windows) + table.order[position])
                n_waiting += len(which)
                if n_waiting > pairs_at_once:
                    verify()
                    n_waiting = 0
        verify()
        found = np.unique(np.concatenate(kept), axis=0)
        left, right, edits = found[:, 0] // len(index.windows), found[:, 0] % len(index.windows), found[:, 1]
        # From distinct windows to the texts that hold them, and to the items that hold theirs.
        order = np.argsort(copy_of, kind="stable")
        first = np.searchsorted(copy_of[order], np.arange(len(windows) + 1))
        which, at = _spans(first[left], first[left + 1])
        text, right, edits = c.owner[starts[order[at]]], right[which], edits[which]
        which, at = _spans(index.held_from[right], index.held_from[right + 1])
        for key in zip((text[which] + begin).tolist(), index.holder[at].tolist(), edits[which].tolist()):
            if best.get(key[:2], r.max_edits + 1) > key[2]:
                best[key[:2]] = key[2]
    both = np.array([(*k, v) for k, v in sorted(best.items())], np.int64).reshape(-1, 3)
    return both[:, 0], both[:, 1], both[:, 2]


def _pieces_of(items: DataFrame, rules: LeakRules, size: int) -> DataFrame:
    """``item_id, passage`` with long passages cut into parts of about ``size`` words that overlap by a window and its edits, on the executors."""
    overlap = rules.words + 2 * rules.max_edits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, parts = [], []
            for name, passage in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(passage) if len(passage) > size else [passage]
                for i in range(0, max(1, len(words) - overlap + 1), size):
                    names.append(name)
                    parts.append(" ".join(words[i : i + size + overlap]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(parts, pa.string())], names=["item_id", "passage"])

    return spread(items).mapInArrow(run, "item_id string, passage string")


def leaked_items(documents: DataFrame, items: DataFrame, rules: LeakRules = LeakRules()) -> DataFrame:
    """``doc_id, item_id, edits`` of every document that holds a window of ``words`` successive words of an item's passage, give or
    take ``max_edits`` words; ``edits`` is the fewest over its windows.

    Method. Every window of an item and every window of a text is embedded by a CGK random walk, which turns edit distance into
    Hamming distance. Tables sample positions of the embedding; windows that agree in all sampled positions of some table are
    candidates, whose edit distance is then computed exactly. Tables are added until the wanted recall is measured on windows
    edited in every kind; windows without an edit agree in every table, so none of these is ever missed. Before the walk,
    windows are left out that cannot match: more than ``max_edits`` words that no item holds, or too few of the short pieces that
    edits must leave whole (both lossless). Copies of a window within a batch are searched for once.

    The texts are never shuffled. An index holds ``block_chars`` characters of passages, cut on the executors so that a long
    passage is no exception; several blocks take several passes, one after the other, each with an index of its own that is
    built, sent out and dropped before the next one. Words are compared by 64-bit hashes.

    Defined cases: null and empty texts and passages, and passages shorter than a window, match nothing; repeated texts count
    each; rows that repeat a document's id are one; repeated item ids are one item; null item ids none; an empty table on either side
    gives no rows. Other columns are ignored.
    """
    passages = _pieces_of(items.select(F.col("item_id").cast("string").alias("item_id"), "passage").where("item_id IS NOT NULL AND passage IS NOT NULL"), rules, 2_000)
    chars = passages.agg(F.coalesce(F.sum(F.length("passage")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(chars / rules.block_chars))
    texts = spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text IS NOT NULL"))
    context = documents.sparkSession.sparkContext
    found: DataFrame | None = None
    for block in range(blocks):
        own = passages.where(F.pmod(F.xxhash64("item_id", "passage"), F.lit(blocks)) == block) if blocks > 1 else passages
        index = build_index([tuple(row) for row in own.collect()], rules)  # about block_chars characters
        shared = context.broadcast(index)
        result = texts.mapInArrow(_searcher(shared), "doc_id bigint, item_id string, edits bigint").groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))
        if blocks > 1:
            result = durable(result)
            shared.destroy()
        found = result if found is None else found.unionByName(result)
    return found if blocks == 1 else found.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))


def _searcher(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        names = np.array([*index.items, None], object)
        for batch in batches:
            text, item, edits = search(batch.column(1).to_pylist(), index)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), pa.array(names[item].tolist(), pa.string()), pa.array(edits)], names=["doc_id", "item_id", "edits"])

    return run
