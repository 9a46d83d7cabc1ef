"""Byte-level BPE of whole columns with the vocabulary of a public tokenizer (problem 8), and sizes in its tokens.

Texts are cut into words by the vocabulary's published split rule, slice by slice (about a MB of whole texts); a slice hands on
its distinct words only, and its texts as places in that list. The words of all slices meet by their hash in blocks of the
corpus, where each distinct word is encoded once, whatever slice it is from: an inverted index from token pair to word positions
applies the merges in rank order, and each merge touches only the neighbours of the places where it applies. Words and texts
come together again by slice. No text travels, and no word more often than once a slice."""

from __future__ import annotations

import json
import os
import unicodedata as ud
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.runtime import materialise

#: Bytes of text that are cut into words together; a longer text is a slice of its own.
SLICE_BYTES = 1_000_000
#: Bytes of words, by the sum over slices, that one task encodes together.
BLOCK_BYTES = 4_000_000
#: Below this many places a merge is replayed in plain Python, above it in numpy.
FEW = 48

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


def default_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the vocabulary lies, unless a query is given another path."""
    return os.path.join(os.environ.get("INKWELL_TOKENIZERS", "/opt/tokenizers"), name)


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of every code point for the split rule: white space, letter, number, other."""
    table = np.full(0x110000, OTHER, np.uint8)
    white = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    kinds = {"L": LETTER, "N": NUMBER}
    for cp in range(0x110000):
        if (k := kinds.get(ud.category(chr(cp))[0])) is not None:
            table[cp] = k
    table[white] = SPACE
    return table


class Vocabulary:
    """Merges and ids of a byte-level BPE file in the tokenizers library's JSON format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        # the format writes bytes as printable characters: those that are printable stand for themselves, the others follow from U+0100
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        shown = {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        ids = model["vocab"]
        self.byte_ids = np.array([ids[shown[b]] for b in range(256)], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int32)
        key = np.array([ids[a] << 20 | ids[b] for a, b in pairs], np.int64)
        self.by_key = np.argsort(key, kind="stable").astype(np.int32)  # place in the sorted keys -> rank
        self.keys = key[self.by_key]
        self.rank_of = dict(zip(key.tolist(), range(len(pairs)), strict=True))
        self.pair_of = list(zip((key >> 20).tolist(), (key & 0xFFFFF).tolist(), strict=True))
        self.kind = np.uint16 if max(ids.values()) <= 0xFFFF else np.int32  # in which ids travel
        byte_of = {c: b for b, c in shown.items()}
        spelled = {i: bytes(byte_of[c] for c in t) for t, i in ids.items()}
        tokens = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.byte_length = np.array([len(t) for t in tokens], np.int64)
        self.characters = np.array([sum(c & 0xC0 != 0x80 for c in t) for t in tokens], np.int64)  # that begin in the token
        self.within = np.array([bool(t) and t[0] & 0xC0 == 0x80 for t in tokens])  # begins within a character
        self.bytes_rank = self.ranks(self.byte_ids[np.arange(65536) >> 8], self.byte_ids[np.arange(65536) & 255])

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it never merges."""
        key = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.by_key[at], -1).astype(np.int32)


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def replay(words: np.ndarray, starts: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Encode words: ``words`` are their bytes one after another, ``starts`` where each begins. Returns the ids and, per
    word, how many it has. A merge of equal tokens applies from the left."""
    n = len(words)
    sym = vocab.byte_ids[words].astype(np.int64)
    nxt = np.arange(1, n + 1)
    prv = np.arange(-1, n - 1)
    ends = np.append(starts[1:], n)
    full = ends > starts
    nxt[ends[full] - 1] = -1
    prv[starts[full]] = -1
    alive = np.ones(n, bool)
    # inverted index: the places of every pair, by rank
    first = np.full(n, -1, np.int32)
    if n > 1:
        first[:-1] = vocab.bytes_rank[words[:-1].astype(np.int64) << 8 | words[1:]]
    first[nxt < 0] = -1
    has = np.flatnonzero(first >= 0)
    order = has[np.argsort(first[has], kind="stable")]
    ranks, cuts = np.unique(first[order], return_index=True)
    index: dict[int, list[np.ndarray | int]] = {}
    bounds = np.append(cuts, len(order))
    for i, r in enumerate(ranks.tolist()):
        index[r] = [order[bounds[i] : bounds[i + 1]]]
    import heapq

    heap = list(index)
    heapq.heapify(heap)
    rank_of = vocab.rank_of
    while heap:
        r = heapq.heappop(heap)
        places = index.pop(r)
        a, b = vocab.pair_of[r]
        c = int(vocab.merged[r])
        arrays = [p for p in places if not isinstance(p, int)]
        singles = [p for p in places if isinstance(p, int)]
        if sum(map(len, arrays)) + len(singles) <= FEW:
            for p in sorted({*singles, *(int(x) for y in arrays for x in y)}):
                if not alive[p] or sym[p] != a:
                    continue
                q = int(nxt[p])
                if q < 0 or sym[q] != b:
                    continue
                sym[p] = c
                alive[q] = False
                t = int(nxt[q])
                nxt[p] = t
                if t >= 0:
                    prv[t] = p
                    k = rank_of.get(c << 20 | int(sym[t]))
                    if k is not None:
                        if k not in index:
                            index[k] = []
                            heapq.heappush(heap, k)
                        index[k].append(p)
                o = int(prv[p])
                if o >= 0:
                    k = rank_of.get(int(sym[o]) << 20 | c)
                    if k is not None:
                        if k not in index:
                            index[k] = []
                            heapq.heappush(heap, k)
                        index[k].append(o)
            continue
        at = np.concatenate([*arrays, np.array(singles, np.int64)]) if singles or len(arrays) > 1 else arrays[0]
        at = np.unique(at[alive[at] & (sym[at] == a)])
        q = nxt[at]
        ok = q >= 0
        ok[ok] = sym[q[ok]] == b
        at, q = at[ok], q[ok]
        if a == b and len(at) > 1:  # runs of one token: every second place, from the left
            joined = np.zeros(len(at), bool)
            joined[1:] = q[:-1] == at[1:]
            begin = np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
            ok = (np.arange(len(at)) - begin) % 2 == 0
            at, q = at[ok], q[ok]
        if not len(at):
            continue
        sym[at] = c
        alive[q] = False
        t = nxt[q]
        nxt[at] = t
        inner = t >= 0
        prv[t[inner]] = at[inner]
        o = prv[at]
        outer = o >= 0
        new_at = np.concatenate([at[inner], o[outer]])
        new_rank = np.concatenate([vocab.ranks(np.full(int(inner.sum()), c), sym[t[inner]]), vocab.ranks(sym[o[outer]], np.full(int(outer.sum()), c))])
        good = new_rank >= 0
        new_at, new_rank = new_at[good], new_rank[good]
        if not len(new_at):
            continue
        by = np.argsort(new_rank, kind="stable")
        new_at, new_rank = new_at[by], new_rank[by]
        cut = np.flatnonzero(np.diff(new_rank, prepend=-1))
        for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(new_at)], strict=True):
            k = int(new_rank[i])
            if k not in index:
                index[k] = []
                heapq.heappush(heap, k)
            index[k].append(new_at[i:j])
    left = np.cumsum(alive)
    upto = np.concatenate([[0], left])
    return sym[alive].astype(np.int32), (upto[ends] - upto[starts]).astype(np.int64)


def word_starts(text: bytes, text_starts: np.ndarray) -> np.ndarray:
    """Byte offsets at which a word begins, by the vocabulary's split rule: contractions of an apostrophe, runs of letters,
    of numbers or of other signs, each with one blank before it, and white space. ``text`` are UTF-8 texts one after
    another that begin at ``text_starts`` (each not empty); every text start is a word start."""
    cps = np.frombuffer(text.decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64)
    width = np.ones(n, np.int64) + (cps > 0x7F) + (cps > 0x7FF) + (cps > 0xFFFF)
    offset = np.cumsum(width) - width
    kind = _classes()[cps]
    fresh = np.zeros(n, bool)  # begins a text
    fresh[np.searchsorted(offset, text_starts)] = True
    start = fresh.copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    ends_run = np.append(start[1:], True)
    ends_text = np.append(fresh[1:], True)
    # the last white space before a word: a blank goes with the word, any other stands alone
    last = np.flatnonzero(space & ends_run & ~ends_text)
    start[last] = True
    blank = last[cps[last] == 0x20]
    start[blank + 1] = False
    # contractions: an apostrophe that begins a run of its own, before s t m d or re ve ll
    lone = np.flatnonzero((cps == 0x27) & start & ends_run & ~ends_text)
    if len(lone):
        pad = np.concatenate([cps, np.zeros(2, np.uint32)])
        gone = np.concatenate([fresh, np.ones(2, bool)])
        c1, c2 = pad[lone + 1], pad[lone + 2]
        one = np.isin(c1, np.frombuffer("stmd".encode("utf-32-le"), np.uint32))
        two = ((c1 == 0x72) & (c2 == 0x65) | (c1 == 0x76) & (c2 == 0x65) | (c1 == 0x6C) & (c2 == 0x6C)) & ~gone[lone + 2]
        hit = lone[one | two]
        start[hit + 1] = False
        behind = hit + np.where(one, 2, 3)[one | two]
        behind = behind[behind < n]
        start[behind] |= ~fresh[behind]
        start[behind] |= fresh[behind]
    return offset[start]


class Words:
    """The words of a slice of texts: ``starts`` byte offsets, ``distinct`` its distinct words (bytes end to end, starts), and
    ``code`` the distinct word of each occurrence."""

    def __init__(self, text: bytes, text_starts: np.ndarray):
        self.text = text
        self.starts = word_starts(text, text_starts)
        offsets = np.append(self.starts, len(text)).astype(np.int32)
        flat = pa.Array.from_buffers(pa.binary(), len(self.starts), [None, pa.py_buffer(offsets), pa.py_buffer(text)])
        coded = flat.dictionary_encode()
        self.code = coded.indices.to_numpy(zero_copy_only=False)
        bounds = np.frombuffer(coded.dictionary.buffers()[1], np.int32)[coded.dictionary.offset :][: len(coded.dictionary) + 1].astype(np.int64)
        data = coded.dictionary.buffers()[2]
        self.bytes = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and len(bounds) > 1 else np.zeros(0, np.uint8)
        self.word_starts = bounds[:-1] - bounds[0]


def slices(text: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(from, to) of rows so that each slice holds about ``most`` bytes of text, at least one row."""
    lens = np.asarray(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False), np.int64)
    at, held = 0, 0
    for i, k in enumerate(lens.tolist()):
        if held and held + k > most:
            yield at, i
            at, held = i, 0
        held += k
    if at < len(lens):
        yield at, len(lens)


def text_bytes(text: pa.Array) -> tuple[bytes, np.ndarray]:
    """The UTF-8 bytes of the texts of an array end to end and the offset of each (one more than rows); null is empty. Bytes
    that are no UTF-8 become U+FFFD."""
    filled = pc.fill_null(text, "").cast(pa.large_string())
    try:
        filled.validate(full=True)
    except pa.ArrowInvalid:
        filled = pa.array([bytes(v.as_buffer()).decode("utf-8", "replace") for v in filled], pa.large_string())
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset :][: len(filled) + 1]
    data = filled.buffers()[2]
    raw = data.to_pybytes()[offsets[0] : offsets[-1]] if data is not None else b""
    return raw, offsets - offsets[0]


def gather(ids: np.ndarray, per_word: np.ndarray, code: np.ndarray) -> np.ndarray:
    """What the words have in ``ids`` (``per_word`` entries each) for all occurrences end to end: that of word ``code[0]``, then
    of ``code[1]`` and so on."""
    counts = per_word[code]
    keep = counts > 0
    src, counts = (np.cumsum(per_word) - per_word)[code][keep], counts[keep]
    if not len(counts):
        return ids[:0]
    first = np.cumsum(counts) - counts
    step = np.ones(int(counts.sum()), np.int64)
    step[first[1:]] = src[1:] - (src[:-1] + counts[:-1]) + 1
    step[0] = src[0]
    return ids[np.cumsum(step)]


def _binary(values: list[np.ndarray]) -> pa.Array:
    """One binary value per array, as its bytes."""
    return _cut(np.concatenate(values) if values else np.zeros(0, np.uint8), np.concatenate([[0], np.cumsum([len(v) for v in values])]))


def _cut(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary values: the bytes of ``values[bounds[i]:bounds[i + 1]]``."""
    offsets = np.ascontiguousarray(bounds * values.itemsize, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _joined(column: pa.Array, kind: np.dtype | type) -> tuple[np.ndarray, np.ndarray]:
    """The contents of a binary column end to end and where each value begins (one more than rows); null is empty."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset :][: len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    size = np.dtype(kind).itemsize
    values = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind) if data is not None else np.zeros(0, kind)
    return values, (offsets - offsets[0]) // size


Strengths = Callable[[bytes, np.ndarray, np.ndarray], np.ndarray]


def _cutter(strengths: Strengths | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Slices of texts: a row of kind 0 with the slice's distinct words (a: bytes, b: lengths), and one of kind 1 per text (a: the
    places of its words in that list, b: what ``strengths`` says of the byte each word begins with; both null for a null text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, j in slices(batch.column(1)):
                ids, text = batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i)
                raw, offsets = text_bytes(text)
                begin = np.unique(offsets[:-1][offsets[1:] > offsets[:-1]])
                words = Words(raw, begin)
                row = np.append(np.searchsorted(words.starts, offsets[:-1]), len(words.starts))
                wide = len(words.word_starts) > 0xFFFF
                code = _cut(words.code.astype(np.int32 if wide else np.uint16), row)
                mark = _cut(strengths(raw, begin, words.starts)[words.starts], row) if strengths and len(raw) else _cut(np.zeros(0, np.int8), row * 0)
                lengths = np.diff(np.append(words.word_starts, len(words.bytes))).astype(np.int32)
                nulls = pc.is_null(text)
                none = pa.scalar(None, pa.binary())
                columns = [
                    pa.concat_arrays([pa.nulls(1, ids.type), ids]),
                    pa.concat_arrays([_binary([words.bytes]), pc.if_else(nulls, none, code)]),
                    pa.concat_arrays([_binary([lengths.view(np.uint8)]), pc.if_else(nulls, none, mark)]),
                ]
                n = len(ids) + 1
                kind = pa.array(np.append(0, np.ones(n - 1)).astype(np.int8))
                fixed = [pa.array(np.full(n, number, np.int64)), kind, pa.array(np.full(n, wide))]
                yield pa.RecordBatch.from_arrays([*fixed, *columns], names=["slice", "kind", "wide", "id", "a", "b"])
                number += 1

    return run


def _hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word (none is empty)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power = np.cumprod(np.full(int(lengths.max()), 0x9E3779B97F4A7C15, np.uint64))
    at = np.arange(len(data)) - np.repeat(starts, lengths)
    h = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * power[at], starts)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _spreader(blocks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The words of a slice by the block that their hash falls into: block, slice, a (bytes), b (lengths), at (places, each as what
    it is above the one before)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data, _ = _joined(batch.column(1).slice(i, 1), np.uint8)
                lengths, _ = _joined(batch.column(2).slice(i, 1), np.int32)
                lengths = lengths.astype(np.int64)
                starts = np.cumsum(lengths) - lengths
                block = (_hashes(data, starts, lengths) % np.uint64(blocks)).astype(np.int32)
                order = np.argsort(block, kind="stable")
                first = np.flatnonzero(np.diff(block[order], prepend=-1))
                edges = np.append(first, len(order))
                sorted_bytes = gather(data, lengths, order)
                spans = np.concatenate([[0], np.cumsum(lengths[order])])
                columns = [
                    pa.array(block[order][first]),
                    pa.array(np.full(len(first), batch.column(0)[i].as_py(), np.int64)),
                    _cut(sorted_bytes, spans[edges]),
                    _cut(lengths[order].astype(np.int32), edges),
                    _cut(_steps(order, first).astype(np.int32), edges),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "slice", "a", "b", "at"])

    return run


def _steps(rising: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Differences to the entry before, in runs that begin at ``first`` (and at 0)."""
    steps = np.diff(rising, prepend=0)
    steps[first] = rising[first]
    return steps


def _replayer(path: str, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Encodes the distinct words of a block once and hands every slice its own: slice, at, a (ids), b (how many each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        slice_, at = table.column("slice").combine_chunks(), table.column("at").combine_chunks()
        data = np.concatenate([_joined(c, np.uint8)[0] for c in table.column("a").chunks])
        lengths = np.concatenate([_joined(c, np.int32)[0] for c in table.column("b").chunks]).astype(np.int64)
        rows = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(_joined(c, np.int32)[1]) for c in table.column("b").chunks]))])
        del table, held
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        coded = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        bounds = np.frombuffer(coded.dictionary.buffers()[1], np.int64)[coded.dictionary.offset :][: len(coded.dictionary) + 1]
        words = np.frombuffer(coded.dictionary.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        ids, per_word = replay(words, bounds[:-1] - bounds[0], vocabulary(path))
        ids = ids.astype(vocabulary(path).kind)
        for i in range(len(rows) - 1):
            mine = code[rows[i] : rows[i + 1]]
            got = [gather(ids, per_word, mine).view(np.uint8)] if with_ids else [np.zeros(0, np.uint8)]
            columns = [slice_.slice(i, 1), at.slice(i, 1), _binary(got), _binary([per_word[mine].astype(np.int32).view(np.uint8)])]
            yield pa.RecordBatch.from_arrays(columns, names=["slice", "at", "a", "b"])

    return run


Finish = Callable[[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch]


def _finisher(finish: Finish, ids_kind: type) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Streams over rows sorted by slice and kind: the encoded words of a slice, then its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: int | None = None
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        ready: tuple[np.ndarray, np.ndarray] | None = None
        for batch in batches:
            slices_ = batch.column(0).to_numpy(zero_copy_only=False)
            kinds = batch.column(1).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero((np.diff(slices_) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), len(slices_)]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if i == j:
                    continue
                if slices_[i] != current:
                    current, parts, ready = int(slices_[i]), [], None
                run_ = batch.slice(i, j - i)
                if kinds[i] == 0:
                    for k in range(j - i):
                        at, ids, counts = (_joined(run_.column(c).slice(k, 1), t)[0] for c, t in ((6, np.int32), (4, ids_kind), (5, np.int32)))
                        parts.append((np.cumsum(at), ids.astype(np.int32), counts))
                    continue
                if ready is None:
                    ready = _in_place(parts)
                    parts = []
                code, rows = _joined(run_.column(4), np.int32 if run_.column(2)[0].as_py() else np.uint16)
                mark, _ = _joined(run_.column(5), np.int8)
                nulls = pc.is_null(run_.column(4)).to_numpy(zero_copy_only=False)
                yield finish(run_.column(3), nulls, code, rows, mark, *ready)

    return run


def _in_place(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a slice's words end to end in the order of its list, and how many each word has."""
    at, ids, counts = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int32),) * 3
    order = np.argsort(at)
    counts = counts.astype(np.int64)
    return (gather(ids, counts, order) if len(ids) else ids), counts[order]


def encoded(df: DataFrame, id_col: str, text: str, path: str | None, finish: Finish, schema: str, strengths: Strengths | None = None, with_ids: bool = True) -> DataFrame:
    """Rows of ``schema`` that ``finish`` makes of the texts of each slice: it is given their ids, which are null, the places of their
    words, where each text's begin, ``strengths`` per word, and the token ids of the slice's words with their numbers. Slices and
    their words are kept as a table in the shared folder."""
    path = path or default_path()
    kind = df.schema[id_col].dataType.simpleString()
    table = materialise(df.select(id_col, text).mapInArrow(_cutter(strengths), f"slice bigint, kind tinyint, wide boolean, id {kind}, a binary, b binary"), "zstd")
    lists = table.where("kind = 0")
    total = lists.agg(F.sum(F.octet_length("a"))).head()[0] or 0  # one row, to fix the number of blocks
    blocks = max(1, -(-total // BLOCK_BYTES))
    words = lists.select("slice", "a", "b").mapInArrow(_spreader(blocks), "block int, slice bigint, a binary, b binary, at binary").repartitionById(blocks, F.col("block"))
    known = words.mapInArrow(_replayer(path, with_ids), "slice bigint, at binary, a binary, b binary")
    own = known.select("slice", F.lit(0).cast("tinyint").alias("kind"), F.lit(False).alias("wide"), F.lit(None).cast(kind).alias("id"), "a", "b", "at")
    texts = table.where("kind = 1").withColumn("at", F.lit(None).cast("binary"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = own.unionAll(texts).repartition(n, "slice").sortWithinPartitions("slice", "kind")
    return both.mapInArrow(_finisher(finish, vocabulary(path).kind), schema)


def _with_ids(ids: pa.Array, nulls: np.ndarray, code: np.ndarray, rows: np.ndarray, mark: np.ndarray, tokens: np.ndarray, per_word: np.ndarray) -> pa.RecordBatch:
    before = np.concatenate([[0], np.cumsum(per_word[code])])
    bounds = pa.array(before[rows].astype(np.int32), mask=np.append(nulls, False)) if nulls.any() else pa.array(before[rows].astype(np.int32))
    return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(bounds, pa.array(gather(tokens, per_word, code)))], names=["id", "out"])


def _with_counts(ids: pa.Array, nulls: np.ndarray, code: np.ndarray, rows: np.ndarray, mark: np.ndarray, tokens: np.ndarray, per_word: np.ndarray) -> pa.RecordBatch:
    before = np.concatenate([[0], np.cumsum(per_word[code])])
    return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(before[rows]), pa.int64(), mask=nulls)], names=["id", "out"])


def encode_texts(df: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, out: str = "ids") -> DataFrame:
    """(id, ids): the token ids of each row's text, without special tokens (their strings are ordinary text). A null text has
    null ids, an empty one the empty list; a blank text is encoded like any other; repeated ids give repeated rows; other
    columns are ignored; an empty table gives no row. Texts are processed whole, whatever their length."""
    kind = df.schema[id_col].dataType.simpleString()
    return encoded(df, id_col, text, path, _with_ids, f"id {kind}, out array<int>").toDF(id_col, out)


def token_counts(df: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, out: str = "n_tokens") -> DataFrame:
    """(id, n_tokens bigint): how many tokens each text has; null for a null text, 0 for an empty one."""
    kind = df.schema[id_col].dataType.simpleString()
    return encoded(df, id_col, text, path, _with_counts, f"id {kind}, out bigint", with_ids=False).toDF(id_col, out)


def _decoder(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                lists = batch.column(1).slice(i, 512)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                text = gather(vocab.token_bytes, vocab.byte_length, flat)
                ends = np.concatenate([[0], np.cumsum(vocab.byte_length[flat])])[np.concatenate([[0], np.cumsum(counts)])]
                whole = pa.Array.from_buffers(pa.string(), len(lists), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(text))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 512), pc.if_else(pc.is_null(lists), pa.scalar(None, pa.string()), whole)], names=["id", "out"])

    return run


def decode_ids(df: DataFrame, id_col: str = "doc_id", ids: str = "ids", path: str | None = None, out: str = "text") -> DataFrame:
    """(id, text): the text that token ids stand for; null for null ids, empty for none. Ids of no token stand for nothing."""
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, ids).mapInArrow(_decoder(path or default_path()), f"id {kind}, out string").toDF(id_col, out)
