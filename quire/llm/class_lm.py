"""Language-model scores from a Brown class-based bigram model.

    P(text) = prod_t P(class_t | class_t-1) * P(word_t | class_t)

The exchange algorithm assigns the ``head`` most frequent words to ``classes``
classes so that the mutual information of neighbouring classes is largest. Every
other word of the training part starts in a class by its shape; a distributed pass
of the exchange then moves each of them, however rare, to the class that its own
neighbours favour. Only words that no training text holds are classed by shape alone.
Emissions use the word's count over the whole training corpus.

Each task encodes its documents in blocks: the block's distinct words, split by a
hash into parts, and the token sequence as positions in that list. A word part is
merged over all blocks in one place, which answers every block with the words'
counts; so a word crosses the network once for each block it occurs in, not once
for each document, and neither vocabulary nor counts are ever broadcast. The classes
of a word's neighbours travel and are answered the same way. What is broadcast is bounded by parameters: the head words and the class tables.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import batches as batch_bounds
from quire.llm.common import parallelism, written

ALPHA = 0.1
#: The end of a text, as a word that no text can hold.
END = b"\n"
BLOCK_BYTES = 6 << 20
#: Bytes of the input table for which there is one word part, so that a part stays as small at any size.
PART_BYTES = 16 << 20
#: Blocks, and rows of word parts, in an Arrow batch.
BLOCKS, PARTS = 4, 64
SHAPES = 12


def _pack(a: np.ndarray | bytes) -> bytes:
    return zstandard.compress(a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes(), 3)


def _open(blob: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), dtype)


def tokens(text: bytes) -> list[bytes]:
    """A-Z lowered; the six ASCII white-space characters separate words; END closes."""
    words = text.lower().split()
    words.append(END)
    return words


def shape(word: bytes) -> int:
    """0 to 11, for words that no class was learned for: last character, digits, non-ASCII."""
    last = word[-1:]
    ends = 1 if last in (b".", b"!", b"?") else 2 if not (last.isalnum() or last > b"\x7f") else 0
    return ends * 4 + 2 * any(48 <= c < 58 for c in word) + (not word.isascii())


# --- encoding -------------------------------------------------------------------------------

ENCODED = "block long, docs binary, lengths binary, held binary, codes binary, parts array<struct<part:int, words:binary, counts:binary>>"


def _encode(batches: Iterator[pa.RecordBatch], n_parts: int) -> Iterator[pa.RecordBatch]:
    ids: list[int] = []
    held: list[bool] = []
    lengths: list[int] = []
    codes: list[np.ndarray] = []
    index: dict[bytes, int] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        words = list(index)
        sequence = np.concatenate(codes).astype("<u4")
        learned = np.repeat(~np.array(held, bool), lengths)
        counts = np.bincount(sequence[learned], minlength=len(words))
        part = np.fromiter((xxhash.xxh64_intdigest(w) % n_parts for w in words), np.int64, len(words))
        order = np.argsort(part, kind="stable")
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        rows = []
        cuts = np.searchsorted(part[order], np.arange(n_parts + 1))
        for p in range(n_parts):
            own = order[cuts[p] : cuts[p + 1]]
            if len(own):
                rows.append({"part": p, "words": _pack(b" ".join([words[i] for i in own])), "counts": _pack(counts[own].astype("<i8"))})
        key = xxhash.xxh64(np.array(ids, "<i8").tobytes() + _pack(sequence[:64])).intdigest()
        block = int(np.array([key], np.uint64).view(np.int64)[0])
        return pa.RecordBatch.from_pylist(
            [{"block": block, "docs": _pack(np.array(ids, "<i8")), "lengths": _pack(np.array(lengths, "<i8")), "held": _pack(np.array(held, "u1")), "codes": _pack(place[sequence].astype("<u4")), "parts": rows}],
            schema=_SCHEMA,
        )

    for batch in batches:
        for doc, out, text in zip(batch.column("id").to_pylist(), batch.column("held_out").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
            text = text.as_py() or b""
            found = tokens(text)
            for w in found:
                if w not in index:
                    index[w] = len(index)
            codes.append(np.fromiter(map(index.__getitem__, found), np.uint32, len(found)))
            ids.append(doc)
            held.append(out)
            lengths.append(len(found))
            size += len(text)
            if size >= BLOCK_BYTES:
                yield flush()
                ids, held, lengths, codes, index, size = [], [], [], [], {}, 0
    if ids:
        yield flush()


_SCHEMA = pa.schema(
    [("block", pa.int64()), ("docs", pa.binary()), ("lengths", pa.binary()), ("held", pa.binary()), ("codes", pa.binary())]
    + [("parts", pa.list_(pa.struct([("part", pa.int32()), ("words", pa.binary()), ("counts", pa.binary())])))]
)


def _split_words(blob: bytes) -> list[bytes]:
    return zstandard.decompress(blob).split(b" ")


# --- counts of a word part, over all blocks ----------------------------------------------------


def _merge_part(batches: list[tuple[int, bytes, bytes]], head: int) -> dict:
    """All blocks' rows of one part: the answer to each block, statistics, and the part's head words."""
    index: dict[bytes, int] = {}
    where, totals = [], np.zeros(0, np.int64)
    for _, words, counts in batches:
        found = _split_words(words)
        for w in found:
            if w not in index:
                index[w] = len(index)
        at = np.fromiter(map(index.__getitem__, found), np.int64, len(found))
        if len(index) > len(totals):
            totals = np.concatenate((totals, np.zeros(max(len(index), 2 * len(totals)) - len(totals), np.int64)))
        totals[at] += _open(counts, "<i8")
        where.append(at.astype(np.uint32))
    totals = totals[: len(index)]
    known = list(index)
    seen = np.flatnonzero(totals)
    top = seen[np.argsort(-totals[seen], kind="stable")]
    if len(top) > head:
        top = top[totals[top] >= totals[top[head - 1]]]  # ties are cut later, by the word itself
    shapes = np.fromiter((shape(known[i]) for i in seen), np.int64, len(seen))
    return {
        "answers": [(batches[i][0], totals[at]) for i, at in enumerate(where)],
        "distinct": np.bincount(shapes, minlength=SHAPES),
        "tokens": np.bincount(shapes, totals[seen], SHAPES).astype(np.int64),
        "head": sorted(((int(totals[i]), known[i]) for i in top), key=lambda x: (-x[0], x[1]))[:head],
    }


MERGED = "kind string, block long, part int, payload binary, word binary, n long"


def _merge_rows(batches: Iterator[pa.RecordBatch], head: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part: part, block, words, counts."""

    def done(part: int, rows: list) -> pa.RecordBatch:
        m = _merge_part(rows, head)
        out = [("answer", b, part, _pack(a.astype("<i8")), None, None) for b, a in m["answers"]]
        out += [("distinct", s, None, None, None, int(n)) for s, n in enumerate(m["distinct"])]
        out += [("tokens", s, None, None, None, int(n)) for s, n in enumerate(m["tokens"])]
        out.append(("head", None, part, _pack(b" ".join(w for _, w in m["head"])), _pack(np.array([n for n, _ in m["head"]], "<i8")), len(m["head"])))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["kind", "block", "part", "payload", "word", "n"])

    part, rows = None, []
    for batch in batches:
        for p, b, w, c in zip(*(batch.column(k).to_pylist() for k in ("part", "block", "words", "counts")), strict=True):
            if p != part and rows:
                yield done(part, rows)
                rows = []
            part = p
            rows.append((b, w, c))
    if rows:
        yield done(part, rows)


def _head_rows(batches: Iterator[pa.RecordBatch], head: int) -> Iterator[pa.RecordBatch]:
    """The most frequent words of several parts, packed; ties go to the word that sorts first."""
    best: list[tuple[int, bytes]] = []
    for batch in batches:
        for words, counts, n in zip(*(batch.column(k).to_pylist() for k in ("payload", "word", "n")), strict=True):
            if n:
                best += zip((-_open(counts, "<i8")).tolist(), _split_words(words), strict=True)
                best = heapq.nsmallest(head, best)
    if best:
        yield pa.RecordBatch.from_pydict({"words": pa.array([_pack(b" ".join(w for _, w in best))], pa.binary()), "counts": pa.array([_pack(np.array([-n for n, _ in best], "<i8"))], pa.binary())})


# --- classes ------------------------------------------------------------------------------------


def _symbols(parts: list[dict], head: dict[bytes, int]) -> np.ndarray:
    """Of each word of a block: its place among the head words, or len(head) + its shape."""
    out = []
    for p in parts:
        out += [head[w] if w in head else len(head) + shape(w) for w in _split_words(p["words"])]
    return np.array(out, np.int64)


def _bigram_rows(batches: Iterator[pa.RecordBatch], head: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    n = len(head) + SHAPES + 1  # the last stands before every text
    total = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        for row in batch.to_pylist():
            seq = _symbols(row["parts"], head)[_open(row["codes"], "<u4")]
            lengths, held = _open(row["lengths"], "<i8"), _open(row["held"], "u1").astype(bool)
            before = np.concatenate(([n - 1], seq[:-1]))
            before[np.concatenate(([0], np.cumsum(lengths)[:-1]))] = n - 1
            keep = ~np.repeat(held, lengths)
            pair, c = np.unique(before[keep] * n + seq[keep], return_counts=True)
            both, at = np.unique(np.concatenate((total[0], pair)), return_inverse=True)
            total = both, np.bincount(at, np.concatenate((total[1], c)), len(both)).astype(np.int64)
    yield pa.RecordBatch.from_pydict({"pair": total[0], "n": total[1]})


def _packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of a partition's pairs as one row: what reaches the driver is a few bytes a pair."""
    got = [(b.column("pair").to_numpy(), b.column("n").to_numpy()) for b in batches]
    if got:
        pair, n = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.argsort(pair)
        yield pa.RecordBatch.from_pydict({"pair": pa.array([_pack(np.diff(pair[order], prepend=0).astype("<u4"))], pa.binary()), "n": pa.array([_pack(n[order].astype("<i8"))], pa.binary())})


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(a: np.ndarray, b: np.ndarray, n: np.ndarray, head: int, classes: int, rounds: int = 4) -> np.ndarray:
    """Class of each of the head words, from the counts n of the symbol pairs (a, b).

    Words start dealt round robin by frequency and then move, one at a time, to the
    class that raises the sum of N(c,d) ln N(c,d) - N(c) ln N(c) - N(d) ln N(d) most.
    Symbols from head on (shapes and the start) keep classes of their own.
    """
    total = int(max(a.max(initial=0), b.max(initial=0), head + SHAPES)) + 1
    k = classes + total - head
    of = np.concatenate((np.arange(head) % classes, classes + np.arange(total - head)))
    matrix = np.zeros((k, k))
    np.add.at(matrix, (of[a], of[b]), n)
    by_a, by_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    cut_a, cut_b = np.searchsorted(a[by_a], np.arange(total + 1)), np.searchsorted(b[by_b], np.arange(total + 1))
    for _ in range(rounds):
        moved = 0
        for w in range(head):
            right, left = by_a[cut_a[w] : cut_a[w + 1]], by_b[cut_b[w] : cut_b[w + 1]]
            if not len(right) and not len(left):
                continue
            own = of[w]
            self_n = float(n[right][b[right] == w].sum())
            r = np.bincount(of[b[right]], n[right], k)
            ln = np.bincount(of[a[left]], n[left], k)
            r[own] -= self_n
            ln[own] -= self_n  # w with itself goes wherever w goes
            matrix[own] -= r
            matrix[:, own] -= ln
            matrix[own, own] -= self_n
            rows, cols = matrix.sum(axis=1), matrix.sum(axis=0)
            r_n, l_n = r.sum() + self_n, ln.sum() + self_n
            # only row and column of the class that takes w change
            gain = (xlogx(matrix[:classes] + r) - xlogx(matrix[:classes])).sum(axis=1)
            gain += (xlogx(matrix[:, :classes] + ln[:, None]) - xlogx(matrix[:, :classes])).sum(axis=0)
            d = np.arange(classes)
            corner = matrix[d, d]
            gain -= xlogx(corner + r[d]) + xlogx(corner + ln[d]) - 2 * xlogx(corner)
            gain += xlogx(corner + r[d] + ln[d] + self_n) - xlogx(corner)
            gain -= xlogx(rows[:classes] + r_n) - xlogx(rows[:classes]) + xlogx(cols[:classes] + l_n) - xlogx(cols[:classes])
            best = int(np.argmax(gain))
            if gain[best] <= gain[own] + 1e-9:
                best = own
            matrix[best] += r
            matrix[:, best] += ln
            matrix[best, best] += self_n
            moved += best != own
            of[w] = best
        if not moved:
            break
    return of[:head]


@dataclass
class ClassModel:
    head: dict[bytes, int]
    of_symbol: np.ndarray  # class of each head word, then of each shape
    steps: np.ndarray  # counts of class pairs, the last row before a text
    log_step: np.ndarray  # log10 P(class | class before)
    class_tokens: np.ndarray
    class_words: np.ndarray  # distinct
    train_tokens: int
    distinct: int


def _fit(encoded: DataFrame, merged: DataFrame, head: int, classes: int) -> ClassModel:
    spark = encoded.sparkSession
    heads = merged.where("kind = 'head'").select("part", "payload", "word", "n")
    # as many tasks as each of them merges parts: neither they nor the driver see many
    few = heads.repartition(max(1, int(parallelism(spark) ** 0.5)), "part").mapInArrow(lambda b: _head_rows(b, head), "words binary, counts binary")
    with batch_bounds(spark, PARTS):
        best = []
        for r in few.toLocalIterator():  # of one task after the other
            best = heapq.nsmallest(head, best + list(zip((-_open(bytes(r.counts), "<i8")).tolist(), _split_words(bytes(r.words)), strict=True)))
    count = {w: -n for n, w in best}
    words = list(count)
    stats = {(r.kind, r.block): r.n for r in merged.where("kind IN ('distinct', 'tokens')").groupBy("kind", "block").agg(F.sum("n").alias("n")).collect()}
    places = {w: i for i, w in enumerate(words)}
    shared = spark.sparkContext.broadcast(places)
    pairs = encoded.select("codes", "lengths", "held", "parts").mapInArrow(lambda b: _bigram_rows(b, shared.value), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counted = written(pairs, "pairs", BLOCKS)
    with batch_bounds(spark, 1 << 16):
        got = counted.mapInArrow(_packed_rows, "pair binary, n binary").collect()  # (head + 13) squared pairs at most, and sparse
    m = len(words)
    pair = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(_open(bytes(r.pair), "<u4"), dtype=np.int64) for r in got)])
    n = np.concatenate([np.zeros(0), *(_open(bytes(r.n), "<i8").astype(np.float64) for r in got)])
    del got
    a, b = (pair // (m + SHAPES + 1)).astype(np.int32), (pair % (m + SHAPES + 1)).astype(np.int32)
    del pair
    learned = exchange(a, b, n, m, classes)
    of = np.concatenate((learned, classes + np.arange(SHAPES))).astype(np.int64)
    k = classes + SHAPES
    steps = np.zeros((k + 1, k))
    row = np.where(a == m + SHAPES, k, of[np.minimum(a, m + SHAPES - 1)])
    np.add.at(steps, (row, of[b]), n)
    in_head = np.zeros((2, SHAPES), np.int64)
    tokens_, distinct_ = np.zeros(k, np.int64), np.zeros(k, np.int64)
    for w, i in places.items():
        tokens_[of[i]] += count[w]
        distinct_[of[i]] += 1
        in_head[0, shape(w)] += count[w]
        in_head[1, shape(w)] += 1
    for s in range(SHAPES):
        tokens_[classes + s] = stats.get(("tokens", s), 0) - in_head[0, s]
        distinct_[classes + s] = stats.get(("distinct", s), 0) - in_head[1, s]
    return ClassModel(places, of, steps, _log_step(steps), tokens_, distinct_, int(tokens_.sum()), int(distinct_.sum()))


def _log_step(steps: np.ndarray) -> np.ndarray:
    seen = steps.sum(axis=0)
    back = (seen + 1) / (seen.sum() + steps.shape[1])  # a row's own counts, smoothed by the classes' shares
    return np.log10((steps + 5.0 * back) / (steps.sum(axis=1, keepdims=True) + 5.0))


def likelihood(steps: np.ndarray) -> float:
    """What the classes add to the training log-likelihood, but for a constant."""
    return float(xlogx(steps).sum() - xlogx(steps.sum(axis=1)).sum() - xlogx(steps.sum(axis=0)).sum())


# --- classes of the words outside the head ------------------------------------------------------

NEIGHBOURS = "part int, block long, words binary, sizes binary, sides binary, counts binary"
LEARNED = "kind string, block long, part int, payload binary, n long"


def _before(seq: np.ndarray, lengths: np.ndarray, start: int) -> np.ndarray:
    before = np.concatenate(([start], seq[:-1]))
    before[np.concatenate(([0], np.cumsum(lengths)[:-1]))] = start
    return before


def _neighbour_rows(batches: Iterator[pa.RecordBatch], m: ClassModel) -> Iterator[pa.RecordBatch]:
    """Of each word outside the head, in a block: how often each class stands before and after it.

    A side is a class before (k: the start of a text), or k + 2 + a class after; k + 1 and
    2k + 3 are the word itself.
    """
    k = m.steps.shape[1]
    for batch in batches:
        for row in batch.to_pylist():
            symbols = _symbols(row["parts"], m.head)
            codes, lengths = _open(row["codes"], "<u4").astype(np.int64), _open(row["lengths"], "<i8")
            keep = ~np.repeat(_open(row["held"], "u1").astype(bool), lengths)
            rare = symbols >= len(m.head)
            seq = m.of_symbol[symbols][codes]
            before, word = _before(seq, lengths, k), _before(codes, lengths, -1)
            left = np.where(word == codes, k + 1, before)
            right = np.where(word == codes, k + 1, seq) + k + 2
            is_left, is_right = keep & rare[codes], keep & (word >= 0) & rare[word]
            width = 2 * (k + 2)
            key, n = np.unique(np.concatenate((codes[is_left] * width + left[is_left], word[is_right] * width + right[is_right])), return_counts=True)
            sizes = np.bincount(key // width, minlength=len(symbols))
            at, first = 0, np.concatenate(([0], np.cumsum(sizes)))
            out = []
            for p in row["parts"]:
                end = at + len(_split_words(p["words"]))
                own = slice(first[at], first[end])
                out.append({"part": p["part"], "block": row["block"], "words": p["words"], "sizes": _pack(sizes[at:end].astype("<u4")), "sides": _pack((key[own] % width).astype("<u2")), "counts": _pack(n[own].astype("<u4"))})
                at = end
            yield pa.RecordBatch.from_pylist(out, schema=_NEIGHBOURS)


_NEIGHBOURS = pa.schema([("part", pa.int32()), ("block", pa.int64())] + [(c, pa.binary()) for c in ("words", "sizes", "sides", "counts")])


def placed(word: np.ndarray, side: np.ndarray, n: np.ndarray, own: np.ndarray, steps: np.ndarray, chunk: int = 16_384) -> np.ndarray:
    """The class of each word, from its class own before, by the gain of exchange().

    (word, side, n) are sorted by word, as _neighbour_rows() has sides. All words are judged against
    the same counts, less their own; what a word adds to both its row and its column of one
    cell is taken apart, which is exact but for a word beside its own class. A move has to gain
    more than ln k, what it takes to name a class: else the few neighbours of a rare word would
    empty the shape classes, where unseen words are.
    """
    k = steps.shape[1]
    d = np.arange(k)
    rows, cols = steps[:k].sum(axis=1), steps.sum(axis=0)
    of = own.copy()
    has, first, size = np.unique(word, return_index=True, return_counts=True)
    first = np.append(first, len(word))
    at = 0
    while at < len(has):
        to = max(at + 1, int(np.searchsorted(first, first[at] + chunk, "right")) - 1)
        s = slice(first[at], first[to])
        e_side, e_n = side[s], n[s].astype(float)
        local = np.repeat(np.arange(to - at), size[at:to])
        here = of[has[at:to]]
        left = e_side < k + 2
        c = np.where(left, e_side, e_side - k - 2)
        itself = c == k + 1
        cell = np.where(left[:, None], steps[np.minimum(c, k)], steps[:k, np.minimum(c, k - 1)].T)
        cell = np.where(itself[:, None], steps[d, d], cell)
        mine = d[None, :] == here[local][:, None]
        cell = np.maximum(cell - mine * e_n[:, None], 0)
        gain = xlogx(cell + e_n[:, None]) - xlogx(cell)
        gain[itself & left] = 0  # a pair of the word with itself is in both sides, and once a cell
        total = np.add.reduceat(gain, np.concatenate(([0], np.cumsum(size[at:to])[:-1])))
        l_n, r_n = (np.bincount(local, e_n * x, to - at)[:, None] for x in (left, ~left))
        stays = d[None, :] == here[:, None]
        r0, c0 = np.maximum(rows - stays * r_n, 0), np.maximum(cols - stays * l_n, 0)
        total -= xlogx(r0 + r_n) - xlogx(r0) + xlogx(c0 + l_n) - xlogx(c0)
        total[:, rows + cols == 0] = -np.inf  # all words would meet in an empty class
        best = total.argmax(axis=1)
        i = np.arange(to - at)
        of[has[at:to]] = np.where(total[i, best] > total[i, here] + np.log(k), best, here)
        at = to
    return of


def _learn_part(batches: list[tuple], m: ClassModel) -> tuple[list[np.ndarray], np.ndarray]:
    """Of all blocks' rows of one part: each block's words' classes, and the number of moved or shaped words a class."""
    index: dict[bytes, int] = {}
    where, keys, counts = [], [], []
    width = 2 * (m.steps.shape[1] + 2)
    for _, words, sizes, sides, n in batches:
        found = _split_words(words)
        for w in found:
            if w not in index:
                index[w] = len(index)
        at = np.fromiter(map(index.__getitem__, found), np.int64, len(found))
        where.append(at)
        keys.append(np.repeat(at, _open(sizes, "<u4")) * width + _open(sides, "<u2"))
        counts.append(_open(n, "<u4"))
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(at, np.concatenate(counts), len(key))
    own = m.of_symbol[np.array([m.head[w] if w in m.head else len(m.head) + shape(w) for w in index], np.int64)]
    of = placed(key // width, key % width, n, own, m.steps)
    return [of[x] for x in where], np.bincount(of[np.unique(key // width)], minlength=m.steps.shape[1])


def _learn_rows(batches: Iterator[pa.RecordBatch], m: ClassModel) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part, as _neighbour_rows() makes them."""

    def done(part: int, rows: list) -> pa.RecordBatch:
        answers, distinct = _learn_part(rows, m)
        out = [("class", b[0], part, _pack(a.astype("<u2")), None) for b, a in zip(rows, answers, strict=True)]
        out += [("distinct", c, None, None, int(x)) for c, x in enumerate(distinct)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int64()), strict=True)], names=["kind", "block", "part", "payload", "n"])

    part, rows = None, []
    for batch in batches:
        for p, *row in zip(*(batch.column(k).to_pylist() for k in ("part", "block", "words", "sizes", "sides", "counts")), strict=True):
            if p != part and rows:
                yield done(part, rows)
                rows = []
            part = p
            rows.append(tuple(row))
    if rows:
        yield done(part, rows)


PLACED = "docs binary, lengths binary, held binary, codes binary, counts binary, core binary, classes binary"


def _placed_rows(batches: Iterator[pa.RecordBatch], m: ClassModel) -> Iterator[pa.RecordBatch]:
    """Blocks with their words' counts and classes, before (core) and after the pass; the words are not needed any more."""
    for batch in batches:
        for row in batch.to_pylist():
            got = {(x["kind"], x["part"]): x["payload"] for x in row["answers"]}
            each = lambda kind, dtype: np.concatenate([_open(got[kind, p["part"]], dtype) for p in row["parts"]])  # noqa: B023, E731
            out = {c: row[c] for c in ("docs", "lengths", "held", "codes")}
            out |= {"counts": _pack(each("answer", "<i8")), "core": _pack(m.of_symbol[_symbols(row["parts"], m.head)].astype("<u2")), "classes": _pack(each("class", "<u2"))}
            yield pa.RecordBatch.from_pylist([out], schema=pa.schema([(c, pa.binary()) for c in ("docs", "lengths", "held", "codes", "counts", "core", "classes")]))


def _step_rows(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros((k + 1) * k, np.int64)
    for batch in batches:
        for row in batch.to_pylist():
            seq, lengths = _open(row["classes"], "<u2").astype(np.int64)[_open(row["codes"], "<u4")], _open(row["lengths"], "<i8")
            keep = ~np.repeat(_open(row["held"], "u1").astype(bool), lengths)
            total += np.bincount((_before(seq, lengths, k) * k + seq)[keep], minlength=len(total))
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"pair": seen, "n": total[seen]})


def _grow(m: ClassModel, learned: DataFrame, blocks: DataFrame) -> tuple[ClassModel, str]:
    """The model after the pass, and the column of blocks with its classes. All words move at once, so the
    likelihood could fall: then the classes before the pass stay."""
    k = m.steps.shape[1]
    steps = np.zeros((k + 1) * k)
    with batch_bounds(blocks.sparkSession, BLOCKS):
        for r in blocks.mapInArrow(lambda b: _step_rows(b, k), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
            steps[r.pair] = r.n
    steps = steps.reshape(k + 1, k)
    if likelihood(steps) <= likelihood(m.steps):
        return m, "core"
    words = np.bincount(m.of_symbol[: len(m.head)], minlength=k)
    for r in learned.where("kind = 'distinct'").groupBy("block").agg(F.sum("n").alias("n")).collect():
        words[r.block] += r.n
    return ClassModel(m.head, m.of_symbol, steps, _log_step(steps), steps.sum(axis=0).astype(np.int64), words, m.train_tokens, m.distinct), "classes"


# --- scores -------------------------------------------------------------------------------------


def _score_block(row: dict, column: str, m: ClassModel) -> dict:
    counts, classes = _open(row["counts"], "<i8"), _open(row[column], "<u2")
    base = np.log10((counts + ALPHA) / (m.train_tokens + ALPHA * (m.distinct + 1)))
    emit = np.log10((counts + ALPHA) / (m.class_tokens[classes] + ALPHA * (m.class_words[classes] + 1)))
    codes, lengths = _open(row["codes"], "<u4"), _open(row["lengths"], "<i8")
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    seq = classes[codes]
    before = np.concatenate(([len(m.log_step) - 1], seq[:-1]))
    before[starts] = len(m.log_step) - 1
    total = lambda x: np.add.reduceat(x, starts)
    return {
        "doc_id": _open(row["docs"], "<i8"),
        "held_out": _open(row["held"], "u1").astype(bool),
        "n_tokens": lengths,
        "n_known": total((counts > 0).astype(np.int64)[codes]),
        "train_tokens": np.full(len(lengths), m.train_tokens, np.int64),
        "base_score": total(base[codes]),
        "score": total(emit[codes] + m.log_step[before, seq]),
    }


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _parts(docs: DataFrame) -> int:
    """Word parts for a table of this size, by the planner's estimate; 1 where it has none."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return -(-size // PART_BYTES) if size < 1 << 50 else 1


def class_lm_scores(docs: DataFrame, held_out, head: int = 2048, classes: int = 48) -> DataFrame:
    """Score every row of docs (doc_id, text), learning from those where held_out is false.

    Returns doc_id, held_out, n_tokens (words and one end), n_known (tokens that the
    training part has), train_tokens, base_score (smoothed unigrams, log10) and score
    (this model, log10). A null text is an empty one and has one token, its end. A null
    doc_id comes back null. With no training rows every token is unknown and counts of
    zero are smoothed; repeated rows are learned and scored as often as they occur; an
    empty table gives an empty one. ``head`` and ``classes`` bound what reaches the driver:
    head words, their pairs, and the class tables.
    """
    spark = docs.sparkSession
    n_parts = max(parallelism(spark), _parts(docs))
    no_id = -(2**63)
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(no_id)).alias("id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    encoded = written(source.mapInArrow(lambda b: _encode(b, n_parts), ENCODED), "encoded")
    parts = encoded.select("block", F.explode("parts").alias("p")).select("p.part", "block", "p.words", "p.counts")
    dealt = parts.repartition(parallelism(spark), "part").sortWithinPartitions("part")
    merged = written(dealt.mapInArrow(lambda b: _merge_rows(b, head), MERGED), "counts", PARTS)
    core = _fit(encoded, merged, head, classes)
    shared = spark.sparkContext.broadcast(core)
    beside = encoded.select("block", "codes", "lengths", "held", "parts").mapInArrow(lambda b: _neighbour_rows(b, shared.value), NEIGHBOURS)
    learned = written(beside.repartition(parallelism(spark), "part").sortWithinPartitions("part").mapInArrow(lambda b: _learn_rows(b, shared.value), LEARNED), "classes", BLOCKS)
    both = merged.where("kind = 'answer'").select("kind", "block", "part", "payload").unionAll(learned.where("kind = 'class'").select("kind", "block", "part", "payload"))
    answers = both.groupBy("block").agg(F.collect_list(F.struct("kind", "part", "payload")).alias("answers"))
    blocks = written(encoded.join(answers.hint("shuffle_hash"), "block").mapInArrow(lambda b: _placed_rows(b, shared.value), PLACED), "placed", BLOCKS)
    grown, column = _grow(core, learned, blocks)
    model = spark.sparkContext.broadcast(grown)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pydict(_score_block(row, column, model.value))

    out = blocks.mapInArrow(rows, SCORED)
    return written(out.withColumn("doc_id", F.when(F.col("doc_id") != no_id, F.col("doc_id"))), "scores", BLOCKS)
