"""N-gram language model: corpus counts by shard, answers by block, Elias-Fano tries in the blocks.

Documents are cut into blocks of about ``BLOCK`` tokens. A block asks for the corpus counts of all its
distinct words, pairs and triples: keys go to shards by their hash, each shard sums the training counts
that the blocks brought and answers each block in the order of its question, so that what is asked is a
run of sorted keys and what is answered a run of counts. Nothing is pruned and nothing is collected:
blocks, shards and what they exchange grow with the input, while one block or one shard stays of one size.

A block then lays the part of the model that its texts can meet in a trie: each level keeps the words of
its nodes and its pointers as Elias-Fano sequences and smoothed probabilities and back-off weights as
two-byte codes of one grid, all of them views of one memory map. Words are monotone by adding the last value of the range
before; a lookup takes a context's range from the pointers and searches it for the word's successor.

Probabilities are interpolated by Dirichlet priors: of a triple (c + S p2) / (c_context + S), of a pair
likewise over the word's, which is (c + 0.5) / (N + 0.5 (V + 1)); they sum to one over all words. What was never
counted backs off, by the weight S / (c_context + S). A text's first word has the end as its context.
S of an order is set so that, of all training tokens, each left out once, as many are expected to be new after
their context as are (n-grams counted once): sums over all shards, 25 of them an order.

Words are known by 64-bit hashes; pairs and triples by as many bits as the number of tokens has and
``SPARE_BITS`` more (64 at most), so that one lookup in 2**SPARE_BITS meets a stranger at most.

Defined results: a null or empty text is its end alone; an empty table gives an empty result;
without training rows every count is 0 and the score is the base score up to its code; rows that repeat are scored
each; a row with a null id trains.
"""

from __future__ import annotations

import json
import mmap
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import SPACE_RUN, read, stored
from plumbline.llm.ngram_join import mixed

#: Tokens in a block, beyond which a new one starts (a text is never cut), and tokens of the corpus for each shard.
BLOCK = 1_000_000
SHARD = 4_000_000
SPARE_BITS = 20
#: Weights of the lower order, in occurrences of the context, among which those of the model are chosen.
STRENGTHS = 2.0 ** np.arange(-4, 21)
ADDED = 0.5
#: The end token as a word; no word is empty.
END = ""
#: Codes of log10 values: a grid from ``LOWEST`` on, each value within half a step of its code.
CODES, LOWEST, STEP = 65_536, -24.0, 2.0**-11

_EACH, _TOP = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
#: The places of the set bits of each byte, in order.
_SET_BITS = np.array([sorted(range(8), key=lambda bit: (not byte >> bit & 1, bit)) for byte in range(256)], np.uint64)


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary with counts by word."""

    FIELDS = ("low", "high", "ones")

    def __init__(self, meta: tuple[int, int, int], low: np.ndarray, high: np.ndarray, ones: np.ndarray) -> None:
        self.n, self.width, self.top = meta
        self.low, self.high, self.ones = low, high, ones
        self.zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        values = values.astype(np.uint64)
        universe = int(values[-1]) + 1 if n else 1
        width = max(0, (universe // max(n, 1)).bit_length() - 1)
        at = np.arange(n, dtype=np.int64) * width
        low = np.zeros((n * width + 127) // 64 + 1, np.uint64)
        if width:
            bits = values & np.uint64((1 << width) - 1)
            offset = (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, at >> 6, bits << offset)
            over = (at & 63) + width > 64
            np.bitwise_or.at(low, (at[over] >> 6) + 1, bits[over] >> (np.uint64(64) - offset[over]))
        top = universe >> width
        place = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        high = np.zeros((n + top + 2 + 63) // 64 + 1, np.uint64)
        np.bitwise_or.at(high, place >> 6, np.uint64(1) << (place & 63).astype(np.uint64))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high).astype(np.int64))[:-1]])
        return cls((n, width, top), low, high, ones)

    @staticmethod
    def _within(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Places of the rank-th set bits of words: the byte by sums over bytes, the bit by a table."""
        rank = rank.astype(np.uint64)
        sums = word - ((word >> np.uint64(1)) & np.uint64(0x5555555555555555))
        sums = (sums & np.uint64(0x3333333333333333)) + ((sums >> np.uint64(2)) & np.uint64(0x3333333333333333))
        sums = ((sums + (sums >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _EACH  # of each byte and those below
        shift = np.bitwise_count(((rank * _EACH | _TOP) - sums) & _TOP).astype(np.uint64) << np.uint64(3)
        below = ((sums << np.uint64(8)) >> shift) & np.uint64(0xFF)
        byte = (word >> shift) & np.uint64(0xFF)
        return (shift + _SET_BITS[byte, rank - below]).astype(np.int64)

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.int64)
        at = i * self.width
        off = (at & 63).astype(np.uint64)
        first, second = self.low[at >> 6] >> off, (self.low[(at >> 6) + 1] << np.uint64(1)) << (np.uint64(63) - off)
        return ((first | second) & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at places."""
        word = np.searchsorted(self.ones, i, "right") - 1
        place = word * 64 + self._within(self.high[word], i - self.ones[word])
        return ((place - i) << self.width) | self._lows(i)

    def _before(self, h: np.ndarray) -> np.ndarray:
        """How many values have high bits below h."""
        k = np.maximum(h - 1, 0)
        word = np.searchsorted(self.zeros, k, "right") - 1
        place = word * 64 + self._within(~self.high[word], k - self.zeros[word])
        return np.where(h > 0, place - k, 0)

    def successor(self, x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The place of the first value not below each x in the range from begin to end; end if there is none."""
        h = np.minimum(x >> self.width, self.top + 1)
        i = np.clip(self._before(h), begin, end)
        # values with the same high bits, by their low bits
        stop = np.clip(self._before(np.minimum(h, self.top) + 1), i, end)
        low = x & ((1 << self.width) - 1)
        left = np.flatnonzero(i < stop)
        while len(left):
            middle = (i[left] + stop[left]) >> 1
            below = self._lows(middle) < low[left]
            i[left[below]] = middle[below] + 1
            stop[left[~below]] = middle[~below]
            left = left[i[left] < stop[left]]
        return i


def _coded(x: np.ndarray) -> np.ndarray:
    """Two-byte codes of log10 values on a grid that every trie shares, so that a value reads the same whatever lies beside it."""
    return np.clip(np.rint((x - LOWEST) / STEP), 0, CODES - 1).astype(np.uint16)


class Trie:
    """Levels of words, pairs and triples: p1.. are log10 probabilities, b1 and b2 log10 back-off weights."""

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.a = arrays
        self.words, self.starts = {}, {}
        for k in (2, 3):
            for kind, out in (("words", self.words), ("starts", self.starts)):
                out[k] = EliasFano(tuple(int(v) for v in arrays[f"{kind}{k}.meta"]), *(arrays[f"{kind}{k}.{f}"] for f in EliasFano.FIELDS))

    @classmethod
    def pack(cls, children: dict[int, tuple[int, np.ndarray, np.ndarray]], values: dict[str, np.ndarray]) -> bytes:
        """The bytes of a trie from the levels 2 and 3 as (nodes above, parents, words), by parent and word, and values by name."""
        arrays: dict[str, np.ndarray] = {}
        for k, (above, parents, words) in children.items():
            starts = np.concatenate([[0], np.cumsum(np.bincount(parents, minlength=above))])
            last = np.zeros(above, np.int64)
            last[parents] = words  # of equal parents the last assignment stays: their greatest word
            base = np.concatenate([[0], np.cumsum(last)[:-1]]) if above else last
            for kind, sequence in (("words", words + base[parents]), ("starts", starts)):
                ef = EliasFano.build(sequence)
                arrays[f"{kind}{k}.meta"] = np.array([ef.n, ef.width, ef.top])
                arrays |= {f"{kind}{k}.{f}": getattr(ef, f) for f in EliasFano.FIELDS}
        for name, x in values.items():
            arrays[name] = _coded(x)
        return cls.to_bytes(arrays)

    @staticmethod
    def to_bytes(arrays: dict[str, np.ndarray]) -> bytes:
        """A line that says where each array starts, then the arrays, each on a multiple of 8 bytes."""
        entries, body, at = [], [], 0
        for name, x in arrays.items():
            raw = np.ascontiguousarray(x).tobytes()
            entries.append([name, x.dtype.str, len(x), at])
            body.append(raw + bytes(-len(raw) % 8))
            at += len(body[-1])
        head = json.dumps(entries).encode()
        head += b" " * (-(len(head) + 1) % 8) + b"\n"
        return head + b"".join(body)

    @classmethod
    def mapped(cls, data: bytes) -> Trie:
        """The trie with its levels as views of one memory map."""
        memory = mmap.mmap(-1, len(data))
        memory.write(data)
        start = data.index(b"\n") + 1
        entries = json.loads(data[:start])
        return cls({name: np.frombuffer(memory, kind, count, start + at) for name, kind, count, at in entries})

    def find(self, level: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Nodes of a level for words after context nodes of the level above (-1 is none); -1 where there is none."""
        words, starts = self.words[level], self.starts[level]
        out = np.full(len(context), -1, np.int64)
        known = np.flatnonzero(context >= 0)
        if not words.n or not len(known):
            return out
        # a run of equal contexts reads its range once
        fresh = np.diff(context[known], prepend=-1) != 0
        first = context[known[fresh]]
        begin, end = starts.get(first), starts.get(first + 1)
        base = np.where(begin > 0, words.get(np.maximum(begin - 1, 0)), 0)
        of = np.cumsum(fresh) - 1
        of = of[some := (begin < end)[of]]
        known, begin, end, base = known[some], begin[of], end[of], base[of]
        target = base + word[known]
        at = words.successor(target, begin, end)
        inside = np.flatnonzero(at < end)
        hit = inside[words.get(at[inside]) == target[inside]]
        out[known[hit]] = at[hit]
        return out

    def value(self, name: str, node: np.ndarray) -> np.ndarray:
        return LOWEST + STEP * self.a[name][node]


def token_hashes(text: Column) -> Column:
    """Hashes of the words of a text, ASCII letters in lower case, and of the end."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    t = F.coalesce(text.cast("string"), F.lit(""))
    low = F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, upper, lower))
    return F.transform(F.concat(F.array_remove(F.split(low, SPACE_RUN), END), F.array(F.lit(END))), lambda w: F.xxhash64(w))


def keys(*hashes: np.ndarray) -> np.ndarray:
    """Keys of n-grams of word hashes; n is part of the key."""
    out = np.full(len(hashes[0]), len(hashes), np.uint64)
    for h in hashes:
        out = mixed(mixed(out * np.uint64(0x9E3779B97F4A7C15)) + h)
    return out


def packed(x: np.ndarray) -> bytes:
    """Whole numbers by byte planes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def unpacked(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def steps(x: np.ndarray) -> np.ndarray:
    """The first of sorted numbers, then the differences."""
    return np.diff(x, prepend=x[:1] * x.dtype.type(0))


class Grams:
    """The distinct pairs and triples of a block's tokens, and where the tokens find theirs."""

    def __init__(self, vocabulary: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> None:
        self.size, end = len(vocabulary), ids[ends[-1] - 1]
        self.begins = np.concatenate([[0], ends[:-1]])
        before = np.concatenate([[end], ids[:-1]]).astype(np.int64)
        before[self.begins] = end
        self.pair, self.pair_of = np.unique(before * self.size + ids, return_inverse=True)
        inner = np.ones(len(ids), bool)
        inner[self.begins] = False
        #: tokens after a text's first; each ends a triple that starts with the pair before
        self.inner = np.flatnonzero(inner)
        self.triple, self.triple_of = np.unique(self.pair_of[self.inner - 1] * self.size + ids[self.inner], return_inverse=True)
        self.v, self.w = np.divmod(self.pair, self.size)
        self.lead, self.last = np.divmod(self.triple, self.size)
        self.tail = np.zeros(len(self.triple), np.int64)  # the pair that ends each triple
        self.tail[self.triple_of] = self.pair_of[self.inner]
        self.vocabulary = vocabulary

    def keys(self, n: int) -> np.ndarray:
        h = self.vocabulary
        if n == 1:
            return h
        return keys(h[self.v], h[self.w]) if n == 2 else keys(h[self.v[self.lead]], h[self.w[self.lead]], h[self.last])


def in_blocks(docs: DataFrame, text_col: str, train_col: str) -> DataFrame:
    """Stored rows of block, rows (the other columns), trains, tokens, ends, ids and vocabulary (sorted word hashes)."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (text_col, train_col)]
    hashed = docs.select(F.struct(*kept).alias("row"), F.coalesce(train_col, F.lit(False)).alias("train"), token_hashes(F.col(text_col)).alias("_h"))

    def block(number: int, rows: list[pa.Array], trains: list[pa.Array], flat: list[np.ndarray], sizes: list[np.ndarray]) -> pa.RecordBatch:
        vocabulary, ids = np.unique(np.concatenate(flat), return_inverse=True)
        whole, flags = pa.concat_arrays(rows), pa.concat_arrays(trains)
        around = pa.array([0, len(whole)], pa.int32())
        ends = np.cumsum(np.concatenate(sizes))
        columns = [pa.array([number]), pa.ListArray.from_arrays(around, whole), pa.ListArray.from_arrays(around, flags), pa.array([len(ids)]), pa.array([packed(ends)]), pa.array([packed(ids.astype(np.uint32))]), pa.array([packed(steps(vocabulary))])]
        return pa.RecordBatch.from_arrays(columns, names=["block", "rows", "trains", "tokens", "ends", "ids", "vocabulary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, n = ([], [], [], []), 0
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                b = whole.slice(start, 256)
                offsets = np.asarray(b.column(2).offsets).astype(np.int64)
                held[0].append(b.column(0)), held[1].append(b.column(1))
                held[2].append(np.array(b.column(2).flatten()).view(np.uint64)), held[3].append(np.diff(offsets))
                n += int(offsets[-1] - offsets[0])
                if n >= BLOCK:
                    yield block(number, *held)
                    number, held, n = number + 1, ([], [], [], []), 0
        if n:
            yield block(number, *held)

    row_type = hashed.schema["row"].dataType.simpleString()
    return stored(hashed.mapInArrow(run, f"block bigint, rows array<{row_type}>, trains array<boolean>, tokens bigint, ends binary, ids binary, vocabulary binary"), "lm-blocks")


def _block(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.cumsum(unpacked(row["vocabulary"], np.uint64)), unpacked(row["ids"], np.uint32).astype(np.int64), unpacked(row["ends"], np.int64)


def key_bits(tokens: int) -> int:
    return min(64, max(1, tokens).bit_length() + SPARE_BITS)


def counted(blocks: DataFrame, tokens: int) -> DataFrame:
    """Stored answers: block, n, shard, counts of the n-grams of the block in the order of their keys; once a shard, what its counts sum to."""
    shards = max(1, -(-tokens // SHARD))
    bits = key_bits(tokens)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in ("block", "ends", "ids", "vocabulary")}
                vocabulary, ids, ends = _block(row)
                trains = np.repeat(np.asarray(b.column("trains")[i].values), np.diff(ends, prepend=0))
                grams = Grams(vocabulary, ids, ends)
                for n, of, trained in ((1, ids, trains), (2, grams.pair_of, trains), (3, grams.triple_of, trains[grams.inner])):
                    width = 64 if n == 1 else bits
                    key = grams.keys(n) >> np.uint64(64 - width)
                    count = np.bincount(of[trained], minlength=len(key)).astype(np.uint32)
                    order = np.argsort(key)
                    key, count = key[order], count[order]
                    cuts = [*np.searchsorted(key, np.array([(s << width) // shards for s in range(shards)], np.uint64)).tolist(), len(key)]
                    parts = [(s, lo, hi) for s, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if lo < hi]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "block": pa.array([row["block"]] * len(parts), pa.int64()),
                            "n": pa.array([n] * len(parts), pa.int32()),
                            "shard": pa.array([s for s, _, _ in parts], pa.int32()),
                            "keys": pa.array([packed(steps(key[lo:hi])) for _, lo, hi in parts], pa.binary()),
                            "counts": pa.array([packed(count[lo:hi]) for _, lo, hi in parts], pa.binary()),
                        }
                    )

    def answer(asked: pa.Table) -> pa.Table:
        # a shard is a range of hashes: of one size, whatever is frequent, since a block asks for a key once
        key = [np.cumsum(unpacked(k.as_py(), np.uint64)) for k in asked.column("keys")]
        distinct, of = np.unique(np.concatenate(key), return_inverse=True)
        counts = np.concatenate([unpacked(c.as_py(), np.uint32) for c in asked.column("counts")])
        total = np.bincount(of, weights=counts, minlength=len(distinct)).astype(np.uint64)
        found = np.split(total[of], np.cumsum([len(k) for k in key])[:-1])
        c = total[total > 0].astype(np.float64)
        times = np.bincount(np.minimum(c, 1 << 16).astype(np.int64)) if len(c) else np.zeros(1)
        c = np.arange(1, len(times))
        new = [float((times[1:] * c * s / (c - 1 + s)).sum()) for s in STRENGTHS]
        rest = [0] * (len(key) - 1)
        columns = [asked.column("block"), asked.column("n"), asked.column("shard"), pa.array([packed(x) for x in found], pa.binary())]
        columns += [pa.array([int(total.sum()), *rest], pa.int64()), pa.array([int((total > 0).sum()), *rest], pa.int64())]
        columns += [pa.array([int((total == 1).sum()), *rest], pa.int64()), pa.array([new, *([None] * len(rest))], pa.list_(pa.float64()))]
        return pa.Table.from_arrays(columns, names=["block", "n", "shard", "counts", "total", "distinct", "once", "new"])

    asked = blocks.select("block", "trains", "ends", "ids", "vocabulary").mapInArrow(ask, "block bigint, n int, shard int, keys binary, counts binary")
    return stored(asked.groupBy("n", "shard").applyInArrow(answer, "block bigint, n int, shard int, counts binary, total bigint, distinct bigint, once bigint, new array<double>"), "lm-answers")


def fitted(answers: DataFrame) -> tuple[int, int, tuple[float, float]]:
    """Training tokens, their distinct words and the weights of the lower order for pairs and for triples."""
    sums = {r["n"]: r for r in answers.groupBy("n").agg(F.sum("total").alias("total"), F.sum("distinct").alias("distinct"), F.sum("once").alias("once")).collect()}  # 3 rows
    new = answers.where("new is not null").select("n", F.posexplode("new")).groupBy("n", "pos").agg(F.sum("col").alias("new")).collect()  # len(STRENGTHS) rows an order
    if not sums:
        return 0, 0, (1.0, 1.0)

    def weight(n: int) -> float:
        expected = np.array([r["new"] for r in sorted((r for r in new if r["n"] == n - 1), key=lambda r: r["pos"])])
        return float(2.0 ** np.interp(sums[n]["once"] if n in sums else 0, expected, np.log2(STRENGTHS)))

    return sums[1]["total"], sums[1]["distinct"], (weight(2), weight(3))


def model_slice(grams: Grams, counts: list[np.ndarray], mass: float, strengths: tuple[float, float]) -> bytes:
    """The trie of what of a block's n-grams was counted, by the counts of its words, pairs and triples."""
    s2, s3 = strengths
    one, two, three = (c.astype(np.float64) for c in counts)
    p1 = (one + ADDED) / mass
    p2 = (two + s2 * p1[grams.w]) / (one[grams.v] + s2)
    p3 = (three + s3 * p2[grams.tail]) / (two[grams.lead] + s3)
    pairs, triples = np.flatnonzero(two > 0), np.flatnonzero(three > 0)
    node = np.cumsum(two > 0) - 1
    return Trie.pack(
        {2: (grams.size, grams.v[pairs], grams.w[pairs]), 3: (len(pairs), node[grams.lead[triples]], grams.last[triples])},
        {"p1": np.log10(p1), "b1": np.log10(s2 / (one + s2)), "p2": np.log10(p2[pairs]), "b2": np.log10(s3 / (two[pairs] + s3)), "p3": np.log10(p3[triples])},
    )


def token_scores(trie: Trie, grams: Grams) -> np.ndarray:
    """log10 probability of each token of a block; each distinct pair and triple is looked up once."""
    pair = trie.find(2, grams.v, grams.w)
    of_pair = trie.value("b1", grams.v) + trie.value("p1", grams.w)
    seen = np.flatnonzero(pair >= 0)
    of_pair[seen] = trie.value("p2", pair[seen])
    triple = trie.find(3, pair[grams.lead], grams.last)
    rest = np.zeros(len(pair))
    rest[seen] = trie.value("b2", pair[seen])
    of_triple = rest[grams.lead] + of_pair[grams.tail]
    seen = np.flatnonzero(triple >= 0)
    of_triple[seen] = trie.value("p3", triple[seen])
    out = of_pair[grams.pair_of]
    out[grams.inner] = of_triple[grams.triple_of]
    return out


def with_lm_scores(docs: DataFrame, train: Column, text_col: str = "text") -> DataFrame:
    """``docs`` with n_tokens, n_known, train_tokens, base_score and score instead of the text, by a model of the rows where ``train`` holds.

    Other columns travel with the blocks of texts; ours replace columns of the same names.
    """
    added = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    kept = [f for f in docs.schema.fields if f.name not in (*added, text_col)]
    blocks = in_blocks(docs.select(*(F.col(f"`{f.name}`") for f in kept), F.col(text_col).alias("_text_"), train.alias("_train_")), "_text_", "_train_")
    tokens = blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    answers = counted(blocks, tokens)
    total, distinct, strengths = fitted(answers)
    mass = total + ADDED * (distinct + 1)

    def scored(block: pa.Table, answers: pa.Table) -> pa.Table:
        vocabulary, ids, ends = _block(block.select(["ends", "ids", "vocabulary"]).to_pylist()[0])
        grams = Grams(vocabulary, ids, ends)
        n, shard = (np.asarray(answers.column(c)) for c in ("n", "shard"))
        counts = []
        for k in (1, 2, 3):
            parts = np.flatnonzero(n == k)[np.argsort(shard[n == k])]
            answered = [unpacked(answers.column("counts")[int(i)].as_py(), np.uint64) for i in parts]
            key = grams.keys(k) >> np.uint64(0 if k == 1 else 64 - key_bits(tokens))
            count = np.zeros(len(key), np.int64)
            if answered:
                count[np.argsort(key)] = np.concatenate(answered)
            counts.append(count)
        trie = Trie.mapped(model_slice(grams, counts, mass, strengths))
        base = np.log10((counts[0] + ADDED) / mass)[ids]
        sums = [np.add.reduceat(x, grams.begins) for x in ((counts[0] > 0)[ids].astype(np.int64), base, token_scores(trie, grams))]
        rows = block.column("rows").combine_chunks().flatten()
        columns = [pa.array(np.diff(ends, prepend=0)), pa.array(sums[0]), pa.array(np.full(len(ends), total, np.int64)), pa.array(sums[1]), pa.array(sums[2])]
        return pa.Table.from_arrays([*(rows.field(i) for i in range(len(kept))), *columns], names=[*(f.name for f in kept), *added])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"])
    return blocks.drop("trains", "tokens").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scored, schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 1, F.lit(False))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", held_out().alias("held_out"), "text")
    return with_lm_scores(docs, ~F.col("held_out"))
