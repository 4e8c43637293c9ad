"""Language-model scoring with an Elias-Fano n-gram trie.

Model: p(w | v) = q(v, w) + a(v) * p(w), an interpolated bigram model by absolute discounting:
q = (c(v w) - D) / c(v), a(v) = D * (different successors of v) / c(v), and p(w) = (c(w) + s) / (N + s (V + 1)),
which leaves s / (N + s (V + 1)) for all unknown words. An unknown or missing v has a = 1, q = 0. A text is its
words, A-Z lower-cased, then one end, which is also what stands before the first word.

Counting. Each task counts the words of its rows, by hash, in one sorted chunk of (hash, count) for each shard;
one row a shard moves through the shuffle, and a reducer merges sorted chunks. Pairs are counted the same way
in a second pass, as (first word's id, second's id). What is gathered follows the input; nothing is cut.

Trie. Level 1 has the words: each shard a range of 64-bit word hashes, Elias-Fano coded; a word's id is its rank.
Level 2 has the pairs, in shards by the first word's hash; words that begin very many pairs are spread over
several shards by their successor. Each level-2 shard holds an Elias-Fano list of its contexts (ids), an
Elias-Fano list of monotone pointers to the contexts' successors, and the successors: ids are made monotone
over the whole level by adding, in each context, the last value of the context before it, and Elias-Fano coded.
Probabilities q and weights a are quantised to 16 bits in the logarithm, downwards, so that no sum exceeds 1.

Lookup is context-relative: a context's rank gives its pointer range and the value before it, the base;
base + id is searched in the successors by select on the high bits, then among the few low bits that share
them; a hit counts if it lies in the context's range.

The levels are files in the shared folder, memory-mapped by the workers, so no model is in anyone's heap, none is
broadcast, and a lost executor takes nothing with it. Where the folder is no mounted file system, files are
fetched by pyarrow.fs when first used, to a file that is deleted as soon as it is mapped.

Hashes are 64-bit; two words of a vocabulary of V share one with probability V^2 / 2^65, which is accepted.

A null text has only its end; a null doc_id is scored, its remainder (for the query) is null and it is not
held out. Repeated rows count as often as they occur. With no training text all words are unknown. Empty tables give empty
results; extra columns are ignored.
"""

from __future__ import annotations

import mmap
import os
import tempfile
import uuid
from collections import Counter, OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import local_path, new_folder, require, staged

DISCOUNT = 0.75
SMOOTHING = 0.1
#: Tokens that a shard of a level should have; words with more successors than this are spread.
SHARD_TOKENS = 1 << 20
#: Tokens whose pairs a task holds before it puts them in order.
CHUNK_TOKENS = 1 << 21
#: Texts that are looked up at once.
BATCH = 1024
#: Files of a level that a process holds mapped at most.
OPEN_FILES = 4_096
#: Words whose ids a worker keeps.
CACHE_WORDS = 400_000
Q_LOW, Q_STEPS = -10.0, 65535
A_LOW, A_STEPS = -10.0, 65535
#: The end of a text: no word has white space.
END = xxhash.xxh64_intdigest(b" ")
_U = np.uint64


# ---------------------------------------------------------------- Elias-Fano lists


def ef_encode(values: np.ndarray) -> bytes:
    """A non-decreasing list of u64 as bytes: n, low width, number of high words and of low words; the high
    words; zeros and ones up to and with each high word; the low words."""
    values = np.asarray(values, "<u8")
    n = len(values)
    top = int(values[-1]) if n else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    high = (values >> _U(low)).astype(np.int64)
    size = (int(high[-1]) if n else 0) + n + 1
    bits = np.zeros(-(-size // 64) * 64, np.uint8)
    bits[high + np.arange(n)] = 1
    words = np.packbits(bits, bitorder="little").view("<u8")
    zeros = np.cumsum(64 - np.bitwise_count(words).astype(np.int64))
    lows = np.zeros(-(-n * low // 64) + 1, "<u8")
    if low:
        part = values & _U((1 << low) - 1)
        at = np.arange(n, dtype=np.int64) * low
        word, shift = at >> 6, (at & 63).astype("<u8")
        np.bitwise_or.at(lows, word, part << shift)
        over = (shift + _U(low)) > _U(64)
        np.bitwise_or.at(lows, word[over] + 1, part[over] >> (_U(64) - shift[over]))
    ones = np.arange(64, 64 * len(words) + 1, 64) - zeros
    return np.array([n, low, len(words), len(lows)], "<u8").tobytes() + words.tobytes() + zeros.astype("<u8").tobytes() + ones.astype("<u8").tobytes() + lows.tobytes()


_SELECT = np.zeros((256, 8), np.uint8)  # place of the k-th one of a byte
for _b in range(256):
    _places = [i for i in range(8) if _b >> i & 1]
    _SELECT[_b, : len(_places)] = _places


class EliasFano:
    """A coded list in a buffer. Reads are vectorised; nothing is decoded that isn't asked for."""

    def __init__(self, data, at: int = 0) -> None:
        self.n, low, n_words, n_lows = (int(x) for x in np.frombuffer(data, "<u8", 4, at))
        self.low, at = low, at + 32
        self.words = np.frombuffer(data, "<u8", n_words, at)
        self.zeros = np.frombuffer(data, "<u8", n_words, at + 8 * n_words).view(np.int64)
        self.ones = np.frombuffer(data, "<u8", n_words, at + 16 * n_words).view(np.int64)
        self.lows = np.frombuffer(data, "<u8", n_lows, at + 24 * n_words)
        self.end = at + 24 * n_words + 8 * n_lows

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Places of the k-th (from 0) ones or zeros."""
        total = self.ones if ones else self.zeros
        word = np.searchsorted(total, k, "right")
        left = k - np.where(word > 0, total[np.maximum(word, 1) - 1], 0)
        bits = self.words[word] if ones else ~self.words[word]
        out = word * 64
        for width in (32, 16, 8):
            part = bits & _U((1 << width) - 1)
            count = np.bitwise_count(part).astype(np.int64)
            go = left >= count
            left = np.where(go, left - count, left)
            out = out + np.where(go, width, 0)
            bits = np.where(go, bits >> _U(width), part)
        return out + _SELECT[(bits & _U(255)).astype(np.int64), left]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), "<u8")
        at = i.astype(np.int64) * self.low
        word, shift = at >> 6, (at & 63).astype("<u8")
        x = self.lows[word] >> shift
        over = (shift + _U(self.low)) > _U(64)
        if over.any():
            x[over] |= self.lows[word[over] + 1] << (_U(64) - shift[over])
        return x & _U((1 << self.low) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        return ((self._select(i, True) - i).astype("<u8") << _U(self.low)) | self._low(i)

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each value the first index whose entry is not smaller (n if there is none), and whether that entry is
        the value."""
        values = np.asarray(values, "<u8")
        hit = np.zeros(len(values), bool)
        if not self.n:
            return np.zeros(len(values), np.int64), hit
        high = (values >> _U(self.low)).astype(np.int64)
        total = int(self.zeros[-1])
        out = np.full(len(values), self.n, np.int64)
        some = np.nonzero((high >= 0) & (high < total))[0]
        h = high[some]
        # entries with the same high part lie between two zeros
        begin = np.where(h > 0, self._select(np.maximum(h - 1, 0), False) - (h - 1), 0)
        end = np.minimum(self._select(h, False) - h, self.n)
        want = values[some] & _U((1 << self.low) - 1)
        lo, hi = begin.copy(), end.copy()
        live = np.nonzero(lo < hi)[0]
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self._low(mid) < want[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        out[some] = lo
        # the value itself can only be among the entries of its high part
        inside = np.nonzero(lo < end)[0]
        hit[some[inside]] = self._low(lo[inside]) == want[inside]
        return out, hit

    def successor(self, values: np.ndarray) -> np.ndarray:
        return self.find(values)[0]


def _slices(shards: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(shard, begin, end) of each run of equal shards."""
    cut = [*np.nonzero(np.diff(shards, prepend=-1))[0].tolist(), len(shards)]
    for a, b in zip(cut, cut[1:], strict=False):
        yield int(shards[a]), a, b


def quantise(p: np.ndarray, low: float, steps: int) -> np.ndarray:
    """Codes of probabilities, evenly spaced in the logarithm, rounded down; code 0 is 10**low."""
    return np.clip(np.floor(1e-6 + (np.log10(np.maximum(p, 1e-300)) - low) / -low * steps), 0, steps)


def dequantise(codes: np.ndarray, low: float, steps: int) -> np.ndarray:
    return 10.0 ** (low - low * codes.astype(np.float64) / steps)


# ---------------------------------------------------------------- files in the shared folder


def _write(uri: str, data: bytes) -> None:
    """Whole or not at all: written beside, then renamed; a repeated task writes the same bytes."""
    path = local_path(uri)
    if path:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        beside = f"{path}.{uuid.uuid4().hex}"
        with open(beside, "wb") as f:
            f.write(data)
        os.replace(beside, path)
        return
    fs, at = pafs.FileSystem.from_uri(uri)
    beside = f"{at}.{uuid.uuid4().hex}"
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(beside) as f:
        f.write(data)
    fs.move(beside, at)


def _map(uri: str) -> mmap.mmap:
    path = local_path(uri)
    if path:
        with open(path, "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    fs, at = pafs.FileSystem.from_uri(uri)
    with tempfile.TemporaryFile() as f, fs.open_input_stream(at) as source:
        while chunk := source.read(1 << 24):
            f.write(chunk)
        f.flush()
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)


def _kept(held: OrderedDict, key: int, opened):
    """What opened() gives for key, kept with the OPEN_FILES that were used last: a mapping ends with its last use."""
    if key not in held:
        held[key] = opened()
        if len(held) > OPEN_FILES:
            held.popitem(last=False)
    held.move_to_end(key)
    return held[key]


# ---------------------------------------------------------------- counting


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _texts(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[pa.RecordBatch, list]]:
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH):
            b = whole.slice(at, BATCH)
            yield b, b.column(column).to_pylist()


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    begin = np.nonzero(np.concatenate([[True], k[1:] != k[:-1]]))[0] if len(k) else np.zeros(0, np.int64)
    return k[begin], np.add.reduceat(c, begin) if len(k) else c


def _pack_sorted(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """A sorted chunk: Elias-Fano keys, then counts in one byte, larger ones listed."""
    coded = ef_encode(keys)
    big = np.nonzero(counts >= 255)[0]
    return np.array([len(coded), len(big)], "<u8").tobytes() + coded + np.minimum(counts, 255).astype("u1").tobytes() + big.astype("<u8").tobytes() + counts[big].astype("<u8").tobytes()


def _unpack_sorted(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    size, big = (int(x) for x in np.frombuffer(data, "<u8", 2))
    ef = EliasFano(data, 16)
    at = 16 + size
    counts = np.frombuffer(data, "u1", ef.n, at).astype(np.int64)
    where = np.frombuffer(data, "u1", 8 * big, at + ef.n).view("<u8").astype(np.int64)
    counts[where] = np.frombuffer(data, "u1", 8 * big, at + ef.n + 8 * big).view("<u8").astype(np.int64)
    bits = np.unpackbits(ef.words.view("u1"), bitorder="little")
    places = np.nonzero(bits)[0][: ef.n]
    i = np.arange(ef.n)
    return ((places - i).astype("<u8") << _U(ef.low)) | ef._low(i), counts


_CHUNK = pa.schema([("shard", pa.int32()), ("data", pa.binary())])


def _chunks(shards: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """A row a shard; keys ascend within each shard."""
    begin = np.nonzero(np.concatenate([[True], shards[1:] != shards[:-1]]))[0]
    end = np.append(begin[1:], len(shards))
    data = [_pack_sorted(keys[a:b], counts[a:b]) for a, b in zip(begin, end, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(shards[begin], pa.int32()), pa.array(data, pa.binary())], schema=_CHUNK)


class Words:
    """Level 1: ids, counts and back-off weights of words, memory-mapped."""

    def __init__(self, folder: str, bits: int, offsets: np.ndarray, n_tokens: int) -> None:
        self.folder, self.bits, self.offsets, self.n_tokens = folder, bits, offsets, n_tokens
        self.maps: OrderedDict[int, tuple] = OrderedDict()
        self.known: dict[bytes, int] = {}

    @property
    def size(self) -> int:
        return int(self.offsets[-1])

    def shard_of(self, h: np.ndarray) -> np.ndarray:
        return (h >> _U(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h), np.int64)

    def _shard(self, s: int) -> tuple[EliasFano, np.ndarray]:
        def opened():
            data = _map(f"{self.folder}/words-{s:05d}.ef")
            ef = EliasFano(data)
            return ef, np.frombuffer(data, "<u8", ef.n, ef.end)

        return _kept(self.maps, s, opened)

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Ids of hashes, -1 for unknown ones."""
        out = np.full(len(h), -1, np.int64)
        order = np.argsort(h)  # so that shards are slices, and each is read in one direction
        h = h[order]
        for s, a, b in _slices(self.shard_of(h)):
            if self.offsets[s + 1] > self.offsets[s]:
                at, hit = self._shard(s)[0].find(h[a:b])
                out[order[a:b][hit]] = at[hit] + self.offsets[s]
        return out

    def at(self, ids: np.ndarray, what) -> np.ndarray:
        """what(shard) at the places of ids, which ascend."""
        out = np.zeros(len(ids), np.float64)
        for s, a, b in _slices(np.searchsorted(self.offsets, ids, "right") - 1):
            out[a:b] = what(s)[ids[a:b] - self.offsets[s]]
        return out

    def counts(self, ids: np.ndarray) -> np.ndarray:
        return self.at(ids, lambda s: self._shard(s)[1])

    def of_texts(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Ids of each text's words and its end. All new words are looked up at once; found ones are kept, up
        to a bound."""
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        known = self.known
        new = list(set().union((b" ",), *texts).difference(known))
        if new:
            h = np.fromiter(map(xxhash.xxh64_intdigest, new), "<u8", len(new))
            known.update(zip(new, self.ids(h).tolist(), strict=True))
        end = known[b" "]
        return [np.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), end) for words in texts]


def _spread(count: np.ndarray) -> np.ndarray:
    """Number of shards over which a context is spread, a power of two, by its count."""
    return 1 << np.maximum(0, np.ceil(np.log2(np.maximum(count, 1) / SHARD_TOKENS))).astype(np.int64)


def _pair_shard(v: np.ndarray, w: np.ndarray, count: np.ndarray, shards: int) -> np.ndarray:
    """A pair's shard: by its first word; of words with very many successors also by the second."""
    mix = (v.astype("<u8") * _U(0x9E3779B97F4A7C15)) >> _U(40)
    more = (w.astype("<u8") * _U(0xC2B2AE3D27D4EB4F)) >> _U(40)
    return ((mix + more % _spread(count).astype("<u8")) % _U(shards)).astype(np.int64)


def _dealt(shard: np.ndarray, shards: int) -> np.ndarray:
    """Stable order by shard; of 16 bits numpy sorts by radix."""
    return np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")


class Pairs:
    """One shard of level 2, memory-mapped."""

    def __init__(self, data) -> None:
        self.contexts = EliasFano(data)
        self.pointers = EliasFano(data, self.contexts.end)
        self.successors = EliasFano(data, self.pointers.end)
        self.q = np.frombuffer(data, "<u2", self.successors.n, self.successors.end)

    @staticmethod
    def encode(v: np.ndarray, w: np.ndarray, q: np.ndarray) -> bytes:
        """Of pairs sorted by (v, w)."""
        begin = np.nonzero(np.concatenate([[True], v[1:] != v[:-1]]))[0]
        # each context's ids on top of the last value of the one before
        last = np.append(begin[1:], len(v)) - 1
        base = np.concatenate([[0], np.cumsum(w[last][:-1] + 1)])
        size = np.diff(np.append(begin, len(v)))
        return ef_encode(v[begin]) + ef_encode(np.append(begin, len(v))) + ef_encode(w + np.repeat(base, size)) + quantise(q, Q_LOW, Q_STEPS).astype("<u2").tobytes()

    def lookup(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """q of each pair, 0 where it is not in the shard. Pairs in ascending order are the fastest."""
        out = np.zeros(len(v))
        new = np.diff(v, prepend=-1) != 0
        contexts, back = v[new], np.cumsum(new) - 1
        rank, known = self.contexts.find(contexts)
        lo, hi, base = (np.zeros(len(contexts), np.int64) for _ in range(3))
        r = rank[known]
        lo[known], hi[known] = self.pointers.get(r).astype(np.int64), self.pointers.get(r + 1).astype(np.int64)
        later = known & (lo > 0)
        base[later] = self.successors.get(lo[later] - 1).astype(np.int64) + 1
        some = np.nonzero(known[back])[0]
        b = back[some]
        at, hit = self.successors.find((w[some] + base[b]).astype("<u8"))
        hit &= (at >= lo[b]) & (at < hi[b])
        out[some[hit]] = dequantise(self.q[at[hit]], Q_LOW, Q_STEPS)
        return out


class Model:
    """Both levels; what is sent to workers are their places and sizes."""

    def __init__(self, words: Words, shards: int, discount: float, smoothing: float) -> None:
        self.words, self.shards, self.discount, self.smoothing = words, shards, discount, smoothing
        self.maps: OrderedDict[int, Pairs | None] = OrderedDict()
        self.backs: OrderedDict[int, np.ndarray] = OrderedDict()

    def __getstate__(self):
        w = self.words
        return (w.folder, w.bits, w.offsets, w.n_tokens, self.shards, self.discount, self.smoothing)

    def __setstate__(self, state):
        self.__init__(Words(*state[:4]), *state[4:])

    def _pairs(self, s: int) -> Pairs | None:
        def opened():
            data = _map(f"{self.words.folder}/pairs-{s:05d}.ef")
            return Pairs(data) if len(data) > 1 else None

        return _kept(self.maps, s, opened)

    def _backoff(self, s: int) -> np.ndarray:
        return _kept(self.backs, s, lambda: np.frombuffer(_map(f"{self.words.folder}/backoff-{s:05d}.u16"), "<u2"))

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, known tokens, base score, score) of each text."""
        ids = self.words.of_texts([words_of(t) for t in texts])
        n = np.array([len(x) for x in ids])
        w = np.concatenate(ids)
        end = np.cumsum(n)
        begin = end - n
        v = np.concatenate([[0], w[:-1]])
        v[begin] = w[end - 1]  # the end stands before the first word
        total = self.words.n_tokens + self.smoothing * (self.words.size + 1)
        unique, back = np.unique(w, return_inverse=True)
        count, weight = np.zeros(len(unique)), np.ones(len(unique))
        some = unique >= 0
        count[some] = self.words.counts(unique[some])
        weight[some] = dequantise(self.words.at(unique[some], self._backoff), A_LOW, A_STEPS)
        p = (count[back] + self.smoothing) / total
        place = np.concatenate([[0], back[:-1]])
        place[begin] = back[end - 1]
        q = np.zeros(len(w))
        some = np.nonzero((v >= 0) & (w >= 0))[0]
        if len(some):
            # different pairs in order, dealt to their shards in that order
            wide = _U(max(1, self.words.size).bit_length())
            keys, of = np.unique((v[some].astype("<u8") << wide) | w[some].astype("<u8"), return_inverse=True)
            pv, pw = (keys >> wide).astype(np.int64), (keys & _U((1 << int(wide)) - 1)).astype(np.int64)
            shard = _pair_shard(pv, pw, count[np.searchsorted(unique, pv)], self.shards)
            order = _dealt(shard, self.shards)
            pv, pw, found = pv[order], pw[order], np.zeros(len(keys))
            for s, a, b in _slices(shard[order]):
                level = self._pairs(s)
                if level is not None:
                    found[order[a:b]] = level.lookup(pv[a:b], pw[a:b])
            q[some] = found[of]
        sums = [np.add.reduceat(x, begin) for x in ((w >= 0).astype(np.int64), np.log10(p), np.log10(q + weight[place] * p))]
        return n, *sums


def train(docs: DataFrame, *, discount: float = DISCOUNT, smoothing: float = SMOOTHING, shard_tokens: int = SHARD_TOKENS) -> Model:
    """Count all of docs (text) and write the trie to the shared folder."""
    require(docs, "text")
    spark = docs.sparkSession
    folder = new_folder(spark, "trie")
    texts = docs.select("text")
    chars = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = max(0, int(np.ceil(np.log2(max(1, chars / 6 / shard_tokens)))))
    shards = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        n = 0

        def out():
            h = np.fromiter((xxhash.xxh64_intdigest(w) for w in held), "<u8", len(held))
            k, c = _merged([h, np.array([END], "<u8")], [np.fromiter(held.values(), np.int64, len(held)), np.array([n])])
            return _chunks((k >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(k), np.int64), k, c)

        for _, texts in _texts(batches):
            for t in texts:
                held.update(words_of(t))
                n += 1
            if len(held) > CACHE_WORDS:
                yield out()
                held.clear()
                n = 0
        if n:
            yield out()

    def level_1(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_unpack_sorted(x.as_py()) for b in batches for x in b.column(1)]
        k, c = _merged([p[0] for p in parts], [p[1] for p in parts])
        s = key[0].as_py()
        _write(f"{folder}/words-{s:05d}.ef", ef_encode(k) + c.astype("<u8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([len(k)], pa.int64()), pa.array([int(c.sum())], pa.int64())], names=["shard", "n", "tokens"])

    kind = "shard int, data binary"
    made = texts.mapInArrow(count, kind).repartition(shards, "shard").groupBy("shard").applyInArrow(level_1, "shard int, n long, tokens long").collect()  # a row a shard
    sizes = np.zeros(shards, np.int64)
    for r in made:
        sizes[r["shard"]] = r["n"]
    words = Words(folder, bits, np.concatenate([[0], np.cumsum(sizes)]), sum(r["tokens"] for r in made))
    model = Model(words, shards, discount, smoothing)
    if not made:
        return model

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = Model(Words(folder, bits, words.offsets, words.n_tokens), shards, discount, smoothing).words
        wide = _U(max(1, level.size).bit_length())
        held: list[np.ndarray] = []
        n = 0

        def out():
            w = np.concatenate(held)
            k, c = np.unique(w, return_counts=True)
            v = (k >> wide).astype(np.int64)
            w = (k & _U((1 << int(wide)) - 1)).astype(np.int64)
            new = np.diff(v, prepend=-1) != 0
            shard = _pair_shard(v, w, level.counts(v[new])[np.cumsum(new) - 1], shards)
            order = _dealt(shard, shards)
            return _chunks(shard[order], k[order], c[order])

        for _, texts in _texts(batches):
            for w in level.of_texts([words_of(t) for t in texts]):
                w = w.astype("<u8")
                held.append((np.concatenate([w[-1:], w[:-1]]) << wide) | w)
                n += len(w)
            if n > CHUNK_TOKENS:
                yield out()
                held.clear()
                n = 0
        if held:
            yield out()

    def level_2(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = Words(folder, bits, words.offsets, words.n_tokens)
        wide = _U(max(1, level.size).bit_length())
        parts = [_unpack_sorted(x.as_py()) for b in batches for x in b.column(1)]
        k, c = _merged([p[0] for p in parts], [p[1] for p in parts])
        del parts
        v, w = (k >> wide).astype(np.int64), (k & _U((1 << int(wide)) - 1)).astype(np.int64)
        contexts, back, size = np.unique(v, return_inverse=True, return_counts=True)
        q = (c - discount) / level.counts(contexts)[back]
        _write(f"{folder}/pairs-{key[0].as_py():05d}.ef", Pairs.encode(v, w, q))
        for at in range(0, len(contexts), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(contexts[at : at + 200_000]), pa.array(size[at : at + 200_000])], names=["id", "n"])

    def back_off(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = Words(folder, bits, words.offsets, words.n_tokens)
        s = key[0].as_py()
        a = np.zeros(int(level.offsets[s + 1] - level.offsets[s]))
        for b in batches:
            np.add.at(a, b.column(1).to_numpy() - level.offsets[s], b.column(2).to_numpy())
        a = np.minimum(1.0, discount * a / level._shard(s)[1])
        _write(f"{folder}/backoff-{s:05d}.u16", quantise(a, A_LOW, A_STEPS).astype("<u2").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32())], names=["shard"])

    seen = staged(texts.mapInArrow(pairs, kind).repartition(shards, "shard").groupBy("shard").applyInArrow(level_2, "id long, n long"), "contexts")
    starts = F.array(*[F.lit(int(x)) for x in words.offsets[:-1]]) if shards <= 64 else None
    if starts is not None:
        shard = (F.size(F.filter(starts, lambda x: x <= F.col("id"))) - 1).cast("int")
    else:
        offsets = words.offsets

        @F.pandas_udf("int")
        def shard_of(ids):
            import pandas as pd

            return pd.Series((np.searchsorted(offsets, ids.to_numpy(), "right") - 1).astype(np.int32))

        shard = shard_of("id")
    done = seen.select(shard.alias("shard"), "id", "n").groupBy("shard").applyInArrow(back_off, "shard int").collect()
    _fill(spark, model, {r["shard"] for r in done}, seen)
    return model


def _fill(spark: SparkSession, model: Model, done: set[int], seen: DataFrame) -> None:
    """Empty files for shards without rows, so that a missing file is always an error."""
    for s in range(model.shards):
        if s not in done:
            _write(f"{model.words.folder}/backoff-{s:05d}.u16", b"\0\0")
        path = local_path(f"{model.words.folder}/pairs-{s:05d}.ef")
        if path is None:
            fs, at = pafs.FileSystem.from_uri(f"{model.words.folder}/pairs-{s:05d}.ef")
            missing = fs.get_file_info(at).type == pafs.FileType.NotFound
        else:
            missing = not os.path.exists(path)
        if missing:
            _write(f"{model.words.folder}/pairs-{s:05d}.ef", b"\0")


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, held_out, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # the places of its files
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b, texts in _texts(batches, 2):
            n, known, base, score = m.score(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(known), pa.array(np.full(len(n), m.words.n_tokens)), pa.array(base), pa.array(score)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
