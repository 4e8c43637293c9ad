"""Token ids in patched frame-of-reference (PFOR) blocks.

A shard is one self-contained binary value:

    "PFR1", block size u32, documents u64, tokens u64, blocks u64
    document ids i64[documents], document lengths u64[documents], null flags u8[documents]
    block starts u64[blocks + 1], byte offsets from the start of the block area
    blocks, each: minimum u32, width u8, pad u8, exceptions u16,
                  block-size slots of `width` bits (value - minimum, low bits), from the lowest bit up,
                  exception positions u16[exceptions], exception high parts u32[exceptions]

The width of a block is the number of bits that the `percentile`-th delta needs; a delta that needs
more keeps its low bits in the slot and its remaining high bits in the exception list. All numbers are
little-endian. The last block is filled up with its own minimum. A block is found by its start, so ids
[a, b) are read without touching the blocks before them.

Shards are stored as the rows of a Parquet table: Spark's committer then makes the write atomic and
safe against lost executors, on any file system. `(part, shard)` is ascending document order.

Nulls: a null text is the empty text, a null document id sorts first. Ties of a document id are ordered
by a hash of the text, then by text, so that one id's rows, however many, spread over the ranges. Empty tables give an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TEXT_ROWS, arrow_rows, kept_by_worker, new_folder, require, slices, staged

MAGIC = b"PFR1"
BLOCK = 128
PERCENTILE = 0.9
#: A shard is closed once it has so many ids (documents are never divided).
SHARD_TOKENS = 1 << 18
#: Bytes of words and their ids that a worker keeps, about; characters of text that it encodes at a time.
CACHE_BYTES, SLICE = 64 << 20, 2 << 20
#: Rows of an Arrow batch of shards.
SHARD_ROWS = 8

SHARD_SCHEMA = "part int, shard int, n_docs long, n_tokens long, part_start long, payload binary"


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values (u64, less than 2**width) as rows of bytes, each value in the next `width` bits."""
    cols = np.ascontiguousarray(values.T)
    n, rows = cols.shape
    out = np.zeros((-(-n * width // 64), rows), "<u8")
    for j in range(n):
        word, at = divmod(j * width, 64)
        out[word] |= cols[j] << np.uint64(at)
        if at + width > 64:
            out[word + 1] |= cols[j] >> np.uint64(64 - at)
    return np.ascontiguousarray(out.T).view("u1")[:, : -(-n * width // 8)]


def unpack(raw: np.ndarray, width: int, n: int) -> np.ndarray:
    """The n values of each row of bytes."""
    rows = len(raw)
    padded = np.zeros((rows, 8 * -(-n * width // 64)), "u1")
    padded[:, : raw.shape[1]] = raw
    words = np.ascontiguousarray(padded.view("<u8").T)
    out = np.empty((n, rows), "<u4")
    mask = np.uint64((1 << width) - 1)
    for j in range(n):
        word, at = divmod(j * width, 64)
        x = words[word] >> np.uint64(at)
        if at + width > 64:
            x |= words[word + 1] << np.uint64(64 - at)
        out[j] = x & mask
    return out.T


def _exceptions(begin: np.ndarray, n: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte places of each exception's position and high part: the lists of a block begin at begin and
    have n entries; row is the block of each exception, ascending."""
    n = n.astype(np.int64)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    where = begin[row] + 2 * k
    high = begin[row] + 2 * n[row] + 4 * k
    return where[:, None] + np.arange(2), high[:, None] + np.arange(4)


def encode_shard(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """ids (all documents' ids in a row) as one shard."""
    ids = np.asarray(ids, dtype="<u4")
    n, nb = len(ids), -(-len(ids) // block)
    head = MAGIC + np.uint32(block).tobytes() + np.array([len(doc_ids), n, nb], "<u8").tobytes()
    head += np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + np.asarray(lengths, "<u8").tobytes()
    head += np.array([d is None for d in doc_ids], "u1").tobytes()
    if not nb:
        return head + np.zeros(1, "<u8").tobytes()
    grid = np.empty(nb * block, "<u4")
    grid[:n] = ids
    grid[n:] = ids[(nb - 1) * block :].min()
    grid = grid.reshape(nb, block)
    low = grid.min(axis=1)
    delta = grid - low[:, None]
    at = min(block - 1, max(0, int(np.ceil(percentile * block)) - 1))
    width = np.frexp(np.partition(delta, at, axis=1)[:, at].astype(np.float64))[1]
    over = (delta.astype("<u8") >> width[:, None].astype("<u8")) > 0
    n_over = over.sum(axis=1)
    packed = [-(-block * w // 8) for w in range(33)]
    sizes = 8 + np.array(packed)[width] + 6 * n_over
    starts = np.zeros(nb + 1, "<u8")
    np.cumsum(sizes, out=starts[1:])
    out = np.zeros(int(starts[-1]), "u1")
    row_head = np.zeros(nb, np.dtype([("low", "<u4"), ("width", "u1"), ("pad", "u1"), ("n", "<u2")]))
    row_head["low"], row_head["width"], row_head["n"] = low, width, n_over
    at = starts[:-1].astype(np.int64)
    out[at[:, None] + np.arange(8)] = row_head.view("u1").reshape(nb, 8)
    for w in np.unique(width).tolist():
        if w:
            rows = np.nonzero(width == w)[0]
            kept = delta[rows].astype("<u8") & np.uint64((1 << w) - 1)
            out[at[rows, None] + 8 + np.arange(packed[w])] = pack(kept, w)
    row, col = np.nonzero(over)
    where, high = _exceptions(at + 8 + np.array(packed)[width], n_over, row)
    out[where] = col.astype("<u2").view("u1").reshape(-1, 2)
    out[high] = (delta[row, col].astype("<u8") >> width[row].astype("<u8")).astype("<u4").view("u1").reshape(-1, 4)
    return head + starts.tobytes() + out.tobytes()


class Shard:
    """A shard's documents, and its ids in whole or by range."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a PFOR shard")
        self.block = int(np.frombuffer(data, "<u4", 1, 4)[0])
        nd, self.n_tokens, nb = (int(x) for x in np.frombuffer(data, "<u8", 3, 8))
        p = 32
        ids = np.frombuffer(data, "<i8", nd, p)
        self.lengths = np.frombuffer(data, "<u8", nd, p + 8 * nd).astype(np.int64)
        nulls = np.frombuffer(data, "u1", nd, p + 16 * nd)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, nulls, strict=True)]
        p += 17 * nd
        self.starts = np.frombuffer(data, "<u8", nb + 1, p).astype(np.int64)
        self.area = np.frombuffer(data, "u1", offset=p + 8 * (nb + 1))

    def blocks(self, first: int, last: int) -> np.ndarray:
        """The ids of blocks [first, last), filling included."""
        at = self.starts[first:last]
        if not len(at):
            return np.zeros(0, "<u4")
        head = self.area[at[:, None] + np.arange(8)]
        low = head[:, :4].copy().view("<u4")[:, 0]
        width, n_over = head[:, 4], head[:, 6:8].copy().view("<u2")[:, 0]
        grid = np.zeros((len(at), self.block), "<u4")
        for w in np.unique(width):
            if w:
                rows = np.nonzero(width == w)[0]
                size = -(-self.block * int(w) // 8)
                grid[rows] = unpack(self.area[at[rows, None] + 8 + np.arange(size)], int(w), self.block)
        row = np.repeat(np.arange(len(at)), n_over)
        where, high = _exceptions(at + 8 + -(-self.block * width.astype(np.int64) // 8), n_over, row)
        col = self.area[where].view("<u2")[:, 0]
        grid[row, col] |= (self.area[high].view("<u4")[:, 0].astype("<u8") << width[row].astype("<u8")).astype("<u4")
        return (grid + low[:, None]).reshape(-1)

    def ids(self, begin: int = 0, end: int | None = None) -> np.ndarray:
        end = self.n_tokens if end is None else min(end, self.n_tokens)
        if begin >= end:
            return np.zeros(0, "<u4")
        first = begin // self.block
        return self.blocks(first, -(-end // self.block))[begin - first * self.block : end - first * self.block]


# White space that a tokenizer's pattern surely takes as such, by byte; and all characters that it could take as such.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MAYBE_SPACE = _SPACE.copy()
_MAYBE_SPACE[28:32] = True
_WIDE_SPACE = re.compile("[\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
_WIDE_BYTES = re.compile(b"|".join(re.escape(c.encode()) for c in map(chr, range(0x80, 0x10000)) if _WIDE_SPACE.match(c)))
_CLOSED = re.compile(rf"(?!{_WIDE_SPACE.pattern})\S ")
_ALNUM = np.array([i < 128 and chr(i).isalnum() for i in range(256)])


def _white(raw: bytes) -> np.ndarray:
    """For each byte of UTF-8 text whether it belongs to what could be white space."""
    data = np.frombuffer(raw, "u1")
    white = _MAYBE_SPACE[data]
    if b"\xc2\x85" in raw or b"\xc2\xa0" in raw or data.max(initial=0) > 224:  # from U+1000 on
        for m in _WIDE_BYTES.finditer(raw):
            white[m.start() : m.end()] = True
    return white


def _cuts(raw: bytes) -> np.ndarray:
    """For each byte of UTF-8 text whether the text may be cut before it (see WordEncoder); the last byte is no white space."""
    data = np.frombuffer(raw, "u1")
    white, space = _white(raw), _SPACE[data]
    cut = np.zeros(len(data), bool)
    if len(data) < 2:
        return cut
    cut[1:] = space[1:] & ~white[:-1]
    feed = 1 + np.flatnonzero(data[1:-1] == 10)
    cut[1 + feed[~white[feed + 1] & ~white[feed - 1]]] = True
    mark = 1 + np.flatnonzero(((data[1:-1] == 44) | (data[1:-1] == 46)) & space[2:])
    before = data[mark - 1]
    cut[mark[_ALNUM[before]]] = True
    wide = mark[before >= 128]
    ends = [raw[max(0, i - 4) : i] for i in wide.tolist()]
    known = {x: x.decode(errors="ignore")[-1:].isalnum() for x in set(ends)}
    cut[wide[[known[x] for x in ends]]] = True
    return cut


def _strings(raw: bytes, at: np.ndarray) -> pa.StringArray:
    """The strings of raw that begin at `at`, whose last entry is where the last one ends."""
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw))


def _list(strings: pa.StringArray) -> list[str]:
    """As to_pylist, which makes a scalar of each value before."""
    return strings.to_numpy(zero_copy_only=False).tolist()


def _ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each entry, `size` of them, in a row."""
    stop = np.cumsum(size)
    return np.repeat(begin - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)


class WordEncoder:
    """Ids of whole texts by the tokenizers library, as little-endian u32 bytes.

    A byte-level BPE with the usual pattern never joins what is before a run of white space and the run, so a text's ids
    are the ids of its pieces in a row, each beginning with such a run. Cuts are made also after a line feed that has
    no white space beside it, and before a full stop or comma that has a letter or digit before and white space after it.
    Where a character's being white space could be in doubt no cut relies on it. Pieces repeat, so each distinct one is
    encoded once and kept (up to CACHE_BYTES, then those go that were met in one slice only); a long text is cut into
    stretches first. Texts that hold the string of a special token are encoded in whole. Any tokenizer of another kind
    is used on whole texts throughout.
    """

    def __init__(self, path: str) -> None:
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        made = json.loads(self.tok.to_str())
        pre = made.get("pre_tokenizer") or {}
        self.special = [t["content"] for t in made.get("added_tokens") or []]
        plain = made["model"]["type"] == "BPE" and not made.get("normalizer") and not made.get("post_processor")
        self.by_word = plain and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not any(re.search(r"\s", x) for x in self.special)
        vocab = self.tok.get_vocab()
        self.n_bytes = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
        for token, i in vocab.items():
            self.n_bytes[i] = len(token)  # a byte-level token has a character for each byte
        #: Places of the words that are kept, in their order; and by place: where a word's ids begin in `pool`, how
        #: many they are, in how many slices it was met, and the bytes that it takes, about.
        self.known: dict[str, int] = {}
        self.begin, self.size, self.met, self.cost = (np.zeros(1 << 10, np.int64) for _ in range(4))
        self.pool, self.n_pool = np.zeros(1 << 12, "<u4"), 0
        self.held = 0

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, pieces: pa.StringArray, lead: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces in a row, and how many each has. Encoded as one text with lead before each; the ids' byte
        lengths say where a piece ends. lead is "" if each piece begins with white space, otherwise a line feed."""
        words = _list(pieces)
        sizes = pc.binary_length(pieces).to_numpy().astype(np.int64) + len(lead)
        ids = np.array(self.tok.encode_batch_fast([lead + lead.join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends, wanted = np.concatenate([[0], np.cumsum(self.n_bytes[ids])]), np.concatenate([[0], np.cumsum(sizes)])
        cuts = np.searchsorted(ends, wanted)
        if not np.array_equal(ends[np.minimum(cuts, len(ends) - 1)], wanted):
            return self._apart(words)
        if lead:
            ids = np.delete(ids, cuts[:-1])
        return ids, np.diff(cuts) - len(lead)

    def _apart(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self._whole(words)
        return np.frombuffer(b"".join(found), "<u4"), np.array([len(x) // 4 for x in found], np.int64)

    def _learn(self, new: pa.StringArray) -> np.ndarray:
        """Encode and keep words that are not known; their places."""
        words = _list(new)
        raw = "".join(words).encode()
        at = np.concatenate([[0], np.cumsum(pc.binary_length(new).to_numpy().astype(np.int64))])
        white, first = _white(raw), np.frombuffer(raw, "u1")[at[:-1]]
        closed = ~white[at[1:] - 1]
        led = _SPACE[first] & closed
        bare = ~white[at[:-1]] & closed
        size, n, known = np.zeros(len(words), np.int64), len(self.known), self.known
        begin = np.zeros(len(words), np.int64)
        for which, how in ((led, lambda x: self._joined(x, "")), (bare, lambda x: self._joined(x, "\n")), (~led & ~bare, lambda x: self._apart(_list(x)))):
            rows = np.flatnonzero(which)
            for k in range(0, len(rows), 5_000):
                some = rows[k : k + 5_000]
                ids, size[some] = how(new.take(pa.array(some)))
                begin[some] = self.n_pool + np.cumsum(size[some]) - size[some]
                self.pool = self._grown(self.pool, self.n_pool + len(ids))
                self.pool[self.n_pool : self.n_pool + len(ids)] = ids
                self.n_pool += len(ids)
        where = np.arange(n, n + len(words))
        known.update(zip(words, where.tolist(), strict=True))
        cost = 160 + 5 * np.diff(at)
        for name, x in (("begin", begin), ("size", size), ("met", 0), ("cost", cost)):
            grown = self._grown(getattr(self, name), n + len(words))
            grown[n : n + len(words)] = x
            setattr(self, name, grown)
        self.held += int(cost.sum())
        return where

    @staticmethod
    def _grown(x: np.ndarray, n: int) -> np.ndarray:
        """x, or a longer copy, with room for n entries."""
        return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, len(x) * 3 // 2) - len(x), x.dtype)])

    def _trim(self) -> None:
        """Forget the words met in one slice only, and of the others the least met that exceed half of CACHE_BYTES."""
        n = len(self.known)
        met, cost = self.met[:n], self.cost[:n]
        order = np.argsort(-met, kind="stable")
        keep = np.zeros(n, bool)
        keep[order[np.cumsum(cost[order]) <= CACHE_BYTES // 2]] = True
        keep &= met > 1
        self.known = {w: i for i, w in enumerate(itertools.compress(self.known, keep.tolist()))}
        begin, self.size = self.begin[:n][keep], self.size[:n][keep]
        self.pool = self.pool[_ragged(begin, self.size)]
        self.begin, self.n_pool = np.cumsum(self.size) - self.size, len(self.pool)
        self.met, self.cost = met[keep] // 2, cost[keep]
        self.held = int(self.cost.sum())

    def _places(self, words: pa.StringArray) -> np.ndarray:
        """Places of distinct words."""
        found = np.fromiter(map(self.known.get, _list(words), itertools.repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(found < 0)
        if len(new):
            found[new] = self._learn(words.take(pa.array(new)))
        self.met[found] += 1
        return found

    @staticmethod
    def _stretches(text: str) -> Iterator[str]:
        """A text in stretches of about SLICE characters, each but the first beginning with a space after no white space."""
        at = 0
        while len(text) - at > SLICE:
            cut = text.rfind(" ", at + 1, at + SLICE)
            while cut > at and _CLOSED.match(text, cut - 1) is None:
                cut = text.rfind(" ", at + 1, cut)
            if cut <= at:
                found = _CLOSED.search(text, at + SLICE - 1)
                if found is None:
                    break
                cut = found.end() - 1
            yield text[at:cut]
            at = cut
        yield text[at:]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of texts, about SLICE characters together or one text."""
        if not self.by_word:
            return self._whole(texts)
        whole = [any(x in t for x in self.special) for t in texts]
        if any(whole):
            plain = iter(self.encode([t for t, w in zip(texts, whole, strict=True) if not w]))
            return [self._whole([t])[0] if w else next(plain) for t, w in zip(texts, whole, strict=True)]
        if any(len(t) > SLICE for t in texts):
            return [b"".join(self._encoded([part])[0] for part in self._stretches(t)) for t in texts]
        return self._encoded(texts)

    def _encoded(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        if self.held > CACHE_BYTES:
            self._trim()
        parts = [t.encode() for t in texts]
        raw = b"\x02".join(parts) + b"\x02"  # a byte between texts; which of them are between is known by their places
        after = np.cumsum(np.array([len(x) + 1 for x in parts]))
        cut = np.append(_cuts(raw), True)
        cut[0] = cut[after] = cut[after - 1] = True
        at = np.flatnonzero(cut)
        pieces = _strings(raw, at).dictionary_encode()
        where = self._places(pieces.dictionary)
        codes = pieces.indices.to_numpy()
        size, between = self.size[where][codes], np.searchsorted(at, after - 1)
        size[between] = 0
        ids = self.pool[_ragged(self.begin[where][codes], size)].tobytes()
        ends = (4 * np.cumsum(size)[between]).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process, kept until another file or operator is used."""
    return kept_by_worker(f"pfor {path}", lambda: WordEncoder(path))


def shards_of(rows: Iterable[tuple[int | None, bytes]], part: int, shard_tokens: int = SHARD_TOKENS, block: int = BLOCK, percentile: float = PERCENTILE) -> Iterator[tuple]:
    """Rows of SHARD_SCHEMA from (document id, ids as bytes) in order."""
    ids, sizes, texts, held, begin, shard = [], [], [], 0, 0, 0
    for doc_id, raw in rows:
        ids.append(doc_id)
        sizes.append(len(raw) // 4)
        texts.append(raw)
        held += sizes[-1]
        if held >= shard_tokens:
            yield part, shard, len(ids), held, begin, encode_shard(ids, np.array(sizes), np.frombuffer(b"".join(texts), "<u4"), block, percentile)
            ids, sizes, texts, begin, held, shard = [], [], [], begin + held, 0, shard + 1
    if ids:
        yield part, shard, len(ids), held, begin, encode_shard(ids, np.array(sizes), np.frombuffer(b"".join(texts), "<u4"), block, percentile)


_ARROW_SHARD = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("part_start", pa.int64()), ("payload", pa.binary())])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 0, shard_tokens: int = SHARD_TOKENS, block: int = BLOCK, percentile: float = PERCENTILE) -> None:
    """Encode docs (doc_id, text), append end_id to each document, and write PFOR shards to `path` in
    ascending doc_id order. One range shuffle of (doc_id, text), each range sorted on disk if need be;
    a task holds one shard, one Arrow batch of TEXT_ROWS and the ids of the words it has met, up to CACHE_BYTES."""
    require(docs, "doc_id", "text")
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)

        def rows():
            for b in batches:
                for part in slices(b, 1, SLICE, TEXT_ROWS):
                    texts = [t or "" for t in part.column(1).to_pylist()]
                    for d, raw in zip(part.column(0).to_pylist(), enc.encode(texts), strict=True):
                        yield d, raw + end

        for row in shards_of(rows(), TaskContext.get().partitionId(), shard_tokens, block, percentile):
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _ARROW_SHARD.types, strict=True)], schema=_ARROW_SHARD)

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = ("doc_id", F.xxhash64("text"))
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    with arrow_rows(docs.sparkSession, TEXT_ROWS):
        ordered.mapInArrow(encode, SHARD_SCHEMA).write.option("compression", "uncompressed").parquet(path)


_ARROW_DOCS = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_documents(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the shards.

    Ids before a document = ids of the ranges before its range (one row a range, so the window below
    sorts as many rows as there are ranges) + ids before its shard in the range + ids in the shard. The figures
    are written as a scratch table, so that batches of shards stay small whoever reads the result.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, at, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                s = Shard(payload.as_py())
                raw, ends = memoryview(s.ids().tobytes()), np.cumsum(s.lengths)
                begins = ends - s.lengths
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(begins.tolist(), ends.tolist(), strict=True)]
                n = len(crc)
                yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids, pa.int64()), pa.array([part] * n, pa.int32()), pa.array(begins + at), pa.array(s.lengths), pa.array(crc, pa.int64())], schema=_ARROW_DOCS)

    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select(F.col("part").alias("part_"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    docs = shards.select("part", "part_start", "payload").mapInArrow(decode, "doc_id long, part int, at long, n_tokens long, ids_crc32 long")
    joined = docs.join(F.broadcast(before), docs["part"] == before["part_"])  # a row a range: bounded by the shuffle partitions
    with arrow_rows(spark, SHARD_ROWS):
        return staged(joined.select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"), "token-documents")


def token_documents(docs: DataFrame, tokenizer: str, path: str | None = None, **how) -> DataFrame:
    """write_tokens, then read_documents of what was written."""
    spark = docs.sparkSession
    path = path or new_folder(spark, "tokens")
    write_tokens(docs, path, tokenizer, **how)
    return read_documents(spark, path)
