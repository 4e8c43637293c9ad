"""SimHash near-duplicates by deletion-variant signatures.

Fingerprint: A-Z are lower-cased, words joined to shingles of `k` words (repeats included; a text of
fewer words is one shingle, a text of none has fingerprint 0), each shingle hashed by XXH64 with seed 42;
a bit is 1 if it is set in over half of the hashes.

Index: 64 bits are cut into `segments` parts. If two fingerprints differ in at most `distance` bits and
distance < 2 * segments, one segment differs in at most one bit (otherwise there would be two a segment).
So each *distinct* fingerprint is indexed under its one-wildcard variants: for each bit, the segment that
holds it, with that bit left out. Two fingerprints whose segment differs in at most one bit meet under
such a key. The keys are dealt and sorted once; within a key every two fingerprints are compared, and
what is emitted is a spanning forest of the links found (each fingerprint is linked to those not yet
reached), so a key with n fingerprints emits n - 1 rows at most and loses no connection. Keys with more
than MAX_RUN fingerprints are divided into blocks, and pairs of blocks are compared by different tasks.

Components of the links then give each document its class. Equal fingerprints never form pairs.

A null text is a text without words. Rows with a null doc_id get a fingerprint and a class, but can't
name one; a class of nothing but null ids has a null component_id. Repeated rows have equal results.
Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT_ROWS, arrow_rows, kept_by_worker, require, staged, trim
from .components import components

BITS = 64
SEED = 42
#: Fingerprints under one key that a task compares alone.
MAX_RUN = 16_384
#: Nodes under a band key that make all their pairs, and of which a task holds the sets.
FEW, MAX_SETS = 32, 4_096
#: Keys of a shingle set, and minima in each.
BANDS, ROWS = 30, 5
_CHUNK = 1 << 15
_ORDERS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64) | np.array([[0], [1]], np.uint64)


def hashes(text: str | None, k: int) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles (u64), in pieces."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(size + 1) - size - 1
    n = max(1, len(words) - k + 1)
    ends = begin[-n:] + size[-n:] if len(words) >= k else np.array([len(joined)])
    begins, ends = begin[:n].tolist(), ends.tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _CHUNK):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(begins[at : at + _CHUNK], ends[at : at + _CHUNK], strict=True)], "<u8")


def fingerprint(text: str | None, k: int) -> int:
    """The unsigned 64-bit SimHash of a text."""
    return made_of(hashes(text, k))


def made_of(pieces) -> int:
    """The fingerprint of shingle hashes."""
    votes, n = np.zeros(BITS, np.int64), 0
    for h in pieces:
        votes += np.unpackbits(h.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""
    require(docs, "doc_id", "text")

    @F.pandas_udf("long")
    def made(texts):
        import pandas as pd

        return pd.Series(np.array([fingerprint(t, k) for t in texts], "<u8").view("<i8"))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), made("text").alias("fp"))


def hex_of(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def bounds(segments: int) -> list[tuple[int, int]]:
    """First bit and size of each segment."""
    cut = [BITS * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:])]  # noqa: B905


def variants(fp, segments: int):
    """Keys of a fingerprint column: for each bit, (bit, its segment without that bit)."""
    keys = []
    for first, size in bounds(segments):
        mask = (1 << size) - 1
        part = F.shiftrightunsigned(fp, first).bitwiseAND(F.lit(mask).cast("long"))
        for j in range(size):
            left = part.bitwiseAND(F.lit(mask & ~(1 << j)).cast("long"))
            keys.append(left.bitwiseOR(F.lit((first + j) << 40).cast("long")) if segments > 1 else left)
    return F.explode(F.array(*keys))


def forest(fps: np.ndarray, distance: int, other: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the graph that links fps (u64, distinct) within distance; with other, of the
    links between fps and other only."""
    out = []
    if other is None:
        todo, left = [], fps
        while len(left) or todo:
            if not todo:
                x, left = left[0], left[1:]
            else:
                x = todo.pop()
            near = np.bitwise_count(left ^ x) <= distance
            if near.any():
                got = left[near]
                out += [(int(x), int(y)) for y in got]
                todo += list(got)
                left = left[~near]
        return out
    todo, left = [], [fps, other]
    while len(left[0]) or todo:
        if not todo:
            x, side, left[0] = left[0][0], 0, left[0][1:]
        else:
            x, side = todo.pop()
        near = np.bitwise_count(left[1 - side] ^ x) <= distance
        if near.any():
            got = left[1 - side][near]
            out += [(int(x), int(y)) for y in got]
            todo += [(y, 1 - side) for y in got]
            left[1 - side] = left[1 - side][~near]
    return out


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64())])


def _batch(a, b, key=None) -> pa.RecordBatch:
    a = np.asarray(a)
    keys = pa.nulls(len(a), pa.int64()) if key is None else pa.array(np.full(len(a), key))
    return pa.RecordBatch.from_arrays([pa.array(a.astype("<u8").view("<i8")), pa.array(np.asarray(b).astype("<u8").view("<i8")), keys], schema=_LINKS)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted (key, fp) in pieces that end where a key ends; a single key's rows are held at most."""
    keys, fps = [], []
    for b in batches:
        if not b.num_rows:
            continue
        k, f = b.column(0).to_numpy(), b.column(1).to_numpy().view("<u8")
        cut = int(np.searchsorted(k, k[-1]))
        if cut:
            yield np.concatenate([*keys, k[:cut]]), np.concatenate([*fps, f[:cut]])
            keys, fps = [k[cut:]], [f[cut:]]
        else:
            if keys and keys[0][0] != k[0]:
                yield np.concatenate(keys), np.concatenate(fps)
                keys, fps = [], []
            keys.append(k)
            fps.append(f)
    if keys:
        yield np.concatenate(keys), np.concatenate(fps)


def links(fps: DataFrame, distance: int, segments: int, max_run: int = MAX_RUN) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp, distinct) that connect every two within
    distance, directly or by other such links."""
    if distance >= 2 * segments:
        raise ValueError("distance must be less than twice the number of segments")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, f in _runs(batches):
            begin = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0]
            size = np.diff(np.append(begin, len(keys)))
            # keys with few fingerprints, all at once: neighbours at each shift
            few = np.repeat(size <= 32, size)
            x, kx = f[few], keys[few]
            for d in range(1, int(size[size <= 32].max(initial=1))):
                hit = (kx[d:] == kx[:-d]) & (np.bitwise_count(x[d:] ^ x[:-d]) <= distance)
                if hit.any():
                    yield _batch(x[:-d][hit], x[d:][hit])
            for at, n in zip(begin[size > 32], size[size > 32], strict=True):
                run = f[at : at + n]
                if n <= 512:  # all pairs at once, unless they are too many to be emitted
                    hit = np.bitwise_count(run[:, None] ^ run[None, :]) <= distance
                    if hit.sum() <= 9 * n:
                        x, y = np.nonzero(np.triu(hit, 1))
                        if len(x):
                            yield _batch(run[x], run[y])
                        continue
                if n > max_run:
                    yield _batch(run, run, keys[at])
                elif found := forest(run, distance):
                    yield _batch(*np.array(found, "<u8").T)

    def compare_blocks(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))  # two blocks at most
        f, block = rows["fp"].to_numpy().view("<u8"), rows["block"].to_numpy()
        i, j = key[1].as_py(), key[2].as_py()
        found = forest(f, distance) if i == j else forest(f[block == i], distance, f[block == j])
        if found:
            yield _batch(*np.array(found, "<u8").T)

    keyed = fps.select(variants(F.col("fp"), segments).alias("key"), "fp")
    dealt = keyed.repartition("key").sortWithinPartitions("key")
    found = staged(dealt.mapInArrow(compare, "a long, b long, key long"), "simhash-links")
    small = found.where("key is null").select("a", "b")
    large = found.where("key is not null").select("key", F.col("a").alias("fp"))
    n = large.groupBy("key").agg(F.ceil(F.count("*") / F.lit(max_run / 2)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    blocks = large.join(n, "key").withColumn("block", block).select("key", "fp", "block", F.explode(pairs).alias("p")).select("key", "p.i", "p.j", "fp", "block")
    return small.union(blocks.groupBy("key", "i", "j").applyInArrow(compare_blocks, "a long, b long, key long").select("a", "b"))


def near_duplicates(docs: DataFrame, *, k: int = 5, distance: int = 4, segments: int = 3) -> DataFrame:
    """doc_id, fp, component_id for each row of docs (doc_id, text)."""
    fps = staged(fingerprints(docs, k), "simhash")
    distinct = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    classes = components(links(distinct.select("fp"), distance, segments))
    named = distinct.join(classes.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    names = named.join(least, "component").select(F.col("fp").alias("fp_"), "component_id")
    return fps.join(names, F.col("fp") == F.col("fp_"), "left").select("doc_id", "fp", "component_id")


def signature(h: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of shingle hashes: each hashes ROWS of its minima under fixed random orders. Sets of
    similarity s agree in a key with probability s ** ROWS."""
    least = np.full(len(_ORDERS[0]), np.iinfo(np.uint64).max, "<u8")
    for at in range(0, len(h), 2048):
        part = (h[at : at + 2048, None] ^ _ORDERS[0]) * _ORDERS[1]
        np.minimum(least, part.min(axis=0), out=least)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(least.reshape(BANDS, ROWS))], "<u8")


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The different shingle hashes of a text (u64, sorted)."""
    return np.unique(np.concatenate([np.zeros(0, "<u8"), *hashes(text, k)]))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets; 1 if both are empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def similar_forest(sets: list[np.ndarray], similar: float) -> list[tuple[int, int]]:
    """A spanning forest (places) of the graph that links sets (none empty) of similarity `similar` or more."""
    size = np.array([len(x) for x in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    begin = np.cumsum(size) - size
    left, mark = np.ones(len(sets), bool), np.zeros(ids.max() + 1, bool)
    out, todo = [], []
    for first in range(len(sets)):
        if not left[first]:
            continue
        left[first] = False
        todo.append(first)
        while todo:
            x = todo.pop()
            own = ids[begin[x] : begin[x] + size[x]]
            mark[own] = True
            both = np.add.reduceat(mark[ids], begin, dtype=np.int64)
            mark[own] = False
            near = np.nonzero(left & (both / (size + size[x] - both) >= similar))[0].tolist()
            left[near] = False
            out += [(x, y) for y in near]
            todo += near
    return out


def similar_links(nodes: DataFrame, proposed: DataFrame, texts: DataFrame, places: DataFrame, k: int, similar: float, few: int = FEW, max_run: int = MAX_SETS) -> DataFrame:
    """a, b: links between nodes (node, bands) whose exact shingle sets have similarity `similar` or more.

    Candidates are the proposed pairs (a, b) and the nodes that meet under a band key. Up to `few` of a key make
    all their pairs; more get a spanning forest of links that are verified before a node counts as reached, and
    beyond max_run in pairs of blocks. places (node and the keys of texts) says where a candidate's text is.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, f in _runs(batches):
            begin = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0]
            size = np.diff(np.append(begin, len(keys)))
            small = np.repeat(size <= few, size)
            x, kx = f[small], keys[small]
            for d in range(1, int(size[size <= few].max(initial=1))):
                hit = kx[d:] == kx[:-d]
                if hit.any():
                    x0, x1 = x[:-d][hit], x[d:][hit]
                    yield _batch(np.minimum(x0, x1), np.maximum(x0, x1))
            for at, n in zip(begin[size > few], size[size > few], strict=True):
                yield _batch(f[at : at + n], f[at : at + n], keys[at])

    @F.pandas_udf("binary")
    def sets_of(texts):
        import pandas as pd

        found = pd.Series([shingle_set(t, k).tobytes() for t in texts])
        trim()
        return found

    @F.pandas_udf("boolean")
    def alike(a, b):
        import pandas as pd

        return pd.Series([jaccard(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) >= similar for x, y in zip(a, b, strict=True)], dtype=bool)

    def compare(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))  # two blocks at most
        found = similar_forest([np.frombuffer(x.as_py(), "<u8") for x in rows["set"]], similar)
        if found:
            node = rows["node"].to_numpy().view("<u8")
            yield _batch(*node[np.array(found)].T).select(["a", "b"])

    keyed = nodes.select(F.explode("bands").alias("key"), "node")
    met = staged(keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(meet, "a long, b long, key long"), "band-candidates")
    pairs = staged(met.where("key is null").select("a", "b").union(proposed.select(F.least("a", "b"), F.greatest("a", "b"))).distinct(), "similar-candidates")
    large = met.where("key is not null").select("key", F.col("a").alias("node"))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(large.select("node")).distinct()
    held = texts.join(places.join(wanted, "node"), ["k1", "k2", "k3"]).select("node", sets_of("text").alias("set"))
    with arrow_rows(nodes.sparkSession, TEXT_ROWS):
        sets = staged(held.groupBy("node").agg(F.first("set").alias("set")), "shingle-sets")  # a row each, but for repeated rows
        a, b = sets.toDF("a", "set_a"), sets.toDF("b", "set_b")
        linked = staged(pairs.join(a, "a").join(b, "b").where(alike("set_a", "set_b")).select("a", "b"), "similar-links")
    n = large.groupBy("key").agg(F.ceil(F.count("*") / F.lit(max_run / 2)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    met_blocks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    blocks = large.join(n, "key").withColumn("block", block).select("key", "node", F.explode(met_blocks).alias("p")).select("key", "p.i", "p.j", "node")
    return linked.union(blocks.join(sets, "node").groupBy("key", "i", "j").applyInArrow(compare, "a long, b long"))


def without_copies(docs: DataFrame, *, k: int = 5, distance: int = 4, segments: int = 3, similar: float = 0.8) -> DataFrame:
    """docs with one row of each class of near-duplicates: that with the smallest doc_id (nulls last; of equal rows
    any one).

    Two texts are linked if their sets of five-word shingles have a Jaccard similarity of 0.8 or more; classes are
    the components of all such links. Candidates come from the SimHash index (4 bits, keys of 21 bits: more bits would need
    keys so short that very many texts share each) and, as such copies differ in up to 18 bits, from BANDS keys of ROWS
    minima each: a pair of similarity 0.8 meets under none of them with probability (1 - 0.8 ** ROWS) ** BANDS, 7e-6.
    Every link is verified on the
    exact sets before it counts. Rows are told apart by doc_id and a hash of the text; the text of candidates moves
    once for their sets, that of what is kept once at the end.
    """
    require(docs, "doc_id", "text")

    @F.pandas_udf("fp long, node long, bands array<long>")
    def made(texts):
        import pandas as pd

        kept_by_worker("simhash")
        fps, nodes, bands = [], [], []
        for t in texts:
            pieces = list(hashes(t, k))
            fps.append(made_of(pieces))
            h = np.unique(np.concatenate([np.zeros(0, "<u8"), *pieces]))
            nodes.append(xxhash.xxh64_intdigest(h.tobytes(), SEED))
            bands.append(signature(h).view("<i8") if len(h) else np.zeros(0, "<i8"))
        trim()
        return pd.DataFrame({"fp": np.array(fps, "<u8").view("<i8"), "node": np.array(nodes, "<u8").view("<i8"), "bands": bands})

    d, th = F.col("doc_id").cast("long"), F.coalesce(F.xxhash64("text"), F.lit(0))
    with arrow_rows(docs.sparkSession, TEXT_ROWS):
        own = staged(docs.select(d.alias("d"), th.alias("th"), made("text").alias("m")).select("d", "th", "m.*"), "simhash")
    first = F.struct(F.col("d").isNull().alias("none"), "d", "th")
    distinct = staged(own.groupBy("node").agg(F.min_by(F.struct(first.alias("first"), "fp", "bands"), first).alias("x")).select("node", "x.*"), "simhash-distinct")
    fps = staged(distinct.groupBy("fp").agg(F.min("node").alias("chief")), "simhash-fingerprints")
    found = links(fps.select("fp"), distance, segments).distinct()
    a, b = fps.toDF("a", "chief_a"), fps.toDF("b", "chief_b")
    proposed = found.join(a, "a").join(b, "b").select(F.col("chief_a").alias("a"), F.col("chief_b").alias("b"))
    proposed = proposed.union(distinct.join(fps, "fp").where("node <> chief").select("node", "chief"))
    texts = docs.select(F.coalesce(d, F.lit(0)).alias("k1"), d.isNull().alias("k2"), th.alias("k3"), "text")
    places = distinct.where(F.size("bands") > 0).select(F.coalesce("first.d", F.lit(0)).alias("k1"), F.col("first.none").alias("k2"), F.col("first.th").alias("k3"), "node")
    classes = components(similar_links(distinct, proposed, texts, places, k, similar))
    named = distinct.join(classes.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    keep = named.groupBy("component").agg(F.min("first").alias("first"))
    keep = keep.select(F.coalesce("first.d", F.lit(0)).alias("k1"), F.col("first.none").alias("k2"), F.col("first.th").alias("k3"))
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("k1"), F.col("doc_id").isNull().alias("k2"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("k3"))
    kept = rows.join(keep, ["k1", "k2", "k3"], "left_semi")
    return kept.groupBy("k1", "k2", "k3").agg(F.first("row").alias("row")).select("row.*")  # the join's own partitions
