"""Line dedup by pairwise alignment.

Lines are compared by the hash of their trimmed text with white space runs as one blank; lines without a
word have none. A document's later copy of text is what aligns with an earlier document (smaller doc_id).

Finding pairs: short or common lines say little, so the keys are rare ones: each line hash is widened to the
shortest run of adjacent lines that has `min_words` words, from the line on and up to it (a line of min_words is
such a run alone). Each key pairs its documents with the first one, the smallest doc_id that holds it: pairs grow
with the number of lines, however common a run is, and none is left out. Every line of a common block of min_words
lies in such a run of the block, so the run's first document, which holds all of it, is paired with the later one.

Alignment: the two line sequences of a pair are aligned by patience diff: lines that are unique in both (in a
stretch without any: equal lines by their number of occurrence) are matched along their longest increasing
subsequence, matches are extended over equal neighbours, and the gaps between them are aligned the same way. Runs of
aligned lines are the common blocks; those of at least `min_words` words are deleted from the later document. What is
left of it is aligned again with the earlier document two and then four times in a row, as blocks may stand in another
order or repeat. An exact check follows: keys of min_words that both documents still hold go too. So a line is deleted
if, and only if, it lies in a run of min_words words that a document with a smaller id holds as well. A run's first document
has no earlier one that holds it, so one occurrence of each run always stays. Lines without a word go if the lines with
words around them both go.

Only hashes and word counts move for the alignment, 12 bytes a line; lines of a document that very many
others are paired with are dealt out in `fan` copies of its row, so that no task aligns more than about
`pairs_a_task` of its pairs. Text moves once, when a document's deletions are joined to it.

A null text has no lines and stays null; a null doc_id takes no part and keeps its text. Rows that share a
doc_id are never paired with each other; each loses what it shares with earlier ids. Empty tables give empty
results. The operator keeps all other columns; n_lines, n_deleted and deleted replace columns of that name.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, n_words, require, staged

MIN_WORDS = 10
PAIRS_A_TASK = 2_000
_P = 0x9E3779B97F4A7C15
_UNDO = pow(_P, -1, 1 << 64)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (first ascending) whose second ascends too, by patience sorting."""
    tops: list[int] = []
    rows: list[int] = []
    before: list[int] = []
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        before.append(rows[k - 1] if k else -1)
        if k == len(tops):
            tops.append(b)
            rows.append(i)
        else:
            tops[k], rows[k] = b, i
    out, i = [], rows[-1] if rows else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched places (i, j) of equal lines of a and b, both ascending. Iterative: depth is no concern."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {b[j]: j for j in range(b0, b1)}
        found = [(i, place[a[i]]) for i in range(a0, a1) if na[a[i]] == 1 and nb.get(a[i]) == 1]
        if not found:
            numbered, nth = {}, Counter()
            for j in range(b0, b1):
                numbered[b[j], nth[b[j]]] = j
                nth[b[j]] += 1
            nth = Counter()
            for i in range(a0, a1):
                if (j := numbered.get((a[i], nth[a[i]]))) is not None:
                    found.append((i, j))
                nth[a[i]] += 1
        anchors = _increasing(found)
        at = (a0, b0)
        for i, j in anchors:
            out.append((i, j))
            todo.append((at[0], i, at[1], j))
            at = (i + 1, j + 1)
        if anchors:
            todo.append((at[0], a1, at[1], b1))
    return sorted(out)


def run_keys(h: np.ndarray, w: np.ndarray, doc: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first line, last line + 1, hash) of the shortest runs that reach min_words, from each line on and up to each
    line. h (none 0), w and doc are the hash, words and document of each line; a run doesn't leave its document."""
    n = len(h)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.concatenate([[0], np.cumsum(w.astype(np.int64))])
    line = np.arange(n)
    until = np.searchsorted(at, at[:-1] + min_words)  # the run from a line on ends before it
    since = np.searchsorted(at, at[1:] - min_words, "right") - 1
    begin, end = np.concatenate([line, since]), np.concatenate([until, line + 1])
    fine = (begin >= 0) & (end <= n)
    begin, end = begin[fine], end[fine]
    same = doc[begin] == doc[end - 1]
    begin, end = np.divmod(np.unique(begin[same] * (n + 1) + end[same]), n + 1)
    step, undo = np.full(n, _P, np.uint64), np.full(n, _UNDO, np.uint64)
    step[0] = undo[0] = 1
    step, undo = np.multiply.accumulate(step), np.multiply.accumulate(undo)  # powers of the base, modulo 2**64
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h.view(np.uint64) * step, dtype=np.uint64)])
    key = (total[end] - total[begin]) * undo[begin] + (end - begin).astype(np.uint64)
    key ^= key >> np.uint64(31)
    return begin, end, (key * np.uint64(_P)).view(np.int64)


def _aligned(a: list[int], b: list[int], w: list[int], min_words: int) -> list[int]:
    """Places of a in aligned blocks of min_words or more."""
    out: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(a, b), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if block and sum(w[k] for k in block) >= min_words:
                out += block
            block = []
        if i >= 0:
            block.append(i)
        last = (i, j)
    return out


def common_lines(later: np.ndarray, earlier: np.ndarray, words: np.ndarray, min_words: int) -> list[int]:
    """Marks (see _with_blanks) of the later document's lines that lie in a common block of min_words or more. Lines
    without a word (hash 0) are left out of the alignment: they neither match nor divide a block."""
    keep = np.nonzero(later)[0]
    a, w = later[keep], words[keep]
    b = earlier[earlier != 0]
    _, _, held = run_keys(b, _words_of(b, a, w, min_words), np.zeros(len(b)), min_words)
    begin, end, key = run_keys(a, w, np.zeros(len(a)), min_words)
    shared = np.isin(key, held)
    left, names, sizes = a.tolist(), b.tolist(), w.tolist()
    gone = np.zeros(len(a), bool)
    for times in (1, 2, 4):
        if not shared.any():
            break
        found = _aligned(left, [x for k in range(times) for x in [*names, ("end", k)]], sizes, min_words)
        gone[found] = True
        for i in found:
            left[i] = ("gone", i)
        shared &= np.array([not gone[i:j].all() for i, j in zip(begin.tolist(), end.tolist(), strict=True)], bool)
    for i, j in zip(begin[shared].tolist(), end[shared].tolist(), strict=True):
        gone[i:j] = True
    return _with_blanks(keep, gone, len(later))


def _words_of(b: np.ndarray, a: np.ndarray, w: np.ndarray, min_words: int) -> np.ndarray:
    """Words of b's lines, by a's equal lines; a line that a lacks ends every run."""
    by = np.argsort(a, kind="stable")
    at = np.minimum(np.searchsorted(a[by], b), max(0, len(a) - 1))
    return np.where(a[by][at] == b, w[by][at], min_words) if len(a) else np.full(len(b), min_words)


def _with_blanks(keep: np.ndarray, gone: np.ndarray, n: int) -> list[int]:
    """4 * place + 3 of each deleted line; 4 * place + 1 of the lines without a word that follow one, + 2 of those before
    one. Such a line goes if it has both."""
    out: list[int] = []
    places = keep.tolist()
    for k in np.nonzero(gone)[0].tolist():
        out.append(4 * places[k] + 3)
        out += range(4 * (places[k] + 1) + 1, 4 * (places[k + 1] if k + 1 < len(places) else n) + 1, 4)
        out += range(4 * (places[k - 1] + 1 if k else 0) + 2, 4 * places[k] + 2, 4)
    return out


def line_hashes(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text: tells rows of one id apart), h (line hashes, 0 for lines without a
    word), w (words of each line)."""
    plain = F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\x20\x09-\x0D]+", " ")))
    hashed = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), plain.alias("p"))
    return hashed.select("doc_id", "th", F.transform("p", lambda x: F.when(x == "", F.lit(0)).otherwise(F.xxhash64(x))).alias("h"), F.transform("p", lambda x: n_words(x).cast("int")).alias("w"))


def pairs(hashed: DataFrame, min_words: int) -> DataFrame:
    """later, earlier: ids of the documents to align."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                h, w = (b.column(k).flatten().to_numpy() for k in (1, 2))
                doc = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column(1)).to_numpy())
                some = h != 0
                begin, _, key = run_keys(h[some], w[some], doc[some], min_words)
                once = np.unique(np.stack([doc[some][begin], key], 1), axis=0)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(once[:, 0])), pa.array(once[:, 1])], names=["doc_id", "run"])

    runs = staged(hashed.select("doc_id", "h", "w").mapInArrow(made, "doc_id long, run long"), "line-runs")
    start = runs.groupBy("run").agg(F.min("doc_id").alias("earlier"), F.max("doc_id").alias("last")).where("earlier < last").select(F.col("run").alias("r_"), "earlier")
    return runs.join(start, F.col("run") == F.col("r_")).where("earlier < doc_id").select(F.col("doc_id").alias("later"), "earlier").distinct()


def deletions(docs: DataFrame, min_words: int, pairs_a_task: int) -> DataFrame:
    """doc_id, th, lines (sorted places to delete) of docs (doc_id, text)."""
    hashed = staged(line_hashes(docs), "lines")
    found = staged(pairs(hashed, min_words), "line-pairs")
    fan = found.groupBy("earlier").agg((F.floor(F.count("*") / F.lit(pairs_a_task)) + 1).cast("int").alias("fan"))
    fanned = found.join(fan, "earlier").select("later", "earlier", F.pmod(F.xxhash64("later"), F.col("fan")).cast("int").alias("part"))
    left = hashed.join(fan, F.col("doc_id") == F.col("earlier")).select("earlier", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("part"), F.col("h").alias("h0"))
    both = hashed.join(fanned, F.col("doc_id") == F.col("later")).join(left, ["earlier", "part"])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                ids, lines = [], []
                for r, (h0, h, w) in enumerate(zip(b.column(2), b.column(3), b.column(4), strict=True)):
                    got = common_lines(h.values.to_numpy(), h0.values.to_numpy(), w.values.to_numpy(), min_words)
                    ids += [r] * len(got)
                    lines += got
                rows = pa.array(ids, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(lines, pa.int32())], names=["doc_id", "th", "line"])

    gone = both.select("doc_id", "th", "h0", "h", "w").mapInArrow(align, "doc_id long, th long, line int")
    marks = gone.groupBy("doc_id", "th").agg(F.collect_set("line").alias("m"))  # at most three a line of the document

    def of(kind: int):
        return F.transform(F.filter("m", lambda x: x % 4 == kind), lambda x: F.floor(x / 4).cast("int"))

    return marks.select("doc_id", "th", F.sort_array(F.array_union(of(3), F.array_intersect(of(1), of(2)))).alias("lines"))


def without_common_blocks(docs: DataFrame, *, min_words: int = MIN_WORDS, pairs_a_task: int = PAIRS_A_TASK) -> DataFrame:
    """docs, with text less its deleted lines, and n_lines, n_deleted and deleted (their places)."""
    require(docs, "doc_id", "text")
    gone = deletions(docs.select("doc_id", "text"), min_words, pairs_a_task)
    ls, gl = free_name(docs, "ls_"), free_name(docs, "l_")  # the last select sees them beside docs' own columns
    gone = gone.select(F.col("doc_id").alias("d_"), F.col("th").alias("t_"), F.col("lines").alias(gl))
    names = [c for c in docs.columns if c.lower() not in {"text", "n_lines", "n_deleted", "deleted"}]
    rows = docs.select(F.struct(*[F.col(c) for c in names]).alias("r_"), "doc_id", "text")
    joined = rows.join(gone, (F.col("doc_id").cast("long") == F.col("d_")) & (F.xxhash64("text") == F.col("t_")), "left")
    joined = joined.select("r_", "text", F.split("text", "\n").alias(ls), gl)  # used more than once, so Spark splits once
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), gl), lambda i: F.get(ls, i))
    text = F.when(F.col(gl).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return joined.select("r_.*", text.alias("text"), F.coalesce(F.size(ls), F.lit(0)).alias("n_lines"), F.coalesce(F.size(gl), F.lit(0)).alias("n_deleted"), F.coalesce(gl, F.array().cast("array<int>")).alias("deleted"))
