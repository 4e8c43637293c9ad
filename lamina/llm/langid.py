"""Language of a text: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased; runs of characters that are neither letters nor combining marks (digits, marks, white space)
count as one blank, and a blank stands before and after it. Its n-grams of 1 to 4 characters (code points) are hashed
into `2**bits` buckets. Training sums bucket counts by language over every labelled text: each task emits one dense
count vector for each language it met, so what is shuffled is bounded by tasks x languages and no text moves. The
log-probability matrix (languages x buckets) is broadcast after its size is checked. Texts are scored in batches:
the n-grams of all texts of a slice are one sparse list of (text, bucket), whose rows of the matrix are gathered and
summed by text in numpy.

score is the posterior probability of the predicted language, with a text's evidence scaled down to
`evidence` n-grams at most (n-grams of a text are far from independent, and unscaled posteriors are
all 0 or 1).

A null text or one without a letter (Unicode's, so no digit, number sign or numeral) is `und` with score 0. Texts without a label, and null labels, teach
nothing. Without any training text every prediction is `und`. Ties go to the first language in order.
Extra columns are kept, but for columns of the names that predict adds, which it replaces; repeated rows count as
often as they occur and give equal predictions. Texts of any length are read whole, in pieces of bounded size.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT_ROWS, arrow_rows, free_name, kept_by_worker, require, slices, staged, trim

UNKNOWN = "und"
BITS = 15
ORDERS = (1, 2, 3, 4)
SMOOTHING = 0.5
EVIDENCE = 30.0
#: Characters of text that are scored at a time.
SLICE = 1 << 19
#: The matrix that is broadcast has this size at most.
MAX_MATRIX_BYTES = 64 << 20

# Odd multipliers of an n-gram's code points, first to last; the sum's high bits, mixed, are its bucket.
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0x2545F491], np.uint32)
_CHUNK = 1 << 18


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: whether it is a letter, and what it counts as (itself, or a blank)."""
    letter = np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])
    mark = np.array([unicodedata.category(chr(c))[0] == "M" for c in range(sys.maxunicode + 1)])
    return letter, np.where(letter | mark, np.arange(sys.maxunicode + 1), 32).astype(np.uint32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def n_grams(texts: list[str], bits: int = BITS, orders: tuple[int, ...] = ORDERS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket, text's place, first n-gram of each text) of the n-grams of texts, in pieces of _CHUNK at most; places
    ascend in a piece."""
    joined = "".join([f" {t} " for t in map(str.lower, texts)])
    code = kept_by_worker("langid", _tables)[1][np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)]
    row = np.repeat(np.arange(len(texts)), [len(t.lower()) + 2 for t in texts])
    some = np.ones(len(code), bool)
    some[1:] = (code[1:] != 32) | (code[:-1] != 32) | (row[1:] != row[:-1])
    code, row = code[some], row[some]
    most = max(orders)
    for at in range(0, len(code), _CHUNK):
        part, own = code[at : at + _CHUNK + most - 1], row[at : at + _CHUNK + most - 1]
        h = np.zeros(len(part), np.uint32)
        for n in range(1, most + 1):
            m = min(_CHUNK, len(part) - n + 1)
            if m <= 0:
                break
            h = h[:m] + (part[n - 1 : n - 1 + m] + np.uint32(1)) * _MULTIPLIERS[n - 1]
            if n in orders:
                fine = own[:m] == own[n - 1 : n - 1 + m]
                mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
                place = own[:m][fine]
                if len(place):
                    yield (mixed >> np.uint32(32 - bits))[fine], place, np.concatenate([[0], np.nonzero(place[1:] != place[:-1])[0] + 1])


def buckets(text: str, bits: int = BITS, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    """Counts of a text's n-grams by bucket."""
    out = np.zeros(1 << bits, np.int64)
    for bucket, _, _ in n_grams([text], bits, orders):
        out += np.bincount(bucket, minlength=1 << bits)
    return out


class Model:
    """languages, in order, and the log-probability matrix."""

    def __init__(self, languages: list[str], prior: np.ndarray, log_p: np.ndarray, bits: int, orders: tuple[int, ...], evidence: float) -> None:
        self.languages, self.prior, self.bits, self.orders, self.evidence = languages, prior, bits, orders, evidence
        self.by_bucket = np.ascontiguousarray(log_p.T.astype(np.float64))

    def likelihoods(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood of each text in each language, and its number of n-grams."""
        out, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for bucket, place, first in n_grams(texts, self.bits, self.orders):
            out[place[first]] += np.add.reduceat(self.by_bucket[bucket], first, axis=0)
            n += np.bincount(place, minlength=len(texts))
        return out, n

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = [(UNKNOWN, 0.0)] * len(texts)
        some = [i for i, t in enumerate(texts) if self.languages and has_letter(t)]
        if some:
            x, n = self.likelihoods([texts[i] for i in some])
            x = x * np.minimum(1.0, self.evidence / n)[:, None] + self.prior
            best = x.argmax(axis=1)
            score = 1.0 / np.exp(x - x.max(axis=1, keepdims=True)).sum(axis=1)
            for i, k, p in zip(some, best.tolist(), score.tolist(), strict=True):
                out[i] = self.languages[k], p
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]

    def knows_all(self, texts: list[str | None]) -> list[bool]:
        """Whether a text has a letter and its n-grams are at least as likely in some language as by chance, with all
        buckets equally likely. Without languages every text with a letter counts."""
        out = [has_letter(t) for t in texts]
        some = [i for i, x in enumerate(out) if x]
        if self.languages and some:
            x, n = self.likelihoods([texts[i] for i in some])
            for i, fine in zip(some, (x.max(axis=1) >= -n * self.bits * np.log(2)).tolist(), strict=True):
                out[i] = fine
        return out

    def knows(self, text: str | None) -> bool:
        return self.knows_all([text])[0]


def fit(docs: DataFrame, *, bits: int = BITS, orders: tuple[int, ...] = ORDERS, smoothing: float = SMOOTHING, evidence: float = EVIDENCE) -> Model:
    """Learn from all rows of docs (text, lang)."""
    require(docs, "text", "lang")
    schema = pa.schema([("lang", pa.string()), ("n", pa.int64()), ("counts", pa.list_(pa.int64()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        n: dict[str, int] = {}
        for b in batches:
            for part in slices(b, 0, SLICE):
                rows = [(t, x) for t, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if has_letter(t)]
                names = sorted({x for _, x in rows})
                lang = np.array([names.index(x) for _, x in rows], np.int64)
                found = np.zeros(len(names) << bits, np.int64)
                for bucket, place, _ in n_grams([t for t, _ in rows], bits, orders):
                    found += np.bincount((lang[place] << bits) + bucket, minlength=len(names) << bits)
                for k, x in enumerate(names):
                    n[x] = n.get(x, 0) + int((lang == k).sum())
                    held[x] = held.get(x, 0) + found[k << bits : (k + 1) << bits]
                if len(held) > 64:  # many labels: emit early, so that a task's memory stays bounded
                    yield out(held, n)
                    held, n = {}, {}
            trim()
        if held:
            yield out(held, n)

    def out(held, n):
        return pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([n[k] for k in held], pa.int64()), pa.array([held[k] for k in held], pa.list_(pa.int64()))], schema=schema)

    def total(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, n = np.zeros(1 << bits, np.int64), 0
        for b in batches:
            for vector in b.column(2):
                c += vector.values.to_numpy()
            n += sum(b.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([n], pa.int64()), pa.array([c], pa.list_(pa.int64()))], schema=schema)

    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", F.col("lang").cast("string").alias("lang"))
    kind = "lang string, n long, counts array<long>"
    sums = labelled.mapInArrow(count, kind).groupBy("lang").applyInArrow(total, kind)
    most = MAX_MATRIX_BYTES // (8 << bits)
    with arrow_rows(docs.sparkSession, TEXT_ROWS):
        rows = sorted(sums.limit(most + 1).collect(), key=lambda r: r["lang"])  # a row for each language
    if len(rows) > most:
        raise ValueError(f"more than {most} languages: the matrix would exceed {MAX_MATRIX_BYTES} bytes")
    if not rows:
        return Model([], np.zeros(0), np.zeros((0, 1 << bits), np.float32), bits, orders, evidence)
    counts = np.array([r["counts"] for r in rows], np.float64) + smoothing
    n = np.array([r["n"] for r in rows], np.float64)
    log_p = np.log(counts) - np.log(counts.sum(axis=1, keepdims=True))
    return Model([r["lang"] for r in rows], np.log(n / n.sum()), log_p.astype(np.float32), bits, orders, evidence)


def _in_slices(texts, run) -> list:
    """run on lists of texts of SLICE characters together, or one text."""
    out, part, held = [], [], 0
    for t in texts:
        if part and held + len(t or "") > SLICE:
            out += run(part)
            part, held = [], 0
        part.append(t)
        held += len(t or "")
    out += run(part) if part else []
    trim()
    return out


def predict(docs: DataFrame, model: Model, text: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with two more columns, the predicted language and its score; columns of their names are replaced."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("language string, score double")
    def label(texts):
        import pandas as pd

        got = _in_slices(texts, held.value.predict_all)
        return pd.DataFrame({"language": [x for x, _ in got], "score": [s for _, s in got]})

    found = free_name(docs, "found")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in {x.lower() for x in into}]
    return docs.select(*kept, label(F.col(text)).alias(found)).select(*kept, F.col(f"{found}.language").alias(into[0]), F.col(f"{found}.score").alias(into[1]))


def known(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs whose text the model knows. Texts that it does not know are found first, in small batches, and left out by
    their SHA-256."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def knows(texts):
        import pandas as pd

        return pd.Series(_in_slices(texts, held.value.knows_all), dtype=bool)

    h, name = F.sha2(F.col(text), 256), free_name(docs, "unknown")
    rows = docs.where(F.col(text).isNotNull())
    with arrow_rows(docs.sparkSession, TEXT_ROWS):
        unknown = staged(rows.where(~knows(F.col(text))).select(h.alias(name)).distinct(), "unknown-texts")
    return rows.join(unknown, h == F.col(name), "left_anti")
