"""Benchmark decontamination by template canonicalisation.

Words are compared without edge punctuation and case. A word with a digit is a number; a word of the unit
list is a unit if a number stands before it; a capitalised word is a name, unless it begins a sentence (the
text's or line's first word, or after a word that ends in . ! or ?). In the *template* of a text these are
replaced by <num>, <unit> and <name>; their own strings are the slot values.

Every `window` words are a window. The benchmark's windows, once as they stand and once as templates, are
hashed; template windows with fewer than `min_plain` words that are no slot are left out, as they say too
little. A document's windows of both kinds are looked up by hash. An item's contamination is the share of
its words that lie in windows found in the document: literal (`literal`), or as templates (`template`, of the words
that lie in any template window). So a changed word costs one word, not the `window` windows that hold it; at
least `least_windows` of the windows must be found as well.

Slot consistency: where an item's template is found but its words are not, the matched windows give pairs
(the item's slot value, the document's); of several places that match an item's window the one counts that is in line
with most others (ties: the first). The pairs are consistent if values map one to one: `consistency` is the
share of pairs whose second is the commonest image of the first and whose first is the commonest origin of the
second. A document is a leak of an item if literal >= threshold, or if template >= threshold and
consistency >= threshold.

An item of fewer than `window` words is one window of all its words (of at least three words; shorter items
can't be told from chance and never match). Each document is one row of a scan: no document text is
shuffled. The benchmark's windows go to the executors as a sorted hash table if they are under
`broadcast_bytes`; beyond that, the hashes are dealt to tasks and joined to the documents' window hashes,
and only matches come back.

Units are those of UNITS in the corpus's languages (English, German, French, Spanish). German capitalises nouns, so
there more words are slots; min_plain then leaves more windows out, and an item all of whose windows are left out is
found by its words alone.

Texts are parsed many at a time in Arrow and numpy (`Index.parse_all`, which agrees with `parse`): distinct words are looked
up among the benchmark's words, and only windows of words that are there, or of slots, are hashed. Words with other than
ASCII characters are taken apart one by one in Python, as Arrow's lower case is not Python's.

Null texts match nothing; rows with a null item_id are left out; rows of one item_id with different texts are all
looked for, and the best counts; equal rows give equal results; empty tables give empty results; extra columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_by_worker, require, slices, staged, trim

WINDOW = 5
MIN_PLAIN = 3
THRESHOLD = 0.8
LEAST_WINDOWS = 0.5
BROADCAST_BYTES = 64 << 20
SLICE = 1 << 20  # bytes of text that are parsed together

# Unit words that stand for a measure when a number comes before them.
UNITS = frozenset(
    (
        "mm cm m km in ft mi mg g kg t oz lb ml l s sec h kmh mph "
        "second seconds min minute minutes hour hours day days week weeks month months year years meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches foot feet gram grams kilogram kilograms pound pounds liter liters litre litres dollar dollars euro euros cent cents percent degree degrees "
        "sekunde sekunden minuten stunde stunden tag tage tagen woche wochen monat monate monaten jahr jahre jahren meilen gramm kilogramm kilo pfund prozent grad "
        "seconde secondes heure heures jour jours semaine semaines mois an ans année années mètre mètres kilomètre kilomètres gramme grammes kilogramme kilogrammes livre livres degré degrés "
        "segundo segundos minuto minutos hora horas día días semana semanas mes meses año años metro metros kilómetro kilómetros gramo gramos kilogramo kilogramos kilos litro litros dólar dólares céntimo céntimos grado grados"
    ).split()
)
_EDGE = ".,;:!?\"'()[]{}<>«»“”‘’…-–—"
_NUM, _UNIT, _NAME = "<num>", "<unit>", "<name>"
_BASE = np.array([0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1, 0x165667B19E3779F9 | 1, 0xD6E8FEB86659FD93 | 1, 0xFF51AFD7ED558CCD | 1, 0xC4CEB9FE1A85EC53 | 1, 0xBF58476D1CE4E5B9 | 1, 0x94D049BB133111EB | 1], np.uint64)
_ASCII_EDGE = "".join(x for x in _EDGE if x.isascii())
_SLOT = re.compile(r"\d")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")


class Words:
    """Hashes of words by their own strings, kept between texts up to a bound."""

    def __init__(self, most: int = 500_000) -> None:
        self.known: dict[str, tuple[str, int, bool, bool, bool]] = {}
        self.most = most

    def of(self, raw: str) -> tuple[str, int, bool, bool, bool]:
        """plain form, its hash, has a digit, is capitalised, ends a sentence"""
        found = self.known.get(raw)
        if found is None:
            if len(self.known) >= self.most:
                self.known.clear()
            plain = raw.strip(_EDGE).lower()
            bare = raw.lstrip(_EDGE)
            found = self.known[raw] = (plain, xxhash.xxh64_intdigest(plain), bool(_SLOT.search(plain)), bare[:1].isupper(), raw.rstrip("\"')]»”’")[-1:] in (".", "!", "?"))
        return found


_MARK = {x: xxhash.xxh64_intdigest(x) for x in (_NUM, _UNIT, _NAME)}
_UNIT_HASH = {x: xxhash.xxh64_intdigest(x) for x in sorted(UNITS)}
_HAS_WORD, _HAS_DIGIT, _IS_CAPITAL, _ENDS = 1, 2, 4, 8


def _bytes(strings: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Where strings begin, and the last one ends, in the bytes; the bytes with a zero after them."""
    _, at, raw = strings.buffers()
    at = np.frombuffer(at, np.int64)[strings.offset : strings.offset + len(strings) + 1] if at else np.zeros(1, np.int64)
    return at, np.append(np.frombuffer(raw or b"", np.uint8)[: at[-1]], np.uint8(0))


class Parsed(NamedTuple):
    """The words of texts in a row, those of nothing but punctuation left out."""

    begin: np.ndarray  #: the place of each text's first word, and the number of all
    doc: np.ndarray  #: the place of each word's text
    own: np.ndarray  #: the place of each word among the benchmark's; -1: it is not there
    template: np.ndarray  #: the same, or that of its mark if it is a slot
    raw: pa.DictionaryArray  #: the words as they stand

    def plain(self, doc: int, at: int) -> str:
        """The plain word at a place of a text."""
        return kept_by_worker("decontam", Words).of(self.raw[int(self.begin[doc]) + at].as_py())[0]


def parse(text: str | None, words: Words | None = None) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Plain words; their hashes; their template hashes; whether they are slots. Words of nothing but
    punctuation are left out. Without words those that the worker keeps are used."""
    words = words or kept_by_worker("decontam", Words)
    plain: list[str] = []
    own: list[int] = []
    template: list[int] = []
    slot: list[bool] = []
    for line in (text or "").split("\n"):
        begins, after_number = True, False
        for raw in _SPACE.split(line):
            if not raw:
                continue
            p, h, digit, capital, ends = words.of(raw)
            if p:
                mark = _NUM if digit else _UNIT if after_number and p in UNITS else _NAME if capital and not begins else None
                plain.append(p)
                own.append(h)
                template.append(h if mark is None else _MARK[mark])
                slot.append(mark is not None)
                after_number, begins = digit, ends
            elif ends:
                begins = True
    return plain, np.array(own, np.uint64), np.array(template, np.uint64), np.array(slot, bool)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n words in a row."""
    m = max(len(h) - n + 1, 0)
    return _hash((h[k : k + m] for k in range(n)), m)


def _hash(words: Iterable[np.ndarray], m: int) -> np.ndarray:
    """Hash of m windows from their first words' hashes, their second words', and so on."""
    out = np.zeros(m, np.uint64)
    for k, h in enumerate(words):
        out = (out ^ h) * _BASE[k % len(_BASE)]
        out ^= out >> np.uint64(29)
    return out


def item_windows(text: str | None, window: int, min_plain: int) -> Iterator[tuple[int, int, int, int]]:
    """(hash, kind: 0 literal, 1 template, size, position) of a benchmark item."""
    _, own, template, slot = parse(text)
    n = min(window, len(own))
    if n < min(3, window):
        return
    plain = n - np.convolve(slot, np.ones(n, int), "valid") if len(slot) else np.zeros(0)
    for i, h in enumerate(windows(own, n).tolist()):
        yield h, 0, n, i
    for i, h in enumerate(windows(template, n).tolist()):
        if plain[i] >= min(min_plain, n):
            yield h, 1, n, i


class Index:
    """A benchmark's windows, sorted by hash: what is broadcast. items: (item_id, text), each an item of its own."""

    def __init__(self, items: list[tuple[int, str]], window: int, min_plain: int, least_windows: float) -> None:
        self.ids, self.least = [i for i, _ in items], least_windows
        rows = sorted((h, kind, n, k, at) for k, (_, t) in enumerate(items) for h, kind, n, at in item_windows(t, window, min_plain))
        self.hash = np.array([r[0] for r in rows], np.uint64)
        self.kind, self.size, self.item, self.at = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3, 4))
        self.sizes = sorted(set(self.size.tolist()))
        self.parsed = [parse(t, Words()) for _, t in items]
        every: dict[tuple[int, int], set[tuple[int, int]]] = defaultdict(set)
        for _, kind, n, k, at in rows:
            every[k, kind].add((at, n))
        self.total = {key: (len(x), len(_covered(x))) for key, x in every.items()}
        known = _UNIT_HASH | {p: h for plain, own, _, _ in self.parsed for p, h in zip(plain, own.tolist(), strict=True)}
        self.place = {p: k for k, p in enumerate(known)}  # units come first
        self.words = pa.array(known, pa.large_string())
        self.word_hash = np.array([*known.values(), *_MARK.values()], np.uint64)  # the marks come last

    def _shares(self, key: tuple[int, int], found: set[tuple[int, int]]) -> float:
        """The share of words that lie in found windows; 0 if too few of the windows are found."""
        windows, words = self.total.get(key, (0, 0))
        return len(_covered(found)) / words if words and len(found) >= self.least * windows else 0.0

    def _distinct(self, raw: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The place of words among the benchmark's or -1, and what is to know of each."""
        place, flags = np.full(len(raw), -1, np.int32), np.zeros(len(raw), np.uint8)
        ascii_ = pc.string_is_ascii(raw).to_numpy(zero_copy_only=False)
        some = np.flatnonzero(ascii_)
        strings = raw.take(pa.array(some))
        bare = pc.ascii_trim(strings, characters=_ASCII_EDGE)
        place[some] = pc.fill_null(pc.index_in(pc.ascii_lower(bare), value_set=self.words), -1).to_numpy()
        at, x = _bytes(bare)
        word, first = np.diff(at) > 0, x[at[:-1]]
        digits = np.append(0, np.cumsum((x >= ord("0")) & (x <= ord("9"))))[at]
        end, y = _bytes(pc.ascii_rtrim(strings, characters="\"')]"))
        last = y[end[1:] - 1]
        ends = (np.diff(end) > 0) & ((last == ord(".")) | (last == ord("!")) | (last == ord("?")))
        flags[some] = _HAS_WORD * word | _HAS_DIGIT * (np.diff(digits) > 0) | _IS_CAPITAL * (word & (first >= ord("A")) & (first <= ord("Z"))) | _ENDS * ends
        words = kept_by_worker("decontam", Words)
        other = np.flatnonzero(~ascii_)
        for k, w in zip(other.tolist(), raw.take(pa.array(other)).to_pylist(), strict=True):
            p, _, digit, capital, ends_ = words.of(w)
            place[k] = self.place.get(p, -1)
            flags[k] = _HAS_WORD * bool(p) | _HAS_DIGIT * digit | _IS_CAPITAL * capital | _ENDS * ends_
        return place, flags

    def parse_all(self, texts: pa.Array) -> Parsed:
        """As parse, of many texts, with places among the benchmark's words for hashes."""
        lines = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), "\n")
        cut = pc.ascii_split_whitespace(lines.flatten())
        raw = cut.flatten().dictionary_encode()
        place, flags = self._distinct(raw.dictionary)
        code = raw.indices.to_numpy()
        flags = flags[code]
        keep = np.flatnonzero(flags & _HAS_WORD)
        ended = np.cumsum(flags >= _ENDS, dtype=np.int32)[keep]
        flags = flags[keep]
        ended -= flags >= _ENDS  # in words before
        size = np.diff(cut.offsets.to_numpy())
        line = np.repeat(np.arange(len(size), dtype=np.int32), size)[keep]
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(lines.offsets.to_numpy()))[line]
        inside = np.append(False, line[1:] == line[:-1])[: len(line)]  # not the first of its line
        begins = ~inside | np.append(False, ended[1:] > ended[:-1])[: len(line)]
        digit = (flags & _HAS_DIGIT) > 0
        own = place[code[keep]]
        template = own.copy()
        marks = len(self.words)
        template[((flags & _IS_CAPITAL) > 0) & ~begins] = marks + 2
        template[inside & np.append(False, digit[:-1])[: len(line)] & (own >= 0) & (own < len(UNITS))] = marks + 1
        template[digit] = marks
        return Parsed(np.searchsorted(doc, np.arange(len(texts) + 1)), doc, own, template, pa.DictionaryArray.from_arrays(pa.array(code[keep]), raw.dictionary))

    def _hits(self, place: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where n words in a row of one text have the hash of a benchmark's window, and the first place of that hash."""
        m = max(len(place) - n + 1, 0)
        missing = np.append(np.int32(0), np.cumsum(place < 0, dtype=np.int32))
        at = np.flatnonzero((missing[n : n + m] == missing[:m]) & (doc[n - 1 : n - 1 + m] == doc[:m]))
        w = _hash((self.word_hash[place[at + k]] for k in range(n)), len(at))
        where = np.searchsorted(self.hash, w)
        hit = np.flatnonzero(self.hash[np.minimum(where, len(self.hash) - 1)] == w)
        return at[hit], where[hit]

    def matches(self, text: str | None, threshold: float) -> list[tuple[int, float, float, float, int]]:
        """(item_id, literal, template, consistency, windows found) for each item that the text leaks."""
        return next((found for _, found in self.matches_all(pa.array([text], pa.large_string()), threshold)), [])

    def matches_all(self, texts: pa.Array, threshold: float) -> Iterator[tuple[int, list[tuple[int, float, float, float, int]]]]:
        """As matches, of many texts: the place of each that leaks an item, and what it leaks."""
        if not len(self.hash):
            return
        parsed = self.parse_all(texts)
        found: dict[int, dict[tuple[int, int], set[tuple[int, int]]]] = defaultdict(lambda: defaultdict(set))
        places: dict[int, dict[int, list[tuple[int, int, int]]]] = defaultdict(lambda: defaultdict(list))
        for n in self.sizes:
            for kind, place in ((0, parsed.own), (1, parsed.template)):
                at, where = self._hits(place, parsed.doc, n)
                doc = parsed.doc[at]
                for d, p, k in zip(doc.tolist(), (at - parsed.begin[doc]).tolist(), where.tolist(), strict=True):
                    h = self.hash[k]
                    while k < len(self.hash) and self.hash[k] == h:
                        if self.kind[k] == kind and self.size[k] == n:
                            item = int(self.item[k])
                            found[d][item, kind].add((int(self.at[k]), n))
                            if kind:
                                places[d][item].append((p, int(self.at[k]), n))
                        k += 1
        for d in sorted(found):
            made = self._leaked(partial(parsed.plain, d), found[d], places[d], threshold)
            if made:
                yield d, made

    def _leaked(self, plain: Callable[[int], str], found: dict[tuple[int, int], set[tuple[int, int]]], places: dict[int, list[tuple[int, int, int]]], threshold: float) -> list[tuple[int, float, float, float, int]]:
        """Matches of one text, whose plain words plain gives, from the windows found in it."""
        out: dict[int, tuple[int, float, float, float, int]] = {}
        for item in sorted({i for i, _ in found}):
            literal, form = (self._shares((item, kind), found[item, kind]) for kind in (0, 1))
            if literal < threshold and form < threshold:
                continue
            agree = self.consistency(item, plain, places[item])
            if literal >= threshold or agree >= threshold:
                made = (self.ids[item], literal, form, agree, len(found[item, 0] | found[item, 1]))
                out[made[0]] = max(out.get(made[0], made), made)
        return list(out.values())

    def consistency(self, item: int, plain: Callable[[int], str], places: list[tuple[int, int, int]]) -> float:
        words, _, _, slot = self.parsed[item]
        shift = Counter(p - at for p, at, _ in places)
        best: dict[int, tuple[int, int, int]] = {}
        for p, at, n in places:
            best[at] = max(best.get(at, (-1, 0, 0)), (shift[p - at], -p, n))
        pairs = {(at + j, j - p) for at, (_, p, n) in best.items() for j in range(n) if slot[at + j]}
        values = [(words[a], plain(b)) for a, b in pairs]
        images, origins = defaultdict(Counter), defaultdict(Counter)
        for a, b in values:
            images[a][b] += 1
            origins[b][a] += 1
        # ties of the commonest go to the smallest, both ways
        image, origin = ({x: min(c, key=lambda y: (-c[y], y)) for x, c in of.items()} for of in (images, origins))  # noqa: B023
        return sum(image[a] == b and origin[b] == a for a, b in values) / len(values) if values else 1.0


def _covered(windows_: set[tuple[int, int]]) -> set[int]:
    """Places of the words in windows (first, size)."""
    return {j for at, n in windows_ for j in range(at, at + n)}


_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("literal", pa.float64()), ("template", pa.float64()), ("consistency", pa.float64()), ("n_windows", pa.int64())])
_FOUND_SQL = "doc_id long, item_id long, literal double, template double, consistency double, n_windows long"


def leaks(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, min_plain: int = MIN_PLAIN, threshold: float = THRESHOLD, least_windows: float = LEAST_WINDOWS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, item_id, literal, template, consistency, n_windows: a row for each document row and each
    item that it leaks."""
    require(docs, "doc_id", "text")
    require(benchmark, "item_id", "text")
    spark = docs.sparkSession
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    items = staged(items, "benchmark")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") * 16), F.lit(0))).first()[0]  # 2 windows a word, 40 bytes each
    small = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if size > broadcast_bytes:
        return _by_shuffle(small, items, window, min_plain, threshold, least_windows)
    index = Index(sorted((r["item_id"], r["text"]) for r in items.collect()), window, min_plain, least_windows)  # under broadcast_bytes
    held = spark.sparkContext.broadcast(index)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 1, SLICE, b.num_rows):
                ids = part.column(0)
                rows = [(ids[k].as_py(), *m) for k, found in held.value.matches_all(part.column(1), threshold) for m in found]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), _FOUND.types, strict=True)], schema=_FOUND)
            trim()

    return small.where(F.col("text").isNotNull()).mapInArrow(look, _FOUND_SQL)


def _by_shuffle(docs: DataFrame, items: DataFrame, window: int, min_plain: int, threshold: float, least_windows: float) -> DataFrame:
    """As leaks, for a benchmark too large to be broadcast: documents' window hashes are joined to the
    items', candidates (document, item) with any common window are verified on their two texts."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                h = np.unique(np.array([x[0] for x in item_windows(t.as_py(), window, min_plain)], np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), i, np.int64)), pa.array(h.view(np.int64))], names=["id", "h"])

    def doc_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                _, own, template, _ = parse(t.as_py())
                h = np.unique(np.concatenate([windows(x, n) for x in (own, template) for n in range(min(3, window), window + 1)]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), row, np.int64)), pa.array(h.view(np.int64))], names=["id", "h"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, of = [], defaultdict(list)
            for k, item in enumerate(zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)):
                of[item].append(k)
            for item, at in of.items():
                index = Index([item], window, min_plain, least_windows)
                for part in slices(b.take(pa.array(at)), 2, SLICE, len(at)):
                    row, d = part.column(0), part.column(1)
                    rows += [(row[k].as_py(), d[k].as_py(), *m) for k, found in index.matches_all(part.column(2), threshold) for m in found]
            if rows:
                kinds = [pa.int64(), *_FOUND.types]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["row", *_FOUND.names])

    # row numbers stand for documents in the join, as doc_id may repeat or be null; written once, so they stay
    rows = staged(docs.where(F.col("text").isNotNull()).withColumn("row", F.monotonically_increasing_id()), "decontam-docs")
    items = items.select(F.xxhash64("item_id", "text").alias("key"), "item_id", F.col("text").alias("item_text"))
    own = items.select("key", "item_text").mapInArrow(hashes, "id long, h long").withColumnRenamed("id", "key")
    met = rows.select("row", "text").mapInArrow(doc_hashes, "id long, h long").join(own, "h").select(F.col("id").alias("row"), "key").distinct()
    pairs = met.join(rows, "row").join(items, "key")
    found = pairs.select("row", "doc_id", "text", "item_id", "item_text").mapInArrow(verify, "row long, " + _FOUND_SQL)
    best = found.groupBy("row", "doc_id", "item_id").agg(F.max(F.struct("literal", "template", "consistency", "n_windows")).alias("x"))
    return best.select("doc_id", "item_id", "x.*")
