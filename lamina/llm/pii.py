r"""Personal data: base patterns, and a skip-chain conditional random field that adds spans.

Base spans, leftmost and non-overlapping for each kind, matches that fail their check are dropped:
    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)         parts at most 255
    card   [0-9]([\x20-]?[0-9])+                        14 to 19 digits that pass Luhn
    phone  \+[0-9][\x20().0-9-]+[0-9]                   10 to 15 digits
The scanners below take time in proportion to the text's length, whatever it holds.

Model: tokens are words; those without a digit, @, + or a written-out (at) are labelled "outside" for certain, so a
document's chain falls into runs of the other tokens (candidates). Labels are outside, and begin and inside of each
kind. Chain potentials are a linear-chain CRF over features of a candidate and its neighbours. Skip edges link mentions,
however far apart, that are the same or similar: the same word (lower case, without edge punctuation), the same
address however its @ and dots are written, the same four numbers, the same digits (seven or more, of a token, of a
whole run or of a base span), or the same last seven digits. Each mention is linked to the one before it; the edges
reward equal kinds. Where there are skip edges the graph has loops; messages are passed along all edges in turn (damped
on skip edges) until they settle. Tokens of base spans have their labels for certain, and so what one mention makes
certain reaches the others of its document.

Training: the base spans label the documents. The patterns can't say what a mention without its mark is (a phone number
without +, an address with (at), a card with dots), so such mentions are not taught as outside: runs that a skip edge
links to a base span are left out, and each base span is seen again without its mark, as its kind with weight
UNMARKED and as outside with the rest. Alone such a mention stays outside, linked to a sure one it doesn't. The CRF is
fitted on a sample of at most `sample` documents, those of smallest hash of doc_id (their first `sample_runs` runs of
candidates each, long runs in pieces of RUN_PIECE), by maximum likelihood with an L2 penalty; the skip weight is the log
odds that linked base spans agree in kind, at least SKIP_LEAST. Inference covers every token of every document.

An added span holds tokens of one kind, each with a marginal of at least `threshold`, what that kind can't do
without (an email an @; an ip four numbers; a card 12 to 19 digits; a phone 7 to 15), and overlaps no base span.

A null text is empty; positions are code points, ends exclusive. Null doc_ids and repeated rows are kept.
Extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, require

KINDS = ("email", "ip", "card", "phone")
N_LABELS = 1 + 2 * len(KINDS)
SAMPLE = 4_000
SAMPLE_RUNS = 40
RUN_PIECE = 16
UNMARKED = 0.2
SKIP_LEAST, SKIP_MOST = 4.0, 8.0
THRESHOLD = 0.8
SURE = 20.0

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(WORD)
_HINT = re.compile(r"[0-9@+]|[(\[](?:at|AT)[)\]]")
_WRITTEN_AT, _WRITTEN_DOT = re.compile(r"[(\[]at[)\]]"), re.compile(r"[(\[](?:dot|\.)[)\]]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_EDGE_LEFT, _EDGE_RIGHT = "\"'<[{,;:.!?|", "\"'>]}),;:.!?|"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if i % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return _NOT_DIGIT.sub("", s)


def _part_ok(s: str) -> bool:
    s = s.lstrip("0")
    return len(s) <= 3 and int(s or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((begin, 0, end))
        at = text.find("@", max(at + 1, end))
    if _HINT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_part_ok, m.groups()))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


class Token:
    """A candidate: its core (without edge punctuation), place and run."""

    __slots__ = ("begin", "core", "digits", "end", "run")

    def __init__(self, begin: int, word: str, run: int) -> None:
        left = len(word) - len(word.lstrip(_EDGE_LEFT))
        core = word[left:].rstrip(_EDGE_RIGHT if "(" not in word else _EDGE_RIGHT.replace(")", ""))
        self.core = core or word
        self.begin = begin + (left if core else 0)
        self.end = self.begin + len(self.core)
        self.digits, self.run = _digits(self.core), run


def candidates(text: str) -> list[Token]:
    if not _HINT.search(text):
        return []
    out, run, last = [], -1, -2
    for i, m in enumerate(_WORD.finditer(text)):
        if _HINT.search(m[0]):
            run += i != last + 1
            last = i
            out.append(Token(m.start(), m[0], run))
    return out


_RUNS = re.compile(r"[0-9]+|[^\W\d_]+|(.)", re.DOTALL)


def shape(core: str) -> str:
    """Digits as 9 and their number, letters as a, other characters as they are; of long words the rim."""
    core = core if len(core) <= 64 else core[:32] + core[-32:]
    return "".join(m[1] or ("a" if not m[0][0].isdigit() else f"9{min(len(m[0]), 20)}") for m in _RUNS.finditer(core))[:24]


def features(tokens: list[Token]) -> list[list[str]]:
    shapes = [shape(t.core) for t in tokens]
    joined: dict[int, str] = {}
    for t in tokens:
        joined[t.run] = joined.get(t.run, "") + t.digits if len(joined.get(t.run, "")) < 24 else joined[t.run]
    out = []
    for i, t in enumerate(tokens):
        n, core = len(t.digits), t.core
        f = ["", "s" + shapes[i], f"n{min(n, 20)}", f"c{(n >= 7) + (n >= 10) + (n >= 14)}"]
        f.append("p" + (shapes[i - 1] if i and tokens[i - 1].run == t.run else ""))
        f.append("x" + (shapes[i + 1] if i + 1 < len(tokens) and tokens[i + 1].run == t.run else ""))
        if _WRITTEN_AT.search(core.lower()):
            f.append("@w")
        if "@" in core:
            f.append("@" + ("1" if any(k == 0 for _, k, _ in base_spans(core)) else "0"))
        if core.count(".") == 3 and (m := _IP.fullmatch(core)):
            f.append("i" + str(int(all(map(_part_ok, m.groups())))))
        if 14 <= n <= 19:
            f.append("l" + str(int(luhn(t.digits))))
        elif 14 <= len(joined[t.run]) <= 19:
            f.append("r" + str(int(luhn(joined[t.run]))))
        if core[:1] == "+":
            f.append("+" + str(int(10 <= len(joined[t.run]) <= 15)))
        out.append(f)
    return out


def gold(tokens: list[Token], spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Labels by the base spans: the first token that a span touches begins it."""
    y = np.zeros(len(tokens), np.int64)
    begins = np.array([t.begin for t in tokens])
    ends = np.array([t.end for t in tokens])
    for a, k, b in spans:
        lo, hi = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(begins, b, "left"))
        if lo < hi and not y[lo]:
            y[lo] = 1 + 2 * k
            y[lo + 1 : hi] = 2 + 2 * k
    return y


def address(core: str) -> str:
    """An address with its @ and dots as signs."""
    return _WRITTEN_DOT.sub(".", _WRITTEN_AT.sub("@", core.lower()))


def _digit_keys(digits: str) -> list[str]:
    return ["d" + digits, "t" + digits[-7:]] if 7 <= len(digits) <= 15 else ["d" + digits] if 7 <= len(digits) <= 24 else []


def skip_edges(tokens: list[Token], y: np.ndarray) -> list[tuple[int, int]]:
    """Each mention to the one before it that is the same or similar; not a token to its neighbour. y: the labels of
    tokens in base spans, 0 elsewhere. A mention of several tokens is linked by its first."""
    mentions: dict[int, list[str]] = {}
    for i, t in enumerate(tokens):
        keys = mentions.setdefault(i, [])
        if len(t.core) > 3:
            keys.append("w" + t.core.lower())
        if "@" in t.core or _WRITTEN_AT.search(t.core.lower()):
            keys.append("@" + address(t.core))
        if len(numbers := re.findall(r"[0-9]+", t.core)) == 4:
            keys.append("g" + ".".join(numbers))
        keys += _digit_keys(t.digits)
    i = 0
    while i < len(tokens):  # base spans, and runs that hold none, by all their digits
        j = i + 1
        if y[i]:
            while j < len(tokens) and tokens[j].run == tokens[i].run and y[j] and y[j] % 2 == 0:
                j += 1
        else:
            while j < len(tokens) and tokens[j].run == tokens[i].run and not y[j] and sum(len(t.digits) for t in tokens[i:j]) < 24:
                j += 1
        if j > i + 1:
            mentions[i] += _digit_keys("".join(t.digits for t in tokens[i:j]))
        i = j
    last: dict[str, int] = {}
    out = set()
    for i, keys in mentions.items():
        for key in keys:
            if (k := last.get(key)) is not None and (k < i - 1 or tokens[k].run != tokens[i].run):
                out.add((k, i))
            last[key] = i
    return sorted(out)


def _allowed() -> np.ndarray:
    """0 where a label may follow another, otherwise a large penalty."""
    t = np.zeros((N_LABELS, N_LABELS))
    for b in range(2, N_LABELS, 2):
        t[:, b] = -30.0
        t[[b - 1, b], b] = 0.0
    return t


_START = np.array([-30.0 if b and b % 2 == 0 else 0.0 for b in range(N_LABELS)])


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


class Crf:
    def __init__(self, index: dict[str, int], weights: np.ndarray, transitions: np.ndarray, skip: float) -> None:
        self.index, self.weights, self.transitions, self.skip = index, weights, transitions, skip
        kind = np.array([0, *[k for k in range(1, len(KINDS) + 1) for _ in range(2)]])
        self.skip_table = np.where((kind[:, None] == kind[None, :]) & (kind[:, None] > 0), skip, 0.0)

    def unary(self, tokens: list[Token]) -> np.ndarray:
        out = np.zeros((len(tokens), N_LABELS))
        for i, fs in enumerate(features(tokens)):
            out[i] = self.weights[[self.index[f] for f in fs if f in self.index]].sum(axis=0)
        return out

    def marginals(self, theta: np.ndarray, chain: np.ndarray, skips: np.ndarray, rounds: int = 60, tolerance: float = 1e-3) -> np.ndarray:
        """Of nodes with log potentials theta, chain edges (pairs) and skip edges (pairs), by sum-product
        messages in both directions of each edge."""
        src = np.concatenate([chain[:, 0], chain[:, 1], skips[:, 0], skips[:, 1]])
        dst = np.concatenate([chain[:, 1], chain[:, 0], skips[:, 1], skips[:, 0]])
        c, s = len(chain), len(skips)
        back = np.concatenate([np.arange(c, 2 * c), np.arange(c), np.arange(2 * c + s, 2 * c + 2 * s), np.arange(2 * c, 2 * c + s)])
        messages = np.zeros((len(src), N_LABELS))
        tables = (self.transitions, self.transitions.T, self.skip_table)
        parts = ((0, c), (c, 2 * c), (2 * c, len(src)))
        belief = theta.copy()
        for _ in range(rounds if len(src) else 0):
            held = belief[src] - messages[back]
            new = np.empty_like(messages)
            for (a, b), table in zip(parts, tables, strict=True):
                for k in range(a, b, 20_000):
                    e = min(b, k + 20_000)
                    new[k:e] = _lse(held[k:e, :, None] + table[None], 1)
            new -= new.max(axis=1, keepdims=True)
            new[2 * c :] = 0.5 * (new[2 * c :] + messages[2 * c :])
            change = np.abs(new - messages).max()
            messages = new
            belief = theta.copy()
            np.add.at(belief, dst, messages)
            if change < tolerance:
                break
        p = np.exp(belief - belief.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def added(self, docs: list[list[Token]], bases: list[list[tuple[int, int, int]]], threshold: float) -> list[list[tuple[int, int, int]]]:
        """Spans beyond the base ones; documents are parts of one graph without edges between them."""
        theta, chain, skips, at = [], [], [], 0
        for tokens, base in zip(docs, bases, strict=True):
            if tokens:
                u = self.unary(tokens)
                y = gold(tokens, base)
                u[np.nonzero(y)[0], y[y > 0]] += SURE
                run = np.array([t.run for t in tokens])
                joins = np.nonzero(run[1:] == run[:-1])[0]
                u[np.setdiff1d(np.arange(len(tokens)), joins + 1)] += _START
                theta.append(u)
                chain.append(np.stack([joins, joins + 1], 1) + at)
                skips += [(i + at, j + at) for i, j in skip_edges(tokens, y)]
                at += len(tokens)
        if not at:
            return [[] for _ in docs]
        p = self.marginals(np.concatenate(theta), np.concatenate(chain), np.array(skips, np.int64).reshape(-1, 2))
        label, sure = p.argmax(axis=1), p[:, 1::2] + p[:, 2::2]
        out, at = [], 0
        for tokens, base in zip(docs, bases, strict=True):
            out.append(_spans(tokens, label[at : at + len(tokens)], sure[at : at + len(tokens)], base, threshold))
            at += len(tokens)
        return out


def _spans(tokens: list[Token], label: np.ndarray, sure: np.ndarray, base: list[tuple[int, int, int]], threshold: float) -> list[tuple[int, int, int]]:
    out, i = [], 0
    while i < len(tokens):
        if not label[i]:
            i += 1
            continue
        k = (int(label[i]) - 1) // 2
        j = i + 1
        while j < len(tokens) and label[j] == 2 + 2 * k and tokens[j].run == tokens[i].run:
            j += 1
        a, b, n = tokens[i].begin, tokens[j - 1].end, sum(len(t.digits) for t in tokens[i:j])
        whole = (
            j == i + 1 and _DOMAIN.search(address(tokens[i].core).partition("@")[2]) is not None if k == 0 else len(re.findall(r"[0-9]+", tokens[i].core)) == 4 if k == 1 else 12 <= n <= 19 if k == 2 else 7 <= n <= 15
        )
        if whole and sure[i:j, k].min() >= threshold and not any(x < b and a < y for x, _, y in base):
            out.append((a, k, b))
        i = j
    return out


def unmarked(tokens: list[Token], kind: int) -> list[list[Token]]:
    """A base span's tokens as they might stand without the mark by which the pattern knows them: ways to write them."""
    cores = [t.core for t in tokens]
    if kind == 0:
        ways = [[c.replace("@", "(at)") for c in cores]]
    elif kind == 1:
        ways = [[c.replace(".", "[.]") for c in cores]]
    elif kind == 2:
        ways = [[".".join(cores)]]
    else:
        ways = [[c.lstrip("+") for c in cores], [_digits("".join(cores))], ["0" + _digits("".join(cores))[2:]]]
    return [[Token(0, c, 0) for c in way if c] for way in ways]


def train(samples: list[tuple[list[tuple[list[str], int]], float]], agree: int, differ: int, *, rounds: int = 150, l2: float = 1e-3, rate: float = 0.1) -> Crf:
    """Maximum likelihood on runs of (features, label) with weights, by Adam over the whole sample."""
    weights, samples = np.array([w for _, w in samples]), [run for run, _ in samples]
    index = {f: i for i, f in enumerate(sorted({f for run in samples for fs, _ in run for f in fs}))}
    allowed = _allowed()
    w, t = np.zeros((len(index), N_LABELS)), np.zeros((N_LABELS, N_LABELS))
    skip = float(np.clip(np.log((agree + 1) / (differ + 1)), SKIP_LEAST, SKIP_MOST))
    if not samples or not any(y for run in samples for _, y in run):
        w = np.zeros((max(1, len(index)), N_LABELS))
        w[index.get("", 0), 0] = 10.0  # nothing was labelled: all is outside
        return Crf(index or {"": 0}, w, allowed, skip)
    n, m = len(samples), max(map(len, samples))
    width = max(len(fs) for run in samples for fs, _ in run)
    feats = np.full((n, m, width), len(index))
    y, mask = np.zeros((n, m), np.int64), np.zeros((n, m), bool)
    for i, run in enumerate(samples):
        for j, (fs, label) in enumerate(run):
            feats[i, j, : len(fs)] = [index[f] for f in fs]
            y[i, j], mask[i, j] = label, True
    total = (mask * weights[:, None]).sum()
    one = np.eye(N_LABELS)[y] * mask[..., None]
    pair = one[:, :-1, :, None] * one[:, 1:, None, :]
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
    for step in range(1, rounds + 1):
        padded = np.concatenate([w, np.zeros((1, N_LABELS))])
        u = padded[feats].sum(axis=2)
        u[:, 0] += _START
        tr = t + allowed
        f, b = np.zeros_like(u), np.zeros_like(u)
        f[:, 0] = u[:, 0]
        for j in range(1, m):
            nxt = _lse(f[:, j - 1, :, None] + tr, 1) + u[:, j]
            f[:, j] = np.where(mask[:, j, None], nxt, f[:, j - 1])
        z = _lse(f[:, -1], 1)
        for j in range(m - 2, -1, -1):
            nxt = _lse(tr[None] + (u[:, j + 1] + b[:, j + 1])[:, None, :], 2)
            b[:, j] = np.where(mask[:, j + 1, None], nxt, 0.0)
        p = np.exp(f + b - z[:, None, None]) * mask[..., None]
        both = np.exp(f[:, :-1, :, None] + tr + (u[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        gu = (p - one) * weights[:, None, None]
        gw = np.zeros((len(index) + 1, N_LABELS))
        np.add.at(gw, feats.reshape(-1), np.repeat(gu.reshape(-1, N_LABELS), width, axis=0))
        gw = gw[:-1] / total + l2 * w
        gt = ((both - pair) * weights[:, None, None, None]).sum(axis=(0, 1)) / total + l2 * t
        for x, g, a, v in ((w, gw, moments[0], moments[1]), (t, gt, moments[2], moments[3])):
            a *= 0.9
            a += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            x -= rate * (a / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Crf(index, w, t + allowed, skip)


def fit(docs: DataFrame, *, sample: int = SAMPLE, sample_runs: int = SAMPLE_RUNS) -> Crf:
    """Learn from a bounded sample of docs (doc_id, text) that their base spans label."""
    require(docs, "doc_id", "text")
    n = docs.count()
    h = F.shiftrightunsigned(F.xxhash64("doc_id"), 1)
    few = docs.select(h.alias("h"), "text")
    if n > 2 * sample:  # the smallest hashes are among those under a bound that about twice as many keep
        few = few.where(F.col("h") < int(2 * sample / n * 2**63))
    few = few.orderBy("h", F.xxhash64("text"), "text").limit(sample).select("text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs, agree, differ = [], 0, 0
            for text in b.column(0):
                text = text.as_py() or ""
                tokens = candidates(text)
                if not tokens:
                    continue
                base = base_spans(text)
                y = gold(tokens, base)
                kind = (y + 1) // 2
                unsure = set()
                for i, j in skip_edges(tokens, y):
                    if kind[i] and kind[j]:
                        agree, differ = agree + int(kind[i] == kind[j]), differ + int(kind[i] != kind[j])
                    elif kind[i] or kind[j]:
                        unsure.add(tokens[i if kind[j] else j].run)
                upto = next((i for i, t in enumerate(tokens) if t.run >= sample_runs), len(tokens))
                by_run: dict[int, list] = {}
                for t, f, label in zip(tokens[:upto], features(tokens[:upto]), y.tolist(), strict=False):
                    by_run.setdefault(t.run, []).append((f, label))
                runs += [(r[k : k + RUN_PIECE], 1.0) for x, r in by_run.items() if x not in unsure for k in range(0, len(r), RUN_PIECE)]
                for i in np.nonzero(y[:upto] % 2)[0].tolist():
                    j = i + 1
                    while j < upto and y[j] == y[i] + 1 and tokens[j].run == tokens[i].run:
                        j += 1
                    k = int(kind[i]) - 1
                    for way in unmarked(tokens[i:j], k):
                        bare = features(way)[:RUN_PIECE]
                        runs.append(([(f, 1 + 2 * k + (m > 0)) for m, f in enumerate(bare)], UNMARKED))
                        runs.append(([(f, 0) for f in bare], 1.0 - UNMARKED))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((runs, agree, differ))])], names=["made"])

    got = [pickle.loads(r["made"]) for r in few.mapInArrow(extract, "made binary").collect()]  # noqa: S301  our own bytes
    return train([r for runs, _, _ in got for r in runs], sum(a for _, a, _ in got), sum(d for _, _, d in got))


_OUT = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])
_OUT_SQL = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long"


def find(docs: DataFrame, model: Crf, *, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, number of base spans by kind, base_sha256 (of the base spans as written), spans (all spans,
    as written), n_added."""
    require(docs, "doc_id", "text")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                texts = [t or "" for t in b.column(1).to_pylist()]
                bases = [base_spans(t) for t in texts]
                added = held.value.added([candidates(t) for t in texts], bases, threshold)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0),
                        *[pa.array([sum(k == kind for _, k, _ in s) for s in bases], pa.int64()) for kind in range(len(KINDS))],
                        pa.array([hashlib.sha256(written(s).encode()).hexdigest() for s in bases]),
                        pa.array([written(sorted(s + a)) for s, a in zip(bases, added, strict=True)]),
                        pa.array(list(map(len, added)), pa.int64()),
                    ],
                    schema=_OUT,
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _OUT_SQL)
