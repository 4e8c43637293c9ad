import hashlib
import random
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lamina.llm import ann, chat, decontam, eftrie, langid, linedup, mixing, pii
from lamina.llm import queries as q


def rows_of(small, table, columns="*"):
    return duckdb.sql(f"SELECT {columns} FROM '{small}/{table}.parquet'").fetchall()


# ---------------------------------------------------------------- line dedup


def test_patience_alignment():
    assert linedup.patience([1, 2, 3, 4], [1, 9, 3, 4]) == [(0, 0), (2, 2), (3, 3)]
    assert linedup.patience([5, 1, 2, 5], [1, 2]) == [(1, 0), (2, 1)]
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = (rng.integers(1, 8, rng.integers(0, 20)).tolist() for _ in range(2))
        m = linedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in m) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(m, m[1:], strict=False))


def test_line_dedup(docs_of):
    shared = "\n".join(f"a shared line of the block number {i}" for i in range(5))
    docs = docs_of([(7, f"own start\n{shared}\nown end seven"), (3, f"other start\n{shared}\nother end"), (9, shared), (9, "short line\nx"), (11, "short line\ny"), (1, None), (None, shared), (5, "")])
    got = {(r["doc_id"], r["n_lines"], r["text"]): r["deleted"] for r in linedup.without_common_blocks(docs).collect()}
    assert got[7, 7, "own start\nown end seven"] == [1, 2, 3, 4, 5]
    assert got[9, 5, ""] == [0, 1, 2, 3, 4]
    assert got[3, 7, f"other start\n{shared}\nother end"] == [] and got[11, 2, "short line\ny"] == []
    assert got[1, 0, None] == [] and got[None, 5, shared] == [] and got[5, 1, ""] == []
    assert linedup.without_common_blocks(docs.limit(0)).isEmpty()
    fanned = linedup.without_common_blocks(docs, pairs_a_task=1).where("n_deleted > 0").count()
    assert fanned == 2


def test_blocks_of_common_short_lines(docs_of):
    first, second = "this line is held by many", "so is this one here"  # ten words or more only together
    rows = [(0, first), (1, second), (2, f"{first}\n{second}\nof two")] + [(3 + i, first if i % 2 else second) for i in range(12)]
    docs = docs_of([*rows, (50, f"start\n{first}\n \n{second}\nend")])
    got = {r["doc_id"]: r["deleted"] for r in linedup.without_common_blocks(docs).collect()}
    assert got[50] == [1, 2, 3] and all(not got[d] for d in got if d != 50)


def brute_deletions(docs, min_words):
    """Lines in a run of min_words words that a document with a smaller id holds: all pairs, all runs."""
    words = {d: [(i, " ".join(re.split(r"[\x20\x09-\x0D]+", x)).strip()) for i, x in enumerate(t.split("\n"))] for d, t in docs.items()}
    words = {d: [(i, x) for i, x in xs if x] for d, xs in words.items()}
    out = {}
    for d, a in words.items():
        gone = set()
        for e, b in words.items():
            if e >= d:
                continue
            for i in range(len(a)):
                for j in range(len(b)):
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n][1] == b[j + n][1]:
                        n += 1
                    if sum(len(x.split()) for _, x in a[i : i + n]) >= min_words:
                        gone |= set(range(i, i + n))
        places = {a[k][0] for k in gone}
        for k in gone:  # blank lines between two deleted lines go with them
            if k - 1 in gone:
                places |= set(range(a[k - 1][0], a[k][0]))
        out[d] = sorted(places)
    return out


def test_line_dedup_against_brute_force(docs_of):
    rng = np.random.default_rng(3)
    lines = ["one two", "three four five", "six seven eight nine", "a b c d e", "u v w x y z", "", " \t", "long line of eleven words which is enough by itself alone"]
    docs = {d: "\n".join(rng.choice(lines, rng.integers(1, 14))) for d in range(60)}
    block = "p1 p2 p3 p4 p5 p6\nq1 q2 q3 q4 q5 q6"
    docs |= {60: "p1 p2 p3 p4 p5 p6\nalone", 61: "alone too\nq1 q2 q3 q4 q5 q6"} | {d: f"own {d}\n{block}\n{docs[d % 60]}" for d in range(62, 230)}
    docs |= {300: f"x0\n{block}\nx1\n{block}\nx2\n{block}", 301: "q1 q2 q3 q4 q5 q6\nr\n" + block, 302: "\n".join([block] * 40)}
    got = {r["doc_id"]: r["deleted"] for r in linedup.without_common_blocks(docs_of(list(docs.items()))).collect()}
    assert got == brute_deletions(docs, linedup.MIN_WORDS)
    assert all(got[d] for d in range(63, 230)) and not got[62][:0]


def test_crossed_and_repeated_blocks():
    a, b = np.array([9, 1, 2, 3, 8, 1, 2, 3, 7, 4, 5]), np.array([4, 5, 6, 1, 2, 3])
    w = np.full(11, 4, np.int32)
    assert linedup.common_lines(a, b, w, 8) == [4 * k + 3 for k in (1, 2, 3, 5, 6, 7, 9, 10)]
    assert linedup.common_lines(b, a, w[:6], 12) == [4 * k + 3 for k in (3, 4, 5)]
    assert linedup.common_lines(np.array([0, 1, 0, 2]), np.array([1, 2]), w[:4], 8) == [7, 9, 2, 15, 10]


def test_long_and_repeated_rows(docs_of):
    long = "\n".join(f"line {i} of a very long text with words" for i in range(20_000))
    rows = [(1, long), (2, long), (2, long), (3, long + "\nend"), (4, None), (4, "")]
    got = {(r["doc_id"], r["n_lines"]): r["n_deleted"] for r in linedup.without_common_blocks(docs_of(rows).withColumn("deleted", F.lit(1)).withColumn("th", F.lit(2))).collect()}
    assert got == {(1, 20_000): 0, (2, 20_000): 20_000, (3, 20_001): 20_000, (4, 0): 0, (4, 1): 0}


def test_line_dedup_query(spark, small):
    texts = dict(rows_of(small, "documents", "doc_id, text"))

    def norm(line):
        return re.sub(r"[\x20\x09-\x0D]+", " ", line).strip()

    first = {}
    for d in sorted(texts):
        for line in texts[d].split("\n"):
            first.setdefault(norm(line), d)
    got = {r["doc_id"]: r for r in q.op2_patience_line_dedup(spark, small).collect()}
    assert got.keys() == texts.keys()
    for d, r in got.items():
        gone = {int(x) for x in r["deleted"].split(",") if x}
        lines = texts[d].split("\n")
        assert all(not norm(lines[i]) or first[norm(lines[i])] < d for i in gone)
        assert r["kept_sha256"] == hashlib.sha256("\n".join(x for i, x in enumerate(lines) if i not in gone).encode()).hexdigest()
    seen = set()
    for d in sorted(texts):  # an exact copy of an earlier document goes as a whole
        if texts[d] in seen and len(texts[d].split()) >= linedup.MIN_WORDS:
            assert got[d]["n_deleted"] == got[d]["n_lines"]
        seen.add(texts[d])


# ---------------------------------------------------------------- personal data

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    def fine(k, s):
        n = re.sub(r"[^0-9]", "", s)
        return k == 0 or (k == 1 and all(int(p) <= 255 for p in s.split("."))) or (k == 2 and 14 <= len(n) <= 19 and pii.luhn(n)) or (k == 3 and 10 <= len(n) <= 15)

    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text) if fine(k, m[0]))


def test_base_spans():
    rng = np.random.default_rng(0)
    letters = list("ab.@-+ 1234()%é")
    for _ in range(3000):
        t = "".join(rng.choice(letters, rng.integers(0, 40)))
        assert pii.base_spans(t) == plain_spans(t)
    assert pii.base_spans("1" * 200_000) == [] and pii.base_spans("a" * 200_000 + "@") == []


def test_skip_chain_is_exact_on_a_chain():
    rng = np.random.default_rng(0)
    crf = pii.Crf({}, np.zeros((1, pii.N_LABELS)), rng.normal(size=(pii.N_LABELS, pii.N_LABELS)), 2.0)
    theta = rng.normal(size=(4, pii.N_LABELS))
    got = crf.marginals(theta, np.array([[0, 1], [1, 2], [2, 3]]), np.zeros((0, 2), int))
    grid = np.exp(sum(theta[i].reshape([-1 if j == i else 1 for j in range(4)]) for i in range(4)) + sum(crf.transitions.reshape([pii.N_LABELS if j in (i, i + 1) else 1 for j in range(4)]) for i in range(3)))
    for i in range(4):
        want = grid.sum(axis=tuple(j for j in range(4) if j != i))
        assert np.allclose(got[i], want / want.sum(), atol=1e-6)


def test_skip_edges_carry_labels():
    crf = pii.Crf({}, np.zeros((1, pii.N_LABELS)), np.zeros((pii.N_LABELS,) * 2), 4.0)
    theta = np.zeros((2, pii.N_LABELS))
    theta[0, 1], theta[1, 0] = 8.0, 1.0
    alone, linked = (crf.marginals(theta, np.zeros((0, 2), int), np.array(e).reshape(-1, 2)) for e in ([], [[0, 1]]))
    assert alone[1].argmax() == 0 and linked[1, 1:3].sum() > 0.8


def test_pii_query(spark, small):
    texts = dict(rows_of(small, "documents", "doc_id, text"))
    for r in q.op3_skip_chain_pii(spark, small).collect():
        base = plain_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(pii.written(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x == i for _, x, _ in base) for i in range(4)]
        every = [s for s in r["spans"].split(",") if s]
        assert set(pii.written([b]) for b in base) <= set(every) and len(every) == len(base) + r["n_added"]


def test_mentions_without_their_mark(docs_of):
    """What a base span says reaches the same number or address written otherwise; unrelated numbers stay outside."""
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for d in range(400):
        a, b, c = (int(x) for x in rng.integers(10**6, 10**7, 3))
        phone, other = f"+49 {170 + d % 9} {a}", f"{rng.integers(10**11, 10**12)}"
        text = f"Call {phone} on day {d % 30} of 2024 for {b % 900} pieces of lot {other}."
        if d % 4 == 1:
            at = text + " Later she rang "
            text, want[d] = f"{at}0{170 + d % 9}{a} once more.", ("phone", len(at), len(at) + 11)
        if d % 4 == 2:
            at = f"Write to user{c}@mail{d}.example.com about {b} or to "
            text, want[d] = f"{at}user{c}(at)mail{d}.example.com soon.", ("email", len(at), len(at) + len(f"user{c}(at)mail{d}.example.com"))
        rows.append((d, text))
    docs = docs_of(rows)
    got = {r["doc_id"]: r for r in pii.find(docs, pii.fit(docs)).collect()}
    for d, r in got.items():
        base = set(filter(None, pii.written(pii.base_spans(rows[d][1])).split(",")))
        added = set(filter(None, r["spans"].split(","))) - base
        assert added == ({"{}:{}:{}".format(*want[d])} if d in want else set()) and r["n_added"] == len(added), (rows[d], added)
    rerun = {r["doc_id"]: r["spans"] for r in pii.find(docs.repartition(7), pii.fit(docs.repartition(5))).collect()}
    assert rerun == {d: r["spans"] for d, r in got.items()}


def test_pii_odd_rows(docs_of, odd_rows):
    d = docs_of(odd_rows)
    got = pii.find(d, pii.fit(d)).collect()
    assert len(got) == len(odd_rows) and all(r["spans"] == "" for r in got)
    assert pii.find(d.limit(0), pii.fit(d.limit(0))).isEmpty()


# ---------------------------------------------------------------- mixing


def test_targets_fill_like_water(spark):
    rng = np.random.default_rng(0)
    for trial in range(4):
        sizes = [(f"s{i:02d}", int(x)) for i, x in enumerate(rng.pareto(1.0, 9) * 100 + 1)] + [(None, 50 + trial)]
        got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
        weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, (s, _) in enumerate(sizes)}
        cap, left, todo, want = {s: 2.0 * n for s, n in sizes}, 1.5 * sum(n for _, n in sizes), set(weight), {}
        while todo:
            total = sum(weight[s] for s in todo)
            over = {s for s in todo if left * weight[s] / total > cap[s]}
            if not over:
                want |= {s: left * weight[s] / total for s in todo}
                break
            want |= {s: cap[s] for s in over}
            left -= sum(cap[s] for s in over)
            todo -= over
        assert got == pytest.approx(want)


def test_mix_odd_rows(docs_of, odd_rows):
    d = docs_of([(*r, "en", s) for r, s in zip(odd_rows, ("a", "a", None, "b", "b", "b", None, "a", "c"), strict=True)]).withColumn("copies", F.lit(1)).withColumn("n_rows", F.lit(2))
    c = mixing.copies(d).collect()
    assert len(c) == len(odd_rows) and all(0 <= r["copies"] <= 2 for r in c)
    m = mixing.mixed(d)
    assert m.columns == d.columns and m.count() == sum(r["copies"] for r in c)
    assert mixing.copies(d).exceptAll(mixing.copies(d)).isEmpty() and mixing.mixed(d.limit(0)).isEmpty()


def test_mix_is_near_targets_and_cells_do_not_matter(spark, small):
    docs = q.table(spark, small, "documents")
    a, b = (mixing.copies(docs, cell=n) for n in (20_000, 3))
    assert a.exceptAll(b).isEmpty()
    for r in a.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"), F.max("size").alias("most")).collect():
        assert abs(r["taken"] - r["target"]) <= 2 * r["most"]


# ---------------------------------------------------------------- language model


def test_elias_fano():
    rng = np.random.default_rng(0)
    for top, n in ((50, 40), (10**6, 300), (2**63, 500), (0, 5), (5, 0)):
        v = np.sort(rng.integers(0, top + 1, n, dtype=np.uint64))
        e = eftrie.EliasFano(eftrie.ef_encode(v))
        assert (e.get(np.arange(n)) == v).all() if n else e.n == 0
        ask = np.concatenate([v, v + np.uint64(1), rng.integers(0, top + 1, 100, dtype=np.uint64), np.array([2**64 - 1], np.uint64)])
        assert (e.successor(ask) == np.searchsorted(v, ask)).all()


def test_pairs_level():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 40 * 60, 700))
    v, w = keys // 60, keys % 60
    p = rng.uniform(1e-6, 1, len(keys))
    level = eftrie.Pairs(eftrie.Pairs.encode(v, w, p))
    ask_v, ask_w = np.divmod(np.arange(45 * 60), 60)
    got = level.lookup(ask_v, ask_w)
    at = np.searchsorted(keys, np.arange(45 * 60))
    want = np.where(np.isin(np.arange(45 * 60), keys), p[np.minimum(at, len(p) - 1)], 0)
    assert ((got > 0) == (want > 0)).all() and np.allclose(np.log10(got[got > 0]), np.log10(want[want > 0]), atol=10 / 65535 + 1e-9)


def test_scores(spark, small):
    texts = rows_of(small, "documents", "doc_id, text")
    tokens = {d: [*t.encode().lower().split(), b"\n"] for d, t in texts}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in texts}
    one, two, fan = Counter(), Counter(), Counter()
    for d, w in tokens.items():
        if not held[d]:
            one.update(w)
            two.update(zip([w[-1], *w[:-1]], w, strict=True))
    fan.update(v for v, _ in two)
    n, size = sum(one.values()), len(one)
    gain = 0.0
    for r in q.op6_elias_fano_scores(spark, small).collect():
        w = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(w), sum(one[x] > 0 for x in w), n)
        p = {x: (one[x] + 0.1) / (n + 0.1 * (size + 1)) for x in w}
        assert r["base_score"] == pytest.approx(sum(math.log10(p[x]) for x in w))
        score = 0.0
        for v, x in zip([w[-1], *w[:-1]], w, strict=True):
            share = max(0.0, two[v, x] - 0.75) / one[v] if one[v] else 0.0
            score += math.log10(share + (0.75 * fan[v] / one[v] if one[v] else 1.0) * p[x])
        assert r["score"] == pytest.approx(score, abs=2e-4 * len(w))
        gain += r["score"] - r["base_score"] if r["held_out"] else 0.0
    assert gain > 0


def test_scores_odd_rows(docs_of, odd_rows):
    d = docs_of(odd_rows).withColumn("held_out", F.lit(False))
    model = eftrie.train(d, shard_tokens=2_000)
    assert model.shards > 1
    got = eftrie.scores(d, model).collect()
    assert len(got) == len(odd_rows) and {r["n_tokens"] for r in got if r["doc_id"] in (1, 2)} == {1}
    none = eftrie.train(d.limit(0))
    assert all(r["n_known"] == 0 and math.isfinite(r["score"]) for r in eftrie.scores(d, none).collect())


# ---------------------------------------------------------------- chat


def test_chat_reads_back(spark, small):
    turns = defaultdict(list)
    for c, t, role, text in rows_of(small, "conversations"):
        turns[c].append((t, role or "", text or ""))
    turns[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r["conv_id"]: r for r in q.op7_budgeted_chat(spark, small).collect()}
    assert got.keys() == turns.keys()
    for c, t in turns.items():
        t.sort()
        loss = "".join(x for _, r, x in t if r == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in t).encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(t), len(loss), hashlib.sha256(loss.encode()).hexdigest())


@pytest.mark.parametrize(("budget", "history"), [(30, 2), (60, 1), (10, 0), (5000, 3)])
def test_chat_windows(spark, budget, history):
    tricky = ["<|end|>", "\\", "\\-", "<\\-|", "</s>", "a\\\\<|turn|>b\n", None, "", "x " * 12, "<<SYS>>[INST]", "<|turn|>user\nhi<|end|>"]
    rows = [(c, i, "system" if i == 0 and c % 2 else ("user", "assistant", None)[i % 3], tricky[(c + i) % len(tricky)]) for c in range(6) for i in range(c + 1)]
    rows += [(None, 0, "user", "q"), (None, 1, "assistant", "r"), (7, 0, "assistant", "same"), (7, 0, "assistant", "same"), (8, 0, "system", "alone")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    w = chat.windows(t, budget=budget, history=history).cache()
    read = defaultdict(list)
    for r in w.orderBy("conv_id", "window").select("conv_id", "formatted", chat.parsed(F.col("formatted")).alias("p"), chat.targets(F.col("formatted"), F.col("loss_spans")).alias("loss"), "tokens", "over_budget").collect():
        read[r["conv_id"]] += [(x["role"], x["text"]) for x in r["p"]]
        assert r["over_budget"] or r["tokens"] <= budget
        for control in chat.CONTROL:
            marks = r["formatted"].replace(chat.TURN, "").replace(chat.SEEN, "").replace(chat.END, "")
            assert control not in marks
    want = defaultdict(list)
    for c, i, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    assert read == want
    loss = {r["conv_id"]: r["loss_chars"] for r in chat.digest(w).collect()}
    assert loss == {c: sum(len(x) for r, x in v if r == "assistant") for c, v in want.items()}
    assert chat.windows(t.limit(0)).isEmpty()


def greedy_windows(turns, budget, history, share, per_turn):
    """(first, begin, end) of the windows of one conversation's (role, text)."""
    size = [len((x or "").split()) + per_turn for _, x in turns]
    lead = int(turns[0][0] == "system")
    room = budget - (size[0] if lead else 0)
    out, begin, first = [], lead, lead
    for j in range(lead, len(turns)):
        if j == begin or sum(size[first : j + 1]) <= room:
            continue
        out.append((first, begin, j))
        begin = first = j
        for h in range(history, 0, -1):
            if j - h >= lead and sum(size[j - h : j]) <= int(budget * share):
                if sum(size[j - h : j + 1]) <= room:
                    first = j - h
                break
    return [*out, (first, begin, len(turns))]


@pytest.mark.parametrize("block", [1, 3, 256])
def test_chat_windows_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    draw = random.Random(7)
    talks = {c: [("system" if i == 0 and c % 2 else draw.choice(["user", "assistant"]), "w " * draw.choice([0, 1, 3, 8, 40])) for i in range(draw.choice([1, 2, 7, 600 if block == 256 else 30]))] for c in range(12)}
    t = spark.createDataFrame([(c, i, *x) for c, turns in talks.items() for i, x in enumerate(turns)], "conv_id long, turn long, role string, text string")
    for budget, history, share, per_turn in [(40, 2, 0.25, 4), (25, 3, 0.9, 1), (12, 1, 1.0, 0)]:
        got = defaultdict(list)
        for r in chat.spans(chat._numbered(t, per_turn), budget, history, share).orderBy("conv_id", "window").collect():
            got[r["conv_id"]].append((r["first"], r["begin"], r["end"]))
        assert got == {c: greedy_windows(turns, budget, history, share, per_turn) for c, turns in talks.items()}


# ---------------------------------------------------------------- language ID


def test_language_accuracy(spark, small):
    truth = dict(rows_of(small, "documents", "doc_id, lang"))
    got = [r for r in q.op8_naive_bayes_language(spark, small).collect()]
    assert len(got) == len(truth)
    held = [r for r in got if r["held_out"]]
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.9 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["held_out"] for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2} == {True}


def test_language_odd_rows(docs_of, odd_rows):
    d = docs_of([*odd_rows, (6, "12 34 !"), (7, "text", None)])
    got = {r["text"]: (r["lang_pred"], r["score"]) for r in langid.predict(d, langid.fit(d), into=("lang_pred", "score")).collect()}
    assert got[None] == got[""] == got["12 34 !"] == ("und", 0.0) and got["text"][0] == "en"
    none = langid.fit(d.limit(0))
    assert {r["lang_pred"] for r in langid.predict(d, none).collect()} == {"und"}


def brute_grams(text):
    """Character n-grams of 1 to 4 code points by string operations, as bucket counts."""
    import unicodedata

    plain = "".join(c if c.isalpha() or unicodedata.category(c)[0] == "M" else " " for c in f" {text.lower()} ")
    plain = re.sub(" +", " ", plain)
    out = Counter()
    for n in langid.ORDERS:
        for i in range(len(plain) - n + 1):
            h = sum((ord(c) + 1) * int(m) for c, m in zip(plain[i : i + n], langid._MULTIPLIERS, strict=False)) % (1 << 32)
            out[(((h ^ (h >> 15)) * (0x2C1B3C6D + 2 * n)) % (1 << 32)) >> (32 - langid.BITS)] += 1
    return out


def test_language_against_brute_force(docs_of):
    texts = ["The cat sat on 12 mats.", "Straße und Ärger, İstanbul", "हिन्दी में", "le chat s'est assis", "²½① x", "  ", "a"]
    for t in texts:
        assert {k: int(n) for k, n in enumerate(langid.buckets(t)) if n} == dict(brute_grams(t))
    learnt = [("the cat and the dog sat on the mat", "en"), ("le chat et le chien sont assis sur le tapis", "fr"), ("der hund und die katze", "de"), ("the house", "en"), (None, "en"), ("12", "xx")]
    docs = docs_of([(i, t, x) for i, (t, x) in enumerate(learnt)])
    totals, n = defaultdict(Counter), Counter()
    for t, x in learnt:
        if t and any(c.isalpha() for c in t):
            totals[x] += brute_grams(t)
            n[x] += 1
    model = langid.fit(docs)
    assert model.languages == ["de", "en", "fr"]
    asked = docs_of([*texts, "²½① 12", None, "the dog", "un chien", "eine katze " * 5_000])
    got = {r["text"]: (r["lang_pred"], r["score"]) for r in langid.predict(asked, model).collect()}
    for t, (lang, score) in got.items():
        if not t or not any(c.isalpha() for c in t):
            assert (lang, score) == ("und", 0.0)
            continue
        c = brute_grams(t)
        size = 1 << langid.BITS
        x = {l: sum(k * np.log((totals[l][b] + langid.SMOOTHING) / (totals[l].total() + langid.SMOOTHING * size)) for b, k in c.items()) * min(1, langid.EVIDENCE / c.total()) + np.log(n[l] / n.total()) for l in totals}
        assert lang == max(sorted(x), key=x.get)
        assert score == pytest.approx(1 / sum(np.exp(v - x[lang]) for v in x.values()), rel=1e-4)


def test_language_columns_may_clash(docs_of):
    docs = docs_of(["the cat", None]).withColumn("lang_pred", F.lit("old")).withColumn("Score", F.lit(9)).withColumn("found", F.lit(1))
    got = langid.predict(docs, langid.fit(docs))
    assert sorted(got.columns) == ["doc_id", "found", "lang", "lang_pred", "n_chars", "score", "source", "text"]
    assert {r["lang_pred"] for r in got.collect()} == {"en", "und"} and got.count() == 2
    assert langid.predict(docs.limit(0), langid.fit(docs)).isEmpty()


def test_buckets_do_not_depend_on_pieces(monkeypatch):
    text = "Straße und Ärger, " * 50
    whole = langid.buckets(text)
    monkeypatch.setattr(langid, "_CHUNK", 37)
    assert (langid.buckets(text) == whole).all()


# ---------------------------------------------------------------- decontamination


def test_leaks(spark, docs_of):
    item = "A train leaves Paris at 9 and travels 120 km before it meets the train of Anna near the old stone bridge"
    again = "A train leaves Lyon at 7 and travels 300 km before it meets the train of Berta near the old stone bridge"
    mixed = "a train leaves lyon at 7 and that is all that we know about it in this text of ours today"
    bench = spark.createDataFrame([(1, item), (2, None), (None, item), (3, "too short"), (4, "one two three four")], "item_id long, text string")
    docs = docs_of([(0, f"Before it. {item} And after."), (1, f"Again: {again}."), (2, mixed), (3, None), (4, ""), (None, item), (5, item.lower()), (5, "say one two, three four!")])
    for size in (decontam.BROADCAST_BYTES, 0):
        got = {(r["doc_id"], r["item_id"]): r for r in decontam.leaks(docs, bench, broadcast_bytes=size).collect()}
        assert set(got) == {(0, 1), (1, 1), (None, 1), (5, 1), (5, 4)}
        assert got[0, 1]["literal"] == 1.0 and got[1, 1]["literal"] < 0.8 <= got[1, 1]["template"] and got[1, 1]["consistency"] == 1.0
    assert decontam.leaks(docs, bench.limit(0)).isEmpty() and decontam.leaks(docs.limit(0), bench).isEmpty()


def test_inconsistent_slots_are_no_leak(spark, docs_of):
    bench = spark.createDataFrame([(1, "we add 5 to the pile and 5 to the box and 5 to the jar and 5 to the bin")], "item_id long, text string")
    docs = docs_of(["we add 7 to the pile and 7 to the box and 7 to the jar and 7 to the bin", "we add 1 to the pile and 2 to the box and 3 to the jar and 4 to the bin"])
    assert [r["doc_id"] for r in decontam.leaks(docs, bench).collect()] == [0]


def test_slots_map_one_to_one(spark, docs_of):
    """Values may change, but two may not become one, nor one two."""
    item = "first take 5 then take 6 then take 7 then take 8 and say which is the most of all"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = docs_of([re.sub("[5-8]", lambda m: {"5": "11", "6": "12", "7": "13", "8": "14"}[m[0]], item), re.sub("[5-8]", "9", item)])
    assert [(r["doc_id"], r["consistency"]) for r in decontam.leaks(docs, bench).collect()] == [(0, 1.0)]


def test_edited_quotation_and_items_of_one_id(spark, docs_of):
    item = "the old miller counted every single sack of grain before the long winter came over the quiet valley again"
    bench = spark.createDataFrame([(1, item), (1, "an altogether different text of the same item that nobody has quoted yet"), (1, item)], "item_id long, text string").withColumn("doc_id", F.lit(3))
    docs = docs_of([item.replace("sack", "bag"), item.replace("sack", "bag").replace("winter", "summer").replace("old", "new"), " ".join(reversed(item.split())), ("word " * 40_000) + item])
    for size in (decontam.BROADCAST_BYTES, 0):
        got = decontam.leaks(docs.withColumn("item_id", F.lit(7)).withColumn("row", F.lit(1)), bench, broadcast_bytes=size)
        assert sorted(r["doc_id"] for r in got.collect()) == [0, 3]


def test_words_are_not_taken_apart_one_by_one(monkeypatch):
    """Of a text's words only those with other than ASCII characters and those in slots of a found item are."""
    item = "the old miller counted 7 sacks of grain before the long winter came over the quiet valley again"
    index = decontam.Index([(1, item)], decontam.WINDOW, decontam.MIN_PLAIN, decontam.LEAST_WINDOWS)
    taken, of = [], decontam.Words.of
    monkeypatch.setattr(decontam.Words, "of", lambda self, raw: taken.append(raw) or of(self, raw))
    text = " ".join(f"Word{i} some été" for i in range(500))
    assert index.matches(text, 0.8) == [] and set(taken) == {"été"} and len(taken) == 1
    assert [x[0] for x in index.matches(f"{text} {item.replace('7', '8')}.", 0.8)] == [1] and set(taken) == {"été", "8"}


def test_texts_parsed_together():
    """As parsed one by one: other scripts, white space that parts no words, sentences, lines, units, nulls."""
    odd = "one Two THREE four. 5 6, 7m km km. Jahr años Ärger «mot» İstanbul ΣΟΦΟΣ ... ! ?\" — “Hi.” (x) 'tis x² ٣ a\x1fb a\x85B \xa0C a\u2028d Ǆ ß 2! Minute <num> Ünder end?) end.» end.\"' Ｘ １ \0 -- ) .)".split(" ")
    rng = random.Random(7)
    texts = [None, "", " \n\n ", "..."] + ["".join(rng.choice(odd) + rng.choice([*"        ", "\n", " \n\t", "\r\n", "\x0b", "\x0c "]) for _ in range(rng.randrange(40))) for _ in range(400)]
    index = decontam.Index([(i, t) for i, t in enumerate(texts[-90:])], decontam.WINDOW, decontam.MIN_PLAIN, decontam.LEAST_WINDOWS)
    parsed = index.parse_all(pa.array([None, *texts], pa.string()).slice(1))
    for d, text in enumerate(texts):
        plain, own, template, slot = decontam.parse(text)
        a, b = parsed.begin[d : d + 2]
        assert [parsed.plain(d, k) for k in range(b - a)] == plain
        assert [index.place.get(p, -1) for p in plain] == parsed.own[a:b].tolist()
        known = parsed.template[a:b] >= 0
        assert known.tolist() == [s or p in index.place for s, p in zip(slot, plain, strict=True)]
        assert (index.word_hash[parsed.template[a:b][known]] == template[known]).all() and (index.word_hash[parsed.own[a:b]][parsed.own[a:b] >= 0] == own[parsed.own[a:b] >= 0]).all()
    together = dict(index.matches_all(pa.array(texts), 0.3))
    assert together == {d: x for d, t in enumerate(texts) if (x := index.matches(t, 0.3))} and len(together) >= 80
    halves = ["the old miller counted", "every single sack of"]  # a window lies in one text
    index = decontam.Index([(1, " ".join(halves))], decontam.WINDOW, decontam.MIN_PLAIN, 0.1)
    assert not list(index.matches_all(pa.array(halves), 0.01)) and index.matches(" ".join(halves), 0.01)


def brute_leaks(docs, items):
    """All pairs, windows as tuples of words."""

    def cut(words, n):
        return [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]

    def forms(text):
        plain, _, _, slot = decontam.parse(text)
        kinds = [("<num>" if re.search(r"\d", w) else "<unit>" if w in decontam.UNITS and i and re.search(r"\d", plain[i - 1]) else "<name>") if s else w for i, (w, s) in enumerate(zip(plain, slot, strict=True))]
        return plain, kinds, slot

    out = {}
    known = [(i, *forms(t)) for i, t in items if i is not None and t]
    for d, t in docs:
        w, k, _ = forms(t)
        places = [defaultdict(list), defaultdict(list)]
        for n in range(3, decontam.WINDOW + 1):
            for x, of in ((w, places[0]), (k, places[1])):
                for p, c in enumerate(cut(x, n)):
                    of[c].append(p)
        for i, iw, ik, slot in known:
            n = min(decontam.WINDOW, len(iw))
            if n < 3:
                continue
            shares, pairs = [], set()
            for kind, x in ((0, iw), (1, ik)):
                fine = [a for a in range(len(iw) - n + 1) if not kind or n - sum(slot[a : a + n]) >= min(decontam.MIN_PLAIN, n)]
                found = [a for a in fine if tuple(x[a : a + n]) in places[kind]]
                cover, every = ({a + j for a in z for j in range(n)} for z in (found, fine))
                shares.append(len(cover) / len(every) if every and 2 * len(found) >= len(fine) else 0.0)
                if kind:
                    every = [(a, p) for a in found for p in places[1][tuple(x[a : a + n])]]
                    line = Counter(p - a for a, p in every)
                    one = {a: min((-line[p - a], p) for b, p in every if b == a)[1] for a in found}
                    pairs = {(a + j, p + j) for a, p in one.items() for j in range(n) if slot[a + j]}
            values = [(iw[a], w[b]) for a, b in pairs]
            count = Counter(values)
            image = {a: min((-m, y) for (x, y), m in count.items() if x == a)[1] for a, _ in values}
            origin = {b: min((-m, x) for (x, y), m in count.items() if y == b)[1] for _, b in values}
            agree = sum(image[a] == b and origin[b] == a for a, b in values) / len(values) if values else 1.0
            if shares[0] >= decontam.THRESHOLD or min(shares[1], agree) >= decontam.THRESHOLD:
                out[d, i] = (*shares, agree)
    return out


def test_leak_query_against_brute_force(spark, small, docs_of):
    docs, items = rows_of(small, "documents", "doc_id, text"), rows_of(small, "benchmark")
    want = brute_leaks(docs, items)
    got = {(r["doc_id"], r["item_id"]): (r["literal"], r["template"], r["consistency"]) for r in q.op9_template_decontamination(spark, small).collect()}
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x]) for x in got)
    # the same items with other numbers and names, inside other texts
    changed = [(1000 + k, "So it is said. " + re.sub(r"\d+", lambda m: str(int(m[0][:12]) * 3 + 1), t) + " That is all.") for k, (_, t) in enumerate(items[:40]) if t]
    want = brute_leaks(changed, items)
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs_of(changed), spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
    assert got == set(want) and len(got) >= len(changed)


# ---------------------------------------------------------------- nearest neighbours


def recall(rows, found, every=50):
    """Recall of the five nearest against brute force; ranks and scores are checked."""
    ids, u = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    got = defaultdict(list)
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hit = total = 0
    for k in np.nonzero(ids % every == 0)[0]:
        s = u @ u[k]
        s[k] = -9
        near = ids[np.lexsort((ids, -s))[:5]]
        assert [r for r, _, _ in got[ids[k]]] == [1, 2, 3, 4, 5]
        assert all(sc == pytest.approx(s[ids == v][0], abs=1e-12) for _, v, sc in got[ids[k]])
        hit, total = hit + len({v for _, v, _ in got[ids[k]]} & set(near)), total + 5
    return hit / total


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_recall_and_scores(spark, size):
    at = f"/root/testdata/{size}"
    assert recall(rows_of(at, "embeddings", "vec_id, embedding"), q.op10_posting_list_search(spark, at).collect()) >= 0.9


def test_bins_divide_lists_and_queries(spark):
    """Many equal vectors, small bins, few queries a task: results stay those of brute force, ties by id."""
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(600, 8)))] + [(i, [1.0] * 8) for i in range(600, 900)]
    v = ann.vectors_of(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    index = ann.fit(v, k=5, list_size=40, recall=1.0)
    whole = ann.search(v, v.where("id % 50 = 0"), 5, index).collect()
    cut = ann.search(v, v.where("id % 50 = 0"), 5, index, bin_bytes=8 * 8 * 30, query_rows=3).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, cut)) and len(cut) == 90
    assert [r["vec_id"] for r in sorted(cut, key=lambda r: r["rank"]) if r["query_id"] == 850] == [600, 601, 602, 603, 604]
    assert recall([r for r in rows if r[0] < 600 or r[0] == 600], [r for r in ann.search(v.where("id <= 600"), v.where("id <= 600 AND id % 50 = 0"), 5, index).collect()]) >= 0.95


def test_pruning_widens_to_k(spark):
    """Each cluster holds two vectors: a query's own list is not enough for five."""
    rows = [(2 * i + j, [float(i == c) + 0.001 * j * (c == 0) for c in range(12)]) for i in range(12) for j in range(2)]
    v = ann.vectors_of(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    index = ann.Index(ann.Graph(np.eye(12)), 0.0, 1, 0.0, 12)
    assert {r["query_id"]: r["count"] for r in ann.search(v, v, 5, index).groupBy("query_id").count().collect()} == dict.fromkeys(range(24), 5)


def test_search_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (100, [0.0, 1.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (6, []), (7, [float("inf"), 0.0]), (50, [1.0, 0.0]), (9, [1.0, 0.0])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = ann.vectors_of(t, "vec_id", "embedding")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in ann.search(v, v.where("id % 50 = 0"), 5, ann.fit(v, k=5)).collect()}
    assert got == {(0, 1): 9, (0, 2): 50, (0, 3): 100, (50, 1): 0, (50, 2): 9, (50, 3): 100, (100, 1): 0, (100, 2): 9, (100, 3): 50}
    none = v.limit(0)
    assert ann.search(none, none, 5, ann.fit(none, k=5)).isEmpty()
