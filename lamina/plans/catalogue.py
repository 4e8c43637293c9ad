"""Registered queries over the driver's tables, and the same in SQL.

Figures are rounded to 6 digits on both sides. A query without SQL is one that SQL can't express (resampling,
permutation tests, fitted models); tests hold it against brute force.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.config import SamplerConfig
from lamina.functions import bits, keys
from lamina.operators import anomaly, arms, dedup, frames, leakage, lookups, metrics, quality, sampling, splitting, statistics
from lamina.scratch import new_folder
from lamina.sources import records, sinks

from . import experiment, views
from .curation import curate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# ---------------------------------------------------------------- groups and splits

_SAMPLER = SamplerConfig(min_difference=30.0 / 255, min_interval=2, max_interval=9)
_SEEDED = "sha256('{seed}:' || {key})"


def _naive(view: str, seed: int = 0) -> str:
    """CTE m: the naive split of a view."""
    return f"""o AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_SEEDED.format(seed=seed, key="path")}, path) AS rn, count(*) OVER (PARTITION BY label)::DOUBLE AS n FROM {view}
), m AS (
  SELECT * EXCLUDE (rn, n), CASE WHEN label = 'normal' THEN CASE WHEN rn <= round_even(n * 0.6::DOUBLE, 0) THEN 'train' WHEN rn <= round_even(n * 0.6::DOUBLE, 0) + round_even(n * 0.2::DOUBLE, 0) THEN 'val' ELSE 'test' END
    ELSE CASE WHEN rn <= round_even(n * 0.3::DOUBLE, 0) THEN 'val' ELSE 'test' END END AS split FROM o
)"""


def _by_group(view: str, seed: int = 0) -> str:
    """CTEs up to m: the deficit-greedy split of a view: a fold over the groups in seeded order whose state is the
    frames assigned to each split, and a letter for each group."""
    deficit = {s: f"goal.{s} * total - acc.{s}" for s in "abc"}
    to = {s: f"""{{'n': 0.0::DOUBLE, {", ".join(f"'{x}': acc.{x}" + (" + x.n" if x == s else "") for x in "abc")}, 's': acc.s || '{s}'}}""" for s in "abc"}
    return f"""g AS (
  SELECT group_id, label, n, row_number() OVER (PARTITION BY label ORDER BY {_SEEDED.format(seed=seed, key="group_id")}, group_id) AS k, sum(n) OVER (PARTITION BY label)::DOUBLE AS total
  FROM (SELECT group_id, min(label) AS label, count(*)::DOUBLE AS n FROM {view} GROUP BY group_id)
), t AS (SELECT * FROM (VALUES ('normal', {{'a': 0.6::DOUBLE, 'b': 0.2::DOUBLE, 'c': 0.2::DOUBLE}}), ('defect', {{'a': -1e9::DOUBLE, 'b': 0.3::DOUBLE, 'c': 1.0::DOUBLE - 0.3::DOUBLE}})) x(label, goal)
), xs AS (SELECT label, goal, total, list({{'n': n, 'a': 0.0::DOUBLE, 'b': 0.0::DOUBLE, 'c': 0.0::DOUBLE, 's': ''}} ORDER BY k) AS xs FROM g JOIN t USING (label) GROUP BY ALL
), f AS (
  SELECT label, list_reduce(list_prepend({{'n': 0.0::DOUBLE, 'a': 0.0::DOUBLE, 'b': 0.0::DOUBLE, 'c': 0.0::DOUBLE, 's': ''}}, xs),
    lambda acc, x: CASE WHEN {deficit["a"]} >= {deficit["b"]} AND {deficit["a"]} >= {deficit["c"]} THEN {to["a"]} WHEN {deficit["b"]} >= {deficit["c"]} THEN {to["b"]} ELSE {to["c"]} END).s AS s FROM xs
), m AS (SELECT {view}.*, CASE substr(f.s, g.k::BIGINT, 1) WHEN 'a' THEN 'train' WHEN 'b' THEN 'val' ELSE 'test' END AS split FROM {view} JOIN g ON g.group_id = {view}.group_id JOIN f ON f.label = g.label)"""


_AUDIT = """per AS (
  SELECT group_id, bool_or(split = 'train') AS a, bool_or(split = 'val') AS b, bool_or(split = 'test') AS c, count(*) FILTER (WHERE split = 'test') AS nt, count(*) FILTER (WHERE split = 'test' AND label = 'normal') AS nn, count(*) AS n
  FROM m GROUP BY group_id
), audit AS (
  SELECT count(*) FILTER (WHERE a AND c) AS shared_train_test, count(*) FILTER (WHERE a AND b) AS shared_train_val, count(*) FILTER (WHERE b AND c) AS shared_val_test,
    coalesce(sum(nt) FILTER (WHERE a AND c), 0)::BIGINT AS contaminated, coalesce(sum(nn), 0)::BIGINT AS normal_test, coalesce(sum(n), 0)::BIGINT AS total FROM per
), audited AS (SELECT *, CASE WHEN normal_test = 0 THEN 0.0::DOUBLE ELSE round(contaminated::DOUBLE / normal_test, 6) END AS fraction, shared_train_test = 0 AND shared_train_val = 0 AS is_clean FROM audit)"""


@query(f"WITH {views.EVENTS} SELECT group_id, count(*) AS n_frames, min(label) AS label FROM e GROUP BY group_id")
def frame_group_counts(spark, sf_dir):
    return frames.consistent_groups(frames.checked(views.events(spark, sf_dir)))


@query(f"WITH {views.EVENTS} SELECT group_id, count(DISTINCT event_type) AS n_labels FROM e GROUP BY group_id HAVING count(DISTINCT event_type) > 1")
def label_consistency(spark, sf_dir):
    """Groups with more than one label, of a label that is none of the group's."""
    return frames.label_conflicts(views.events(spark, sf_dir).withColumn("label", F.col("event_type")))


@query(f"WITH {views.EVENTS}, x AS (SELECT group_id || '/' || (frame_index // 2) AS path FROM e) SELECT path, count(*) AS n FROM x GROUP BY path HAVING count(*) > 1")
def duplicate_paths(spark, sf_dir):
    e = views.events(spark, sf_dir)
    return frames.duplicate_paths(e.withColumn("path", F.concat_ws("/", "group_id", F.floor(F.col("frame_index") / 2).cast("string"))))


@query(f"WITH {views.lines_sql()}, {_naive('l')} SELECT split, label, count(*) AS n, count(DISTINCT group_id) AS n_groups, sum(frame_index)::BIGINT AS s FROM m GROUP BY split, label")
def split_naive(spark, sf_dir):
    m = splitting.split_naive(views.lines(spark, sf_dir))
    return m.groupBy("split", "label").agg(F.count("*").alias("n"), F.count_distinct("group_id").alias("n_groups"), F.sum("frame_index").alias("s"))


@query(f"WITH RECURSIVE {views.lines_sql('l_suppkey')}, {_by_group('l')} SELECT DISTINCT group_id, label, split FROM m")
def split_by_group(spark, sf_dir):
    return splitting.split_by_group(views.lines(spark, sf_dir, "l_suppkey")).select("group_id", "label", "split").distinct()


@query(f"WITH RECURSIVE {views.lines_sql()}, {_by_group('l')} SELECT s.split, count(m.path) AS n_frames, count(DISTINCT m.group_id) AS n_groups FROM (VALUES ('train'), ('val'), ('test')) s(split) LEFT JOIN m ON m.split = s.split GROUP BY s.split")
def split_counts(spark, sf_dir):
    return frames.split_counts(splitting.split_by_group(views.lines(spark, sf_dir)))


@query(f"WITH {views.lines_sql()}, {_naive('l')}, {_AUDIT} SELECT * FROM audited")
def leakage_audit_naive(spark, sf_dir):
    return leakage.payload(splitting.split_naive(views.lines(spark, sf_dir)))


@query(f"WITH RECURSIVE {views.lines_sql()}, {_by_group('l')}, {_AUDIT} SELECT * FROM audited")
def leakage_audit_group(spark, sf_dir):
    return leakage.payload(splitting.split_by_group(views.lines(spark, sf_dir)))


@query(
    f"SELECT 'naive_by_frame' AS strategy, * FROM (WITH {views.lines_sql()}, {_naive('l')}, {_AUDIT} SELECT * FROM audited) UNION ALL SELECT 'by_group' AS strategy, * FROM (WITH RECURSIVE {views.lines_sql()}, {_by_group('l')}, {_AUDIT} SELECT * FROM audited)"
)
def leakage_by_strategy(spark, sf_dir):
    """The flagship: what a split row by row leaks, and a split by group doesn't."""
    lines = views.lines(spark, sf_dir)
    every = [f(lines).withColumn("strategy", F.lit(name)) for name, f in splitting.STRATEGIES.items()]
    return leakage.audit(every[0].unionByName(every[1]), by=("strategy",)).withColumn("fraction", F.round("fraction", 6))


@query(f"WITH {views.lines_sql()}, {_naive('l')} SELECT path, group_id FROM m WHERE split = 'test' AND group_id IN (SELECT group_id FROM m WHERE split = 'train')")
def contaminated_semi(spark, sf_dir):
    return leakage.contaminated_frames(splitting.split_naive(views.lines(spark, sf_dir))).select("path", "group_id")


@query(f"WITH {views.lines_sql()}, {_naive('l')} SELECT group_id FROM m WHERE split = 'train' INTERSECT SELECT group_id FROM m WHERE split = 'test'")
def shared_groups_intersect(spark, sf_dir):
    return leakage.shared_groups(splitting.split_naive(views.lines(spark, sf_dir)))


@query(f"WITH {views.EVENTS}, {_naive('e')} SELECT path AS image_path, split, CASE WHEN label = 'defect' THEN 1 ELSE 0 END AS label_index, '' AS mask_path FROM m WHERE split = 'test'")
def training_samples(spark, sf_dir):
    return frames.samples(splitting.split_naive(views.events(spark, sf_dir)), "test")


# ---------------------------------------------------------------- near-duplicates


def _greedy(view: str, by: str, d: str) -> str:
    """CTE k: kept list of each pool, folded in order."""
    return f"""pool AS (
  SELECT {by}, list({{'h': phash, 'p': path}} ORDER BY source_video, frame_index, path) AS xs FROM {view} GROUP BY ALL
), k AS (
  SELECT * EXCLUDE (xs), len(xs) AS total, list_reduce(list_prepend([]::STRUCT(h UBIGINT, p VARCHAR)[], list_transform(xs, lambda x: [x])),
    lambda a, x: CASE WHEN len(list_filter(a, lambda y: bit_count(xor(y.h, x[1].h)) <= {d})) > 0 THEN a ELSE list_append(a, x[1]) END) AS kept FROM pool
)"""


_KEPT = "SELECT path, list_contains((SELECT flatten(list(list_transform(kept, lambda y: y.p))) FROM k), path) AS kept FROM v"


@query(f"WITH {views.vectors_sql()}, {_greedy('v', 'group_id', '16')} {_KEPT}")
def dedup_within(spark, sf_dir):
    return dedup.deduplicate(views.vectors(spark, sf_dir).drop("vector"), max_distance=16).select("path", "kept")


@query(f"WITH {views.vectors_sql()}, {_greedy('v', '0 AS pool', '16')} {_KEPT}")
def dedup_global(spark, sf_dir):
    return dedup.deduplicate(views.vectors(spark, sf_dir).drop("vector"), max_distance=16, within_group=False).select("path", "kept")


@query(f"WITH {views.vectors_sql()}, {_greedy('v', 'group_id', '16')} {_KEPT}")
def dedup_sorted_stream(spark, sf_dir):
    """The same result by the form for groups of any size."""
    return dedup.deduplicate_sorted(views.vectors(spark, sf_dir).drop("vector"), max_distance=16).select("path", "kept")


@query(f"WITH {views.vectors_sql()}, {_greedy('v', 'group_id', '16')} SELECT sum(total)::BIGINT AS total, sum(len(kept))::BIGINT AS kept, sum(total - len(kept))::BIGINT AS removed, round(sum(len(kept))::DOUBLE / sum(total), 6) AS retained_fraction FROM k")
def dedup_summary(spark, sf_dir):
    return dedup.summary(dedup.deduplicate(views.vectors(spark, sf_dir).drop("vector"), max_distance=16))


@query(
    f"WITH {views.vectors_sql()}, w AS (SELECT v.*, d AS max_distance FROM v, (VALUES (0), (4), (8), (12), (16), (20)) z(d)), {_greedy('w', 'max_distance, group_id', 'max_distance')} "
    "SELECT max_distance, sum(total)::BIGINT AS total, sum(len(kept))::BIGINT AS kept, sum(total - len(kept))::BIGINT AS removed, round(sum(len(kept))::DOUBLE / sum(total), 6) AS retained_fraction FROM k GROUP BY max_distance"
)
def redundancy_profile(spark, sf_dir):
    return dedup.redundancy_profile(views.vectors(spark, sf_dir).drop("vector"), (0, 4, 8, 12, 16, 20))


@query(f"WITH {views.vectors_sql()} SELECT a.path AS path_a, b.path AS path_b, bit_count(xor(a.phash, b.phash))::INT AS distance FROM v a JOIN v b ON a.path < b.path AND bit_count(xor(a.phash, b.phash)) <= 16")
def hamming_pairs(spark, sf_dir):
    return dedup.hamming_pairs(views.vectors(spark, sf_dir), 16)


@query(
    f"WITH RECURSIVE {views.vectors_sql()}, {_by_group('v')}, {_greedy('m', 'split, group_id', '16')} "
    "SELECT split, sum(total)::BIGINT AS total, sum(len(kept))::BIGINT AS kept, sum(total - len(kept))::BIGINT AS removed, round(sum(len(kept))::DOUBLE / sum(total), 6) AS retained_fraction, 16 AS max_distance FROM k GROUP BY split"
)
def curation_pipeline(spark, sf_dir):
    return curate(views.vectors(spark, sf_dir).drop("vector"), max_distance=16).dedup(16, ("train", "val", "test"))


@query(
    f"WITH RECURSIVE {views.vectors_sql()}, {_by_group('v')}, {_greedy('m', 'split, group_id', '16')}, kept AS (SELECT split, group_id, unnest(list_transform(kept, lambda y: y.p)) AS path FROM k), m2 AS (SELECT kept.*, v.label FROM kept JOIN v USING (path)), {_AUDIT.replace('FROM m GROUP', 'FROM m2 GROUP')} SELECT * FROM audited"
)
def curation_audit(spark, sf_dir):
    return curate(views.vectors(spark, sf_dir).drop("vector"), max_distance=16).leakage().withColumn("fraction", F.round("fraction", 6))


# ---------------------------------------------------------------- sampling

_SAMPLED = f"""{views.EVENTS}, f AS (
  SELECT group_id, frame_index, signal AS ref, 0 AS since, true AS kept FROM e WHERE frame_index = 0
  UNION ALL
  SELECT s.group_id, s.frame_index, CASE WHEN s.keep THEN s.signal ELSE s.ref END, CASE WHEN s.keep THEN 0 ELSE s.since END, s.keep FROM (
    SELECT e.group_id, e.frame_index, e.signal, f.ref, f.since + 1 AS since, CASE WHEN f.since + 1 < 2 THEN false WHEN f.since + 1 >= 9 THEN true ELSE abs(e.signal - f.ref) / 255.0::DOUBLE >= 30.0::DOUBLE / 255.0::DOUBLE END AS keep
    FROM f JOIN e ON e.group_id = f.group_id AND e.frame_index = f.frame_index + 1
  ) s
)"""


def _sampled(spark, sf_dir):
    e = views.events(spark, sf_dir).select("group_id", "frame_index", "signal")
    return sampling.sample(e, _SAMPLER, signal="signal", difference=lambda a, b: sampling.scalar_difference(a, b, 255.0))


@query(f"WITH RECURSIVE {_SAMPLED} SELECT group_id, frame_index, kept FROM f")
def sampler(spark, sf_dir):
    return _sampled(spark, sf_dir).select("group_id", "frame_index", "kept")


@query(f"WITH RECURSIVE {_SAMPLED} SELECT count(*) AS seen, count(*) FILTER (WHERE kept) AS kept, round(count(*) FILTER (WHERE kept)::DOUBLE / count(*), 6) AS retained_fraction FROM f")
def sampler_stats(spark, sf_dir):
    return sampling.stats(_sampled(spark, sf_dir))


@query(f"WITH RECURSIVE {_SAMPLED} SELECT group_id, frame_index, kept FROM f")
def sampler_stream(spark, sf_dir):
    """The sampler on a stream, in several micro-batches; the result is the batch sampler's."""
    from lamina.streaming.sampler import run_to_end, sample_stream

    root = new_folder(spark, "stream")
    e = views.events(spark, sf_dir).select("group_id", "frame_index", "signal")
    for k in range(3):  # three arrivals, in order of the index
        e.where(F.least(F.floor(F.col("frame_index") / 30), F.lit(2)) == k).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    out = sample_stream(stream, _SAMPLER, signal="signal", scale=255.0)
    return run_to_end(out, f"{root}/out", f"{root}/checkpoint")


@query(f"WITH {views.EVENTS} SELECT group_id, count(*) AS n FROM e WHERE frame_index < 40 GROUP BY group_id")
def max_frames_cap(spark, sf_dir):
    return frames.capped(views.events(spark, sf_dir), 40).groupBy("group_id").agg(F.count("*").alias("n"))


@query(f"WITH {views.EVENTS} SELECT path FROM e WHERE frame_index % 15 = 0")
def qc_sample_1_in_15(spark, sf_dir):
    return frames.systematic(views.events(spark, sf_dir)).select("path")


@query(f"WITH {views.EVENTS}, s AS (SELECT *, max(frame_index) OVER (PARTITION BY group_id) >= 5 AS longer FROM e WHERE frame_index < 31) SELECT path FROM s WHERE NOT longer OR frame_index >= 5")
def after_warm_up(spark, sf_dir):
    return frames.after_warm_up(views.events(spark, sf_dir)).select("path")


# ---------------------------------------------------------------- metrics

_RANKS = "(rank() OVER (PARTITION BY {by} ORDER BY {v}) + (count(*) OVER (PARTITION BY {by}, {v}) - 1) / 2.0::DOUBLE)::DOUBLE"
_F1 = """x AS (SELECT score, count(*) AS n, count(*) FILTER (WHERE y) AS p FROM d WHERE split = 'val' GROUP BY score
), z AS (SELECT score, sum(n) OVER w AS alarms, sum(p) OVER w AS tp, sum(p) OVER () AS pos FROM x WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)
), q AS (SELECT score, tp::DOUBLE / alarms AS precision, CASE WHEN pos = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / pos END AS recall FROM z
), b AS (SELECT score, CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * precision * recall / (precision + recall) END AS f1 FROM q
), best AS (SELECT score AS threshold, f1 AS f1_on_val, (SELECT count(*) FROM b) AS candidates FROM b ORDER BY round(f1, 12) DESC, score LIMIT 1)"""


@query(f"WITH {views.SCORED} SELECT path, {_RANKS.format(by='split', v='score')} AS mid_rank FROM d")
def mid_ranks(spark, sf_dir):
    return metrics.mid_ranks(views.scored(spark, sf_dir), "score", ("split",)).select("path", "mid_rank")


@query(f"WITH {views.SCORED}, r AS (SELECT *, {_RANKS.format(by='split', v='score')} AS rk FROM d) SELECT split, count(*) AS n, count(*) FILTER (WHERE y) AS n_pos, round((sum(rk) FILTER (WHERE y) - count(*) FILTER (WHERE y)::DOUBLE * (count(*) FILTER (WHERE y) + 1) / 2) / (count(*) FILTER (WHERE y)::DOUBLE * count(*) FILTER (WHERE NOT y)), 6) AS auroc FROM r GROUP BY split")
def auroc(spark, sf_dir):
    return rounded(metrics.auroc(metrics.checked_scores(views.scored(spark, sf_dir)), by=("split",)), "auroc")


@query(f"WITH {views.SCORED}, r AS (SELECT *, {_RANKS.format(by='1', v='score')} AS rk FROM d) SELECT count(*) AS n, count(*) FILTER (WHERE y) AS n_pos, round((sum(rk) FILTER (WHERE y) - count(*) FILTER (WHERE y)::DOUBLE * (count(*) FILTER (WHERE y) + 1) / 2) / (count(*) FILTER (WHERE y)::DOUBLE * count(*) FILTER (WHERE NOT y)), 6) AS auroc FROM r")
def auroc_bucketed(spark, sf_dir):
    """One AUROC of all rows, its ranks in buckets."""
    return rounded(metrics.auroc(views.scored(spark, sf_dir), buckets=16), "auroc")


@query(
    f"WITH {views.SCORED}, c AS (SELECT split, count(*) FILTER (WHERE score >= 1500 AND y) AS tp, count(*) FILTER (WHERE score >= 1500 AND NOT y) AS fp, count(*) FILTER (WHERE score < 1500 AND NOT y) AS tn, count(*) FILTER (WHERE score < 1500 AND y) AS fn FROM d GROUP BY split), "
    "r AS (SELECT *, CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fn) END AS recall, CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN fp + tn = 0 THEN 0.0::DOUBLE ELSE fp::DOUBLE / (fp + tn) END AS false_alarm_rate FROM c) "
    "SELECT split, tp, fp, tn, fn, round(recall, 6) AS recall, round(precision, 6) AS precision, round(false_alarm_rate, 6) AS false_alarm_rate, round(CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1 FROM r"
)
def confusion(spark, sf_dir):
    return rounded(metrics.rates(metrics.confusion(views.scored(spark, sf_dir), 1500.0, by=("split",))), "recall", "precision", "false_alarm_rate", "f1")


@query(f"WITH {views.SCORED}, {_F1} SELECT threshold, round(f1_on_val, 6) AS f1_on_val, candidates FROM best")
def calibrate_f1(spark, sf_dir):
    return rounded(metrics.calibrate_f1(views.scored(spark, sf_dir).where("split = 'val'"), split="val"), "f1_on_val")


@query(
    f"WITH {views.SCORED}, {_F1}, c AS (SELECT threshold, count(*) FILTER (WHERE score >= threshold AND y) AS tp, count(*) FILTER (WHERE score >= threshold AND NOT y) AS fp, count(*) FILTER (WHERE score < threshold AND NOT y) AS tn, count(*) FILTER (WHERE score < threshold AND y) AS fn FROM d, best WHERE split = 'test' GROUP BY threshold), "
    "r AS (SELECT *, CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fn) END AS recall, CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN fp + tn = 0 THEN 0.0::DOUBLE ELSE fp::DOUBLE / (fp + tn) END AS false_alarm_rate FROM c) "
    "SELECT threshold, tp, fp, tn, fn, round(recall, 6) AS recall, round(precision, 6) AS precision, round(false_alarm_rate, 6) AS false_alarm_rate, round(CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1 FROM r"
)
def evaluate_test(spark, sf_dir):
    from .engine import Engine

    return rounded(Engine(spark).evaluate(views.scored(spark, sf_dir)), "recall", "precision", "false_alarm_rate", "f1")


# ---------------------------------------------------------------- controlled leakage

_SEEDS, _DOSES = (0, 1), (0.0, 0.1, 0.2)
_ARMS = f"""{views.EVENTS}, s AS (SELECT e.*, seed FROM e, (VALUES (0), (1)) z(seed)
), gr AS (SELECT seed, group_id, n, row_number() OVER (PARTITION BY seed ORDER BY sha256(seed || ':' || group_id), group_id) AS k, count(*) OVER (PARTITION BY seed)::DOUBLE AS ng FROM (SELECT seed, group_id, count(*) AS n FROM s WHERE label = 'normal' GROUP BY ALL)
), gs AS (SELECT *, CASE WHEN k <= round_even(ng * 0.6::DOUBLE, 0) THEN 'train' WHEN k <= round_even(ng * 0.6::DOUBLE, 0) + round_even(ng * 0.2::DOUBLE, 0) THEN 'val' ELSE 'test' END AS gsplit FROM gr
), gt AS (SELECT *, sum(CASE WHEN gsplit = 'train' THEN n ELSE 0 END) OVER (PARTITION BY seed)::DOUBLE AS n_train FROM gs
), nm AS (SELECT s.*, gsplit, n_train, k FROM s JOIN gt USING (seed, group_id) WHERE label = 'normal'
), tr AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY k, frame_index, path) AS rn FROM nm WHERE gsplit = 'train'
), sp AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY sha256(seed || ':' || path), path) AS rn FROM nm WHERE gsplit = 'test' AND frame_index > 0
), dz AS (SELECT * FROM (VALUES (0.0::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE)) z(dose)
), ev AS (SELECT seed, path, group_id, label, frame_index, gsplit AS split FROM nm WHERE gsplit <> 'train' AND frame_index = 0 UNION ALL SELECT seed, path, group_id, label, frame_index, 'test' FROM s WHERE label = 'defect'
), arms AS (
  SELECT seed, dose, arm, split, path, group_id, label, frame_index FROM ev, dz, (VALUES ('clean'), ('leaked')) a(arm)
  UNION ALL SELECT seed, dose, 'clean', 'train', path, group_id, label, frame_index FROM tr, dz
  UNION ALL SELECT seed, dose, 'leaked', 'train', path, group_id, label, frame_index FROM tr, dz WHERE rn > round_even(n_train * dose, 0)
  UNION ALL SELECT seed, dose, 'leaked', 'train', path, group_id, label, frame_index FROM sp, dz WHERE rn <= round_even(n_train * dose, 0)
)"""


def _arms(spark, sf_dir):
    e = views.events(spark, sf_dir).select("path", "group_id", "label", "frame_index")
    return arms.leaked_arms(e, seeds=_SEEDS, doses=_DOSES)


@query(f"WITH {_ARMS} SELECT seed, dose, arm, split, count(*) AS n, count(DISTINCT group_id) AS n_groups, sum(frame_index)::BIGINT AS s FROM arms GROUP BY ALL")
def leaked_arms(spark, sf_dir):
    return _arms(spark, sf_dir).groupBy("seed", "dose", "arm", "split").agg(F.count("*").alias("n"), F.count_distinct("group_id").alias("n_groups"), F.sum("frame_index").alias("s"))


@query(f"WITH {_ARMS} SELECT seed, dose, path FROM arms WHERE arm = 'clean' AND split = 'train' EXCEPT ALL SELECT seed, dose, path FROM arms WHERE arm = 'leaked' AND split = 'train'")
def clean_minus_leaked(spark, sf_dir):
    return arms.clean_minus_leaked(_arms(spark, sf_dir))


@query(f"WITH {_ARMS}, tg AS (SELECT DISTINCT seed, group_id FROM arms WHERE split = 'test' AND label = 'normal') SELECT a.seed, dose, arm, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'val') AS n_val, count(*) FILTER (WHERE split = 'test') AS n_test, count(*) FILTER (WHERE split = 'train' AND tg.group_id IS NOT NULL) AS n_leaked FROM arms a LEFT JOIN tg ON tg.seed = a.seed AND tg.group_id = a.group_id GROUP BY ALL")
def leaked_arm_audit(spark, sf_dir):
    return arms.arm_sizes(_arms(spark, sf_dir))


# ---------------------------------------------------------------- paired statistics

_DIFF = f"{views.REPLICATES}, df AS (SELECT *, treatment - control AS d FROM r)"


@query(f"WITH {_DIFF} SELECT contrast, count(*) AS n, round(avg(d), 6) AS mean_difference, round(quantile_cont(d, 0.5), 6) AS median_difference FROM df GROUP BY contrast")
def paired_diff(spark, sf_dir):
    return rounded(statistics.paired_difference(views.replicates(spark, sf_dir), ("contrast",)), "mean_difference", "median_difference")


_RB = f"WITH {_DIFF}, rk AS (SELECT contrast, d, {_RANKS.format(by='contrast', v='abs(d)')} AS mr FROM df WHERE d <> 0), g AS (SELECT DISTINCT contrast FROM df), rb AS (SELECT g.contrast, coalesce(sum(sign(d) * mr) / sum(mr), 0) AS b FROM g LEFT JOIN rk ON rk.contrast = g.contrast GROUP BY g.contrast)"


@query(f"{_RB} SELECT contrast, round(b, 6) AS rank_biserial FROM rb")
def rank_biserial(spark, sf_dir):
    return rounded(statistics.rank_biserial(views.replicates(spark, sf_dir), ("contrast",)), "rank_biserial")


@query(f"{_RB} SELECT contrast, CASE WHEN abs(b) < 0.147 THEN 'despreciable' WHEN abs(b) < 0.33 THEN 'pequeno' WHEN abs(b) < 0.474 THEN 'mediano' ELSE 'grande' END AS effect_magnitude FROM rb")
def effect_magnitude(spark, sf_dir):
    found = statistics.rank_biserial(views.replicates(spark, sf_dir), ("contrast",))
    return found.select("contrast", statistics.magnitude("rank_biserial").alias("effect_magnitude"))


@query(f"WITH {views.REPLICATES} SELECT a.contrast, round(avg(sign(a.treatment - b.control)), 6) AS cliffs_delta FROM r a JOIN r b ON a.contrast = b.contrast GROUP BY a.contrast")
def cliffs_delta(spark, sf_dir):
    return rounded(statistics.cliffs_delta(views.replicates(spark, sf_dir), ("contrast",)), "cliffs_delta")


@query(
    "WITH t AS (SELECT label, toxic, n, n / (sum(n) OVER ())::DOUBLE AS p FROM (SELECT quality AS label, toxic, count(*) AS n FROM labels GROUP BY ALL)), o AS (SELECT *, row_number() OVER (ORDER BY p, label, toxic) AS i, count(*) OVER () AS m FROM t) "
    "SELECT label, toxic, round(least(1.0::DOUBLE, max(p * (m - i + 1)) OVER (ORDER BY p, label, toxic ROWS UNBOUNDED PRECEDING)), 6) AS p_corrected FROM o"
)
def holm(spark, sf_dir):
    counts = views.table(spark, sf_dir, "labels").groupBy(F.col("quality").alias("label"), "toxic").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").cast("double").alias("all"))
    tests = counts.crossJoin(total).withColumn("p_value", F.col("n") / F.col("all"))
    return rounded(statistics.holm(tests, key=("label", "toxic")).select("label", "toxic", "p_corrected"), "p_corrected")


@query(f"WITH {views.REPLICATES}, k AS (SELECT contrast, {_RANKS.format(by='contrast', v='treatment')} AS a, {_RANKS.format(by='contrast', v='control')} AS b FROM r) SELECT contrast, count(*) AS n, round(coalesce(corr(a, b), 0), 6) AS rho FROM k GROUP BY contrast")
def spearman_rho(spark, sf_dir):
    return rounded(statistics.spearman_rho(views.replicates(spark, sf_dir), "treatment", "control", ("contrast",)), "rho")


@query()
def bootstrap_ci(spark, sf_dir):
    return rounded(statistics.compare(views.replicates(spark, sf_dir), "contrast").select("contrast", "n", "ci_low", "ci_high"), "ci_low", "ci_high")


# Up to 13 differences all sign flips, beyond the normal approximation with tie correction; erf by its series
# exp(-x^2) sum x^(2k+1) / gamma(k + 3/2). Values are in tens, so 14 or more differences have ties: the exact form for
# 14 to 50 without ties has no SQL here.
_WILCOXON = f"""WITH {_DIFF}, n0 AS (SELECT contrast, count(*) AS n FROM df GROUP BY contrast),
rk AS (SELECT contrast, d, {_RANKS.format(by="contrast", v="abs(d)")} AS r FROM df WHERE d <> 0),
tie AS (SELECT contrast, sum(c * c * c - c) AS t FROM (SELECT contrast, r, count(*) AS c FROM rk GROUP BY contrast, r) GROUP BY contrast),
st AS (SELECT contrast, count(*) AS m, sum(r) / 2 AS mid, abs(sum(CASE WHEN d > 0 THEN r ELSE 0 END) - sum(r) / 2) AS off, list(r) AS rs FROM rk GROUP BY contrast),
flips AS (SELECT contrast, avg(CASE WHEN abs(s - mid) >= off - 1e-9 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p FROM (
  SELECT contrast, mid, off, list_sum(list_transform(range(m), lambda i: CASE WHEN (mask >> i) & 1 = 1 THEN rs[i + 1] ELSE 0 END)) AS s
  FROM (SELECT *, unnest(range((1 << m::INT)::BIGINT)) AS mask FROM st WHERE m <= 13)) GROUP BY contrast),
z AS (SELECT st.contrast, m, least(8.0::DOUBLE, off / sqrt(m * (m + 1) * (2 * m + 1) / 24.0::DOUBLE - t / 48.0::DOUBLE) / sqrt(2.0::DOUBLE)) AS x FROM st JOIN tie USING (contrast))
SELECT n0.contrast, n0.n, round(CASE WHEN m IS NULL THEN 1.0::DOUBLE WHEN m <= 13 THEN p WHEN x = 0 THEN 1.0::DOUBLE
  ELSE 1 - list_sum(list_transform(range(400), lambda k: exp((2 * k + 1) * ln(x) - x * x - lgamma(k + 1.5::DOUBLE)))) END, 6) AS p_value
FROM n0 LEFT JOIN z USING (contrast) LEFT JOIN flips USING (contrast)"""

# Up to 10 points all orders, beyond the t distribution by its finite sums; the angle is asin(rho).
_SPEARMAN = f"""WITH RECURSIVE {views.REPLICATES}, k AS (SELECT contrast, {_RANKS.format(by="contrast", v="treatment")} AS a, {_RANKS.format(by="contrast", v="control")} AS b FROM r),
mid AS (SELECT contrast, a - avg(a) OVER (PARTITION BY contrast) AS a, b - avg(b) OVER (PARTITION BY contrast) AS b FROM k),
s AS (SELECT contrast, count(*) AS n, list(a) AS la, list(b) AS lb, sqrt(sum(a * a) * sum(b * b)) AS norm, CASE WHEN sum(a * a) * sum(b * b) > 0 THEN sum(a * b) / sqrt(sum(a * a) * sum(b * b)) ELSE 0.0::DOUBLE END AS rho FROM mid GROUP BY contrast),
orders AS (SELECT contrast, 0 AS i, 0 AS used, 0.0::DOUBLE AS dot, n, la, lb, norm, rho FROM s WHERE n <= 10 AND norm > 0
  UNION ALL SELECT contrast, i + 1, used | (1 << j::INT), dot + la[i + 1] * lb[j + 1], n, la, lb, norm, rho FROM orders, range(10) t(j) WHERE i < n AND j < n AND (used >> j::INT) & 1 = 0),
e AS (SELECT contrast, avg(CASE WHEN abs(dot / norm) >= abs(rho) - 1e-12 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p FROM orders WHERE i = n GROUP BY contrast),
t AS (SELECT contrast, CASE WHEN abs(rho) >= 1 THEN 0.0::DOUBLE WHEN n % 2 = 0
  THEN 1 - abs(rho) * list_sum(list_transform(range((n - 2) // 2), lambda j: exp(lgamma(j + 0.5::DOUBLE) - lgamma(j + 1) + j * ln(1 - rho * rho)))) / sqrt(pi())
  ELSE 1 - 2 / pi() * (asin(abs(rho)) + abs(rho) * list_sum(list_transform(range((n - 3) // 2), lambda j: exp(lgamma(j + 1) - lgamma(j + 1.5::DOUBLE) + (j + 0.5::DOUBLE) * ln(1 - rho * rho)))) * sqrt(pi()) / 2) END AS p FROM s WHERE n > 10)
SELECT s.contrast, n, round(rho, 6) AS rho, round(CASE WHEN n > 10 THEN t.p WHEN norm = 0 THEN 1.0::DOUBLE ELSE e.p END, 6) AS p_value, n <= 10 AS exact, round(CASE WHEN n > 10 THEN 0.0::DOUBLE ELSE 2 / gamma(n + 1) END, 6) AS min_achievable_p
FROM s LEFT JOIN e USING (contrast) LEFT JOIN t USING (contrast)"""


@query(_WILCOXON)
def wilcoxon_p(spark, sf_dir):
    return rounded(statistics.compare(views.replicates(spark, sf_dir), "contrast", n_bootstrap=100).select("contrast", "n", "p_value"), "p_value")


@query()
def equivalence(spark, sf_dir):
    found = statistics.equivalence(statistics.compare(views.replicates(spark, sf_dir), "contrast"), 2.0)
    return found.select("contrast", "margin", "is_equivalent", "is_inconclusive")


@query(_SPEARMAN)
def spearman_p(spark, sf_dir):
    return rounded(statistics.monotonicity(views.replicates(spark, sf_dir), "contrast", "treatment", "control"), "rho", "p_value", "min_achievable_p")


# ---------------------------------------------------------------- capture quality and sessions

_CLIP = f"""{views.CLIPS}, q AS (
  SELECT class, day, count(*) AS n_frames, avg(brightness) AS bm, stddev_pop(brightness) AS sd, max(clipped_dark) AS dk, max(clipped_bright) AS br, quantile_cont(sharpness, 0.5) AS sm FROM c GROUP BY class, day
), qq AS (SELECT *, CASE WHEN bm > 0 THEN sd / bm ELSE 0.0::DOUBLE END AS cv, greatest(dk, br) AS cm FROM q)"""


@query(
    f"WITH {_CLIP} SELECT class, day, n_frames, round(bm, 4) AS brightness_mean, round(cv, 4) AS brightness_cv, round(cm, 4) AS clipped_max, round(sm, 2) AS sharpness_median, "
    "array_to_string(list_filter([CASE WHEN cm > 0.02 THEN CASE WHEN dk >= br THEN 'clipped_dark' ELSE 'clipped_bright' END END, CASE WHEN n_frames > 1 AND cv > 0.03 THEN 'flicker' END], lambda x: x IS NOT NULL), ',') AS warnings FROM qq"
)
def clip_quality(spark, sf_dir):
    return quality.summary(quality.clip_quality(views.clips(spark, sf_dir), ("class", "day"))).withColumn("warnings", F.array_join("warnings", ","))


@query(
    f"WITH {_CLIP}, z AS (SELECT *, first_value(bm) OVER w AS rb, first_value(sm) OVER w AS rs FROM qq WINDOW w AS (PARTITION BY class ORDER BY day)), y AS (SELECT class, day, CASE WHEN rb > 0 THEN abs(bm - rb) / rb END AS d, CASE WHEN rs > 0 THEN 1.0::DOUBLE - sm / rs END AS l FROM z) "
    "SELECT class, day, round(d, 6) AS brightness_drift, round(l, 6) AS sharpness_loss, array_to_string(list_filter([CASE WHEN d > 0.10 THEN 'brightness_drift' END, CASE WHEN l > 0.40 THEN 'sharpness_loss' END], lambda x: x IS NOT NULL), ',') AS drift_warnings FROM y"
)
def clip_drift(spark, sf_dir):
    found = quality.drift(quality.clip_quality(views.clips(spark, sf_dir), ("class", "day")), session=("class",), order="day")
    return rounded(found.select("class", "day", "brightness_drift", "sharpness_loss", F.array_join("drift_warnings", ",").alias("drift_warnings")), "brightness_drift", "sharpness_loss")


@query(f"WITH {_CLIP} SELECT class, day FROM qq WHERE n_frames > 1 AND cv > 0.03")
def flicker_cv(spark, sf_dir):
    return quality.clip_quality(views.clips(spark, sf_dir), ("class", "day")).where(F.array_contains("warnings", "flicker")).select("class", "day")


@query(f"WITH {views.EVENTS} SELECT t.label, count(DISTINCT e.group_id) AS n_pieces, t.target, count(DISTINCT e.group_id) < t.target AS is_rehearsal FROM (VALUES ('normal', 30::BIGINT), ('defect', 1000::BIGINT)) t(label, target) LEFT JOIN e ON e.label = t.label GROUP BY t.label, t.target")
def progress_vs_target(spark, sf_dir):
    return lookups.progress(views.events(spark, sf_dir), {"normal": 30, "defect": 1000})


_PIECES = "p AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'ok-' ELSE 'def-' END || printf('%03d', user_id) AS piece, user_id FROM (SELECT DISTINCT user_id FROM events))"


@query(f"WITH {_PIECES} SELECT k.prefix, k.prefix || '-' || printf('%03d', coalesce(max(split_part(piece, '-', 2)::INT) + 1, 0)) AS next_id FROM (VALUES ('ok'), ('def'), ('new')) k(prefix) LEFT JOIN p ON split_part(piece, '-', 1) = k.prefix GROUP BY k.prefix")
def next_id(spark, sf_dir):
    return lookups.next_ids(_pieces(spark, sf_dir), ["ok", "def", "new"])


@query(f"WITH {_PIECES} SELECT piece FROM (SELECT 'ok-' || printf('%03d', x) AS piece FROM range(0, 2000) t(x)) WHERE piece NOT IN (SELECT piece FROM p)")
def not_yet_captured(spark, sf_dir):
    planned = spark.range(2000).select(F.format_string("ok-%03d", "id").alias("piece"))
    return lookups.not_yet_captured(planned, _pieces(spark, sf_dir))


def _pieces(spark, sf_dir):
    users = views.table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select(F.concat(F.when(F.col("user_id") % 2 == 0, "ok-").otherwise("def-"), F.format_string("%03d", "user_id")).alias("piece"))


@query("SELECT user_id::VARCHAR AS key, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def cache_last_wins(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), "value", "event_id")
    return lookups.last_by_key(e, "key", "value", "event_id")


@query(f"WITH {views.EVENTS} SELECT group_id, path FROM e WHERE frame_index = 0")
def first_of_session(spark, sf_dir):
    return lookups.first_of(views.events(spark, sf_dir), "group_id", "frame_index").select("group_id", "path")


# ---------------------------------------------------------------- score alignment, lookups, keys


def _predictions(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    return e.select((F.col("event_id") % 97).alias("batch"), F.col("user_id").cast("string").alias("path"), F.col("value").alias("score"), "event_id")


@query("WITH f AS (SELECT DISTINCT user_id::VARCHAR AS path FROM events) SELECT f.path, p.score FROM f JOIN (SELECT user_id::VARCHAR AS path, arg_max(value, event_id) AS score FROM events GROUP BY user_id) p USING (path)")
def score_alignment(spark, sf_dir):
    p = _predictions(spark, sf_dir).withColumn("batch", F.col("event_id"))
    return lookups.aligned_scores(p.select("path").distinct(), p.drop("event_id"))


@query("SELECT doc_id::VARCHAR AS path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_scores(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"))
    return lookups.missing_scores(docs, views.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("path")))


@query(f"WITH {views.vectors_sql()} SELECT e.path, v.phash IS NOT NULL AS has_hash, bit_count(v.phash)::INT AS n_bits FROM (SELECT DISTINCT user_id::VARCHAR AS path FROM events) e JOIN v ON v.path = e.path")
def hash_lookup(spark, sf_dir):
    users = views.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path")).distinct()
    found = lookups.with_hashes(users, views.vectors(spark, sf_dir))
    return found.select("path", F.col("phash").isNotNull().alias("has_hash"), F.bit_count("phash").alias("n_bits"))


@query(
    "WITH c AS (SELECT n_nationkey AS id, n_name AS category, 0.9::DOUBLE + n_nationkey * 0.004::DOUBLE AS value, CASE WHEN n_nationkey % 3 = 0 THEN 0.95::DOUBLE END AS paper, CASE WHEN n_nationkey % 2 = 0 THEN 0.97::DOUBLE END AS library FROM nation) "
    "SELECT category, coalesce(paper, library) AS reference, CASE WHEN paper IS NOT NULL THEN 'paper' WHEN library IS NOT NULL THEN 'library' END AS origin, CASE WHEN CASE WHEN coalesce(paper, library) IS NOT NULL THEN abs(value - coalesce(paper, library)) <= 0.0205 ELSE value >= 0.95 END THEN 'PASA' ELSE 'FALLA' END AS verdict FROM c"
)
def reference_verdicts(spark, sf_dir):
    n = views.table(spark, sf_dir, "nation")
    cells = n.select(F.lit("m").alias("model"), F.col("n_name").alias("category"), (F.lit(0.9) + F.col("n_nationkey") * F.lit(0.004)).alias("value"))
    refs = n.select(F.lit("m").alias("model"), F.col("n_name").alias("category"), F.when(F.col("n_nationkey") % 3 == 0, F.lit(0.95)).alias("paper"), F.when(F.col("n_nationkey") % 2 == 0, F.lit(0.97)).alias("library"))
    joined = lookups.with_reference(cells, refs)
    return joined.select("category", "reference", "origin", metrics.verdict(F.col("value"), F.col("reference"), F.lit(0.95), 0.0205).alias("verdict"))


@query(f"WITH {views.EVENTS} SELECT path, ('0x' || substr(sha256(group_id || ':' || frame_index), 1, 8))::BIGINT AS seed FROM e")
def stable_seeds(spark, sf_dir):
    return views.events(spark, sf_dir).select("path", keys.stable_seed("group_id", "frame_index").alias("seed"))


@query(f"WITH {views.EVENTS} SELECT path, parse_filename(path, true) AS stem, split_part(path, '/', 2) AS parent, '.png' AS suffix, split_part(path, '/', 2) || '_' || parse_filename(path, true) AS group_key FROM e")
def frame_key(spark, sf_dir):
    e = frames.with_keys(views.events(spark, sf_dir))
    return e.select("path", keys.path_stem("path").alias("stem"), keys.path_parent("path").alias("parent"), keys.path_suffix("path").alias("suffix"), keys.group_of(keys.path_parent("path"), "path").alias("group_key"))


_KEYS = ("../out.bin", "a/../../out.bin", "/etc/passwd", "..\\out.bin", "a/b.bin", "a\\b.bin", "a..b/c.bin", "C:\\x", "")


@query("SELECT * FROM (VALUES ('../out.bin', false), ('a/../../out.bin', false), ('/etc/passwd', false), ('..\\out.bin', false), ('a/b.bin', true), ('a\\b.bin', true), ('a..b/c.bin', true), ('C:\\x', false), ('', false)) t(key, is_safe)")
def storage_key_guard(spark, sf_dir):
    return spark.createDataFrame([(k,) for k in _KEYS], "key string").select("key", keys.key_is_safe("key").alias("is_safe"))


@query(f"WITH {views.vectors_sql()} SELECT path, CASE WHEN phash >= 9223372036854775808 THEN (phash::HUGEINT - 18446744073709551616)::BIGINT ELSE phash::BIGINT END AS packed FROM v")
def packed_bits(spark, sf_dir):
    v = views.table(spark, sf_dir, "embeddings")
    return v.select(F.col("vec_id").cast("string").alias("path"), bits.pack_bits(bits.sign_bits("embedding")).alias("packed"))


@query(f"WITH {views.lines_sql('l_suppkey')}, {_naive('l', 3)} SELECT split, count(*) AS n_frames, count(DISTINCT group_id) AS n_groups FROM m GROUP BY split")
def manifest_roundtrip(spark, sf_dir):
    """Write a manifest, read it back, count."""
    path = new_folder(spark, "manifest")
    sinks.write_manifest(splitting.split_naive(views.lines(spark, sf_dir, "l_suppkey"), seed=3), path, strategy="naive_by_frame", seed=3)
    rows, _ = records.read_manifest(spark, path)
    return rows.groupBy("split").agg(F.count("*").alias("n_frames"), F.count_distinct("group_id").alias("n_groups"))


# ---------------------------------------------------------------- experiment results


@query(f"WITH {views.RESULTS} SELECT dose, arm, round(avg(auroc), 6) AS mean_auroc FROM res GROUP BY dose, arm")
def dose_means(spark, sf_dir):
    return rounded(arms.mean_by_dose(views.results(spark, sf_dir)), "mean_auroc")


_PAIRED = f"{views.RESULTS}, pd AS (SELECT l.dose, l.seed, l.auroc AS treatment, c.control FROM res l JOIN (SELECT seed, arg_min(auroc, dose) AS control FROM res WHERE arm = 'clean' GROUP BY seed) c USING (seed) WHERE l.arm = 'leaked' AND l.dose > 0)"


@query(f"WITH {_PAIRED} SELECT dose, seed, treatment, control FROM pd")
def dose_pairs(spark, sf_dir):
    return arms.paired_by_dose(views.results(spark, sf_dir)).select("dose", "seed", "treatment", "control")


@query(f"WITH {_PAIRED} SELECT dose, count(*) AS n, round(avg(treatment - control), 6) AS mean_difference, round(quantile_cont(treatment - control, 0.5), 6) AS median_difference FROM pd GROUP BY dose")
def dose_contrast(spark, sf_dir):
    """A row for each measured dose; p-values and intervals are held against brute force by tests."""
    found = experiment.dose_response(views.results(spark, sf_dir), n_bootstrap=100)
    return rounded(found.select("dose", "n", "mean_difference", "median_difference"), "mean_difference", "median_difference")


@query(f"WITH {views.RESULTS}, z AS (SELECT seed, max(auroc) FILTER (WHERE arm = 'leaked') - max(auroc) FILTER (WHERE arm = 'clean') AS d FROM res WHERE dose = 0 GROUP BY seed) SELECT count(*) AS n, max(abs(d)) AS max_difference FROM z")
def zero_dose(spark, sf_dir):
    return experiment.zero_dose_holds(views.results(spark, sf_dir))


@query(f"WITH {views.REPLICATES} SELECT contrast, replicate, treatment, control FROM r")
def paired_replicates(spark, sf_dir):
    r, on = views.replicates(spark, sf_dir), ["contrast", "replicate"]
    return statistics.paired(r.select(*on, F.col("treatment").alias("v")), r.select(*on, F.col("control").alias("v")), on, "v").select(*on, "treatment", "control")


@query(f"WITH {views.RESULTS} SELECT dose, count(*) AS n_trainings, round(count(*) * 548 * 0.099::DOUBLE, 6) AS seconds FROM res GROUP BY dose")
def run_cost(spark, sf_dir):
    n = views.results(spark, sf_dir).groupBy("dose").agg(F.count("*").alias("n_trainings"))
    return rounded(n.withColumn("seconds", arms.cost_seconds(F.col("n_trainings"), F.lit(548), 0.099)), "seconds")


# ---------------------------------------------------------------- parsing, media time


@query("SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 7 ELSE user_id END AS n, CASE WHEN user_id % 3 = 0 THEN 0.5::DOUBLE ELSE value END AS x FROM events")
def parsed_settings(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    raw = [F.when(F.col("user_id") % 3 != 0, F.col(c).cast("string")) for c in ("user_id", "value")]
    return e.select("event_id", keys.parse_int("n", raw[0], 7).alias("n"), keys.parse_float("x", raw[1], 0.5).alias("x"))


@query("SELECT page_id, regexp_matches(lower(u), '^rtsps?://') AS is_live FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN replace(url, 'http', 'RTSP') WHEN 1 THEN 'x' || url ELSE url END AS u FROM pages)")
def live_urls(spark, sf_dir):
    u = F.when(F.col("page_id") % 3 == 0, F.replace(F.col("url"), F.lit("http"), F.lit("RTSP"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("x"), F.col("url"))).otherwise(F.col("url"))
    return views.table(spark, sf_dir, "pages").select("page_id", keys.is_rtsp(u).alias("is_live"))


@query(
    f"WITH {views.EVENTS}, m AS (SELECT path, frame_index, CASE WHEN frame_index % 2 = 0 THEN signal END AS ms, CASE event_type WHEN 'click' THEN 25.0::DOUBLE WHEN 'view' THEN 0.0::DOUBLE END AS fps FROM e), "
    "x AS (SELECT *, coalesce(fps > 0, false) AS fps_is_measured FROM m), y AS (SELECT *, CASE WHEN fps_is_measured THEN fps ELSE 30.0::DOUBLE END AS rate FROM x) SELECT path, rate, fps_is_measured, round(CASE WHEN ms > 0 THEN ms / 1000.0::DOUBLE ELSE frame_index / rate END, 6) AS at FROM y"
)
def media_time(spark, sf_dir):
    """The container's time and frame rate where it has them, otherwise the fallback's."""
    e = views.events(spark, sf_dir).withColumn("ms", F.when(F.col("frame_index") % 2 == 0, F.col("signal")))
    fps = F.when(F.col("event_type") == "click", F.lit(25.0)).when(F.col("event_type") == "view", F.lit(0.0))
    rate, measured = keys.measured_fps(fps, 30.0)
    timed = e.select("path", "frame_index", "ms", rate.alias("rate"), measured.alias("fps_is_measured"))
    return rounded(timed.select("path", "rate", "fps_is_measured", keys.timestamp_s("ms", "frame_index", "rate").alias("at")), "at")


# ---------------------------------------------------------------- files, written and read back


@query("SELECT user_id::VARCHAR AS group_id, event_type AS class, CASE WHEN event_type = 'click' THEN 'normal' ELSE 'defect' END AS label, event_id || '.mp4' AS source_video FROM events")
def capture_log(spark, sf_dir):
    path = new_folder(spark, "captures")
    e = views.table(spark, sf_dir, "events")
    label = F.when(F.col("event_type") == "click", "normal").otherwise("scratch")
    rows = e.select(F.col("user_id").cast("string").alias("pieza"), F.col("event_type").alias("clase"), label.alias("etiqueta"), F.concat(F.col("event_id").cast("string"), F.lit(".mp4")).alias("ruta"), "event_id")
    for k in (0, 1):
        sinks.append_records(rows.where(F.col("event_id") % 2 == k).drop("event_id"), path)
    return records.frames_of_captures(records.read_captures(spark, path))


@query("SELECT user_id::VARCHAR AS clave, arg_max(value, event_id) AS auroc FROM events GROUP BY user_id")
def result_cache(spark, sf_dir):
    """Each key written with its first value, then with its last: the last write counts."""
    path = new_folder(spark, "cache")
    per = views.table(spark, sf_dir, "events").groupBy("user_id")
    for pick in (F.min_by, F.max_by):
        sinks.append_records(per.agg(pick("value", "event_id").alias("auroc")).select(F.col("user_id").cast("string").alias("clave"), "auroc"), path)
        time.sleep(1.1)  # files are told apart by their time, in seconds on some stores
    return records.read_cache(spark, path)


@query("SELECT 'docs/' || doc_id || '.txt' AS key, length(text) AS chars FROM documents WHERE text IS NOT NULL")
def artifacts(spark, sf_dir):
    path = new_folder(spark, "artifacts")
    docs = views.table(spark, sf_dir, "documents").where("text IS NOT NULL")
    sinks.put_artifacts(docs.select(F.concat(F.lit("docs\\"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("key"), F.encode("text", "UTF-8").alias("content")), path)
    return spark.read.parquet(path).select("key", F.length(F.decode("content", "UTF-8")).cast("long").alias("chars"))


@query(f"WITH {views.EVENTS} SELECT split, group_id, frame_index, path FROM (SELECT *, CASE WHEN label = 'normal' THEN 'train' ELSE 'test' END AS split FROM e)")
def manifest_json(spark, sf_dir):
    """A manifest with explicit assignments as one JSON document (an interchange format for small tables), read as rows."""
    path = new_folder(spark, "manifest-json")
    e = frames.checked(views.events(spark, sf_dir)).select(*[f.name for f in frames.FRAME_SCHEMA]).withColumn("split", F.when(F.col("label") == "normal", "train").otherwise("test"))
    per = e.groupBy("split").agg(F.collect_list(F.struct(*[f.name for f in frames.FRAME_SCHEMA])).alias("rows"))
    sinks.archive(per.agg(F.lit("by_group").alias("strategy"), F.lit(0).cast("long").alias("seed"), F.map_from_entries(F.collect_list(F.struct("split", "rows"))).alias("assignments")), path)
    return records.read_manifest_json(spark, path).select("split", "group_id", "frame_index", "path")


@query(f"WITH {views.EVENTS} SELECT path, group_id FROM e WHERE frame_index < 3")
def materialised_once(spark, sf_dir):
    """The second write finds a table and leaves it as it is."""
    path = new_folder(spark, "once")
    e = views.events(spark, sf_dir).select("path", "group_id", "frame_index")
    for most in (3, 9):
        sinks.materialise(e.where(F.col("frame_index") < most).drop("frame_index"), path)
    return spark.read.parquet(path)


# ---------------------------------------------------------------- vector anomaly scores


@query()
def anomaly_memory_auroc(spark, sf_dir):
    """AUROC on test of the distance to the nearest of a memory of normal training vectors."""
    m = splitting.split_by_group(views.vectors(spark, sf_dir))
    scored = anomaly.NearestMemory.fit(m).scores(m.where("split = 'test'")).withColumn("y", F.col("label") == "defect")
    return rounded(metrics.auroc(scored), "auroc")


@query()
def anomaly_mahalanobis_auroc(spark, sf_dir):
    m = splitting.split_by_group(views.vectors(spark, sf_dir))
    scored = anomaly.Mahalanobis.fit(m).scores(m.where("split = 'test'")).withColumn("y", F.col("label") == "defect")
    return rounded(metrics.auroc(scored), "auroc")
