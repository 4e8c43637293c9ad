"""Every operator and stage: extra columns with names of its own, nulls, repeated rows, empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lamina.llm import ann, chat, decontam, eftrie, langid, linedup, mixing, pfor, pii, queries, simhash

# names that operators give to columns of their own or of their results
CLASHES = (
    "th h w p h0 n_lines n_deleted deleted earlier later fan part d_ t_ l_ r_ ls_ fp node bands component component_id first_id key k1 k2 k3 size copies target taken source_size "
    "lang_pred score found language leak_id item_id row literal template n_windows start n_tokens ids_crc32 shard payload at spans n_added held list id v rank query_id place class cell i c_ i_ x_ window"
).split()


@pytest.fixture(scope="module")
def odd(docs_of, odd_rows):
    docs = docs_of([*odd_rows, (6, "plain words of a text that is long enough to be kept")])
    return docs, docs.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


OPERATORS = {
    "pfor": lambda d: pfor.token_documents(d, queries.tokenizer_path()),
    "linedup": linedup.without_common_blocks,
    "pii": lambda d: pii.find(d, pii.fit(d)),
    "simhash": lambda d: simhash.near_duplicates(d),
    "without_copies": simhash.without_copies,
    "mixing": mixing.copies,
    "mixed": mixing.mixed,
    "langid": lambda d: langid.predict(d, langid.fit(d)),
    "known": lambda d: langid.known(d, langid.fit(d)),
    "eftrie": lambda d: eftrie.scores(d.withColumn("held_out", F.lit(False)), eftrie.train(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names_change_nothing(odd, name):
    docs, wide = odd
    run = OPERATORS[name]
    plain = run(docs)
    columns = [c for c in plain.columns if c not in CLASHES or name not in ("mixed", "without_copies", "known")]
    assert sorted(map(str, plain.select(*columns).collect())) == sorted(map(str, run(wide).select(*columns).collect()))
    assert run(wide.limit(0)).isEmpty()


def test_leaks_with_clashing_names(spark, odd):
    bench = spark.createDataFrame([(1, "plain words of a text that is long enough to be kept"), (2, None), (None, "a b c d e f g h")], "item_id long, text string")
    for size in (decontam.BROADCAST_BYTES, 0):
        found = [decontam.leaks(d, b, broadcast_bytes=size).collect() for d, b in ((odd[0], bench), (odd[1], bench.withColumns({c: F.lit("x") for c in ("doc_id", "key", "row", "h")})))]
        assert sorted(map(str, found[0])) == sorted(map(str, found[1])) and len(found[0]) == 1


def test_chat_and_vectors_with_clashing_names(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hello"), (1, 1, "assistant", None), (None, 0, None, ""), (1, 1, "assistant", None)], "conv_id long, turn int, role string, text string")
    wide = turns.withColumns({c: F.lit("x") for c in ("i", "tokens", "window", "first", "begin", "end", "formatted", "prefix", "room", "new", "c_", "i_")})
    assert sorted(map(str, chat.digest(chat.windows(turns)).collect())) == sorted(map(str, chat.digest(chat.windows(wide)).collect()))
    table = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(8)], "vec_id long, embedding array<double>")
    wide = table.withColumns({c: F.lit("x") for c in ("id", "v", "list", "cell", "score")})
    both = [ann.search(v, v, 3, ann.fit(v, k=3)).orderBy("query_id", "rank").collect() for v in (ann.vectors_of(t, "vec_id", "embedding") for t in (table, wide))]
    assert both[0] == both[1] and len(both[0]) == 24


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages_on_odd_tables(spark, small, odd, stage):
    run = corpus_pipeline.STAGES[stage][1]
    docs, wide = odd
    plain, other = run(spark, docs, small), run(spark, wide, small)
    if stage < len(corpus_pipeline.STAGES) - 1:
        assert plain.columns == docs.columns and other.columns == wide.columns
    assert sorted(map(str, plain.collect())) == sorted(map(str, other.select(*plain.columns).collect()))
    assert run(spark, docs.limit(0), small).isEmpty()
