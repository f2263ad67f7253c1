"""The pipeline's stages, each on what the one before it kept, and the registered queries on the smallest tables."""

import os
import random

import duckdb
import pytest

import corpus_pipeline
from panemill.llm import queries

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    rng = random.Random(21)

    def text(n):
        return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))

    item = text(20)
    base = text(100)
    texts = [text(rng.randrange(5, 80)) for _ in range(40)] + [base, base, base + " more", f"{text(40)} {item} {text(30)}", "123 456", None, "", "слово и дело"]
    rows = [(i, t, "en" if i < 47 else None, f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
        if name != "token_files":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert kept[0] == [*range(44)]  # without numbers, null, nothing and a script that nothing was learned of
    assert kept[1] == [*range(41), 43]
    assert kept[2] == [*range(41)]
    assert set(kept[3]) <= set(kept[2]) and len(kept[3]) > len(kept[2])
    assert kept[4] == kept[3]
    starts = docs.orderBy("start").collect()
    assert sorted(r.doc_id for r in starts) == kept[4] and all(a.start + a.n_tokens == b.start for a, b in zip(starts, starts[1:]))
    assert [r.doc_id for r in starts] != kept[4]  # copies don't stand side by side
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got.collect()) == sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in starts)


def test_stages_on_odd_rows(spark, tmp_path):
    rng = random.Random(22)
    base = " ".join(f"w{rng.randrange(5000)}" for _ in range(60))
    other = " ".join(f"w{rng.randrange(5000)}" for _ in range(60))
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(100_000))
    rows = [(7, base, "en", None), (7, base, "en", None), (5, base + " x", None, "src0"), (5, other, "en", "src0"), (None, other, "en", "src1"), (None, None, None, None), (3, None, "en", "src1"), (4, "", "en", "src1"), (6, long, "en", "src2"), (8, long + " y", "en", "src2")]
    schema = "doc_id long, text string, lang string, source string"
    spark.createDataFrame([(1, "no such words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, schema).selectExpr("*", "length(text) AS n_chars", "'x' AS Copy", "1 AS id", "2 AS component", "3 AS h")
    kept = {"language_id": [(None, 60), (5, 60), (5, 61), (6, 100_000), (7, 60), (7, 60), (8, 100_001)], "near_dedup": [(None, 60), (5, 60), (5, 61), (6, 100_000)]}
    kept["decontamination"] = kept["near_dedup"]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        docs = stage(spark, docs, str(tmp_path))
        if name in kept:
            assert sorted(((r.doc_id, len(r.text.split())) for r in docs.collect()), key=str) == sorted(kept[name], key=str)
        if name != "token_files":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert {r.doc_id for r in docs.collect()} <= {None, 5, 6}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DATA}/{table}.parquet')")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_names():
    assert {int(q[2:].split("_")[0]) for q in queries.QUERIES} == set(range(1, 14)) and len(queries.QUERIES) == 13
