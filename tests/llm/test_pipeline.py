"""The pipeline's stages on planted cases, and the SQL of the queries that have one."""

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from tests.llm.test_operators import linked, prose, without_long_runs
from treeloom.llm import queries
from treeloom.llm.sql import SQL

SMALL = "/root/testdata/sf0.001"


def test_stages_and_registration():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "packing"]
    known = __spark_entry__.queries()
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 11)} and "pipeline" in known


def test_stages_on_planted_cases(spark, documents, tmp_path):
    text = prose(1, 200)
    docs = documents([(1, text), (2, "x " + text.split(" ", 1)[1]), (3, text), (4, prose(2, 100)), (5, None), (6, ""), (4, prose(2, 100)), (None, text), (None, "y")], ["score", "k", "_own", "_linked", "t", "at", "_id", "__________"])
    out = corpus_pipeline.near_duplicates_stage(spark, docs, "")
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "4", "5", "6", "None", "None"] and out.columns == docs.columns
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    same = corpus_pipeline.quality_stage(spark, docs, str(tmp_path))  # no class to tell apart: all stay, with their columns
    assert same.columns == docs.columns and sorted(map(str, same.collect())) == sorted(map(str, docs.collect()))
    passage = prose(9, 40)
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    mixed = documents([(1, "a " + passage + " b"), (2, prose(3, 80))])
    assert [r["doc_id"] for r in corpus_pipeline.decontamination_stage(spark, mixed, str(tmp_path)).collect()] == [2]
    ran = corpus_pipeline.lines_stage(spark, documents(["a\nb\nc\nd", "x\na\nb\nc\ny"]), "").collect()
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in ran} == {0: ("a\nb\nc\nd", 7), 1: ("x\ny", 3)}


def test_stages_on_empty_tables(spark, documents, tmp_path):
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "some passage of the benchmark, which is long enough")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    empty = documents([])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0 and (name == "packing" or out.columns == empty.columns)


def test_packing_stage(spark, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    texts = [None, "", prose(1, 900), prose(1, 900)]
    out = corpus_pipeline.packing_stage(spark, documents([*texts, (3, texts[3])], ["ids", "length"]), "").toPandas()
    for i, t in enumerate(texts):
        d = out[out.doc_id == i].sort_values(["start", "sequence_id"])
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        copies = 2 if i == 3 else 1
        assert d.length.sum() == copies * len(ids) and len(d[d.start == 0]) == copies
        assert [x for y in d.drop_duplicates("start").ids for x in y] == ids


def test_each_stage_against_brute_force_on_what_the_one_before_kept(spark, tmp_path):
    docs = queries.table(spark, SMALL, "documents")
    saved = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        saved[name] = before, {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.count() == len(saved[name][1])
    before, after = saved["quality_classifier"]
    assert all(before[k] == t for k, t in after.items())
    before, after = saved["line_dedup"]
    want, had = without_long_runs(list(before.items()), 3, 13)
    assert set(after) == {k for k in want if want[k] or not had[k]}
    assert all([x.strip() for x in (t or "").split("\n") if x.strip()] == want[k] for k, t in after.items())
    before, after = saved["minhash_near_dedup"]
    ids = sorted(before)
    of = linked([before[k] for k in ids], 5)
    assert after == {k: before[k] for i, k in enumerate(ids) if of[i][1] == i}
    before, after = saved["benchmark_decontamination"]
    plain = lambda t: " ".join((t or "").lower().split())
    items = [plain(r["text"]) for r in queries.table(spark, SMALL, "benchmark").collect() if plain(r["text"])]
    grams = {x[i : i + 10] for x in items for i in range(len(x) - 9)}
    for k, t in before.items():
        if any(x in plain(t) for x in items):
            assert k not in after
        if k not in after:  # by the lemma a part that is contained shares many grams
            assert sum(plain(t)[i : i + 10] in grams for i in range(len(plain(t)))) >= 20
    assert all(before[k] == t for k, t in after.items())


def test_run(spark):
    out = corpus_pipeline.run(spark, SMALL).toPandas()
    assert len(out) and out.sequence_id.is_unique
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").toPandas()
    kept = set(out.doc_id)
    good = labels[(labels.quality == 1) & (labels.toxic == 0)].doc_id
    assert len(kept & set(good)) > 0.6 * len(good)


@pytest.mark.parametrize("name", SQL)
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SMALL)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({SQL[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)
