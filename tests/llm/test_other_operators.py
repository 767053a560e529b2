"""Mixing, preference formatting, the classifier, vector search and the pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"
DATA = "/root/testdata/sf0.001"


def test_mixing_holds_the_margins(spark):
    from traceloom.llm.mixing import POWERS, mixing_weights, sample_documents

    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("topic", F.lit("clash"))
    out = mixing_weights(docs).toPandas()
    out["mass"] = out.weight * out.tokens
    for m in ("source", "lang", "topic"):
        goal = out.groupby(m).tokens.sum() ** POWERS[m]
        got = out.groupby(m).mass.sum()
        assert np.allclose(got / got.sum(), goal / goal.sum(), rtol=0.02)
    kept = sample_documents(docs)
    assert kept.columns == docs.columns and kept.count() == int(out.sampled.sum())


def test_sampled_rows_have_the_raked_margins(spark):
    import corpus_pipeline as C
    from traceloom.llm.mixing import POWERS, sample_documents, tokens_of, topic_of

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    tokens = lambda df: df.select("lang", topic_of(F.col("text")).alias("topic"), tokens_of(F.col("text")).alias("tokens")).toPandas()
    have = tokens(docs)
    whole, once = tokens(sample_documents(docs, repeats=True)), C.mixing(spark, docs, DATA)
    assert once.count() == once.select("doc_id").distinct().count()
    for got in (whole, tokens(once)):
        for m in ("lang", "topic"):
            goal = have.groupby(m).tokens.sum() ** POWERS[m]
            sums = got.groupby(m).tokens.sum()
            big = goal / goal.sum() > 0.1
            assert np.allclose((sums / sums.sum())[big], (goal / goal.sum())[big], rtol=0.05), (m, sums / sums.sum(), goal / goal.sum())
    assert abs(whole.tokens.sum() / have.tokens.sum() - 1) < 0.02


def test_mixing_edge_cases(spark):
    from traceloom.llm.mixing import mixing_weights

    rows = [(1, "a b", None, None, 3, "x"), (1, "a b", None, None, 3, "x"), (None, None, "en", "s", None, None), (2, "", "en", "s", 0, None), (3, "word " * 9000, "en", "s", 1, None)]
    out = mixing_weights(spark.createDataFrame(rows, DOCS)).collect()
    assert len(out) == 5 and {r["sampled"] for r in out if r["tokens"] == 0} == {False}
    assert mixing_weights(spark.createDataFrame([], DOCS)).count() == 0


def test_preference_pairs(spark):
    from traceloom.llm.preference_format import preference_pairs

    turns = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (1, 2, "user", None),
        (2, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, None, ""), (None, 0, "user", "lost"), (6, 0, "user", "b"), (6, 0, "user", "a"), (7, 0, "user", "a"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("t", F.lit("clash"))
    out = {r["pair_id"]: r for r in preference_pairs(df, F.expr("conv_id div 2"), F.expr("conv_id % 2 = 0")).collect()}
    assert set(out) == {0, 1, 2, 3}
    a = out[0]
    assert a["prompt"] == "<|im_start|>user\nhi<|im_end|>\n" and a["prompt_turns"] == 1
    (x, z), = [map(int, s.split("-")) for s in a["chosen_mask"].split(",")]
    assert a["chosen"][x:z] == "yes" and a["rejected_turns"] == 2
    assert out[1]["prompt_turns"] == 1 and out[1]["chosen"] == out[1]["rejected"] == ""
    assert out[2]["rejected"] == "" and out[2]["prompt"] == "" and out[2]["chosen_mask"] == ""
    assert out[3]["prompt_turns"] == 1 and out[3]["chosen_turns"] == 1
    assert preference_pairs(df.where("false"), F.col("conv_id"), F.lit(True)).count() == 0


@pytest.mark.parametrize("name", ["op3_preference_format", "op9_mixing"])
def test_oracles(spark, name):
    import duckdb

    from traceloom.llm.queries import ORACLE_SQL, QUERIES

    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = QUERIES[name](spark, DATA)
    want = c.execute(f"select {', '.join(got.columns)} from ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_classifier_on_held_out_labels(spark):
    from traceloom.llm.quality_classifier import classify, fit_model

    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = fit_model(docs, labels.where("doc_id % 4 != 0"), rows=2000)
    out = classify(docs.join(labels.where("doc_id % 4 = 0").select("doc_id"), "doc_id", "left_semi"), model).join(labels, "doc_id").toPandas()
    assert (out.selected == ((out.quality == 1) & (out.toxic == 0))).mean() > 0.93
    assert (out.selected & (out.toxic == 1)).sum() <= 3
    assert out.toxic_prob[out.toxic == 1].median() > 0.7 > 0.1 > out.toxic_prob[out.toxic == 0].median()
    assert (np.diff(model.thresholds) > 0).all()


def test_classifier_edge_cases(spark):
    from traceloom.llm.quality_classifier import quality_classifier

    docs = spark.createDataFrame([(1, None, None, None, None, None), (None, "", None, None, None, None), (2, "x " * 50000, "en", "s", 1, "e"), (2, "x", "en", "s", 1, "e")], DOCS)
    labels = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    assert quality_classifier(docs, labels).count() == 4
    assert quality_classifier(docs.where("false"), labels).count() == 0


def brute(rows, asks, k):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 8:
            good[i] = min(v, good.get(i, v))
    out = {}
    for q, v in good.items():
        if asks(q):
            s = sorted(((-float(np.einsum("i,i->", np.array(v), np.array(w))), i) for i, w in good.items() if i != q))
            out[q] = [(i, -x) for x, i in s[:k]]
    return out


def vectors(n):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(n)]
    return rows + [(1000 + i, rows[5][1]) for i in range(40)] + [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [1.0] * 7), (None, [1.0] * 8), (3, rows[3][1]), (2004, [None] + [1.0] * 7)]


@pytest.mark.parametrize("n", [0, 10, 300])
def test_search_of_a_small_table_is_exact(spark, n):
    from traceloom.llm.vector_search import nearest

    rows = vectors(n) if n else []
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("uid", F.lit(1))
    got = {}
    for r in nearest(df, F.col("vec_id") % 5 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute(rows, lambda i: i % 5 == 0, 20)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_search_by_the_forest_reaches_the_recall(spark):
    from traceloom.llm.vector_search import nearest

    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 16)) + 4 * rng.normal(size=(20, 16))[rng.integers(0, 20, 4000)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = nearest(df, F.col("vec_id") % 20 == 0, leaf_rows=64).toPandas()
    met = 0
    for q, g in out.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        met += (s[g.vec_id] >= np.sort(s)[-20] - 1e-9).sum()
        assert np.allclose(g.score, s[g.vec_id])
    assert met / len(out) >= 0.9 and len(out) == 200 * 20


def test_components(spark):
    from traceloom.llm.components import connected_components
    from traceloom.llm.scratch import Scratch

    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 200), (None, 5), (102, 100)] + [(300, 300 + i) for i in range(1, 50)]
    out = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert {out[i] for i in range(41)} == {0} and out[102] == 100 and out[349] == 300 and 200 not in out


def test_pipeline_keeps_columns_and_effects(spark):
    import corpus_pipeline as C

    docs = C.table(spark, DATA, "documents")
    sizes = [docs.count()]
    for name, stage in C.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, DATA).collect(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] == sizes[2] >= sizes[3] > sizes[4] > 0
    out = C.run(spark, DATA)
    assert out.select("doc_id").distinct().count() == sizes[-1]
    empty = spark.createDataFrame([], docs.schema)
    for _, stage in C.STAGES:
        assert stage(spark, empty, DATA).count() == 0


def test_classifier_with_conflicting_labels_and_repeated_ids(spark):
    from traceloom.llm.quality_classifier import quality_classifier

    rows = [(i, "good words in a row " * 5 if i % 2 else "bad junk *** " * 5, "en", "s", 1, None) for i in range(40)]
    rows += [(1, "another text of document one", "en", "s", 1, None)] * 3 + [(None, None, None, None, None, None)]
    labels = [(i, i % 2, 0) for i in range(40)] + [(0, 1, 0), (3, 0, 1), (None, 1, 0), (5, None, None)]
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality long, toxic long")
    one, two = (sorted(map(repr, quality_classifier(docs, m).collect())) for m in (marks, marks.orderBy("quality", "doc_id")))
    assert len(one) == len(rows) and one == two
    assert quality_classifier(docs.where("false"), marks).count() == 0 and quality_classifier(docs, marks.where("false")).count() == len(rows)
