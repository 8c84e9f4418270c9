"""The pipeline: stages against brute force, columns, odd rows; registered queries against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from gridbill.llm import bpe, decontam, jaccard, pii, queries, toxicity


def test_stages_take_effect(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    labels = spark.read.parquet(f"{tiny}/labels.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.fit(docs, labels)
    scores = dict(zip(rows, model.scores(list(rows.values())), strict=True))
    rows = {i: t for i, t in rows.items() if scores[i] < toxicity.THRESHOLD}
    now = corpus_pipeline.drop_toxic(spark, docs, tiny)
    assert now.columns == docs.columns and {r.doc_id for r in now.collect()} == {*rows}

    sets = {i: {*jaccard.shingles(t).tolist()} for i, t in rows.items()}
    link = lambda a, b: sets[a] and sets[b] and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))
    label, changed = {i: i for i in rows}, True
    while changed:
        changed = False
        for a in rows:
            for b in rows:
                if label[a] != label[b] and link(a, b):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    now = corpus_pipeline.drop_near_copies(spark, now, tiny)
    rows = {i: t for i, t in rows.items() if label[i] == i}
    assert now.columns == docs.columns and {r.doc_id for r in now.collect()} == {*rows}

    items = [r.text for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    before, texts = {*rows}, {r.doc_id: r.text or "" for r in docs.collect()}
    now = corpus_pipeline.drop_leaks(spark, now, tiny)
    rows = {r.doc_id: r.text for r in now.collect()}
    assert now.columns == docs.columns and {i for i in before if not any(t in texts[i] for t in items)} >= {*rows}

    now = corpus_pipeline.mask_personal_data(spark, now, tiny)
    assert now.columns == docs.columns
    assert all(not pii.base_spans(r.text or "") for r in now.collect())
    last = corpus_pipeline.tokens(spark, now, tiny)
    assert last.count() == len(rows) and "doc_id" in last.columns


def test_run_is_its_stages(spark, tiny):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "decontamination", "personal_data", "bpe"]
    assert corpus_pipeline.run(spark, tiny).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_odd_rows(spark, tiny, documents):
    docs = documents([(1, None), (2, ""), (None, "null id"), (3, "same row twice here now"), (3, "same row twice here now")])
    now = corpus_pipeline.drop_near_copies(spark, corpus_pipeline.drop_toxic(spark, docs, tiny), tiny)
    assert sorted((r.doc_id or 0, r.text) for r in now.collect() if r.text is not None) == [(0, "null id"), (2, ""), (3, "same row twice here now")]
    now = corpus_pipeline.mask_personal_data(spark, corpus_pipeline.drop_leaks(spark, now, tiny), tiny)
    assert now.count() == 4 and now.columns == docs.columns
    assert bpe.digests(now.select("doc_id", "text")).count() == 4


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_against_sql(spark, name):
    path = "/root/testdata/sf0.001"
    df = queries.QUERIES[name](spark, path)
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet')")
    sql = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in sql.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(columns).collect())) == sorted(sql.fetchall())


def test_registered():
    names = entry.queries()
    assert {*queries.QUERIES, "pipeline"} <= {*names}
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert decontam.ORACLE == entry.oracle_sql()["op9_templates"]


def test_near_copies_are_dropped_without_moving_texts(spark, tiny, documents):
    """An id with one row of its own and one that copies a smaller id stays, as one row for each text."""
    copy, other = "one two three four five six seven", "a b c d e f g h"
    rows = [(1, copy), (2, copy), (3, other), (3, copy), (3, copy), (4, other + " i"), (5, None), (None, copy)]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        now = corpus_pipeline.drop_near_copies(spark, documents(rows[:3] + rows[5:]), tiny)
        plan = now._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
        assert sorted((r.doc_id or 0, r.text or "") for r in now.collect()) == [(0, copy), (1, copy), (3, other), (5, "")]
        now = corpus_pipeline.drop_near_copies(spark, documents(rows), tiny)
        assert sorted((r.doc_id or 0, r.text or "") for r in now.collect()) == [(0, copy), (1, copy), (3, other), (3, copy), (5, "")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
