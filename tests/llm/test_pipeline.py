import hashlib
from collections import Counter

import pytest

from kelpie.llm import queries, tokens
from kelpie.llm.near_dedup import kept


def test_pipeline(spark, tmp_path):
    import public_tokenizers

    import corpus_pipeline

    rows = [(i, f"document number {i} " + " ".join(f"w{(i * 37 + k * k) % 997}" for k in range(60 + i % 40)), "en", f"s{i % 4}", 1) for i in range(120)]
    rows += [(500 + i, rows[7][1].upper(), "en", "s0", 1) for i in range(20)] + [(600, None, "en", None, None), (601, "", None, "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns
        at.write.parquet(str(tmp_path / name))
        if name == "near dedup":
            # Copies are gone but for the one with the largest id, and all else is there.
            assert {r["doc_id"] for r in at.select("doc_id").collect()} >= {i for i in range(120) if i != 7} | {519}
            assert not {r["doc_id"] for r in at.select("doc_id").collect()} & {7, *range(500, 519)}
        at = spark.read.parquet(str(tmp_path / name))
    last = [r["text"] or "" for r in at.collect()]
    tok = tokens.load(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter(hashlib.sha256(" ".join(map(str, tok.encode(t, add_special_tokens=False).ids)).encode()).hexdigest() for t in last)
    assert Counter(r["ids_sha256"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want
    assert kept(docs.limit(0)).count() == 0


def test_queries_are_complete():
    names = queries.queries()
    assert {int(n[2:].split("_")[0]) for n in names} == set(range(1, 14)) and set(queries.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", ["op3_host_quality", "op5_bloom_exact_dedup", "op6_fair_queue_mix", "op12_word_id_importance"])
def test_sql_twins(spark, name):
    import duckdb

    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for table in ("documents", "benchmark"):
        c.execute(f"create view {table} as select * from '{d}/{table}.parquet'")
    want = c.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, d)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(x) for x in cols]
    text = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    assert sorted(tuple(text(r[x]) for x in cols) for r in got.collect()) == sorted(tuple(text(r[i]) for i in at) for r in want.fetchall())
