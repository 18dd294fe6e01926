"""The pipeline and the registered queries at the smallest size, and its stages against plain Python."""

import hashlib

import duckdb
import pytest

import corpus_pipeline
from gaugeleaf.llm import byte_bpe, registry
from gaugeleaf.llm.common import materialize, table

SF = "/root/testdata/sf0.001"


def test_names():
    names = [n for n in registry.queries() if n != "pipeline"]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in registry.queries()


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    cursor = con.execute(registry.oracle_sql()[name])
    names = [x[0] for x in cursor.description]
    order = sorted(names)
    assert order == sorted(df.columns) or set(order) <= set(df.columns)
    want = sorted(repr([r[names.index(c)] for c in order]) for r in cursor.fetchall())
    assert sorted(repr([r[c] for c in order]) for r in df.collect()) == want


def test_stages_and_run(spark):
    docs, kept = table(spark, SF, "documents"), []
    columns = docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = materialize(stage(spark, docs, SF))
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        if n < 4:
            assert docs.columns == columns
            last = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert kept[0] >= kept[1] >= kept[2] == kept[3] == kept[4] and len(kept[4]) > 0.4 * table(spark, SF, "documents").count()
    import tiktoken

    path, pattern = byte_bpe.vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={p: i for i, p in enumerate(byte_bpe.load_ranks(path))}, special_tokens={})
    rows = docs.collect()
    for r in rows:
        assert list(r.ids) == library.encode_ordinary(last[r.doc_id]) and r.decoded_sha256 == hashlib.sha256(last[r.doc_id].encode()).hexdigest()
    again = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in again) == sorted((r.doc_id, r.n_tokens) for r in rows)
