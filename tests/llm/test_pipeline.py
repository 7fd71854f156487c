"""The pipeline's stages against brute force, each on its own input, and the queries' SQL."""

import duckdb
import public_tokenizers
import pytest

import __spark_entry__
import corpus_pipeline
from quarrystone.llm import language_id, packing, secrets
from tests.llm.test_operators import brute_components, brute_contamination, brute_fingerprint, brute_secrets, check_pieces

SF = "/root/testdata/sf0.001"


def test_stages_in_turn(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, SF)
        out.write.parquet(path := str(tmp_path / str(k)))
        read = spark.read.parquet(path)
        seen[name] = (before, read.collect())
        if name != "packing":
            assert read.columns == columns
            docs = read
    before, after = seen["language_id"]
    sizes = language_id.Sizes(language_id.fit(spark.read.parquet(f"{SF}/documents.parquet")))
    assert {r.doc_id for r in after} == {i for i, t in before.items() if sizes.predict((t or "").encode())[1] >= language_id.NARROW}
    assert len(after) > 0.97 * len(before)
    before, after = seen["simhash_dedup"]
    assert {r.doc_id for r in after} == set(brute_components({i: brute_fingerprint(t) for i, t in before.items()}).values())
    before, after = seen["decontaminate"]
    assert {r.doc_id for r in after} == {i for i, t in before.items() if not brute_contamination(t, items)[4]}
    before, after = seen["secrets"]
    assert {r.doc_id for r in after} == set(before)
    for r in after:
        spans = brute_secrets(before[r.doc_id] or "")
        assert not brute_secrets(r.text or "") and r.n_chars == len(r.text) and (spans or "[secret]" in r.text or r.text == before[r.doc_id])
    before, after = seen["packing"]
    check_pieces(after, before, packing.Ids(public_tokenizers.path("byte_bpe_50k.json")), 1024)


def test_run_of_an_empty_table(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", ["op1_warc", "op8_decontaminate", "op12_fill_in_middle"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in df.select(*columns).collect())


def test_all_queries_are_there():
    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in names if n.startswith("op")} and "pipeline" in names
    assert secrets.KINDS[:3] == ("assign", "access", "hex")
