"""Registered queries against their DuckDB twins at sf0.001 (the driver's
check in miniature), and partition invariance of key operators."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from figura.operators import evaluate, features
from figura.plans.tables import TABLES, vocabulary
from tools.oracle_check import rows_of, type_diff

SF = "/root/testdata/sf0.001"
# quick queries from every module; the full set runs in tools/oracle_check.py
NAMES = ["prf_overall_by_genre", "mcnemar_midp", "split_sizes", "error_sample_counts",
         "whitespace_norm", "infix_tokens", "token_offsets", "id_split_typed", "offset_repair",
         "smallest_context", "nearest_ancestor", "nth_fragment", "dep_arguments", "mean_pool",
         "context_dictionary", "attr_extract", "node_text", "leaf_tokens", "corpus_assembly",
         "batch_encoder", "feature_store_roundtrip", "dev_export"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF)
    sql = E.oracle_sql()[name]
    assert type_diff(sdf, duck.sql(sql)) == {}
    sc, sr = rows_of(sdf.toPandas())
    dc, dr = rows_of(duck.execute(sql).fetchdf())
    assert sc == dc and len(sr) == len(dr) and sr == dr


@pytest.mark.parametrize("n", [1, 17])
def test_operators_partition_invariant(spark, n):
    from figura.plans.tables import predictions
    p = predictions(spark, SF).repartition(n)
    m = sorted(map(tuple, evaluate.prf_by_group(p.where(F.col("split") == "test"), digits=6).collect()))
    base = sorted(map(tuple, evaluate.prf_by_group(
        predictions(spark, SF).where(F.col("split") == "test"), digits=6).collect()))
    assert m == base
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(
        F.col("doc_id").alias("id"), F.col("text").alias("min_context"))
    d1 = {r.min_context: r.ctx_id for r in features.context_dictionary(docs.repartition(n)).collect()}
    d2 = {r.min_context: r.ctx_id for r in features.context_dictionary(docs).collect()}
    assert d1 == d2
    vocab = vocabulary(spark, SF)
    toks = docs.select("id", F.explode(F.split("min_context", " ")).alias("t"))
    a = {r.id: [round(x, 6) for x in r.ctx_emb] for r in
         features.mean_pool(toks.repartition(n), "id", "t", vocab, dtype="float64").collect()}
    b = {r.id: [round(x, 6) for x in r.ctx_emb] for r in
         features.mean_pool(toks, "id", "t", vocab, dtype="float64").collect()}
    assert a == b
