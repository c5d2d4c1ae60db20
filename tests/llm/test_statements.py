"""Queries with a DuckDB statement, and the shapes of all others, on the given tables."""

import os

import duckdb
import pytest

from shelfline.llm import catalog

COLUMNS = {
    "op1": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op2": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op3": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op4": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "match_item", "match_start"],
    "op5": ["doc_id", "size", "source_size", "target", "taken"],
    "op6": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op7": ["doc_id", "held_out", "score", "predicted"],
    "op8": ["query_id", "rank", "vec_id", "score"],
    "op9": ["doc_id", "class_id", "keep"],
    "op10": ["page_id", "host", "path", "rule", "verdict", "block_score"],
    "op11": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
    "op12": ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"],
    "op13": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
}


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_statement(spark, sf_dir, name):
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{file}'")
    wanted = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    got = catalog.queries()[name](spark, sf_dir)
    assert set(got.columns) == set(columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, wanted.fetchall()))


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n.startswith("op")])
def test_columns_and_rows(spark, sf_dir, name):
    got = catalog.queries()[name](spark, sf_dir)
    assert got.columns == COLUMNS[name.split("_")[0]]
    if name.startswith("op13"):  # nodes, one of them the root over all conversations
        convs = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct().count()
        assert [r.n_convs for r in got.where("depth = 0").collect()] == [convs]
        return
    if name.startswith("op12"):
        assert got.count() == 600 * spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang").distinct().count()
        return
    rows = spark.read.parquet(f"{sf_dir}/{'pages' if name.startswith('op10') else 'embeddings' if name.startswith('op8') else 'documents'}.parquet").count()
    assert got.count() == (20 * (rows // 20) if name.startswith("op8") else rows)
