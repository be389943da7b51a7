"""Every registered query over a small table with nulls, repeats and empty texts, and over empty tables."""

import pytest

from docquarry.llm.queries import QUERIES

CONTRACT = {
    "op1_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op2_pii": {"doc_id": "bigint", "text": "string"},
    "op3_lm": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op4_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op5_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op6_secrets": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op7_near_dedup": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op8_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op9_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op10_ann": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
}
DOCS = [(1, "one two three", "en", "s", 13), (2, None, None, None, None), (3, "", "en", "s", 0), (4, " \n ", "en", "s", 3), (5, "x" * 30_000, "en", "s", 1), (1, "one two three", "en", "s", 13), (None, "no id at all", None, None, None)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    out = {}
    for kind, n in (("full", None), ("empty", 0)):
        at = str(tmp_path_factory.mktemp(kind))
        spark.createDataFrame(DOCS[:n], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1), (3, 0, 1)][:n], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([(0, [1.0, 2.0], 1), (20, [1.0, 0.5], None), (21, None, 1), (None, [1.0, 1.0], 2)][:n], "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
        out[kind] = at
    return out


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_contract(spark, tables, name):
    full = QUERIES[name](spark, tables["full"])
    assert CONTRACT[name].items() <= dict(full.dtypes).items()
    rows = full.collect()
    if name not in ("op5_packing", "op10_ann"):
        assert len(rows) == len(DOCS)
    empty = QUERIES[name](spark, tables["empty"])
    assert dict(empty.dtypes) == dict(full.dtypes) and empty.count() == 0
