"""Registered queries: their columns, and their SQL where there is some."""

import pytest

import __spark_entry__ as entry
import check
from pairloom.llm import queries

COLUMNS = {
    "op1_personal_data": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op2_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op3_exact_duplicates": "doc_id keep_id group_size kept text_sha256",
    "op4_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op5_language": "doc_id held_out lang_pred score",
    "op6_pieces": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op7_licenses": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op8_near_duplicates": "doc_id fingerprint component_id",
    "op9_shards": "doc_id size text_crc32 law shard slot grown_shard",
    "op10_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op11_importance_resampling": "doc_id n_features weight score rank",
    "op12_word_pieces": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op13_merkle_manifest": "doc_id leaf subroot root proof_sha256 folded_root verified",
    "pipeline": "doc_id piece start length ids_crc32 sequence_id offset",
}

TYPES = {
    "doc_id": "bigint", "kept": "boolean", "base_failed": "boolean", "held_out": "boolean", "over_limit": "boolean",
    "spans": "string", "base_sha256": "string", "text_sha256": "string", "ids_sha256": "string", "decoded_sha256": "string",
    "lang_pred": "string", "score": "double", "base_labels": "string", "labels": "string", "fingerprint": "string",
    "leaf": "string", "subroot": "string", "root": "string", "proof_sha256": "string", "folded_root": "string", "verified": "boolean",
    "law": "string", "shard": "int", "grown_shard": "int", "piece": "int",
}


def test_all_are_registered():
    assert set(queries.QUERIES) == set(COLUMNS) <= set(entry.queries())
    assert set(queries.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(spark, sf, name):
    found = dict(queries.QUERIES[name](spark, sf).dtypes)
    for column in COLUMNS[name].split():
        assert found[column] == ("bigint" if (name, column) == ("op11_importance_resampling", "score") else TYPES.get(column, "bigint"))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf, name):
    state, note = check.compare(spark, check.connect(sf), sf, name)
    assert state == "ok" and "types" not in note, note
