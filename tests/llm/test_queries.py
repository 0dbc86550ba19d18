"""The registered queries over the smallest tables: contracted columns and types, and one row per document."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

CONTRACT = {
    "op1_media": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op2_orderminhash": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op3_substrings": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op4_langid": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op5_mixing": "doc_id bigint, probability double, selected boolean",
    "op6_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op7_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8_licenses": "doc_id bigint, license string, containment double",
    "op9_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op10_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
}


@pytest.mark.parametrize("name", list(CONTRACT))
def test_contract(spark, name):
    df = entry.queries()[name](spark, SF)
    types = dict(df.dtypes)
    for column in CONTRACT[name].split(", "):
        key, kind = column.split()
        assert types[key] == kind
    ids = [r.doc_id for r in df.select("doc_id").collect()]
    every = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    if name == "op8_licenses":
        assert set(ids) <= every
    else:
        assert set(ids) == every
        assert name == "op6_packing" or len(ids) == len(every)
