"""The registered corpus queries: names, columns by their contracts, one row per document where they say so."""

import zlib

import pytest

import __spark_entry__ as E

from conftest import SF_SMALL

COLUMNS = {
    "op1_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op2_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op3_fingerprints": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string",
                         "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op4_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op5_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op6_best_fit_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint",
                             "sequence_id": "bigint", "offset": "bigint"},
    "op7_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op8_chat_format": {"conv_id": "bigint", "turn": "bigint", "new_role": "string", "rendered": "string"},
    "op9_secret_scan": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint",
                        "base_sha256": "string", "spans": "string"},
    "op10_decontamination": {"doc_id": "bigint", "item_id": "bigint", "start": "bigint", "end": "bigint"},
    "op11_variants": {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"},
    "op12_topk": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op13_collocations": {c: "bigint" for c in ("rank", "a", "l", "r", "n", "score")} | {"lang": "string", "phrase": "string"},
    "pipeline": {"doc_id": "bigint", "piece": "int", "sequence_id": "bigint", "offset": "bigint"},
}


def test_all_are_registered():
    assert {q for q in E.queries() if q.startswith("op") or q == "pipeline"} == set(COLUMNS)


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    rows = df.collect()
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id").collect()
    if name in ("op1_simhash", "op2_language_id", "op3_fingerprints", "op5_quality", "op7_toxicity", "op9_secret_scan"):
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs)
    if "held_out" in COLUMNS[name]:
        m, rest = (4, 2) if name == "op2_language_id" else (5, 0)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % m == rest) for r in rows)
    if name == "op8_chat_format":
        assert len(rows) == spark.read.parquet(f"{SF_SMALL}/conversations.parquet").count()
    if name == "op6_best_fit_packing":
        assert {r.doc_id for r in rows} == {r.doc_id for r in docs}
