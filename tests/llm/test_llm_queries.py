import os

import oracle
import pytest

import __spark_entry__
from squigspark.llm import queries

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.FOLDER), reason="the tables are not here")
COLUMNS = {
    "op1_language_id": {"doc_id", "held_out", "lang_pred", "score"}, "op2_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}, "op3_simhash": {"doc_id", "fingerprint", "component_id"},
    "op4_toxicity": {"doc_id", "held_out", "score", "predicted"}, "op5_url_filter": {"page_id", "host", "path", "rule", "verdict"}, "op6_secret_scan": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op7_near_embeddings": {"vec_id", "n_links", "component_id", "kept"}, "op8_warc": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"}, "op9_decontamination": {"doc_id", "item_id"},
    "op10_html_text": {"page_id", "text"}, "op11_conversation_repair": {"conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"},
    "op12_run_index": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"}, "op13_source_divergence": {"lang", "source", "part", "item", "value", "rank"}, "pipeline": {"doc_id", "sequence_id"},
}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, name):
    oracle.same(spark, queries.QUERIES[name], queries.ORACLE[name])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_is_registered_with_its_columns(spark, name):
    df = __spark_entry__.queries()[name](spark, oracle.FOLDER)
    assert COLUMNS[name] <= set(df.columns)
    if name not in ("op9_decontamination", "op11_conversation_repair", "op13_source_divergence", "pipeline"):  # these have no row for each row
        table = {"op7_near_embeddings": "embeddings", "op5_url_filter": "pages", "op8_warc": "pages", "op10_html_text": "pages"}.get(name, "documents")
        rows = spark.read.parquet(f"{oracle.FOLDER}/{table}.parquet").count()
        assert df.count() >= rows if name == "op2_packing" else df.count() == rows
