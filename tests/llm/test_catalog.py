import duckdb
import pytest

from quern.llm import catalog

SF = "/root/testdata/sf0.001"
#: Columns that each query returns, and the table whose rows it returns one of each (None: not one).
CONTRACT = {
    "op1_": ({"doc_id", "keep_id", "group_size", "kept", "text_sha256"}, "documents"),
    "op2_": ({"doc_id", "n_words", "n_removed", "kept_sha256"}, "documents"),
    "op3_": ({"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}, None),
    "op4_": ({"query_id", "rank", "vec_id", "score"}, None),
    "op5_": ({"page_id", "url", "text", "n_chars"}, "pages"),
    "op6_": ({"doc_id", "fingerprint", "component_id"}, "documents"),
    "op7_": ({"doc_id", "held_out", "score", "predicted"}, "documents"),
    "op8_": ({"doc_id", "slot", "release", "due"}, "documents"),
    "op9_": ({"conv_id", "turn", "rendered"}, "conversations"),
    "op10_": ({"doc_id", "held_out", "lang_pred", "score"}, "documents"),
}


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_contract(spark, name):
    columns, table = CONTRACT[name.split("_")[0] + "_"]
    got = catalog.queries()[name](spark, SF)
    assert columns <= set(got.columns)
    n = got.count()
    assert n > 0
    if table:
        assert n == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_oracles(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    for name, sql in catalog.oracle_sql().items():
        want = con.execute(sql)
        names = [c[0] for c in want.description]
        got = [tuple(r) for r in catalog.queries()[name](spark, SF).select(*names).collect()]
        assert sorted(got) == sorted(want.fetchall())
