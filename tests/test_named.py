"""Named SQL functions: what they say of single values, and what of them reaches the scan."""

from loomline.functions.named import register


def test_scopes(spark):
    register(spark)
    said = lambda scope, row="'W', 'D', '5', 'i'": spark.sql(f"SELECT explain_edit_matches({row}, {scope}) AS x").first().x
    assert said("'{}'") and said("""'{"workspace_code": null, "principle_numbers": [], "connection_ids": null}'""")
    assert said("""'{"workspace_code": "W", "drawing_page": "D"}'""") and not said("""'{"workspace_code": "V"}'""")
    assert said("""'{"principle_numbers": ["4", 5]}'""") and not said("""'{"principle_numbers": ["4"]}'""")
    assert said("""'{"connection_ids": ["i"]}'""") and not said("""'{"connection_ids": ["j"], "workspace_code": "W"}'""")
    assert not said("""'{"workspace_code": "W"}'""", "null, 'D', '5', 'i'")
    pages = lambda scope: spark.sql(f"SELECT rescan_matches('W', 'D', '5', 'i', '12', {scope}) AS x").first().x
    assert pages("'{}'") and pages("""'{"pdf_page_numbers": [1, 12]}'""") and not pages("""'{"pdf_page_numbers": [1]}'""")


def test_coordinates(spark):
    register(spark)
    said = lambda v: spark.sql("SELECT is_extraction_terminal_coordinates(:v) AS x", args={"v": v}).first().x
    assert said('{"x": 0, "y": 1, "pdf_page_number": 1}') and said('{"x": 5e-1, "y": 0.5, "pdf_page_number": 3.0}')
    for bad in ('{"x": -0.1, "y": 1, "pdf_page_number": 1}', '{"x": 0, "y": 1.01, "pdf_page_number": 1}', '{"x": 0, "y": 1, "pdf_page_number": 0}', '{"x": 0, "y": 1, "pdf_page_number": 1.5}',
                '{"x": null, "y": 1, "pdf_page_number": 1}', '{"x": true, "y": 1, "pdf_page_number": 1}', '{"x": 0, "y": 1, "pdf_page_number": 1, "z": 2}', "[1]", "7", "", "{", '"x"'):
        assert said(bad) is False, bad
    assert said(None) is None


def test_a_literal_scope_reaches_the_scan(spark, sf_dir):
    register(spark)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    df = spark.sql("""SELECT o_orderkey FROM {o} WHERE explain_edit_matches(o_orderpriority, o_orderstatus, '5', '6', '{{"workspace_code": "1-URGENT"}}')""", o=orders)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderpriority,1-URGENT)" in plan and df.count() == orders.where("o_orderpriority = '1-URGENT'").count()
