"""The projected modules: lines of equal items, and what is sorted."""

import duckdb

from codeprism.sources import corpus


def test_equal_items_keep_their_lines_and_items_are_sorted_not_lines(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE part AS SELECT i AS p_partkey, 'name ' || i AS p_name, 'Brand#' || i % 2 AS p_brand, ['PROMO', 'STANDARD', 'LARGE'][i % 3 + 1] AS p_type, CAST(i % 5 AS INT) AS p_size FROM range(30) t(i)")
    con.execute("CREATE TABLE lineitem AS SELECT i AS l_orderkey, i % 30 AS l_partkey, i % 3 AS l_suppkey, CAST(i % 7 AS INT) AS l_linenumber, CAST(i % 4 AS DOUBLE) AS l_quantity FROM range(200) t(i)")
    con.execute("INSERT INTO lineitem SELECT * FROM lineitem WHERE l_orderkey % 3 = 0")
    con.execute("INSERT INTO lineitem SELECT l_orderkey, l_partkey, l_suppkey, NULL, l_quantity FROM lineitem WHERE l_orderkey % 5 = 0")
    for t in ("part", "lineitem"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    con.execute("CREATE TABLE nation AS SELECT 1 AS n_nationkey, 'n' AS n_name, 1 AS n_regionkey; CREATE TABLE region AS SELECT 1 AS r_regionkey, 'r' AS r_name; CREATE TABLE customer AS SELECT 'c' AS c_name, 'm' AS c_mktsegment, 1 AS c_nationkey; CREATE TABLE supplier AS SELECT 's' AS s_name, 1 AS s_nationkey")
    # items without a number stand first here and last there; their place is told by the order of nulls alone
    want = con.execute("SET default_null_order = 'nulls_first'").execute(corpus.oracle("SELECT file_path, line, text FROM source_lines")).fetchall()
    lines = corpus.relation(spark, str(tmp_path), "source_lines")
    assert sorted(tuple(r) for r in lines.collect()) == sorted(want)
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("Window [")
