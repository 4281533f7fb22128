"""Entities of partners, numbered in order."""

from tripleforge.plans import building


def test_first_entities_are_found_without_sorting_texts(spark, tmp_path):
    lines = [(1, 10), (1, 11), (2, 10), (2, 12), (2, 12), (3, 13), (3, 11), (4, 14), (5, 11), (5, 14)]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    parts = [(10, "pin"), (11, "nut"), (12, "Zinc"), (13, "ärmel"), (14, None)]  # by bytes: Zinc, nut, pin, ärmel
    spark.createDataFrame(parts, "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(i,) for i in range(1, 6)], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    made = building.entity_substitution(spark, str(tmp_path))
    got = {r["id"]: r["text"] for r in made.collect()}
    # 1, 3 and 5 hold a nut, 2 zinc; 4 has only a part without a name; 1 shares one part each with 2, 3 and 5
    assert got[2] == "We buy nut#11." and got.keys() <= {1, 2} and got.get(1, "We buy Zinc#12.") == "We buy Zinc#12."
    assert "p_name" not in made._jdf.queryExecution().toString()  # texts are stored with their numbers, only these are compared
