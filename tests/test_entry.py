import __spark_entry__


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).columns == ["group_key", "group_order", "n_rows", "first_row"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
