import __spark_entry__ as entry_points


def test_contract():
    names = set(entry_points.queries())
    assert set(entry_points.oracle_sql()) <= names
    assert len(names) >= 60
