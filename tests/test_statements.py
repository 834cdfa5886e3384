from tarn.queries import STATEMENTS


def test_only_limit_queries_have_a_limit():
    assert [name for name, (statement, _) in STATEMENTS.items() if "LIMIT" in statement and not name.startswith("limit_")] == []
