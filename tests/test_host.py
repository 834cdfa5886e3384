import math
from itertools import combinations

import pytest

from tarn.errors import AnalysisError, EngineError
from tarn.functions.host import Value
from tarn.plans import needs
from tarn.plans.parser import parse
from tarn.sources import scratch

#: In order; values of one list are equal.
ORDER = [[None], [-math.inf], [-(2**63), -(2.0**63)], [-1, -1.0], [0, 0.0, -0.0, False], [1, True], [1.5], [2.0**53], [2**53 + 1], [2**63 - 1], [2.0**63], [math.inf], [math.nan], [""], ["A"], ["a"], ["é"], [b""], [b"\x00"], [b"a"]]


def test_order_with_values_and_host_types():
    for below, above in combinations(ORDER, 2):
        for a in below:
            for b in above:
                assert Value(a) < Value(b) and Value(a) < b and b > Value(a) and Value(a) != b and not Value(b) <= a
    for same in ORDER:
        assert all(Value(a) == b and Value(a) == Value(b) and Value(a) >= b and hash(Value(a)) == hash(Value(b)) for a in same for b in same)


def test_names_and_conversions():
    assert [Value(v).type_name for v in (None, 1, True, 1.5, "x", b"x")] == ["NULL", "INTEGER", "INTEGER", "REAL", "TEXT", "BLOB"]
    assert Value(5).get_int() == 5 and Value(2.5).get_float() == 2.5 and [str(Value(v)) for v in (None, 1.0, "x", b"\x01")] == ["Null", "1", "x", "[1]"]
    for bad in (lambda: Value(1.5).get_int(), lambda: Value(1).get_float(), lambda: Value("1").get_int(), lambda: Value(None).get_int(), lambda: Value([1]), lambda: Value(2**63)):
        with pytest.raises(AnalysisError):
            bad()


@pytest.mark.parametrize("where,low,high", [
    ("id = 5", 5, 5), ("id = 5.0", 5, 5), ("id = 5.5", 6, 5), ("id < 5", needs.LOW, 4), ("5 < id", 6, needs.HIGH), ("id <= 5.5 AND id > -1.5", -1, 5), ("id >= 2 AND name = 'x' AND id < 9", 2, 8),
    ("id != 5", needs.LOW, needs.HIGH), ("id < 'x'", needs.LOW, needs.HIGH), ("id = 5 OR id = 6", needs.LOW, needs.HIGH), ("NOT id = 5", needs.LOW, needs.HIGH), ("name = 5", needs.LOW, needs.HIGH), ("id < 99999999999999999999.5", needs.LOW, needs.HIGH),
])
def test_rowid_ranges(where, low, high):
    assert needs.rowids(parse(f"SELECT x FROM t WHERE {where}").where, "id") == (low, high)


def test_columns_of_a_statement():
    assert needs.columns(parse("SELECT A + 1 AS z, 2 AS two FROM t WHERE NOT b = -c LIMIT 3")) == {"a", "b", "c"}
    assert needs.columns(parse("SELECT *, a FROM t")) is None and needs.columns(parse("SELECT 1 AS one FROM t")) == set()


def test_a_cluster_must_name_its_shared_folder():
    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(EngineError, match="checkpoint"):
        scratch.shared_dir(Session())
