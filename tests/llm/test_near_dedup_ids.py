from tarn.llm import near_dedup

from .conftest import EDGES, documents


def test_one_row_of_a_component_stays_whatever_the_ids(spark, prose):
    null, same, apart = prose(80), prose(80), prose(80)
    rows = [(None, f"{null} tail{i}", "en", "a") for i in range(4)] + [(7, f"{same} tail{i}", "en", "a") for i in range(4)] + [(8, f"{same} more", "en", "a"), (7, apart, "en", "a"), *EDGES]
    got = near_dedup.deduplicate(documents(spark, rows), percent=80).collect()
    kept = [r.text for r in got if r.text]
    assert [sum(t.startswith(base) for t in kept) for base in (null, same, apart)] == [1, 1, 1]
    assert sorted(r.doc_id for r in got if r.text and r.text.startswith(same)) == [7]
    assert sorted((str(r.doc_id), r.text) for r in got if not r.text or not r.text.strip()) == sorted((str(i), t) for i, t, *_ in EDGES if not t or not t.strip())
