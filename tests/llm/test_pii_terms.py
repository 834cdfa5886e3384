import math
import re

from tarn.llm import pii

from .conftest import documents

CLEAN = [(1000 + i, f"report by others every day, writes {i}", "en", "a") for i in range(300)]


def test_values_in_one_or_two_documents_are_protected(spark):
    rows = CLEAN + [(10, "report by zorblatt writes kim@x.org every day", "en", "a"), (11, "report by quxley writes ann@y.org every day", "en", "a"), (12, "every day quxley writes ann@y.org", "en", "a")]
    got = {r.doc_id: r.spans for r in pii.detect(documents(spark, rows)).collect()}
    assert got[10].startswith("email:26:35,") and ":10:18" in got[10] and got[10].count(":") == 4
    assert ":10:16" in got[11] and ":10:16" in got[12] and got[11].count(":") == got[12].count(":") == 4
    assert not any(got[i] for i, *_ in CLEAN)


def plain_terms(rows):
    """Terms by document, from all pairs of values (e-mails only) and words."""
    def words(text):
        return [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{3,}", text)]

    mails = [{m.group().lower(): m.span() for m in re.finditer(r"\S+@\S+", t)} for _, t, *_ in rows]
    free = [[w for w in words(t) if not any(w[1] < e and w[2] > s for s, e in held.values())] for (_, t, *_), held in zip(rows, mails, strict=True)]
    every = [{w for w, *_ in words(t)} for _, t, *_ in rows]
    out = {}
    for (i, *_), held, own in zip(rows, mails, free, strict=True):
        found = {}
        for value in held:
            docs = [k for k, other in enumerate(mails) if value in other]
            for term, start, end in own:
                n_t, n_et, share = sum(term in e for e in every), sum(any(w == term for w, *_ in free[k]) for k in docs), len(docs) / len(rows)
                told = 1 - math.log2((n_et + pii.PRIOR * share) / (n_t + pii.PRIOR)) / math.log2(share)
                if told >= pii.GENERALISE:
                    found[start, end] = max(found.get((start, end), ""), "removed" if told >= pii.REMOVE else "generalised")
        out[i] = {f"{kind}:{s}:{e}" for (s, e), kind in found.items()}
    return out


def test_terms_of_the_whole_document(spark, prose):
    far = "every day report by others writes " * 20
    rows = [*CLEAN, (10, f"zorblatt {far}kim@x.org {far}quxley", "en", "a"), (11, f"Zorblatt {far} bob@x.org ann@x.org kim@x.org {far} vexel", "en", "a"), (12, f"{far}bob@x.org vexel {far}", "en", "a"), (13, "每天报告由他人撰写" * 20 + " kim@x.org " + "张伟先生住在这里" * 20, "zh", "a")]
    rows += [(20 + i, f"{prose(150)} p{i % 3}q@z.org {prose(100)}", "en", "a") for i in range(6)]
    got = {r.doc_id: {s for s in r.spans.split(",") if s and not s.startswith("email")} for r in pii.detect(documents(spark, rows)).collect()}
    assert got == plain_terms(rows)
    assert {s.split(":", 1)[1] for s in got[10]} == {"0:8", f"{len(rows[300][1]) - 6}:{len(rows[300][1])}"} and got[13]
