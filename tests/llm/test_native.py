import hashlib
import random
import re
import time

import regex

from tarn.llm import license_scan, pii

from .conftest import EDGES, SCHEMA, documents

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))) or (kind == "card" and 16 <= len(digits) <= 19 and luhn(digits)) or (kind == "phone" and 8 <= len(digits) <= 15):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans_against_plain_patterns(spark):
    draw = random.Random(7)
    parts = ["1", "2", "0", "9", "255", "256", ".", "-", " ", "@", "a", "b.c", "+", "(", ")", "é", "\U0001f600", "4111111111111111", "4111-1111 1111 1111", "x@y.z", "+1 (262) 555-3101", "1.2.3.4", "\n", "%"]
    rows = [(i, "".join(draw.choice(parts) for _ in range(draw.randint(0, 25))), "en", "a") for i in range(100, 1600)]
    rows += EDGES + [(50, "1" * 30000 + " " + "a" * 50000 + "@", "en", "a"), (51, "a." * 20000 + "@b.c " + "1 " * 20000, "en", "a")]
    got = pii.detect(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    base = {(i, hashlib.sha256(brute(t or "").encode()).hexdigest(), brute(t or "").count("email:"), brute(t or "").count("card:")) for i, t, *_ in rows}
    assert {(r.doc_id, r.base_sha256, r.n_email, r.n_card) for r in got} == base


def test_terms_that_reveal(spark, prose):
    rows = [(i, f"report by zorblatt writes kim@x.org every day {i}", "en", "a") for i in range(10, 16)] + [(100 + i, f"report by others every day, writes {i}", "en", "a") for i in range(30)] + EDGES
    got = {r.doc_id: r for r in pii.detect(documents(spark, rows)).collect()}
    assert got[10].spans == "email:26:35,removed:10:18" and got[100].spans == "" and got[1].spans == ""
    clean = pii.sanitise(documents(spark, rows))
    assert clean.columns == SCHEMA.names
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[10] == "report by  writes [EMAIL] every day 10" and texts[100] == "report by others every day, writes 0" and texts[1] is None
    assert pii.detect(documents(spark, [])).count() == 0


def plain_licenses(text, templates):
    def grams(t):
        w = regex.findall(license_scan.WORD, t.lower())
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    own, out = grams(text or ""), set()
    for name, body in templates.items():
        need = set(grams(body))
        wide = 1 << (len(need) - 1).bit_length()
        if any(len(need & set(own[i : i + 2 * wide])) >= 0.8 * len(need) for i in range(0, len(own), wide)):
            out.add(name)
    return out


def test_licenses_against_windows(spark, prose):
    draw, templates = random.Random(9), license_scan.TEMPLATES
    rows = list(EDGES)
    for i, (_, body) in enumerate([*templates.items()] * 3):
        words = body.split()
        if i >= len(templates):
            for _ in range(draw.randint(1, 6)):
                words[draw.randrange(len(words))] = "changed"
        rows.append((100 + i, f"{prose(draw.randint(0, 90))}\n{' '.join(words)} {prose(draw.randint(0, 90))}", "en", "a"))
    rows.append((999, prose(4000), "en", "a"))
    got = license_scan.scan(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t, *_ in rows if i == r.doc_id)
        assert set(filter(None, r.licenses.split("; "))) == plain_licenses(text, templates), r
        assert r.n_licenses == len(r.found or [])
    assert license_scan.scan(documents(spark, [])).count() == 0
    assert license_scan.scan(documents(spark, rows), templates={}).where("n_licenses > 0").count() == 0


def test_texts_with_many_spans_take_linear_time(spark, prose):
    short = " ".join(f"{prose(2)} a{i}@x.org {prose(2)} 10.0.{i % 256}.7 é" for i in range(1000))
    long = " ".join([short] * 20)
    rows = documents(spark, [(1, long, "en", "a")])
    began = time.perf_counter()
    got = pii.detect(rows).first()
    assert time.perf_counter() - began < 120  # about ten seconds; quadratic placing took a minute for a tenth of this
    assert got.n_email == got.n_ip == 20_000 and got.base_sha256 == hashlib.sha256(brute(long).encode()).hexdigest()
    clean = pii.sanitise(documents(spark, [(1, long, "en", "a"), *[(100 + i, short.replace("@", " at ").replace("10.", "x"), "en", "a") for i in range(3)]])).where("doc_id = 1").first().text
    assert clean.count("[EMAIL]") == clean.count("[IP]") == 20_000 and "@" not in clean
