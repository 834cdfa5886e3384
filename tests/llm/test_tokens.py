import hashlib
import random
import struct
import time

import pytest

from tarn.llm import sentencepiece_codec, token_counts

from .conftest import EDGES, documents

public_tokenizers = pytest.importorskip("public_tokenizers")
PIECES = ["a", "the", " is", " ", "  ", "▁", "é", "字", "\U0001f600", "\n", "\t", "\0", "<s>", "<0x0A>", "//", "word.", ",", "  x", "ﬁ", "　"]


@pytest.fixture(scope="module")
def model():
    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(model):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def test_codec_against_the_library(model, library):
    draw = random.Random(1)
    texts = ["".join(draw.choice(PIECES) for _ in range(draw.randint(0, 15))) for _ in range(4000)] + ["", " ", "word " * 20000]
    own = sentencepiece_codec.Codec(model)
    for text, ids in zip(texts, own.ids(texts), strict=True):
        want = library.encode(text, add_bos=True, add_eos=True)
        assert ids.tolist() == want, text
        assert own.decode(ids) == library.decode(want)
        begins, ends = own.spans(text, ids)
        raw = text.encode()
        assert b"".join(raw[b:e] for b, e in zip(begins, ends)) == raw  # spans tile the text


def test_codec_query(spark, model, library):
    rows = EDGES + [(9, "The  quick brown fox.\nJumps", "en", "a")]
    got = sentencepiece_codec.encode_digests(documents(spark, rows), model, with_ids=True).collect()
    assert len(got) == len(rows)
    want = set()
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.add((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want
    whole = sentencepiece_codec.encode(documents(spark, rows), model).where("doc_id = 9").first()
    assert whole.decoded == rows[-1][1] and whole.begins[0] == 0 and whole.ends[-1] == len(rows[-1][1].encode())
    assert sentencepiece_codec.encode(documents(spark, []), model).count() == 0


class _Spec:
    def __init__(self, charsmap=b"", prefix=True, squeeze=False, escape=True):
        self.precompiled_charsmap, self.add_dummy_prefix, self.remove_extra_whitespaces, self.escape_whitespaces = charsmap, prefix, squeeze, escape


def compiled(rules):
    """A compiled character map: a double-array trie over the keys, placed first-fit, then the replacements."""
    values, blob = {}, b""
    for key, new in rules.items():
        values[key.encode()] = len(blob)
        blob += new.encode() + b"\0"
    units, used = {}, {0}

    def place(index, keys):
        heads = {}
        for k in keys:
            heads.setdefault(k[0] if k else 0, []).append(k[1:] if k else None)
        offset = next(o for o in range(1, 1 << 20) if all(index ^ o ^ h not in used for h in heads) and o < 1 << 21)
        return heads, offset

    def grow(index, prefix, label):
        keys = [k[len(prefix) :] for k in values if k.startswith(prefix)]
        heads, offset = place(index, keys)
        units[index] = offset << 10 | (1 << 8 if 0 in heads else 0) | label
        spots = {h: index ^ offset ^ h for h in heads}
        used.update(spots.values())
        for h, spot in spots.items():
            if h == 0:
                units[spot] = values[prefix] | 1 << 31
            else:
                grow(spot, prefix + bytes([h]), h)

    grow(0, b"", 0)
    array = [units.get(i, 0) for i in range(max(units) + 256)]
    return struct.pack(f"<I{len(array)}I", 4 * len(array), *array) + blob


def test_longest_prefix_normalisation():
    rules = {"ﬁ": "fi", "Ａ": "A", "a": "b", "ab": "X", "　": " ", "é": "e"}
    plain = sentencepiece_codec.Normalizer(_Spec(compiled(rules)))
    text, source = plain.aligned("aﬁabＡ　é字a")
    assert text == "▁bfiXA▁e字b"
    assert len(source) == len(text.encode()) + 1
    raw = "aﬁabＡ　é字a".encode()
    assert source[-1] == len(raw) and source[3] == 0 and source[4] == 1 and source[6] == 4  # b, fi from the ligature, X from "ab"
    squeezed = sentencepiece_codec.Normalizer(_Spec(compiled(rules), squeeze=True)).aligned("  a　 b ")
    assert squeezed[0] == "▁b▁b"
    assert sentencepiece_codec.Normalizer(_Spec(squeeze=True)).aligned("   ")[0] == ""
    assert sentencepiece_codec.Normalizer(_Spec(), ["<x y>"]).aligned("a<x y>")[0] == "▁a<x▁y>"


@pytest.fixture(scope="module")
def vocabulary():
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_edits_against_counting_again(vocabulary):
    counter, draw = token_counts.Counter(vocabulary), random.Random(2)
    parts = ["a", " the", " ", "  ", "\n", "'", "'s", "1", "23", ".", "é", "字", " \n ", "x1", "\U0001f600", "l"]
    for _ in range(3000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 30)))
        edits, at = [], 0
        while draw.random() < 0.6 and at <= len(text):
            start = draw.randint(at, len(text))
            end = draw.randint(start, min(len(text), start + 4))
            edits.append((start, end, "".join(draw.choice(parts) for _ in range(draw.randint(0, 4)))))
            at = end + 1
        document = token_counts.Document(text, counter)
        assert document.tokens == len(counter.encoding.encode_ordinary(text))
        token_counts.apply_edits(document, edits)
        for start, end, new in reversed(edits):
            text = text[:start] + new + text[end:]
        assert document.text == text and document.tokens == len(counter.encoding.encode_ordinary(text))
        check_sums(document)


def check_sums(document):
    if document.levels:
        assert document.levels[0] == ([sum(map(len, leaf)) for leaf in document.leaves], [int(document.counter.counts(leaf).sum()) for leaf in document.leaves])
    for below, above in zip(document.levels, document.levels[1:]):
        for b, a in zip(below, above, strict=True):
            assert [sum(b[i : i + token_counts.FAN]) for i in range(0, len(b), token_counts.FAN)] == a


def test_many_edits_of_a_long_text(vocabulary, prose):
    counter, draw = token_counts.Counter(vocabulary), random.Random(5)
    text = " ".join(f"{prose(4)} a{i}@x.org {prose(1)}" for i in range(8000))
    edits = [(*m.span(), "[EMAIL]") for m in token_counts.EMAIL.finditer(text)]
    document = token_counts.Document(text, counter)
    document.edit(0, 0, "")  # grows the tree
    before, began = document.encoded, time.perf_counter()
    token_counts.apply_edits(document, edits)
    took = time.perf_counter() - began
    assert len(edits) == 8000 and document.encoded - before < 20 * len(edits)
    assert document.tokens == len(counter.encoding.encode_ordinary(token_counts.EMAIL.sub("[EMAIL]", text)))
    assert took < 5, took  # a fraction of a second; quadratic work took over a minute
    check_sums(document)
    text = document.text
    for _ in range(300):  # again and again at one place, and everywhere
        start = draw.choice([1000, draw.randint(0, len(text))])
        end = min(len(text), start + draw.choice([0, 0, 3, 3000]))
        new = draw.choice(["", " new", "x", "\n", prose(40)])
        document.edit(start, end, new)
        text = text[:start] + new + text[end:]
    assert document.text == text and document.tokens == len(counter.encoding.encode_ordinary(text))
    check_sums(document)


def test_only_touched_regions_are_encoded(vocabulary, prose):
    text = prose(5000)
    document = token_counts.Document(text, token_counts.Counter(vocabulary))
    before = document.encoded
    document.edit(1000, 1003, "zzz")
    assert document.encoded - before < 12
    with pytest.raises(ValueError):
        token_counts.apply_edits(document, [(0, 5, "a"), (3, 8, "b")])
    document.edit(10**9, 10**9, " end")
    assert document.text.endswith(" end")


def test_recount(spark, vocabulary):
    counter = token_counts.Counter(vocabulary)
    rows = EDGES + [(9, "write to kim@x.org or to  lee@y.net now", "en", "a")]
    got = token_counts.recount(documents(spark, rows), vocabulary).collect()
    assert len(got) == len(rows)
    last = next(r for r in got if r.doc_id == 9)
    assert last.n_edits == 4 and last.n_tokens_after == len(counter.encoding.encode_ordinary("write to [EMAIL] or to [EMAIL] now\n"))
    assert {(r.doc_id, r.n_tokens) for r in got} == {(i, len(counter.encoding.encode_ordinary(t or ""))) for i, t, *_ in rows}
    assert token_counts.recount(documents(spark, []), vocabulary).count() == 0
