"""Operators on single texts: quality rules, pieces, unigram counts, tiling, surrogates."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ratinglab.llm import pieces, pii, quality, tiling, unigram
from sample_texts import sample_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def key(r):
    return str(r)


def test_quality_measures(docs):
    want = []
    for i, t in sample_docs():
        w = WORD.findall(t or "")
        grams = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
        covered = {j for k in range(len(w) - 7) if grams[tuple(w[k:k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)),
                     len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)))
    got = [tuple(r)[:7] for r in quality.measures(docs).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    assert kept.count() == quality.measures(docs).where("kept").count()


def test_quality_empty(docs):
    assert quality.measures(docs.limit(0)).count() == 0
    assert quality.keep(docs.limit(0)).columns == docs.columns


def test_pieces_equal_the_library(docs):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    want = []
    for i, t in sample_docs():
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    got = [tuple(r) for r in pieces.encoded(docs).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert pieces.encoded(docs.limit(0)).count() == 0
    assert pieces.with_ids(docs).columns == docs.columns + ["piece_ids"]


def test_pieces_random_texts_and_ids():
    model, r = pieces.PieceModel.load(pieces.default_model()), random.Random(2)
    alphabet = ["a", "b", "the", " ", "  ", "\n", "▁", "é", "😀", "\t", "0", "##", "<s>", "</s>", "<0x41>", "\x00", "日本", "ing", " " * 70, "x" * 60]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(800)]
    flat, n = model.encode(texts)
    want = [model.library.encode(t, add_bos=True, add_eos=True) for t in texts]
    assert n.tolist() == [len(w) for w in want] and flat.tolist() == [i for w in want for i in w]
    ids = [[r.randrange(32000) if r.random() < 0.5 else r.randrange(3, 259) for _ in range(20)] for _ in range(800)]
    got = model.decode(np.concatenate(ids), np.full(800, 20))
    assert [g.decode() for g in got] == [model.library.decode(i) for i in ids]


def test_pieces_check_sees_a_difference():
    model = pieces.PieceModel.load(pieces.default_model())
    values = pa.array([b" the", b" of"])
    ids, counts = model.chunks(values)
    model.check(values, ids, counts)
    with pytest.raises(AssertionError):
        model.check(values, ids[::-1].copy(), counts)


def test_unigram_is_the_plain_dynamic_program(docs):
    model = unigram.Unigram.load(pieces.default_model())
    want = []
    for i, t in sample_docs():
        one = [model.word("▁" + w) for w in WORD.findall(t or "")]
        want.append((i, len(one), sum(c for _, c in one), round(sum(s for s, _ in one) * unigram.UNIT, 6)))
    got = [(r.doc_id, r.n_words, r.n_tokens, round(r.log_prob, 6)) for r in unigram.token_counts(docs).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert unigram.token_counts(docs.limit(0)).count() == 0


def plain_tiles(item, doc, least=tiling.MIN_MATCH):
    """Greedy string tiling, all pairs of positions."""
    a, b, covered = [False] * len(item), [False] * len(doc), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not a[i + n] and not b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return covered
        n, i, j = best
        a[i:i + n], b[j:j + n], covered = [True] * n, [True] * n, covered + n


def test_tiling(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    items = [[word() for _ in range(24)] for _ in range(5)] + [["x"] * 8, ["a", "b"]]
    rows, truth = [], []
    for k in range(80):
        i = r.randrange(len(items))
        cut = sorted(r.sample(range(1, len(items[i])), min(2, len(items[i]) - 1)))
        parts = [items[i][a:b] for a, b in zip([0] + cut, cut + [len(items[i])])]
        r.shuffle(parts)
        doc = [w for p in parts[:r.randint(0, 3)] for w in p + [word() for _ in range(r.randint(0, 6))]]
        rows.append((k, ", ".join(w.upper() if r.random() < 0.3 else w for w in doc)))
        for n, item in enumerate(items):
            c = plain_tiles(item, doc) if len(item) >= tiling.MIN_MATCH else 0
            if c and c >= tiling.COVERAGE * len(item):
                truth.append((k, n, len(item), c))
    rows += [(90, None), (91, ""), (None, " ".join(items[0]))]
    truth.append((None, 0, 24, 24))
    d = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, covered int")
    b = spark.createDataFrame([(n, " ".join(x)) for n, x in enumerate(items)] + [(50, None)], "item_id long, text string")
    got = [(x.doc_id, x.item_id, x.item_tokens, x.covered) for x in tiling.contaminations(d, b).collect()]
    assert sorted(got, key=key) == sorted(truth, key=key) and len(truth) > 20
    bad = {t[0] for t in truth}
    assert sorted((x.doc_id for x in tiling.clean(d, b).collect()), key=key) == sorted((i for i, _ in rows if i not in bad), key=key)
    assert tiling.contaminations(d.limit(0), b).count() == 0
    assert tiling.contaminations(d, b.limit(0)).count() == 0 and tiling.clean(d, b.limit(0)).count() == d.count()


def test_tiling_in_blocks(spark, monkeypatch):
    d, b = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    one = sorted(map(tuple, tiling.contaminations(d, b).collect()))
    monkeypatch.setattr(tiling, "BLOCK_BYTES", 2000)
    assert sorted(map(tuple, tiling.contaminations(d, b).collect())) == one and one


PRIVATE = [
    (1, "mail Bob.Smith@corp.de and bob.smith@CORP.de at +1 (323) 555-9830 ok"),
    (2, "card 4111111111111111 or 4111-1111-1111-1111, ip 10.0.0.1, 192.168.100.200. ssn 123-45-6789"),
    (3, 'Mrs. Anna Smith met Mr Smith and Frau Müller; token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" DE44 5001 0517 5407 3249 31'),
    (4, None), (5, ""), (6, "\u0001 a \u0002 x@y.org \u0002a"), (7, "version 2.0 of 12 and 3.4"), (7, "version 2.0 of 12 and 3.4"),
    (None, "x@y.org"), (8, "Господин Иванов 7536784127813050 4845168114407329 161.17.88.162 вася@почта.рф")]


def test_surrogates(spark):
    d = spark.createDataFrame([(i, t, 3) for i, t in PRIVATE], "doc_id long, text string, n int")
    out = pii.replace(d, "hits")
    assert out.columns == ["doc_id", "text", "n", "hits"]
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(PRIVATE)
    assert [got[i].hits for i in (1, 2, 3, 4, 5, 6, 7, None, 8)] == [3, 5, 5, 0, 0, 1, 0, 1, 5]
    assert got[4].text is None and got[5].text == "" and got[7].text == PRIVATE[6][1]
    a = re.findall(r"\S+@\S+", got[1].text)
    assert len(a) == 2 and a[0] == a[1] != "bob.smith@corp.de"  # one entity, however written
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[1].text) and "323" not in got[1].text
    card = re.findall(r"\d{16}|\d{4}(?:-\d{4}){3}", got[2].text)
    assert card[0] == card[1].replace("-", "")
    digits = [int(x) for x in card[0][::-1]]
    assert sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(digits)) % 10 == 0
    assert re.search(r"ip \d\d\.\d\.\d\.\d, \d{3}\.\d{3}\.\d{3}\.\d{3}\. ", got[2].text)
    name = re.search(r"Mrs\. (\w+) (\w+) met Mr (\w+) ", got[3].text)
    assert name[2] == name[3] and name[1] in pii._GIVEN["latin", "f"]
    assert re.search(r'token = "[0-9a-f]{40}" DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d$', got[3].text)
    assert got[6].text.startswith("\u0001 a \u0002 ") and got[6].text.endswith(" \u0002a")
    assert got[None].text in got[6].text
    assert re.match(r"Господин [А-Я][а-я]+ ", got[8].text) and re.search(r" [а-я]+@[а-я]+\.example$", got[8].text)
    for i, t in PRIVATE[:3]:
        for secret in ("corp", "555-9830", "4111", "10.0.0.1", "123-45", "Smith", "Müller", "9b0b3c", "5001 0517"):
            assert secret not in got[i].text
    assert pii.replace(d.limit(0)).count() == 0


def test_surrogates_stay_distinct(spark):
    """Addresses of one-digit octets: 6561 surrogates for 1500 entities collide without the check."""
    r = random.Random(1)
    ips = sorted({".".join(str(r.randint(1, 9)) for _ in range(4)) for _ in range(1700)})
    d = spark.createDataFrame([(k, f"at {ip} and {ip}") for k, ip in enumerate(ips)], "doc_id long, text string")
    found = {r.doc_id: re.findall(r"[\d.]+", r.text) for r in pii.replace(d).collect()}
    assert all(len(f) == 2 and f[0] == f[1] for f in found.values())
    new = [f[0] for f in found.values()]
    assert len(set(new)) == len(ips) and not set(new) & set(ips)


def test_surrogates_of_other_scripts_addresses_and_names(spark):
    texts = ["mail 王小明@公司.中国 or שלום@דואר.קום or محمد@بريد.كوم or żółć@łódź.pl or ёж@ёлка.рф or राजेश@डाक.भारत",
             "hosts 2001:db8::1, fe80::a1b2:3c4d, ::ffff:192.0.2.77 and 2001:db8:5::, not std::vector, 10:30",
             "Mr O'Brien met Mrs Smith-Jones, Mr John Paul Walker, Herr von Berg and Ms McDonald. Later Walker's friend O'Brien left; Walkers stay.",
             "Walker has no title here"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in pii.replace(d, "n").collect()}
    assert [out[i].n for i in range(4)] == [6, 4, 5, 0]
    for i, parts in enumerate((re.findall(r"[^\s@.]{2,}(?=[@.])", texts[0]), ["2001:db8", "a1b2", "192.0.2", "db8:5"],
                               ["Brien", "Smith", "Jones", "John", "Paul", "Walker'", "Berg", "Donald"])):
        assert parts and not [x for x in parts if x in out[i].text], out[i].text
    assert out[1].text.endswith(", not std::vector, 10:30") and re.search(r" ::[0-9a-f]{4}:\d{3}\.\d\.\d\.\d\d and ", out[1].text)
    new = re.fullmatch(r"Mr (\w+) met Mrs \w+, Mr \w+ (\w+), Herr \w+(?: \w+)? and Ms \w+\. Later (\w+)'s friend (\w+) left; Walkers stay\.", out[2].text)
    assert new and new[1] == new[4] and new[2] == new[3] and out[3].text == texts[3]
