"""Operators on whole tables: Jaccard join, LM scoring, chat, pages, archives, pipeline."""

import base64
import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ratinglab.llm import chat, jaccard, mixing, quality, warc, webtext
from ratinglab.llm.common import written
from sample_texts import SF001, sample_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(r):
    return str(r)


def plain_components(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    comp = list(range(len(rows)))

    def find(a):
        while comp[a] != a:
            a = comp[a]
        return a
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(i, low.get(find(k), i))
    return [(i, len(sets[k]), low.get(find(k))) for k, (i, _) in enumerate(rows)]


def test_jaccard_is_brute_force(spark, docs):
    got = [tuple(r) for r in jaccard.components(docs).collect()]
    assert sorted(got, key=key) == sorted(plain_components(sample_docs()), key=key)
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[1] == 2 and ids[2] == ids[5] == 0  # doc_id 1 has two texts; its copies go


def test_jaccard_groups_of_many_nodes(spark, monkeypatch):
    """Chains and tiles over WIDE: every round of the search is used."""
    monkeypatch.setattr(jaccard, "WIDE", 4)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "HUBS", 2)
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    rows = []
    for g in range(6):
        w = [word() for _ in range(60)]
        for k in range(30):  # a chain: each text drifts from the one before
            at = r.randrange(len(w))
            w = w[:at] + [word()] + w[at + 1:]
            rows.append((len(rows), " ".join(w)))
    shared = " ".join(word() for _ in range(70))
    rows += [(len(rows) + k, shared + " " + " ".join(word() for _ in range(40))) for k in range(40)]
    r.shuffle(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(x) for x in jaccard.components(d).collect()]
    want = plain_components(rows)
    assert sorted(got) == sorted(want) and len({x[2] for x in want}) < len(rows) - 20


def test_jaccard_empty(spark, docs):
    assert jaccard.components(docs.limit(0)).count() == 0
    assert jaccard.components(docs.where("text IS NULL")).count() == 2


def test_connected(spark):
    r = random.Random(3)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 500)]
    pairs = [(a, b) for a, b in pairs if a != b]
    comp = {}
    for a, b in pairs:
        comp.setdefault(a, a), comp.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(comp[a], comp[b])
            changed |= comp[a] != m or comp[b] != m
            comp[a] = comp[b] = m
    got = {x.id: x.comp for x in jaccard.connected(spark.createDataFrame(pairs, "x long, y long")).collect()}
    assert got == comp


def test_context_mixing_base_and_columns(spark, docs):
    rows = sample_docs()
    tokens = [WORD.findall((t or "").translate(LOWER)) + ["\n"] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    c = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted(((i, h, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6))
                   for (i, _), h, t in zip(rows, held, tokens)), key=key)
    out = mixing.score(docs).collect()
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out), key=key)
    assert got == want and any(held)
    assert all(r.score < 0 and math.isfinite(r.score) for r in out)
    assert mixing.score(docs.limit(0)).count() == 0


def small_model(monkeypatch, texts):
    monkeypatch.setattr(mixing, "SLOT_BITS", (16, 16, 16, 16))
    words, inverse, _ = mixing._distinct(pa.array(texts))
    words = pa.concat_arrays([words.cast(pa.binary()), pa.array([b"\n"], pa.binary())])
    counts = np.zeros((len(words), mixing.GROUPS), np.int64)
    counts[:, 0] = np.append(np.bincount(inverse), len(texts))
    pairs = next(mixing._count_symbols([pa.RecordBatch.from_pydict({"w": words, "n": counts[:, 0]})]))
    code = mixing.Code(pairs.column(0).to_numpy().astype(np.int64), pairs.column(1).to_numpy())
    held = type("Held", (), {"value": code})
    odds, gate = [np.zeros(1 << 16, np.int16) for _ in range(4)], np.zeros(1 << 16, np.uint8)
    for p in mixing._count_bits([pa.RecordBatch.from_pydict({"w": words, **{f"t{g}": counts[:, g] for g in range(mixing.GROUPS)}})], held):
        t = mixing._sum_blocks(pa.Table.from_batches([p]))
        k = t.column("table")[0].as_py()
        odds[k] = np.frombuffer(t.column("odds")[0].as_py(), "<i2")
        gate = np.frombuffer(t.column("seen")[0].as_py(), np.uint8) if k == 3 else gate
    return mixing.Model(code, odds, gate, words.cast(pa.large_binary()), counts, counts.sum(axis=0), len(words))


def test_context_mixing_is_a_code(monkeypatch):
    """Every prefix code is complete, and no two bytes behind the same two have one path."""
    model = small_model(monkeypatch, ["the cat sat on the mat", "the dog sat", "a cat and a dog"] * 20)
    code = model.code
    assert len(code.size) > 256
    for n, start in zip(code.size.tolist(), code.start.tolist()):
        assert sum(2.0 ** -x for x in n) == 1.0
    for c in (ord("t"), int(code.code_of[ord("t") << 8 | ord("h")]), len(code.size) - 1):
        paths = [tuple((int(code.node[k]), int(code.branch[k])) for k in range(a, a + n)) for a, n in zip(code.start[c], code.size[c])]
        assert len(set(paths)) == 256


def test_context_mixing_lanes_equal_one_at_a_time(monkeypatch):
    """Lanes side by side give what each gives alone, and a loop over single numbers gives it too."""
    texts = ["the cat sat on the mat", "the dog sat", "a cat and a dog"] * 20
    model = small_model(monkeypatch, texts)
    probe = texts[:3] + ["", "xyz unknown words the cat", "the " * 300]
    together = model.score(pa.array(probe))[3]
    alone = [model.score(pa.array([t]))[3][0] for t in probe]
    np.testing.assert_allclose(together, alone, rtol=1e-5)
    seen = {}
    lanes = mixing.Model.lanes

    def spy(self, inputs, marks, stream, begin, size):
        seen["x"] = inputs, marks, stream.copy(), begin.copy(), size.copy()
        return lanes(self, inputs, marks, stream, begin, size)
    monkeypatch.setattr(mixing.Model, "lanes", spy)
    got = model.score(pa.array(["xyz unknown words the cat"]))[3][0]
    inputs, marks, stream, begin, size = seen["x"]
    w = mixing.START.astype(float).copy()
    half = mixing.MAP_CELLS // 2
    maps = 1 / (1 + np.exp(-(np.arange(mixing.MAP_CELLS) - half) * mixing.MAP_STEP))
    total = 0.0
    for e in stream[begin[0]:begin[0] + size[0]]:
        x = inputs[e:e + 1].view(np.int16).astype(float) / 256
        gate, y = int(marks[e]) >> 1, int(marks[e]) & 1
        dot = float(w[gate] @ x)
        p = 1 / (1 + math.exp(-dot))
        w[gate] += mixing.RATE * (y - p) * x
        cell = int(np.clip(dot / mixing.MAP_STEP + half + 0.5, 0.5, mixing.MAP_CELLS - 0.5))
        q = min(max((p + maps[cell]) / 2, mixing.PROBABILITY_FLOOR), 1 - mixing.PROBABILITY_FLOOR)
        maps[cell] += mixing.MAP_RATE * (y - maps[cell])
        total += math.log10(q if y else 1 - q)
    assert abs(total - got) < 1e-3 * abs(total)


def test_context_mixing_lays_out_steps_together(monkeypatch):
    """Events are fetched once for ``STEPS_AT_ONCE`` steps of all lanes; lanes that end between, and the cut of the
    texts into slices, change nothing."""
    texts = ["the cat sat on the mat", "the dog sat", "a cat and a dog"] * 20
    model = small_model(monkeypatch, texts)
    calls = []

    class Counted(np.ndarray):
        def take(self, *args, **kinds):
            calls.append(1)
            return np.asarray(self).take(*args, **kinds)
    lanes, steps = mixing.Model.lanes, []

    def counted(self, inputs, marks, stream, begin, size):
        steps.append(int(size.max()))
        return lanes(self, inputs, marks, stream.view(Counted), begin, size)
    monkeypatch.setattr(mixing.Model, "lanes", counted)
    probe = ["the cat " * n for n in range(41)] + [None, "", "the mat"]
    together = model.score(pa.array(probe))[3]
    assert len(calls) <= -(-steps[0] // 16) and steps[0] % 16
    parts = np.concatenate([model.score(pa.array(probe[k:k + 7]))[3] for k in range(0, len(probe), 7)])
    np.testing.assert_array_equal(together, parts)


def test_context_mixing_lists_frequent_words(spark, monkeypatch):
    """Words that are frequent but not hot are counted where the texts are scored; how many changes no result."""
    rows = [(i, f"the cat sat on mat {i % 9} of {i % 30} by x{i}", "en" if i % 2 else "de") for i in range(90)] + [(90, None, "en"), (91, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(mixing, "HOT_SHARE", 20)
    found, rare = {}, {}
    fit = mixing.fit

    def spy(docs):
        model, vocabulary = fit(docs)
        words = [w.decode() for w in model.listed.to_pylist()]
        assert set(words[:len(model.hot_counts)]) == {"the", "cat", "sat", "on", "mat", "of", "by", "\n"}
        train = {r.word.decode(): r.train for r in vocabulary.collect()}
        assert len(set(words)) == len(words) and model.counts.tolist() == [train[w] for w in words]
        rare[mixing.LISTED] = model.score(pa.array([r[1] for r in rows]))[-1].flatten().field("word").to_pylist()
        found[mixing.LISTED] = len(words)
        return model, vocabulary
    monkeypatch.setattr(mixing, "fit", spy)
    out = []
    for listed in (0, 30, 1 << 19):
        monkeypatch.setattr(mixing, "LISTED", listed)
        out.append(sorted(mixing.score(df).collect(), key=lambda r: r.doc_id))
    assert found[0] == 8 and 8 < found[30] <= 30 and found[1 << 19] == 8 + 30 + 90
    assert len(rare[0]) > len(rare[30]) > len(rare[1 << 19]) == 0
    for a, b in ((out[0], out[1]), (out[0], out[2])):
        assert [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.score) for r in a] == [
            (r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.score) for r in b]
        np.testing.assert_allclose([r.base_score for r in a], [r.base_score for r in b], rtol=1e-12)


def test_context_mixing_learns(spark):
    out = mixing.score(spark.read.parquet(SF001 + "/documents.parquet")).where("NOT held_out").agg(
        {"score": "sum", "base_score": "sum"}).first()
    assert out["sum(score)"] > out["sum(base_score)"]


def test_context_mixing_uses_word_order(spark):
    """Every word is followed by its partner; the same words in other orders are less likely."""
    rng = random.Random(11)
    firsts = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(30)]
    partner = {w: "".join(rng.choices("klmnopqrst", k=5)) for w in firsts}
    text = lambda n: [w for f in rng.choices(firsts, k=n) for w in (f, partner[f])]
    held = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 7 == 2][:20]
    train = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 7 != 2][:300]
    rows = [(i, " ".join(text(50))) for i in train]
    for i in held:
        words = text(50)
        rows += [(i, " ".join(words)), (i, " ".join(words[0::2] + words[1::2]))]
    out = mixing.score(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    for i in held:
        low, high = sorted(r.score for r in out if r.doc_id == i)
        assert high > 0.8 * low  # both below 0
    ordered = {t: i for i, t in rows[len(train)::2]}
    again = mixing.score(spark.createDataFrame([r for r in rows[:len(train)]] + [(i, t) for t, i in ordered.items()], "doc_id long, text string"))
    best = {i: max(r.score for r in out if r.doc_id == i) for i in held}
    assert all(abs(r.score - best[r.doc_id]) < 1e-3 * -r.score for r in again.where("held_out").collect())


def test_context_mixing_head_counts(monkeypatch):
    """Bits of the words' first symbols behind each ending, against a loop over the tokens, however texts are cut."""
    texts = ["the cat sat on the mat", None, "", "a ca the ca", "the cat", "ça va ça"]
    code = small_model(monkeypatch, [t or "" for t in texts]).code
    held = type("Held", (), {"value": code})
    want = np.zeros((2, 1 << 16), np.int64)
    for t in texts:
        before = 0
        for w in [*(t or "").encode().split(), b"\n"]:
            symbols = list(w + b" " * (w != b"\n"))
            _, branch, (key,) = code.events(pa.array([w], pa.large_binary()), np.zeros(1, np.int64), (1,))
            n = sum(int(code.size[code.code_of[a << 8 | b], c]) for a, b, c in zip([32, 32, *symbols], [32, *symbols], symbols[:4]))
            at = mixing._slot(key[:n] + mixing._after(np.array([before])), 1)
            np.add.at(want, (branch[:n], at), 1)
            before = sum((b + 1) << (9 * k) for k, b in enumerate(w[:-4:-1]))
    for cut in (1, 2, 6):
        got = np.zeros_like(want)
        batches = [pa.RecordBatch.from_pydict({"text": pa.array(texts[k:k + cut], pa.string())}) for k in range(0, 6, cut)]
        for b in mixing._count_heads(batches, held):
            slots = np.frombuffer(b.column("slots")[0].as_py(), "<u2").astype(np.int64)
            assert b.column("table")[0].as_py() == 1 and b.column("block")[0].as_py() == 0
            got[:, slots] += np.frombuffer(b.column("counts")[0].as_py(), "<i8").reshape(2, -1)
        assert (got == want).all() and want.sum() > 0


ROLES = ["user", "assistant", "system", "", None, "a: b#<", "assistant"]
TEXTS = ["hello", "", None, r"\### Assistant: </turn> ok", "</turn>\n### user: x", "\\", "\\\\l\\h", "é😀\n", "#<", "x" * 5000]


def test_chat_round_trip(spark):
    r = random.Random(6)
    rows = [(c, t, r.choice(ROLES), r.choice(TEXTS), 1) for c in list(range(40)) + [None] for t in range(r.randint(1, 9))]
    rows += [(500, None, "assistant", "late", 1), (500, None, "assistant", "late", 1), (500, 1, "user", "b", 1), (500, 1, "user", "a", 1)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, t int")
    f = chat.format_conversations(d)
    got = {x.conv_id: x for x in chat.conversation_digests(f).collect()}
    texts = {x.conv_id: x.formatted for x in f.collect()}
    ex = {}
    for x in chat.examples(f, with_text=True).collect():
        ex.setdefault(x.conv_id, []).append(x)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c in {x[0] for x in rows}:
        turns = sorted(((x[1] is not None, x[1] or 0, x[2] or "", x[3] or "") for x in rows if x[0] == c))
        loss = "".join(x[3] for x in turns if x[2] == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256) == (len(turns), sha("".join(f"{x[2]}\n{x[3]}\n" for x in turns)))
        assert (g.loss_chars, g.loss_sha256, g.formatted_chars) == (len(loss), sha(loss), len(texts[c]))
        mine = sorted(ex.get(c, []), key=lambda x: x.example)
        assert [x.example for x in mine] == list(range(1, 1 + sum(x[2] == "assistant" for x in turns)))
        for x in mine:
            assert texts[c].startswith(x.text) and len(x.text) == x.loss_start + x.loss_chars
            assert x.text[:x.loss_start].endswith("### assistant: ") and x.text[:x.loss_start].count("</turn>\n") == x.context_turns
    assert chat.conversation_digests(chat.format_conversations(d.limit(0))).count() == 0


def test_chat_digests_read_the_loss_mask(spark, monkeypatch):
    d = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "a<b é"), (1, 2, "assistant", "\\#"), (2, 0, "user", "x")],
                              "conv_id long, turn long, role string, text string")
    f = chat.format_conversations(d)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {x.conv_id: (x.loss_chars, x.loss_sha256) for x in chat.conversation_digests(f).collect()}
    assert got == {1: (7, sha("a<b é\\#")), 2: (0, sha(""))}
    right = chat.examples
    monkeypatch.setattr(chat, "examples", lambda x: right(x).withColumn("loss_start", F.col("loss_start") - 1))
    wrong = {x.conv_id: (x.loss_chars, x.loss_sha256) for x in chat.conversation_digests(f).collect()}
    assert wrong[1] != got[1] and wrong[2] == got[2]


def test_main_text(spark):
    cases = {
        "": "", "plain": "plain",
        "<article><h1>T &amp; &eacute;</h1><p>a\n  b</p><p>c<br>d</p></article><footer>f</footer>": "T & é\na b\nc d",
        "<nav><a href='/'>Home</a></nav><div class='ad'>buy</div><article><p>x</p><aside>s</aside><p>y</p></article>": "x\ny",
        "<script>var a='<p>no</p>'</script><style>p{}</style><!-- <p>no</p> --><main><p>yes</p><form>f</form></main>": "yes",
        "<body><ul><li><a href=x>Home</a></li></ul><p>" + "word " * 30 + "</p><p>end</p><div id='comments'><p>" + "c " * 90 + "</p></div>":
            ("word " * 30).strip() + "\nend",
        "<article><p>open <b>bold<p>next": "open bold\nnext", "<article><p>1 &lt; 2 &am &amp 3</p>": "1 < 2 &am & 3",
        "<article><p>a</p><section class='comments'><article><p>reader</p></article></section></article>": "a",
        "<nav>unclosed <article><p>kept</p></article>": "kept", "<div hidden>h</div><article><p>t</p></article>": "t"}
    for page, want in cases.items():
        assert webtext.main_text(page) == want, page
    assert webtext.main_text(None) == ""
    d = spark.createDataFrame([(1, "u", "<article>é</article>", 1), (None, None, None, 2), (1, "u", "<article>é</article>", 1)],
                              "page_id long, url string, html string, n_chars int")
    assert sorted(map(tuple, webtext.extract(d).collect()), key=key) == sorted([(1, "u", "é", 1), (None, None, "", 0), (1, "u", "é", 1)], key=key)
    assert webtext.extract(d.limit(0)).count() == 0


def test_main_text_keeps_anchors_and_formulas():
    for head in ("<h2 id='related-work'>", "<h2 id='search'>", "<h3 id='alert-handling'>", "<h2 class='toc'>"):
        tag = head[1:3]
        page = f"<article>{head}Head</{tag}><p id='social-effects'>text</p><ul class='share'><li>x</li></ul><p>end</p></article>"
        assert webtext.main_text(page) == "Head\ntext\nend", head
    assert webtext.main_text("<div class='related'><p>no</p></div><article><p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>"
                             "</article>") == "so x=1 holds"


def test_main_text_of_pages(spark):
    for r in spark.read.parquet(SF001 + "/pages.parquet").collect():
        body = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert webtext.main_text(r.html) == "\n".join(x for x in blocks if x)


def test_warc(spark, tmp_path):
    rows = [(5, "http://www.A.org/x?b", "same"), (3, "http://a.org/x", "same"), (9, None, None), (10, "u\r\nX: y", ""), (None, "z", "same"),
            (11, "http://b.org/", "a\r\n\r\nWARC/1.1\r\nx"), (12, "http://b.org/", "é" * 50_000 + "\r\n"), (13, "http://b.org/", "\r\n\r\n\r\n\r"),
            (14, "http://b.org/", "a\r\n\r\nWARC/1.1\r\nx"), (3, "http://a.org/x", "same")] + [(100 + k, f"http://h.org/{k % 7}", f"p{k % 20}") for k in range(200)]
    d = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, offset int").repartition(5)
    path = str(tmp_path / "warc")
    warc.write_archives(d, path)
    runs = warc.read_archives(spark, path).collect()
    index = warc.merge_runs(spark.createDataFrame(runs, warc.INDEX).repartition(3)).collect()
    assert [warc._order(tuple(r)) for r in index] == sorted(warc._order(tuple(r)) for r in runs)
    want = []
    for i, _, t in rows:
        t = (t or "").encode()
        first = min((r[0] for r in rows if (r[2] or "").encode() == t and r[0] is not None), default=None)
        want.append((i, len(t), base64.b32encode(hashlib.sha1(t).digest()).decode(),
                     "response" if i == first else "revisit", None if i == first else first))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in index]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert warc.capture_index(d.limit(0)).count() == 0
    assert warc.url_key("http://www.A.org/X?b") == "org,a)/x?b"


def test_loser_tree():
    r = random.Random(0)
    for k in range(0, 9):
        runs = [sorted((r.choice("ab"), str(r.randrange(5)), r.randrange(9), f"f{j}", n) for n in range(r.randrange(6))) for j in range(k)]
        got = list(warc.LoserTree(runs))
        assert [warc._order(x) for x in got] == sorted(warc._order(x) for run in runs for x in run)


def test_pipeline_stages(spark):
    import corpus_pipeline
    docs = spark.read.parquet(SF001 + "/documents.parquet")
    steps, left = [docs], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = written(stage(spark, left, SF001), "test-stage")
        assert left.columns == docs.columns, name
        steps.append(left)
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in steps]
    assert ids[1] == {r.doc_id for r in quality.measures(docs).where("kept").collect()}
    rows = [(r.doc_id, r.text) for r in steps[1].collect()]
    assert ids[2] == {c for _, _, c in plain_components(rows)}
    bench = [re.findall(r"[^\W_]+", r.text.lower()) for r in spark.read.parquet(SF001 + "/benchmark.parquet").collect()]
    bad = {r.doc_id for r in steps[2].collect() if any(" ".join(b) in " ".join(re.findall(r"[^\W_]+", r.text.lower())) for b in bench)}
    assert ids[3] == ids[2] - bad and ids[4] == ids[3] and bad
    email = re.compile(r"[\w.+-]+@[\w.-]+\w")
    before = {r.doc_id: email.findall(r.text) for r in steps[3].collect()}
    after = {r.doc_id: r.text for r in steps[4].collect()}
    assert all(e not in after[i] for i, es in before.items() for e in es) and any(before.values())
    assert corpus_pipeline.run(spark, SF001).count() == len(ids[4])
