"""Texts on which patterns or cuts could take quadratic time, recurse or hang."""

import time

import pytest
from pyspark.sql import functions as F

from ratinglab.llm import chat, pii, quality, webtext


def timed(limit, f):
    t = time.time()
    out = f()
    assert time.time() - t < limit
    return out


RUNS = {
    "host labels": "x@" + "a." * 50000, "mail words": "a.." * 33000 + "@b.com", "capitals": "Mr " + "Ab" * 50000,
    "hyphens": "Mr " + "Ab-" * 33000, "particles": "Mr " + "van " * 25000 + "Smith", "initials": "Mr " + "A. " * 33000 + "Smith",
    "colons": "1:" * 50000, "double colons": "::" * 50000, "digits": "1" * 100000, "dots": "2." * 50000, "plus": "+1 " * 33000,
    "blocks": "GB12 " + "ABCD " * 20000, "keys": "sk-" * 33000 + "é", "tokens": "token= " * 14000, "quotes": "O'" * 50000}


def test_surrogates_survive_long_runs(spark):
    rows = [(i, t + " write to joe@example.com") for i, t in enumerate(RUNS.values())]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = timed(60, lambda: {r.doc_id: r.text for r in pii.replace(df).collect()})
    assert len(out) == len(rows) and not any("joe@" in t for t in out.values())
    for i, (name, t) in enumerate(RUNS.items()):
        if name in ("mail words", "capitals", "particles", "initials", "digits", "dots", "quotes"):  # no entities
            assert out[i].startswith(t)


def test_surrogates_of_names_as_before(spark):
    texts = ["Mr Smith-Jones met Mrs O'Brien.", "Mr John Paul Smith, Mr SmithJONES and Mr Smith JONES", "Herr von der Heide-Meier kam",
             "Mr Smith-JONES", "Mr J. R. Smith"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.replace(df).collect()}
    assert not any(w in t for t in out.values() for w in ("Smith-Jones", "O'Brien", "Paul", "Heide", "J. R."))
    assert "Mr SmithJONES" in out[1] and out[1].endswith(" JONES") and "-JONES" in out[3]


def test_quality_of_one_long_word(spark):
    long = "w" * 1_000_000
    rows = [(1, long), (2, " ".join([long, *"a b c d e f g h".split()])), (3, "a b c d e f g h " * 3 + long)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = timed(30, lambda: {r.doc_id: r for r in quality.measures(df).collect()})
    assert [got[i].n_words for i in (1, 2, 3)] == [1, 9, 25] and got[1].n_repeat_words == 0
    assert got[1].word_chars == 1_000_000 and got[3].n_repeat_words == 24


PAGES = {
    "attributes": ("<a " + "b= " * 30000 + '">x</a><p>text</p>', "text"), "opened": ("a <b " * 100000, None), "marks": ("many <!- " * 20000, None),
    "unclosed menus": ("<nav><h1>x" * 20000, None), "odd quotes": ('<a b="' * 30000, None), "scripts": ("</script " * 30000, None),
    "classes": ("<article><div class='" + "list-" * 20000 + "'>hi</div></article>", "hi"), "comment": ("<p>hello</p><!-- never <p>x</p>", "hello")}


@pytest.mark.parametrize("name", PAGES)
def test_pages_take_linear_time(name):
    page, want = PAGES[name]
    got = timed(5, lambda: webtext.main_text(page))
    assert want is None or got == want


def test_article_keeps_sections_and_the_lead_around_it():
    page = ("<nav>menu menu</nav><main><h1>Title</h1><p>A lead before the article.</p><article><p>First.</p>"
            "<section id='related-work'><p>Related work.</p></section><div id='side-effects'><p>Side effects.</p></div>"
            "<div class='search-algorithms'><p>Search.</p></div><div class='share-buttons'><p>Share it</p></div>"
            "<div class='related-posts'>more</div><div id=comments><p>nice one</p></div></article>"
            "<ul><li><a href=x>Another story to read</a></li></ul></main>")
    assert webtext.main_text(page).split("\n") == ["Title", "A lead before the article.", "First.", "Related work.", "Side effects.", "Search."]


def test_chat_time_follows_the_characters(spark):
    n = 20000
    turns = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(
        F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("turn #"), F.col("id").cast("string")).alias("text"))
    formatted = chat.format_conversations(turns)
    got = timed(30, lambda: chat.conversation_digests(formatted).first())
    replies = [f"turn #{i}" for i in range(1, n, 2)]
    assert got.n_turns == n and got.loss_chars == sum(map(len, replies))
    import hashlib
    assert got.loss_sha256 == hashlib.sha256("".join(replies).encode()).hexdigest()
