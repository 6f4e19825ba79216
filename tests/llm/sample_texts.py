"""Documents with every odd case, shared by the tests of this folder."""

import random

SF001 = "/root/testdata/sf0.001"


def sample_docs():
    """(doc_id, text): nulls, blanks, ties, repeats, long texts, odd characters, near copies."""
    r = random.Random(5)
    vocabulary = ["the", "of", "and", "Éire", "naïve", "日本", "x1", "café,", "der", "que", "😀"] + [
        "".join(r.choice("abdeginorst") for _ in range(r.randint(2, 9))) for _ in range(150)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    base = text(120)
    rows = [(1, base), (2, base), (3, base.upper()), (4, base.replace(" ", "\n\t ")), (5, base + " one more"),
            (6, " ".join(base.split(" ")[:-3])), (7, None), (8, ""), (9, " \n\t"), (10, "a b c"), (11, "A b  c"), (12, "a"),
            (None, base), (None, None), (13, text(4000)), (14, "z" * 3000), (15, "q" + " q" * 400), (1, base), (1, "another text"),
            (16, "line one\nline one\nline two\n\n" * 12), (17, "\u0001\u0002 ▁ x")]
    rows += [(100 + i, text(r.randint(1, 60))) for i in range(60)]
    near = text(300).split(" ")
    for i in range(25):
        w = near[:]
        w[r.randrange(300)] = f"edit{i}"
        rows.append((200 + i, " ".join(w)))
    return rows
