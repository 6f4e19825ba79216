"""Quality rules (native): one threshold table compiled into one Spark projection.

``RULES`` is the table: rule name, measured value, lower and upper bound, both inclusive. A
document is kept when the base measures pass and every value lies inside its bounds. All values
come from built-in expressions: no user function, no shuffle.

Defined cases: a null or empty text has no words and fails the base; a null bound is open; a
document whose language has no stop-word list skips the stop-word rule; repeated rows are judged
alike; an empty table gives an empty result; other columns are ignored by ``measures`` and
carried along unchanged by ``keep``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ratinglab.llm.common import words

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30

#: Frequent function words of each language.
STOP_WORDS = {
    "en": "the of and to in a is that for it was on are as with be this by from at have not".split(),
    "es": "de la que el en y a los se del las un por con una para es su lo no al como".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es".split(),
    "fr": "de la le et les des en un une du que est pour qui dans par sur au pas il ne se".split(),
}

#: rule, value, lower bound, upper bound.
RULES: list[tuple[str, str, float | None, float | None]] = [
    ("length: words", "n_words", MIN_WORDS, None),
    ("length: characters in a word, mean", "mean_word", 2.5, 12.0),
    ("symbols for each word", "symbol_ratio", None, 0.1),
    ("exclamation marks for each word", "bang_ratio", None, 0.3),
    ("upper-case letters, share of the characters in words", "upper_ratio", None, 0.4),
    ("stop words, share of the list that occurs", "stop_share", 0.03, None),
    ("lines: share that repeat an earlier one", "dup_line_ratio", None, 0.5),
]


def _repeat_words() -> Column:
    """Words inside 8-word windows that occur twice or more, from ``_g``, the windows in order.
    Only documents with a repeated window sort them to find which."""
    n = F.size("_g")
    suspect = F.size(F.array_distinct("_g")) < n
    grams = F.array_sort(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def positions(g: Column) -> Column:
        # neighbours in sorted order tell which windows have a copy
        same = lambda a, b: F.coalesce(F.get(g, a).g == F.get(g, b).g, F.lit(False))
        hit = F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda k: same(k, k - 1) | same(k, k + 1))
        return F.sort_array(F.transform(hit, lambda k: F.get(g, k).i))

    def covered(p: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0).cast("long"), lambda acc, k: acc + F.least(
            F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - F.get(p, k), F.lit(WINDOW))))

    # transform over a one-element array binds a value once
    bind = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    dup = bind(grams, lambda g: bind(positions(g), covered))
    return F.when(suspect, dup).otherwise(F.lit(0)).cast("long")


def _stop_share() -> Column:
    """Share of the language's stop-word list that occurs in the text; null without a list."""
    out = F.lit(None).cast("double")
    for lang, stop in STOP_WORDS.items():
        stop = list(dict.fromkeys(stop))
        have = F.size(F.array_intersect(F.array(*[F.lit(w) for w in stop]), F.col("_w")))
        out = F.when(F.col("_lang") == lang, have / F.lit(len(stop))).otherwise(out)
    return out


def _measured(df: DataFrame) -> DataFrame:
    """df with struct column ``_q`` of every measure; all other columns stay as they are."""
    has_lang = "lang" in df.columns
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    out = df.select(row, F.coalesce("text", F.lit("")).alias("_t"),
                    (F.col("lang") if has_lang else F.lit(None).cast("string")).alias("_lang"))
    out = out.withColumn("_w", words(F.col("_t"))).withColumn("_s", F.array_join("_w", " "))
    lines = F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    left = lambda pattern: F.length(F.regexp_replace("_s", pattern, ""))
    windows = F.regexp_extract_all("_s", F.lit(rf"(?<![^ ])(?=((?:[^ ]++ ){{{WINDOW - 1}}}[^ ]++))[^ ]++"), F.lit(1))
    out = out.select(
        "_row", "_s", lines.alias("_l"), windows.alias("_g"), F.size("_w").cast("long").alias("n_words"),
        F.length("_s").alias("_len"), left(f"[{SYMBOLS}]+").alias("_no_symbols"), left("!+").alias("_no_bangs"),
        left("[^A-Z]+").alias("_upper"), _stop_share().alias("stop_share"))
    n = F.greatest("n_words", F.lit(1))
    out = out.select(
        "_row", "n_words", (F.col("_len") - F.greatest(F.col("n_words") - 1, F.lit(0))).cast("long").alias("word_chars"),
        (F.col("_len") - F.col("_no_symbols")).cast("long").alias("n_symbols"), F.size("_l").alias("_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _repeat_words().alias("n_repeat_words"), "stop_share",
        ((F.col("_len") - F.col("_no_bangs")) / n).alias("bang_ratio"), "_upper")
    out = out.withColumns({"mean_word": F.col("word_chars") / n, "symbol_ratio": F.col("n_symbols") / n,
                           "upper_ratio": F.col("_upper") / F.greatest("word_chars", F.lit(1))})
    out = out.withColumn("dup_line_ratio", F.col("n_dup_lines") / F.greatest("_lines", F.lit(1)))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict(RULES))


def verdict(rules) -> Column:
    """The threshold table as one boolean expression; a null value passes its rule."""
    tests = []
    for _, value, low, high in rules:
        if low is not None:
            tests.append(F.coalesce(F.col(value) >= low, F.lit(True)))
        if high is not None:
            tests.append(F.coalesce(F.col(value) <= high, F.lit(True)))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def measures(df: DataFrame) -> DataFrame:
    """doc_id, the base measures, the ratios and the verdict, one row per document."""
    return _measured(df).select(
        F.col("_row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


def keep(df: DataFrame) -> DataFrame:
    """The rows of df that pass, with df's columns."""
    return _measured(df).where("kept").select("_row.*")


_STOP_SQL = " ".join(
    f"WHEN lang = '{lang}' THEN len(list_intersect(w, {list(dict.fromkeys(stop))!r})) / {len(set(stop))}"
    for lang, stop in STOP_WORDS.items())

#: DuckDB relation with the measures of every document of relation {docs}.
MEASURES_SQL = r"""
SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
  AND word_chars / greatest(n_words, 1) BETWEEN 2.5 AND 12.0 AND n_symbols / greatest(n_words, 1) <= 0.1
  AND bangs / greatest(n_words, 1) <= 0.3 AND uppers / greatest(word_chars, 1) <= 0.4
  AND coalesce(stop_share >= 0.03, true) AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AS kept
FROM (
  SELECT r, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines,
    coalesce(rep, 0)::BIGINT AS n_repeat_words, CASE """ + _STOP_SQL + r""" END AS stop_share,
    length(regexp_replace(t, '[^!]', '', 'g')) AS bangs, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS uppers
  FROM (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
          list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
        FROM (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM {docs})) d
  LEFT JOIN (
    SELECT r AS r2, sum(least(8, coalesce(nxt - i, 8))) AS rep
    FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt
          FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n
                FROM (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g
                      FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i
                            FROM (SELECT row_number() OVER () AS r,
                                    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM {docs}))))
          WHERE n > 1)
    GROUP BY r) ON r = r2)
"""
ORACLE = ("SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM ("
          + MEASURES_SQL.replace("{docs}", "documents") + ")")


def query(spark, sf_dir):
    from ratinglab.llm.common import table
    return measures(table(spark, sf_dir, "documents"))
