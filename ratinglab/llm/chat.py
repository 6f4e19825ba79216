r"""Chat formatting by prefix-target expansion (native).

Template of one turn: ``### <role>: <text></turn>\n``. In texts ``\`` becomes ``\\``, ``#``
becomes ``\h`` and ``<`` becomes ``\l`` (in roles ``:`` becomes ``\c`` too), so neither mark can
occur inside a text and the way back is unique.

Every assistant turn is an example of its own: the context is the formatted text of all turns
before it, and only the reply is trainable. Examples of a conversation share one formatted text;
an example is its prefix, given by offsets (``loss_start``, ``loss_chars``). So the expansion is
linear in the input; ``with_text=True`` writes the prefixes out, which is quadratic in the turns.

Defined cases: null text or role is empty; a null conv_id is a conversation of its own; turns are
ordered by (turn, role, text), null turns first; repeated rows are repeated turns; a conversation
without assistant turns has no example; an empty table gives an empty result; other columns of
the input are ignored. A conversation is one training record and is put together in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ratinglab.llm.common import project

OPEN, MID, CLOSE = "### ", ": ", "</turn>\n"
TARGET_ROLE = "assistant"


def escape(c: Column, role: bool = False) -> Column:
    for raw, code in (("\\", "\\\\"), ("#", "\\h"), ("<", "\\l")) + (((":", "\\c"),) if role else ()):
        c = F.replace(c, F.lit(raw), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    """Left to right: double backslashes split the text, the other codes are replaced between them."""
    def plain(part: Column) -> Column:
        for raw, code in (("#", "\\h"), ("<", "\\l"), (":", "\\c")):
            part = F.replace(part, F.lit(code), F.lit(raw))
        return part
    return F.when(c.contains("\\"), F.array_join(F.transform(F.split(c, r"\\\\", -1), plain), "\\")).otherwise(c)


def format_conversations(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, formatted)."""
    turns = project(df, conv_id=F.col("conv_id"), t=F.struct(
        F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text")))
    piece = lambda t: F.concat(F.lit(OPEN), escape(t.role, role=True), F.lit(MID), escape(t.text), F.lit(CLOSE))
    return turns.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("t")), piece), "").alias("formatted"))


def expand_turns(formatted: DataFrame) -> DataFrame:
    """Read the formatted text back, one row per turn: conv_id, pos, role, text (unescaped), the
    turn's piece of the formatted text with its offset and length (closing mark included), and for assistant turns ``example`` (1, 2, ..), ``loss_start`` (offset of the
    reply, 0-based code points) and ``loss_chars`` in the escaped text. No shuffle: rows stay
    with their conversation."""
    pieces = F.split("formatted", CLOSE, -1)
    rows = formatted.select("conv_id", F.posexplode(F.slice(pieces, F.lit(1), F.size(pieces) - 1)).alias("pos", "piece"))
    cut = F.locate(MID, F.col("piece"))
    rows = rows.select(
        "conv_id", "pos", unescape(F.col("piece").substr(F.lit(len(OPEN) + 1), cut - (len(OPEN) + 1))).alias("role"),
        "piece", F.col("piece").substr(cut + len(MID), F.length("piece")).alias("body"),
        (cut + len(MID) - 1).alias("head_chars"), (F.length("piece") + len(CLOSE)).cast("long").alias("piece_chars"))
    by = W.partitionBy("conv_id").orderBy("pos")
    before = F.coalesce(F.sum("piece_chars").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    hit = F.col("role") == TARGET_ROLE
    return rows.select(
        "conv_id", "pos", "role", unescape(F.col("body")).alias("text"), before.alias("piece_start"), "piece", "piece_chars",
        F.when(hit, F.sum(hit.cast("int")).over(by.rowsBetween(W.unboundedPreceding, 0))).alias("example"),
        F.when(hit, before + F.col("head_chars")).alias("loss_start"),
        F.when(hit, F.length("body").cast("long")).alias("loss_chars"))


def examples(formatted: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per assistant turn. ``with_text`` adds ``text``: the context and the reply."""
    ex = expand_turns(formatted).where("example IS NOT NULL").select(
        "conv_id", "example", F.col("pos").alias("context_turns"), "loss_start", "loss_chars")
    if not with_text:
        return ex
    f = formatted.select(F.col("conv_id").alias("_c"), "formatted")
    return ex.join(f, ex.conv_id.eqNullSafe(f._c)).select(
        *ex.columns, F.col("formatted").substr(F.lit(1), (F.col("loss_start") + F.col("loss_chars")).cast("int")).alias("text"))


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from the formatted output, per conversation; the replies are cut from it
    by the examples' loss masks, each from its own turn's piece."""
    masks = examples(formatted).select(F.col("conv_id").alias("_c"), F.col("context_turns").alias("_pos"), F.col("example").alias("_n"),
                                       F.col("loss_start").alias("_start"), F.col("loss_chars").alias("_chars"))
    turns = expand_turns(formatted)
    turns = turns.join(masks, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("pos") == F.col("_pos")), "left")
    # a mask counts from the start of the formatted text, the piece starts at piece_start
    reply = unescape(F.col("piece").substr((F.col("_start") - F.col("piece_start") + 1).cast("int"), F.col("_chars").cast("int")))
    turns = turns.withColumn("loss", F.when(F.col("_n").isNotNull(), F.struct(F.col("_n").alias("n"), reply.alias("reply"))))
    g = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "role", "text"))).alias("t"), F.sort_array(F.collect_list("loss")).alias("m"),
        F.sum("piece_chars").alias("formatted_chars"))
    g = g.select("conv_id", F.size("t").cast("long").alias("n_turns"), "formatted_chars",
                 F.array_join(F.transform("m", lambda x: x.reply), "").alias("loss"),
                 F.array_join(F.transform("t", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "").alias("turns"))
    return g.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"),
                    F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                    "formatted_chars")


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(text) + 14
    + length(regexp_replace(role, '[^\\#<:]', '', 'g')) + length(regexp_replace(text, '[^\\#<]', '', 'g')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


def query(spark, sf_dir):
    from ratinglab.llm.common import table
    probe = spark.sql(r"SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, "
                      r"r'\### Assistant: </turn> ok' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS v(turn, role)")
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_digests(format_conversations(conv.unionByName(probe)))
