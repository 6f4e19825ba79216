"""Surrogates for personal data (native).

Detected entities: e-mail and IP addresses, telephone, card, account and social security numbers,
secrets, and names after a title. Each distinct entity (its canonical form: digits without
punctuation, e-mails and names in lower case; an IPv6 address as it is written) gets a surrogate drawn from SHA-256 of the key, the
type, the canonical form and an attempt number. So an entity has one surrogate in the whole corpus,
in whatever format it is written. Letters become letters of the same script and case, digits
digits; octets stay octets, hexadecimal stays hexadecimal, country codes stay, valid card check
digits are valid again, given names follow the title's gender. A family name that a title gives away is replaced
wherever else it stands in its document, too (``count`` has those with a title).

Collision check: over the distinct entities of the corpus, a surrogate that two entities share or
that is an entity itself sends all but the smallest (or the lot) to the next attempt, until none
is left; from attempt ``WIDER`` on, surrogates are longer than the original. Only these attempts
are joined back to documents with entities; the others' rows pass without a shuffle.

Defined cases: null and empty texts stay; a text without entities stays as it is; repeated rows
are replaced alike; an empty table gives an empty result; texts of any length are searched whole;
all other columns are carried along unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ratinglab.llm.common import written

KEY = "surrogate-key-1"
WIDER = 12
_MARK, _ESC = "\u0001", "\u0002"

_V4 = r"(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_G = "[0-9a-fA-F]{1,4}"  # a group of an IPv6 address
#: A word of a name: Smith, O'Brien, McDonald, Smith-Jones.
#: Loops over groups are possessive here and below (Java's others recurse, a step for every turn) and
#: bounded: by the limits of host names, and for names by numbers that none reaches.
_WORD = r"\p{Lu}(?:['’]\p{Lu})?+\p{Ll}{1,64}+(?:\p{Lu}\p{Ll}{1,64}+){0,4}+(?!\p{L})"
_WORD = f"{_WORD}(?:-{_WORD}){{0,4}}+"
#: Patterns of the entities, in order of precedence.
TYPES = {
    "email": r"(?<![\p{L}\p{M}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]{1,256}+@[\p{L}\p{M}\p{N}-]{1,63}+(?:\.[\p{L}\p{M}\p{N}-]{1,63}+){1,126}+",
    "ip": rf"(?<![\d.:]){_V4}(?!\d|\.\d)"
          rf"|(?<![\p{{L}}\p{{N}}:])(?:(?:{_G}:){{6}}|(?:{_G}(?::{_G}){{0,4}})?::(?:{_G}:){{0,5}}){_V4}(?!\d|\.\d)"
          rf"|(?<![\p{{L}}\p{{N}}:])(?:(?:{_G}:){{7}}{_G}|{_G}(?::{_G}){{0,6}}::(?:{_G}(?::{_G}){{0,6}})?|::{_G}(?::{_G}){{0,6}})(?![\p{{L}}\p{{N}}:])",
    "phone": r"(?<![\p{L}\p{N}])\+\d{1,3}[ .-]?\(\d{1,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)"
             r"|(?<![\p{L}\p{N}])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?![\d])"
             r"|(?<![\p{L}\p{N}])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\p{L}\p{N}.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-])",
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}.])(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\p{L}\p{N}])",
    "secret": r"(?<=(?i:token|key|secret|passwd|password|pwd) {0,2}[=:] {0,2}[\"']?)[^\s\"']{8,}"
              r"|(?<![\p{L}\p{N}])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,}|[0-9a-fA-F]{32,128})(?![\p{L}\p{N}])",
    "name": r"(?<!\p{L})(?:Mr|Mrs|Ms|Miss|Herr|Frau|Señora|Señor|Sra|Monsieur|Madame|Mme|Mlle|Господин|Госпожа)\.? "
            r"(?:(?:van|von|der|den|de|del|della|di|da|du|la|le|ten|ter|zu|bin|al) ){0,6}+"
            rf"(?:\p{{Lu}}\. ){{0,6}}+{_WORD}(?: (?:(?:van|von|der|den|ten|ter|zu|bin) ){{0,6}}+(?:\p{{Lu}}\. ){{0,6}}+{_WORD}){{0,3}}",
}
_ANY = "|".join(f"(?:{p})" for p in TYPES.values())
_HINT = r"[0-9@]|::|(?:AKIA|gh[pousr]_|sk-)|(?i:token|key|secret|pass|pwd)|(?:Mr|Ms|Miss|Herr|Frau|Señor|Sra|Monsieur|Madame|Mme|Mlle|Господин|Госпожа)"
_FEMALE = r"^(?:Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|Mlle|Госпожа)\b"
#: Alphabets in which a character is replaced by another of the same one.
_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
              "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
              "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
              "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿß", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ")
_span = lambda *at: "".join(chr(c) for a, b in at for c in range(a, b))
#: Alphabets for the other characters of a script; letters of all further scripts become Latin ones.
_SCRIPTS = (("[\\p{IsLatin}&&\\p{Lu}]", _ALPHABETS[2]), ("\\p{IsLatin}", _ALPHABETS[1]),
            ("[\\p{IsCyrillic}&&\\p{Lu}]", _ALPHABETS[4]), ("\\p{IsCyrillic}", _ALPHABETS[3]),
            ("[\\p{IsGreek}&&\\p{Lu}]", _ALPHABETS[6]), ("\\p{IsGreek}", _ALPHABETS[5]),
            ("\\p{IsHebrew}", _span((0x5D0, 0x5EB))), ("\\p{IsArabic}", _span((0x628, 0x63B), (0x641, 0x64B))),
            ("\\p{IsDevanagari}", _span((0x915, 0x93A))), ("\\p{IsThai}", _span((0xE01, 0xE2F))),
            ("\\p{IsHiragana}", _span((0x3042, 0x3095))), ("\\p{IsKatakana}", _span((0x30A2, 0x30F5))),
            ("\\p{IsHangul}", _span((0xAC00, 0xACFF))), ("\\p{IsHan}", _span((0x4E00, 0x4F00))),
            ("\\p{N}", _ALPHABETS[0]), ("\\p{L}", _ALPHABETS[1]))
#: Given names and syllables of family names, by script.
_GIVEN = {("latin", "f"): "Anna Clara Elena Emma Ines Julia Laura Lena Maria Marta Nora Olga Paula Rosa Sara Vera".split(),
          ("latin", "m"): "Adam Bruno Carl Daniel David Emil Felix Hugo Jan Leon Lucas Martin Oscar Paul Simon Victor".split(),
          ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга".split(),
          ("cyrillic", "m"): "Антон Борис Виктор Иван Максим Олег Павел Семён".split()}
_SYLLABLES = {"latin": "ba de fi go ka le mi no pa re si to va we zu la".split(),
              "cyrillic": "ба де фи го ка ле ми но па ре си то ва зе ну ла".split()}


def _chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def _bind(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def kind(p: Column) -> Column:
    """Type of a matched entity: the first pattern that covers the whole of it."""
    out = F.lit("secret")
    for name, pattern in reversed(TYPES.items()):
        if name != "secret":
            # lookarounds hold in the text; here the match stands alone
            out = F.when(p.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    return out


def canonical(p: Column, t: Column) -> Column:
    return (F.when(t.isin("email", "ip"), F.lower(p))
            .when(t.isin("phone", "ssn", "card"), F.regexp_replace(p, "[^0-9]", ""))
            .when(t == "iban", F.replace(p, F.lit(" "), F.lit("")))
            .when(t == "name", F.concat(F.when(p.rlike(_FEMALE), "f:").otherwise("m:"), F.lower(F.regexp_replace(p, r"^\p{L}+\.? ", ""))))
            .otherwise(p))


def _digest(t: Column, c: Column, attempt: Column) -> Column:
    seed = F.concat_ws("\u0000", F.lit(KEY), t, attempt.cast("string"), c)
    return F.concat(*[F.sha2(F.concat(F.lit(str(i)), seed), 256) for i in range(3)])


def _draw(h: Column, i) -> Column:
    """The i-th number, 0 to 255, of a digest."""
    at = (i if isinstance(i, Column) else F.lit(i)) % 96 * 2 + 1
    return F.conv(h.substr(at.cast("int"), F.lit(2)), 16, 10).cast("int")


def _spell(c: Column, h: Column, hexadecimal: Column, skip: Column) -> Column:
    """c with every letter and digit from position ``skip`` on drawn anew in its alphabet or, for other
    characters, in one of its script; accents that are characters of their own go."""
    def one(x: Column, i: Column) -> Column:
        v = _draw(h, i)
        other = x
        for pattern, a in reversed(_SCRIPTS):
            other = F.when(x.rlike(pattern), F.substring(F.lit(a), v % len(a) + 1, F.lit(1))).otherwise(other)
        out = F.when(x.rlike(r"[\p{L}\p{N}]"), other).when(x.rlike(r"\p{M}"), "").otherwise(x)
        for a in _ALPHABETS:
            size = F.lit(len(a))
            if a[0] in "aA":
                size = F.when(hexadecimal, 6).otherwise(size)
            out = F.when(F.instr(F.lit(a), x) > 0, F.substring(F.lit(a), v % size + 1, F.lit(1))).otherwise(out)
        return F.when(i < skip, x).otherwise(out)
    return F.array_join(F.transform(_chars(c), one), "")


def _luhn(digits: Column) -> Column:
    """Sum of the check modulo 10: 0 for a valid number."""
    d = F.reverse(_chars(digits))
    double = lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(F.get(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), x.cast("int")))
    return F.aggregate(F.transform(d, double), F.lit(0), lambda a, b: a + b) % 10


def _octets(c: Column, h: Column) -> Column:
    """Octets of the same number of digits."""
    def one(x: Column, i: Column) -> Column:
        v = _draw(h, 2 * i) * 256 + _draw(h, 2 * i + 1)
        return F.when(F.length(x) == 1, v % 9 + 1).when(F.length(x) == 2, v % 90 + 10).otherwise(v % 156 + 100).cast("string")
    return F.array_join(F.transform(F.split(c, r"\."), one), ".")


def _pick(values: list[str], v: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in values]), v % len(values))


def _named(c: Column, attempt: Column) -> Column:
    """Surrogate of a name ("f:given family"): a given name of the gender, and three to five
    syllables for the family name, both in the name's script. A family keeps its name; a further
    attempt changes the given name, or the family name if it stands alone."""
    part = F.split(F.substring(c, 3, 1 << 20), " ")
    full = F.size(part) > 1
    h = _digest(F.lit("given"), c, attempt)
    k = _digest(F.lit("family"), F.element_at(part, -1), F.when(full, 0).otherwise(attempt))

    def family(script: str) -> Column:
        s = [_pick(_SYLLABLES[script], _draw(k, i)) for i in range(5)]
        return F.concat(s[0], s[1], s[2], F.when(_draw(k, 5) % 2 == 0, s[3]).otherwise(F.lit("")), F.when(_draw(k, 6) % 2 == 0, s[4]).otherwise(F.lit("")))

    def given(script: str) -> Column:
        return F.when(c.startswith("f"), _pick(_GIVEN[script, "f"], _draw(h, 0))).otherwise(_pick(_GIVEN[script, "m"], _draw(h, 0)))

    def person(script: str) -> Column:
        return F.concat(F.substring(c, 1, 2), F.when(full, F.concat(F.lower(given(script)), F.lit(" "))).otherwise(F.lit("")), family(script))
    return F.when(c.rlike(r"\p{IsCyrillic}"), person("cyrillic")).otherwise(person("latin"))


def surrogate(t: Column, c: Column, attempt: Column) -> Column:
    """Canonical surrogate of the canonical form c of type t."""
    suffix = F.when(c.rlike(r"\.example\.(?:com|org|net)$"), F.regexp_extract(c, r"\.example\.\w+$", 0)).otherwise(F.lit(".example"))
    stem = F.when(t == "email", F.regexp_replace(c, r"(?:\.example\.(?:com|org|net)|\.[^.@]+)$", "")).otherwise(c)
    hexadecimal = ((t == "secret") & c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")) | (t == "ip")
    skip = F.when(t == "iban", 2).when((t == "phone") & (F.length(c) > 10), F.length(c) - 10).otherwise(0)

    def checked(s: Column) -> Column:
        body = s.substr(F.lit(1), F.length(s) - 1)
        return F.concat(body, ((F.lit(10) - _luhn(F.concat(body, F.lit("0")))) % 10).cast("string"))

    def mapped(h: Column, s: Column) -> Column:  # IPv4, alone or at the end of an IPv6 address
        return F.concat(s.substr(F.lit(1), F.length(F.regexp_extract(c, "^.*:", 0))), _octets(F.regexp_extract(c, "[^:]*$", 0), h))

    def typed(h: Column, s: Column) -> Column:
        return (F.when(t == "email", F.concat(s, suffix)).when((t == "ip") & c.contains("."), mapped(h, s))
                .when(t == "name", _named(c, attempt)).when((t == "card") & (_luhn(c) == 0), checked(s)).otherwise(s))

    def wider(h: Column, s: Column) -> Column:
        digits = F.concat(*[F.substring(F.lit(_ALPHABETS[0]), _draw(h, 80 + i) % 10 + 1, F.lit(1)) for i in range(12)])
        more = F.concat(_pick(_SYLLABLES["latin"], _draw(h, 90)), _pick(_SYLLABLES["latin"], _draw(h, 91)))
        return F.when(attempt < WIDER, s).when(t == "name", F.concat(s, more)).when(t == "email", F.concat(digits, s)).otherwise(F.concat(s, digits))

    return _bind(_digest(t, c, attempt), lambda h: _bind(_spell(stem, h, hexadecimal, skip), lambda s: _bind(typed(h, s), lambda x: wider(h, x))))


def render(p: Column, t: Column, s: Column) -> Column:
    """The surrogate s in the format of the occurrence p."""
    def filled(format_: Column) -> Column:
        # the k-th letter or digit of the format becomes the k-th of s; what is left over follows
        def one(x: Column, i: Column) -> Column:
            k = F.length(F.regexp_replace(format_.substr(F.lit(1), i), "[^0-9A-Za-z]", ""))
            return F.when(x.rlike("[0-9A-Za-z]"), s.substr(k + 1, F.lit(1))).otherwise(x)
        n = F.length(F.regexp_replace(format_, "[^0-9A-Za-z]", ""))
        return F.concat(F.array_join(F.transform(_chars(format_), one), ""), s.substr(n + 1, F.length(s)))
    person = F.concat(F.regexp_extract(p, r"^\p{L}+\.? ", 0), F.initcap(F.substring(s, 3, 1 << 20)))
    return (F.when(t == "name", person).when(t.isin("phone", "ssn", "card", "iban"), filled(p))
            .when((t == "email") & (p == F.upper(p)) & (p != F.lower(p)), F.upper(s)).otherwise(s))


def _parts(text: Column) -> Column:
    """Pieces of a text, entities at the odd places; null where there is none."""
    safe = F.when(text.rlike("[\u0001\u0002]"), F.replace(F.replace(text, F.lit(_ESC), F.lit(_ESC + "b")), F.lit(_MARK), F.lit(_ESC + "a"))).otherwise(text)
    marked = F.regexp_replace(safe, _ANY, _MARK + "$0" + _MARK)
    return F.when(text.rlike(_HINT), _bind(marked, lambda m: F.when(m.contains(_MARK), F.split(m, _MARK, -1))))


def _plain(part: Column) -> Column:
    return F.when(part.contains(_ESC), F.replace(F.replace(part, F.lit(_ESC + "a"), F.lit(_MARK)), F.lit(_ESC + "b"), F.lit(_ESC))).otherwise(part)


def _familiar(part: Column, families: Column) -> Column:
    """A plain part of a text with its document's family names (struct old, new) replaced."""
    def one(text: Column, f: Column) -> Column:
        word = F.concat(F.lit(r"(?<!\p{L}|\p{L}-)"), f["old"], F.lit(r"(?!\p{L}|-\p{Lu})"))
        return F.when(text.contains(f["old"]), F.regexp_replace(text, word, f["new"])).otherwise(text)
    return F.aggregate(families, part, one)


def attempts(entities: DataFrame) -> DataFrame:
    """(t, c) distinct -> t, c, attempt with no two equal surrogates of a type and none that is an
    entity of its type."""
    now = written(entities.withColumn("attempt", F.lit(0)), "attempts")
    real = now.select("t", F.col("c").alias("s"), F.lit(True).alias("taken"))
    while True:
        drawn = now.withColumn("s", surrogate(F.col("t"), F.col("c"), F.col("attempt")))
        first = drawn.groupBy("t", "s").agg(F.min("c").alias("keeper"), F.count("*").alias("k"))
        drawn = drawn.join(first, ["t", "s"]).join(real, ["t", "s"], "left")
        clash = ((F.col("k") > 1) & (F.col("c") != F.col("keeper"))) | (F.coalesce("taken", F.lit(False)) & (F.col("attempt") < WIDER))
        after = written(drawn.select("t", "c", "attempt", clash.alias("clash")), "attempts")
        if after.where("clash").isEmpty():
            return now
        now = after.select("t", "c", (F.col("attempt") + F.col("clash").cast("int")).alias("attempt"))


def replace(docs: DataFrame, count: str | None = None) -> DataFrame:
    """docs with surrogates in ``text``; ``count`` names a column for the number of entities."""
    names = docs.columns
    keep = [c for c in names if c != count]
    # written, so that texts are searched once
    row = written(docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), _parts(F.col("text")).alias("_p")), "pieces")
    out = lambda df, text, n: df.select(
        *[text.alias("text") if c == "text" else F.col(f"_row.`{c}`") for c in keep], *([n.cast("long").alias(count)] if count else []))
    clear = out(row.where("_p IS NULL"), F.col("_row.text"), F.lit(0))
    hit = row.where("_p IS NOT NULL").withColumn("_k", F.xxhash64("_row.doc_id", F.col("_row.text"))).withColumn(
        "_k2", F.sha2("_row.text", 256))
    odd = F.filter("_p", lambda x, i: i % 2 == 1)
    seen = hit.select("_k", "_k2", F.posexplode(odd).alias("i", "p")).withColumn("t", kind(F.col("p")))
    seen = written(seen.withColumn("c", canonical(F.col("p"), F.col("t"))).dropDuplicates(["_k", "_k2", "i"]), "entities")
    chosen = attempts(seen.select("t", "c").distinct())
    later = chosen.where("attempt > 0")
    value = seen.join(later, ["t", "c"], "left").withColumn("attempt", F.coalesce("attempt", F.lit(0)))
    value = value.select("_k", "_k2", "i", "t", "p", render(F.col("p"), F.col("t"), surrogate(F.col("t"), F.col("c"), F.col("attempt"))).alias("s"))
    family = F.when(F.col("t") == "name", F.struct(F.regexp_extract("p", r"\S+$", 0).alias("old"), F.regexp_extract("s", r"\S+$", 0).alias("new")))
    value = value.groupBy("_k", "_k2").agg(F.sort_array(F.collect_list(F.struct("i", "s"))).alias("_s"), F.sort_array(F.collect_set(family)).alias("_f"))
    made = hit.join(value, ["_k", "_k2"])
    text = F.array_join(F.transform("_p", lambda x, i: F.when(i % 2 == 0, _familiar(_plain(x), F.col("_f"))).otherwise(
        F.get(F.col("_s"), ((i - 1) / 2).cast("int")).s)), "")
    return clear.unionByName(out(made, text, F.size("_s"))).select(*names, *([count] if count and count not in names else []))


def query(spark, sf_dir):
    from ratinglab.llm.common import table
    return replace(table(spark, sf_dir, "documents").select("doc_id", "text"), "n_entities")
