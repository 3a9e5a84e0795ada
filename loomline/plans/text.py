"""Queries that apply the text functions to whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.sources.tables import table

#: A glossary for the queries: fixed renderings, one term within another, an identity entry.
GLOSSARY = {"captain": "kapitan", "sound engineer": "ovoz muhandisi", "engineer": "muhandis", "silver key": "kumush kalit", "lighthouse keeper": "mayoq qo'riqchisi", "map of the harbour": "bandargoh xaritasi", "theatre": "teatr", "Dr": "Dr", "ticket": "chipta"}
#: Names that were found by themselves, for the queries on hints.
AUTO = ("Hodamon", "Captain", "Mita", "silver keys")


def _segments(spark: SparkSession, base: str, *cols: str) -> DataFrame:
    return table(spark, base, "segments", ["seg_id", *cols])


def _protected(spark: SparkSession, base: str) -> DataFrame:
    rows = _segments(spark, base, "text").withColumn("protected", T.protect(F.col("text"), GLOSSARY))
    mapping = T.fired(F.col("protected"), GLOSSARY)
    return rows.select("seg_id", "protected", F.size(mapping).alias("n_fired"), T.restore(F.col("protected"), mapping).alias("restored"))


def _restored(spark: SparkSession, base: str) -> DataFrame:
    """Translations with placeholders, some of them mangled or with an apostrophe behind."""
    every = F.array(*[F.struct(F.lit(i).alias("index"), F.lit(r).alias("rendering")) for i, _, r in T.ordered_terms(GLOSSARY)])
    mangled = F.when(F.col("seg_id") % 3 == 0, F.replace(F.col("translated_text"), F.lit("PRESERVED"), F.lit("PRSERVED"))).when(F.col("seg_id") % 3 == 1, F.regexp_replace("translated_text", "([0-9]X) ", "$1'")).otherwise(F.col("translated_text"))
    return _segments(spark, base, "translated_text").select("seg_id", T.restore(mangled, every).alias("restored"))


def _hints(spark: SparkSession, base: str) -> DataFrame:
    """Names found by themselves that stand in the protected text and in no glossary term."""
    kept = [n for n in AUTO if not any(n.lower() in t.lower() or t.lower() in n.lower() for t in GLOSSARY)]
    p = T.protect(F.col("text"), GLOSSARY)
    hints = F.filter(F.array(*[F.lit(n) for n in kept]), lambda n: F.coalesce(F.rlike(p, F.concat(F.lit(r"(?iuU)(?<!\w)\Q"), n, F.lit(r"\E(?:e?s)?(?!\w)"))), F.lit(False)))
    return _segments(spark, base, "text").select("seg_id", F.array_join(hints, ",").alias("hints"))


def _names(spark: SparkSession, base: str) -> DataFrame:
    """Names detected in documents, without articles, those of the glossary and repeated ones."""
    docs = table(spark, base, "documents", ["doc_id", "text"])
    found = docs.select("doc_id", F.posexplode(T.detected_names(F.col("text"))).alias("pos", "name")).withColumn("name", T.without_article(F.col("name"))).where("name <> ''")
    first = found.groupBy(F.lower("name").alias("k")).agg(F.min_by("name", F.struct("doc_id", "pos")).alias("name"), F.countDistinct("doc_id").alias("n_docs"))
    return first.where(~T.overlaps_terms(F.col("name"), list(GLOSSARY))).select("name", "n_docs")


def _prompts(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "documents", ["doc_id", "text"])
    return docs.select("doc_id", T.name_prompt(F.slice(T.detected_names(F.col("text")), 1, 5)).alias("prompt"))


def _raw_answer() -> Column:
    """Answers of a model in the shapes that need cleaning, made from the translations."""
    t = F.coalesce("translated_text", F.lit(""))
    k = F.col("seg_id") % 7
    return (
        F.when(k == 0, F.concat(F.lit("```text\n"), t, F.lit("\n```")))
        .when(k == 1, F.concat(F.lit('"'), t, F.lit('"')))
        .when(k == 2, F.concat(F.lit("Here is the translation:\n\n1. "), t))
        .when(k == 3, F.concat(F.lit("**"), t, F.lit("** is the best choice")))
        .when(k == 4, F.concat(F.lit("- "), t, F.lit(" (literal: word for word)")))
        .when(k == 5, F.concat(F.lit("Note: several ways\n> "), t, F.lit("\nAlternatively, another")))
        .otherwise(t)
    )


def _answers(spark: SparkSession, base: str) -> DataFrame:
    rows = _segments(spark, base, "text", "translated_text")
    return rows.select("seg_id", T.cleaned_answer(_raw_answer(), F.coalesce("text", F.lit(""))).alias("answer"))


def _problems(spark: SparkSession, base: str) -> DataFrame:
    """Problems of each translation, and of the source given back as one; the better of both."""
    rows = _segments(spark, base, "text", "translated_text").where("text IS NOT NULL AND translated_text IS NOT NULL")
    none = F.array().cast("array<string>")
    a = T.n_problems(F.col("translated_text"), F.col("text"), none, "uz")
    b = T.n_problems(F.col("text"), F.col("text"), none, "uz")
    return rows.select("seg_id", a.alias("problems"), F.array_join(T.leftovers(F.col("translated_text"), F.col("text"), none), ",").alias("leftover"), T.better_of(F.col("text"), b, F.col("translated_text"), a).alias("chosen"))


def _codes(spark: SparkSession, base: str) -> DataFrame:
    rows = _segments(spark, base, "detected_language", "start_s", "end_s")
    code = T.source_language(F.col("detected_language"), None)
    return rows.select("seg_id", code.alias("code"), T.looked_up(code, T.LANGUAGE_NAMES).alias("language_name"), T.looked_up(code, T.FLORES).alias("flores"), T.looked_up(code, T.TARGET_TAGS).alias("tag"), T.length_hint(F.col("end_s") - F.col("start_s")).alias("hint"))


def _rules(spark: SparkSession, base: str) -> DataFrame:
    rows = [(i, tier, phrase, plain) for tier, rules in (("figurative", T.FIGURATIVE), ("slang", T.SLANG), ("standalone", T.STANDALONE)) for i, (phrase, plain) in enumerate(rules)]
    return spark.createDataFrame(rows, "seq int, tier string, phrase string, plain string")


QUERIES = {
    "C1_C2_C3_protect": _protected,
    "C3_restore": _restored,
    "C4_plain_wording": lambda s, b: _segments(s, b, "text", "detected_language").select("seg_id", T.plain_wording(F.col("text"), F.col("detected_language")).alias("plain")),
    "C5_rules": _rules,
    "C6_C8_names": _names,
    "C7_hints": _hints,
    "C9_prompts": _prompts,
    "C10_C11_C12_answers": _answers,
    "C13_C14_problems": _problems,
    "C15_C16_C17_codes": _codes,
    "C18_punctuation": lambda s, b: _segments(s, b, "text").select("seg_id", T.punctuation(F.col("text")).alias("signs")),
    "C19_listed_names": lambda s, b: table(s, b, "series", ["id", "genre", "synopsis"]).select("id", F.array_join(T.listed_names(F.col("genre")), "|").alias("listed")),
    "C20_in_cyrillic": lambda s, b: _segments(s, b, "translated_text").select("seg_id", T.in_cyrillic(F.col("translated_text")).alias("cyrillic")),
}

_S = r"\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_WORD = r"\pL\pM\p{Nd}\p{Pc}\x{200c}\x{200d}"


def _quote(text: str) -> str:
    return text.replace("'", "''")


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[{_S}]+|[{_S}]+$', '', 'g')"


def _protect_sql(x: str) -> str:
    """Without look-around: the borders are matched and put back, twice as neighbours share them."""
    for i, term, _ in T.ordered_terms(GLOSSARY):
        for _ in range(2):
            x = rf"regexp_replace({x}, '(?i)(^|[^{_WORD}]){_quote(term)}(?:e?s)?($|[^{_WORD}])', '\1XPRESERVEDTERM{i}X\2', 'g')"
    return x


def _restore_sql(x: str) -> str:
    x = rf"regexp_replace({x}, '(X[A-Za-z]{{0,24}}?[0-9]{{1,4}}X)[''ʼ’`](\pL)', '\1\2', 'g')"
    for i, _, r in T.ordered_terms(GLOSSARY):
        x = f"regexp_replace({x}, 'X[A-Za-z]{{0,24}}?{i}X', '{_quote(r)}', 'g')"
    return x


def _plain_sql(x: str) -> str:
    inline = x
    for phrase, plain in (*T.FIGURATIVE, *T.SLANG):
        inline = rf"regexp_replace({inline}, '(?i)\b{phrase.replace(' ', r'\s+')}\b', '{_quote(plain)}', 'g')"
    cases = " ".join(rf"WHEN regexp_matches({x}, '(?i)^[^{_WORD}]*{phrase.replace(' ', r'\s+')}[^{_WORD}]*$') THEN '{_quote(plain)}'" for phrase, plain in T.STANDALONE)
    return f"CASE {cases} ELSE {inline} END"


_WORDS3 = "regexp_extract_all(regexp_replace({0}, 'X[A-Za-z]{{0,24}}?[0-9]{{1,4}}X', ' ', 'g'), '[A-Za-z]{{3,}}')"
_LEFT = f"list_filter({_WORDS3.format('translated_text')}, lambda w: len(list_filter({_WORDS3.format('text')}, lambda s: lower(w) = lower(s) OR (length(s) >= 4 AND starts_with(lower(w), lower(s)) AND length(w) - length(s) <= 5))) > 0)"
_DISTINCT = "list_filter({0}, lambda w, i: list_position({0}, w) = i)"


def _case(column: str, values: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE {column} END"


def _cyrillic_sql(x: str) -> str:
    for latin, cyrillic in T.CYRILLIC_PAIRS:
        x = f"replace({x}, '{_quote(latin)}', '{cyrillic}')"
    return f"translate({x}, '{T.LATIN_LETTERS}', '{T.CYRILLIC_LETTERS}')"


# a mark behind each letter, digit or comma and its space stands in for the look behind
_NAMES = r"regexp_extract_all(regexp_replace(text, '([\pL\pN,;:]) ', '\1 §', 'g'), '§(\p{Lu}\p{Ll}{2,})', 1)"
_LISTED = f"n0 AS (SELECT doc_id, {_NAMES} AS w FROM documents), n1 AS (SELECT doc_id, w, list_transform(w, lambda x: lower(x)) AS low FROM n0), n2 AS (SELECT doc_id, list_filter(w, lambda x, i: list_position(low, lower(x)) = i) AS names FROM n1)"

SQL = {
    "C1_C2_C3_protect": f"""
WITH p AS (SELECT seg_id, {_protect_sql('text')} AS protected FROM segments)
SELECT seg_id, protected, CAST({' + '.join(f"coalesce(CAST(contains(protected, 'XPRESERVEDTERM{i}X') AS INT), 0)" for i, _, _ in T.ordered_terms(GLOSSARY))} AS INT) AS n_fired, {_restore_sql('protected')} AS restored FROM p""",
    "C3_restore": rf"""
WITH m AS (SELECT seg_id, CASE WHEN seg_id % 3 = 0 THEN replace(translated_text, 'PRESERVED', 'PRSERVED') WHEN seg_id % 3 = 1 THEN regexp_replace(translated_text, '([0-9]X) ', '\1''', 'g') ELSE translated_text END AS t FROM segments)
SELECT seg_id, {_restore_sql('t')} AS restored FROM m""",
    "C4_plain_wording": f"SELECT seg_id, CASE WHEN lower(string_split(coalesce(detected_language, ''), '-')[1]) = 'en' THEN {_plain_sql('text')} ELSE text END AS plain FROM segments",
    "C5_rules": " UNION ALL ".join(f"SELECT {i} AS seq, '{tier}' AS tier, '{_quote(p)}' AS phrase, '{_quote(q)}' AS plain" for tier, rules in (("figurative", T.FIGURATIVE), ("slang", T.SLANG), ("standalone", T.STANDALONE)) for i, (p, q) in enumerate(rules)),
    "C10_C11_C12_answers": f"""
WITH a AS (SELECT seg_id, coalesce(text, '') AS source, {_strip("coalesce(translated_text, '')")} AS t FROM segments),
b AS (SELECT seg_id, source, seg_id % 7 AS k, t FROM a),
l AS (SELECT *, list_filter(list_transform(regexp_split_to_array(t, '\\r\\n|[\\n\\r\\v\\f]'), lambda x: {_strip('x')}), lambda x: x <> '') AS lines FROM b),
c AS (SELECT *, CASE WHEN len(lines) = 0 THEN CASE WHEN k = 3 THEN 'is the best choice' ELSE '' END ELSE lines[1] END AS first FROM l)
SELECT seg_id, CASE WHEN length(first) > greatest(80, length(source) * 6) THEN '' ELSE first END AS answer FROM c""",
    "C13_C14_problems": f"""
WITH p AS (SELECT seg_id, text, translated_text, {_DISTINCT.format(_LEFT)} AS left_a, len({_WORDS3.format('text')}) AS own FROM segments WHERE text IS NOT NULL AND translated_text IS NOT NULL),
q AS (SELECT *, CAST(regexp_matches(translated_text, '[\\x{{400}}-\\x{{4ff}}]') AS INT) + CAST(len(left_a) > 0 AS INT) AS a, CAST(regexp_matches(text, '[\\x{{400}}-\\x{{4ff}}]') AS INT) + CAST(own > 0 AS INT) AS b FROM p)
SELECT seg_id, a AS problems, array_to_string(left_a, ',') AS leftover, CASE WHEN translated_text <> '' AND a < b THEN translated_text ELSE text END AS chosen FROM q""",
    "C15_C16_C17_codes": f"""
WITH c AS (SELECT seg_id, coalesce(nullif(detected_language, ''), 'auto') AS code, end_s - start_s AS d FROM segments)
SELECT seg_id, code, {_case('code', T.LANGUAGE_NAMES)} AS language_name, {_case('code', T.FLORES)} AS flores, {_case('code', T.TARGET_TAGS)} AS tag, CASE WHEN d > 0 THEN greatest(2, CAST(floor(d * 2.5) AS INT)) END AS hint FROM c""",
    "C18_punctuation": "SELECT seg_id, CASE WHEN text IS NULL THEN NULL ELSE (CASE WHEN regexp_matches(text, '[!！¡]') THEN '!' ELSE '' END) || (CASE WHEN regexp_matches(text, '[?？¿]') THEN '?' ELSE '' END) END AS signs FROM segments",
    "C19_listed_names": f"SELECT id, array_to_string(list_filter(list_transform(string_split(genre, ','), lambda x: {_strip('x')}), lambda x: x <> ''), '|') AS listed FROM series",
    "C20_in_cyrillic": f"SELECT seg_id, {_cyrillic_sql('translated_text')} AS cyrillic FROM segments",
}
SQL["C7_hints"] = rf"""
WITH p AS (SELECT seg_id, {_protect_sql('text')} AS t FROM segments)
SELECT seg_id, array_to_string(list_filter([{", ".join(f"'{n}'" for n in AUTO if not any(n.lower() in t.lower() or t.lower() in n.lower() for t in GLOSSARY))}], lambda n: coalesce(regexp_matches(t, '(?i)(^|[^{_WORD}])' || n || '(?:e?s)?($|[^{_WORD}])'), false)), ',') AS hints FROM p"""

SQL["C6_C8_names"] = rf"""
WITH {_LISTED}, e AS (SELECT doc_id, unnest(names) AS name, generate_subscripts(names, 1) AS pos FROM n2),
g AS (SELECT arg_min(name, {{'d': doc_id, 'p': pos}}) AS name, count(DISTINCT doc_id) AS n_docs FROM e GROUP BY lower(name))
SELECT name, n_docs FROM g WHERE NOT ({" OR ".join(rf"regexp_matches(name, '(?i)(^|[^{_WORD}]){_quote(t)}(?:e?s)?($|[^{_WORD}])') OR regexp_matches('{_quote(t)}', '(?i)(^|[^{_WORD}])' || name || '(?:e?s)?($|[^{_WORD}])')" for t in GLOSSARY)})"""
SQL["C9_prompts"] = f"WITH {_LISTED} SELECT doc_id, CASE WHEN len(names) > 0 THEN 'Character and place names in this audio: ' || array_to_string(names[1:5], ', ') || '.' END AS prompt FROM n2"
