"""Queries of the problems that prepare text for training."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.canonical import canonical_column, equal_looking_pairs
from loomline.llm.languages import fit_on, label_languages
from loomline.llm.mixing import Mix
from loomline.llm.packing import fill_containers, fill_report
from loomline.llm.spans import SharedSpans
from loomline.llm.splitting import split_rows
from loomline.llm.transcripts import Transcripts
from loomline.sources.tables import spread, table


def p1_languages(spark: SparkSession, base: str) -> DataFrame:
    """Language and confidence of every line and document, and of each piece of a mixed one."""
    lines = spread(table(spark, base, "segments", ["seg_id", "text", "detected_language"]))
    docs = spread(table(spark, base, "documents", ["doc_id", "text", "lang"]))
    # both tables' labels, whose texts differ
    model = fit_on(lines.unionByName(docs.withColumnsRenamed({"doc_id": "seg_id", "lang": "detected_language"})), "seg_id", "text", "detected_language")
    a = label_languages(lines.withColumnRenamed("seg_id", "rec_id"), model, "rec_id", "text", "detected_language")
    b = label_languages(docs.withColumnRenamed("doc_id", "rec_id"), model, "rec_id", "text", "lang")
    return a.withColumn("tbl", F.lit("segments")).unionByName(b.withColumn("tbl", F.lit("documents")))


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    """Records whose label is missing or wrong, and the pieces of mixed ones."""
    every = p1_languages(spark, base).where("language IS NOT NULL")
    wrong = F.col("label_language").isNull() | (F.col("label_language") != F.col("language"))
    cases = every.where((F.col("piece") > 0) | (wrong & (F.col("n_letters") >= 20)))
    return cases.select("tbl", "rec_id", "piece", F.col("language").alias("lang_code"))


def p2_turns(spark: SparkSession, base: str) -> DataFrame:
    """Clean speaker turns of every media item, with their text."""
    lines = table(spark, base, "transcripts", ["line_id", "media_id", "start_s", "end_s", "speaker_id", "text"])
    known = spread(table(spark, base, "segments", ["seg_id", "text", "detected_language"]))
    return Transcripts(lines, fit_on(known, "seg_id", "text", "detected_language", rows=4_000)).turns()


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    """Clean speaker turns of every media item."""
    return p2_turns(spark, base).select("media_id", "turn_no", "speaker_id", "from_ms", "to_ms", "n_words")


def _line_limit(spark: SparkSession, base: str) -> tuple[int, int]:
    """Most characters of a piece of a line, and words of overlap, that size_limits names: one row."""
    named = table(spark, base, "size_limits").where("applies_to = 'segments' AND unit = 'characters'").select("max_size", "overlap").orderBy("max_size").first()
    return (named["max_size"], named["overlap"] or 0) if named else (280, 5)


def _pieces(spark: SparkSession, base: str, limit: int, overlap: int) -> DataFrame:
    return split_rows(spread(table(spark, base, "segments", ["seg_id", "text", "words"])), "seg_id", "text", "words", limit=limit, overlap=overlap)


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    """Lines that had to be split, and whether their sentences allow it."""
    limit, overlap = _line_limit(spark, base)
    # every such line has one first piece
    return _pieces(spark, base, limit, overlap).where((F.col("size") > limit) & (F.col("piece") == 1)).select("seg_id", "breakable").distinct()


def p3_pieces(spark: SparkSession, base: str) -> DataFrame:
    """Every line in pieces of at most as many characters as its limit."""
    return _pieces(spark, base, *_line_limit(spark, base))


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    """Pairs of lines of one speaker whose texts differ but look the same."""
    lines = spread(table(spark, base, "segments", ["seg_id", "media_id", "speaker_id", "text", "translated_text"]))
    pairs = equal_looking_pairs(lines, "seg_id", ["media_id", "speaker_id"], ["text", "translated_text"])
    return pairs.select(F.col("id_a").alias("seg_id_a"), F.col("id_b").alias("seg_id_b"), "field")


def p5_canonical(spark: SparkSession, base: str) -> DataFrame:
    """Every line with both texts in one form."""
    lines = spread(table(spark, base, "segments", ["seg_id", "text", "translated_text"]))
    return lines.select("seg_id", canonical_column(F.col("text")).alias("text"), canonical_column(F.col("translated_text")).alias("translated_text"))


def _capacities(spark: SparkSession, base: str) -> list[int]:
    """The container sizes that size_limits names for documents: a few rows."""
    limits = table(spark, base, "size_limits").where("applies_to = 'documents' AND unit = 'tokens'")
    return [r["max_size"] for r in limits.select("max_size").distinct().collect()]


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    """Documents that the largest container can't hold, so that packing divides them."""
    docs = spread(table(spark, base, "documents", ["doc_id", "text"]))
    packed = fill_containers(docs, "doc_id", "text", [max(_capacities(spark, base))])
    return packed.where("n_pieces > 1").select("doc_id").distinct()


def p6_packed(spark: SparkSession, base: str) -> DataFrame:
    """Containers of every capacity, by document and piece."""
    return fill_containers(spread(table(spark, base, "documents", ["doc_id", "text"])), "doc_id", "text", _capacities(spark, base))


def p6_fill(spark: SparkSession, base: str) -> DataFrame:
    """How full the containers of each capacity are."""
    return fill_report(p6_packed(spark, base))


def _mix(spark: SparkSession, base: str) -> Mix:
    return Mix(spread(table(spark, base, "documents", ["doc_id", "text", "source"])), table(spark, base, "mix_targets"), "doc_id", "text", "source")


def p7_mix(spark: SparkSession, base: str) -> DataFrame:
    """The documents of each mix in the order of their virtual finish times."""
    return _mix(spark, base).selection()


def p7_shares(spark: SparkSession, base: str) -> DataFrame:
    """The shares each mix reached beside those it aimed at."""
    return _mix(spark, base).shares()


def _sized_mix(spark: SparkSession, base: str) -> Mix:
    """The same mixes in characters, four for a token."""
    targets = table(spark, base, "mix_targets").withColumn("total_tokens", F.col("total_tokens") * 4)
    return Mix(table(spark, base, "documents", ["doc_id", "n_chars", "source"]), targets, "doc_id", "text", "source", size="n_chars")


def p7_sized_mix(spark: SparkSession, base: str) -> DataFrame:
    """The documents of each mix measured in characters, which SQL can count."""
    return _sized_mix(spark, base).selection().withColumn("finish", F.round("finish", 6))


def p7_sized_shares(spark: SparkSession, base: str) -> DataFrame:
    """The shares reached in characters."""
    return _sized_mix(spark, base).shares()


def _shared(spark: SparkSession, base: str) -> SharedSpans:
    return SharedSpans(spread(table(spark, base, "documents", ["doc_id", "text"])), "doc_id", "text", min_chars=200)


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    """Pairs of documents with 200 or more consecutive characters in common."""
    return _shared(spark, base).pairs().select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p8_report(spark: SparkSession, base: str) -> DataFrame:
    """Of each document, how much of it occurs elsewhere."""
    return _shared(spark, base).report().withColumnRenamed("id", "doc_id")


def p8_classes(spark: SparkSession, base: str) -> DataFrame:
    """Of each document of 200 characters and more, the first with the same text."""
    return _shared(spark, base).classes().withColumnsRenamed({"id": "doc_id", "class_id": "class_doc_id"})


def p8_class_pairs(spark: SparkSession, base: str) -> DataFrame:
    """Pairs of different texts with a common stretch, each by its first document."""
    return _shared(spark, base).class_pairs().withColumnsRenamed({"class_a": "doc_id_a", "class_b": "doc_id_b"})


def p8_passages(spark: SparkSession, base: str) -> DataFrame:
    """Fuzzy passages: chained matches of two documents."""
    return _shared(spark, base).passages().withColumnsRenamed({"id_a": "doc_id_a", "id_b": "doc_id_b"})


QUERIES = {"p1_found": p1_found, "p1_languages": p1_languages, "p2_found": p2_found, "p2_turns": p2_turns, "p3_found": p3_found, "p3_pieces": p3_pieces, "p5_found": p5_found, "p5_canonical": p5_canonical, "p6_found": p6_found, "p6_packed": p6_packed, "p6_fill": p6_fill, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_sized_mix": p7_sized_mix, "p7_sized_shares": p7_sized_shares, "p8_found": p8_found, "p8_report": p8_report, "p8_classes": p8_classes, "p8_class_pairs": p8_class_pairs, "p8_passages": p8_passages}



def _quote(text: str) -> str:
    return text.replace("'", "''")


# Fixed values of the SQL alone, so that it is a check of the operator's tables: look-alikes and the letters they resemble, signs and what they stand for.
_LIKE = "АВЕЅІЈКМНОРСТХУаеѕіјорсхуһԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳ口力工夕卜八二千へべぺり"
_AS = "ABESIJKMHOPCTXYaesijopcxyhdqwABEZHIKMNOPTYXocjロカエタトハニチヘベペリ"
_MARKS = {"'": "‘’‚‛ʻʼʽʹˈ′‵`´՚ꞌ׳ʿʾ", '"': "“”„‟″‶〃״ʺ", "-": "‐‑‒–—―−﹘﹣⁃˗", ":": "∶꞉ː", "/": "⁄∕", "~": "∼˜", "<": "‹", ">": "›", ".": "․", "!": "ǃ"}
_UNSEEN_RANGES = "\\x{ad}\\x{34f}\\x{61c}\\x{180b}-\\x{180f}\\x{200b}-\\x{200f}\\x{202a}-\\x{202e}\\x{2060}-\\x{206f}\\x{fe00}-\\x{fe0f}\\x{feff}"
_BLANK_RANGES = "\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{202f}\\x{205f}\\x{3000}"


def _skeleton(x: str) -> str:
    """What a text looks like, in SQL: every look-alike in one script, whatever the text's own."""
    width = "".join(map(chr, range(0xFF01, 0xFF5F)))
    kana = "".join(map(chr, range(0xFF61, 0xFFA0)))
    full = "".join(unicodedata.normalize("NFKC", c) for c in kana)
    x = f"regexp_replace({x}, '[{_UNSEEN_RANGES}]', '', 'g')"
    x = f"regexp_replace({x}, '[{_BLANK_RANGES}]', ' ', 'g')"
    for c in map(chr, range(0xFB00, 0xFB07)):
        x = f"replace({x}, '{c}', '{unicodedata.normalize('NFKC', c)}')"
    x = f"translate({x}, '{_quote(width + kana)}', '{_quote(''.join(chr(ord(c) - 0xFEE0) for c in width) + full)}')"
    for plain, signs in _MARKS.items():
        x = f"translate({x}, '{_quote(signs)}', '{_quote(plain * len(signs))}')"
    for sign, plain in (("…", "..."), ("⋯", "..."), ("‥", "..")):
        x = f"replace({x}, '{sign}', '{plain}')"
    return f"translate(nfc_normalize({x}), '{_LIKE}', '{_AS}')"


def _named(x: str) -> str:
    blank = r"\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}_-"
    return f"regexp_replace(regexp_replace(lower({x}), '^[{blank}]+|[{blank}]+$', '', 'g'), '[{blank}]+', '_', 'g')"


_MIXED = f"""
WITH d AS (SELECT doc_id, {_named('source')} AS source, n_chars AS n, md5('7:' || doc_id) AS u FROM documents WHERE n_chars > 0 AND source IS NOT NULL),
v AS (SELECT source, sum(n) AS supply FROM d GROUP BY 1),
t AS (SELECT mix, {_named('source_name')} AS source, sum(greatest(coalesce(CAST(weight AS DOUBLE), 0.0), 0.0)) AS weight, max(greatest(coalesce(max_repeats, 1), 1)) AS max_repeats, 4 * max(max(total_tokens)) OVER (PARTITION BY mix) AS budget FROM mix_targets GROUP BY 1, 2),
p AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY u, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM d),
c AS (SELECT t.*, supply, unnest(generate_series(1, max_repeats)) AS copy FROM t JOIN v ON v.source = t.source WHERE weight > 0),
f AS (SELECT mix, c.source, doc_id, copy, n, u, budget, CAST((copy - 1) * supply + upto AS DOUBLE) / weight AS finish FROM c JOIN p ON p.source = c.source),
r AS (SELECT *, sum(n) OVER (PARTITION BY mix ORDER BY finish, source, copy, u, doc_id ROWS UNBOUNDED PRECEDING) AS total FROM f),
m AS (SELECT * FROM r WHERE total <= budget)"""

_STRETCHES = """
WITH d AS (SELECT doc_id, text FROM documents WHERE length(text) >= 200),
w AS (SELECT DISTINCT doc_id, md5(substr(text, i, 200)) AS h FROM (SELECT doc_id, text, unnest(generate_series(1, length(text) - 199)) AS i FROM d)),
s AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
x AS (SELECT w.doc_id, w.h FROM w JOIN s ON s.h = w.h)"""

SQL = {
    "p5_found": f"""
WITH v AS (SELECT seg_id, media_id, speaker_id, 'text' AS field, text AS value FROM segments WHERE media_id IS NOT NULL AND speaker_id IS NOT NULL AND text <> ''
  UNION ALL SELECT seg_id, media_id, speaker_id, 'translated_text', translated_text FROM segments WHERE media_id IS NOT NULL AND speaker_id IS NOT NULL AND translated_text <> ''),
s AS (SELECT *, {_skeleton('value')} AS look FROM v)
SELECT a.seg_id AS seg_id_a, b.seg_id AS seg_id_b, a.field FROM s a JOIN s b ON a.media_id = b.media_id AND a.speaker_id = b.speaker_id AND a.field = b.field AND a.look = b.look AND a.seg_id < b.seg_id AND a.value <> b.value""",
    "p8_found": f"""{_STRETCHES}
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id""",
    "p8_classes": "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class_doc_id FROM documents WHERE length(text) >= 200",
    "p8_class_pairs": f"""{_STRETCHES},
c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS cls FROM d),
y AS (SELECT DISTINCT c.cls, x.h FROM x JOIN c ON c.doc_id = x.doc_id)
SELECT DISTINCT a.cls AS doc_id_a, b.cls AS doc_id_b FROM y a JOIN y b ON a.h = b.h AND a.cls < b.cls""",
    "p8_report": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT text, count(*) AS n, min(doc_id) AS cls FROM d WHERE length(text) >= 200 GROUP BY text),
w AS (SELECT cls, i, md5(substr(text, i, 200)) AS h FROM (SELECT cls, text, unnest(generate_series(1, length(text) - 199)) AS i FROM t)),
s AS (SELECT h, count(DISTINCT cls) AS k FROM w GROUP BY h HAVING count(DISTINCT cls) > 1),
x AS (SELECT cls, i, k, lead(i) OVER (PARTITION BY cls ORDER BY i) AS following FROM w JOIN s ON s.h = w.h),
p AS (SELECT cls, CAST(sum(least(200, coalesce(following - i, 200))) AS BIGINT) AS part, max(k) - 1 AS most FROM x GROUP BY cls),
r AS (SELECT doc_id, length(d.text) AS n_chars, CASE WHEN n > 1 THEN length(d.text) ELSE coalesce(part, 0) END AS shared_chars, coalesce(n - 1, 0) AS n_copies, coalesce(most, 0) AS n_texts FROM d LEFT JOIN t ON t.text = d.text LEFT JOIN p ON p.cls = t.cls)
SELECT doc_id, n_chars, shared_chars, coalesce(round(shared_chars / nullif(n_chars, 0), 6), 0.0) AS shared_part, n_copies, n_texts FROM r""",
    "p7_sized_mix": f"{_MIXED} SELECT mix, source, doc_id, CAST(copy AS INT) AS copy, n AS n_tokens, round(finish, 6) AS finish, CAST(total AS BIGINT) AS total FROM m",
    "p7_sized_shares": f"""{_MIXED},
g AS (SELECT mix, source, sum(n) AS tokens, count(DISTINCT doc_id) AS n_docs, max(copy) AS most_copies FROM m GROUP BY 1, 2),
e AS (SELECT t.*, coalesce(supply, 0) AS supply, coalesce(tokens, 0) AS tokens, coalesce(n_docs, 0) AS n_docs, coalesce(most_copies, 0) AS most_copies FROM t LEFT JOIN v ON v.source = t.source LEFT JOIN g ON g.mix = t.mix AND g.source = t.source)
SELECT mix, source, round(weight / nullif(sum(weight) OVER (PARTITION BY mix), 0.0), 6) AS target_share, round(weight / nullif(sum(weight) OVER (PARTITION BY mix), 0.0) * budget, 3) AS target_tokens, CAST(supply AS BIGINT) AS supply_tokens, max_repeats, CAST(tokens AS BIGINT) AS tokens,
  round(tokens / nullif(budget, 0), 6) AS share_of_total, round(tokens / nullif(sum(tokens) OVER (PARTITION BY mix), 0), 6) AS share_reached, n_docs, CAST(most_copies AS INT) AS most_copies FROM e""",
}
