"""Quality rules with cross-document line frequency, in built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, UPPER, Opened, let, words_of

SYMBOLS = "#*$%&|<>"


def _repeated_words(words: Column) -> Column:
    """Words inside windows of three words that the text has twice or more."""

    def covered(windows: Column) -> Column:
        def positions(ranked: Column) -> Column:
            same = F.filter(
                ranked,
                lambda e, i: F.coalesce(e["w"] == F.get(ranked, i - 1)["w"], F.lit(False))
                | F.coalesce(e["w"] == F.get(ranked, i + 1)["w"], F.lit(False)),
            )
            return F.sort_array(F.transform(same, lambda e: e["i"]))

        ranked = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        shares = let(
            let(ranked, positions),
            lambda at: F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3)))),
        )
        total = F.aggregate(shares, F.lit(0).cast("long"), lambda a, x: a + x)
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(total)

    def windows(hashes: Column) -> Column:
        first = F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - 2, F.lit(0)))
        return F.transform(first, lambda h, i: F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2)))

    return let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), covered)


def _measures(text: Column) -> dict[str, Column]:
    bare = F.coalesce(text, F.lit(""))
    solid = F.translate(bare, BLANKS + " ", "")
    lines = F.filter(F.split(bare, "\n"), lambda line: F.translate(line, BLANKS + " ", "") != "")
    counts = let(
        words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated_words(w).alias("n_repeat_words"))
    )
    return {
        "counts": counts,
        "word_chars": F.length(solid).cast("long"),
        "n_symbols": (F.length(bare) - F.length(F.translate(bare, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
    }


def _lines(text: Column) -> Column:
    """Normalised lines: A-Z lower, digits as 0, white space as one blank, trimmed."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER + "0123456789", UPPER.lower() + "0" * 10)
    one = F.regexp_replace(low, "[\\x20\\x09\\x0B-\\x0D]+", " ")
    return F.transform(F.split(one, "\n"), lambda line: F.trim(line))


def without_lines(text: Column, positions: Column) -> Column:
    """Text without the lines at these positions, in time n log n: markers sort
    in front of the lines that they strike out."""
    marks = F.transform(positions, lambda p: F.struct(p.alias("i"), F.lit(0).alias("k"), F.lit("").alias("line")))
    lines = F.transform(F.split(text, "\n"), lambda line, i: F.struct(i.alias("i"), F.lit(1).alias("k"), line.alias("line")))

    def kept(ranked: Column) -> Column:
        return F.filter(
            ranked, lambda e, i: (e["k"] == 1) & ~F.coalesce((F.get(ranked, i - 1)["i"] == e["i"]), F.lit(False))
        )

    left = let(F.sort_array(F.concat(marks, lines)), kept)
    return F.array_join(F.transform(left, lambda e: e["line"]), "\n")


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    min_docs: int = 20,
    max_host_share: float = 0.1,
    min_left_percent: int = 50,
) -> DataFrame:
    """Measure documents, take out lines that too many documents of a host have,
    and judge what is left.

    Lines are normalised and hashed (64 bits). A line goes if ``min_docs``
    different texts of its host or more have it, and more than ``max_host_share``
    of the host's different texts; exact copies of a text count once, so copying
    alone makes no line frequent. A document is kept unless the base rules fail it
    or less than ``min_left_percent`` of its words are left.

    Adds ``n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed
    n_line_words`` (words of the removed lines) ``kept clean_text``. Null text
    counts as empty, its ``clean_text`` is null, and base rules fail it. A null
    host is a host. Repeated rows are judged each. Input columns of the same
    names as results are replaced.

    A frequent line reaches the counting shuffle as one row per text, the join
    that marks its documents can be split by Spark, and no array grows beyond
    one document.
    """
    opened = Opened(docs, id_col, text_col)
    text = F.col(opened.text)
    host = F.col(f"in_{opened.names.index(host_col)}")
    base = opened.df
    lines = base.select("key", host.alias("host"), F.xxhash64(text).alias("digest"), F.posexplode(_lines(text)).alias("pos", "line"))
    lines = lines.where("line <> ''").select(
        "key", "host", "digest", "pos", F.xxhash64("line").alias("h"), F.size(F.split("line", " ")).alias("words")
    )
    hosts = base.select(host.alias("host"), F.xxhash64(text).alias("digest")).groupBy("host").agg(F.countDistinct("digest").alias("texts"))
    counted = lines.groupBy("host", "h").agg(F.countDistinct("digest").alias("docs")).where(F.col("docs") >= min_docs)
    limit = F.col("docs") > max_host_share * F.col("texts")
    frequent = (
        counted.alias("c").join(hosts.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host"))).where(limit).select(F.col("c.host").alias("f_host"), F.col("h").alias("f_h"))
    )
    removed = (
        lines.join(frequent, F.col("host").eqNullSafe(F.col("f_host")) & (F.col("h") == F.col("f_h")))
        .groupBy("key")
        .agg(F.sum("words").alias("n_line_words"), F.collect_list("pos").alias("gone"))
    )
    measured = base.select("*", *[c.alias(n) for n, c in _measures(text).items()])
    joined = measured.join(removed.withColumnRenamed("key", "r_key"), F.col("key") == F.col("r_key"), "left")
    n_words = F.col("counts.n_words")
    repeats = F.col("counts.n_repeat_words")
    gone = F.coalesce(F.col("n_line_words"), F.lit(0)).cast("long")
    failed = (n_words < min_words) | (100 * repeats > max_repeat_percent * n_words)
    clean = F.when(F.col("gone").isNull(), text).otherwise(without_lines(text, F.col("gone")))
    return opened.closed(
        joined,
        {
            "n_words": n_words,
            "word_chars": F.col("word_chars"),
            "n_symbols": F.col("n_symbols"),
            "n_dup_lines": F.col("n_dup_lines"),
            "n_repeat_words": repeats,
            "base_failed": failed,
            "n_line_words": gone,
            "kept": ~failed & (100 * (n_words - gone) >= min_left_percent * n_words),
            "clean_text": clean,
        },
    )


def op1_quality(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    judged = quality_rules(docs)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_line_words", "kept"
    )


OP1_SQL = r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word,
    generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM documents WHERE text IS NOT NULL),
  g AS (SELECT doc_id, i, word || ' ' || lead(word) OVER p || ' ' || lead(word, 2) OVER p AS gram FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
  r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g WHERE gram IS NOT NULL) WHERE c > 1),
  cover AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
  n AS (SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY doc_id),
  raw AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM documents),
  dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
  norm AS (SELECT doc_id, source, text, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789',
    'abcdefghijklmnopqrstuvwxyz0000000000'), '[\x20\x09\x0B-\x0D]+', ' ', 'g')) AS line FROM raw),
  hosts AS (SELECT source, count(DISTINCT coalesce(text, '')) + count(DISTINCT CASE WHEN text IS NULL THEN 1 END) AS texts FROM documents GROUP BY source),
  f AS (SELECT norm.source, line, any_value(texts) AS texts, count(DISTINCT text) AS docs FROM norm JOIN hosts ON norm.source IS NOT DISTINCT FROM hosts.source
    WHERE line <> '' GROUP BY norm.source, line),
  gone AS (SELECT doc_id, sum(len(string_split(norm.line, ' '))) AS n FROM norm JOIN f ON norm.line = f.line AND norm.source IS NOT DISTINCT FROM f.source
    WHERE docs >= 20 AND docs > 0.1 * texts GROUP BY doc_id),
  m AS (SELECT d.doc_id, coalesce(n.n_words, 0) AS n_words, CAST(coalesce(n.word_chars, 0) AS BIGINT) AS word_chars,
    coalesce(length(text) - length(translate(text, '#*$%&|<>', '')), 0) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
    coalesce(cover.n, 0) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_line_words
    FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN cover USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - n_line_words) >= 50 * n_words AS kept FROM m
"""
