"""Source divergence audit: which sources of a language use its words differently,
and which words make the difference.

Words are counted once, inside the tasks that read the texts. Everything after that
works on *cells*: terms with the same count in a source and the same count in the
language have the same value, so the value is worked out once for a cell and its
number of terms, cells are ranked by cumulative number of terms, and only the terms
of the cells that reach the ranks asked for are looked at again.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Bytes that end a term, A-Z in lower case, everything else as it is.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
PIECE = 1 << 22
HELD = 400_000
SCALE = 1_000_000_000
TALLY = "lang string, source string, term binary, n long, docs long"


def pieces_of_terms(raw: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """Terms of a text, in lists for about ``piece`` bytes of it."""
    folded, at = raw.translate(FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + piece)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def _tally(held: int):
    def rows(found: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs, texts) in found.items():
            terms = list(n)
            columns = [
                pa.array([lang] * (len(terms) + 1), pa.string()),
                pa.array([source] * (len(terms) + 1), pa.string()),
                pa.array([None, *terms], pa.binary()),
                pa.array([0, *n.values()], pa.int64()),
                pa.array([texts, *[docs[t] for t in terms]], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = {}, 0
        for batch in batches:
            for lang, source, raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                entry = found.setdefault((lang, source), [Counter(), Counter(), 0])
                entry[2] += 1
                before, seen = len(entry[0]), set()
                for terms in pieces_of_terms(raw):
                    entry[0].update(terms)
                    seen.update(terms)
                entry[1].update(seen)
                size += len(entry[0]) - before + 1
                if size >= held:
                    yield from rows(found)
                    found, size = {}, 0
        yield from rows(found)

    return run


def _p(count: str, n: str, v: str) -> str:
    """Share of a term in parts of ``SCALE``, smoothed; null where no term is kept."""
    return f"(1 + (cast({SCALE} as decimal(12,0)) * ({count} + 2)) div nullif({n} + 2 * {v}, 0))"


def _f(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _terms(used: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """The ``top`` terms of each group by value, through ranked cells."""
    group = ["lang", "source"]
    counted = used.groupBy(*group, "g", "l").agg(F.count("*").alias("m")).join(totals, group)
    valued = counted.withColumns({"p": F.expr(_p("g", "n", "v")), "q": F.expr(_p("l", "lang_n", "v"))}).where("p > q")
    cells = saved(valued.select(*group, "g", "l", "q", "m", _f("p", "q").alias("value")))
    # Cells of one value are one level; a level holds a term at least, so the first
    # ``top`` levels are enough, and of these the ones that begin within ``top`` terms.
    order = Window.partitionBy(*group).orderBy(F.desc("value"))
    levels = cells.groupBy(*group, "value").agg(F.sum("m").alias("m"))
    first = levels.withColumn("level", F.row_number().over(order)).where(F.col("level") <= top)
    before = F.coalesce(F.sum("m").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = first.withColumn("before", before).where(F.col("before") < top).select(*group, "value")
    wanted = cells.join(chosen, [*group, "value"]).select(*group, "g", "l", "q", "value")
    ranked = Window.partitionBy(*group).orderBy(F.desc("value"), "term")
    listed = used.join(wanted, [*group, "g", "l"]).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    return listed.select(*group, F.lit("term").alias("part"), F.col("term").alias("item"), "q", "value", "rank")


def _pairs(used: DataFrame, totals: DataFrame) -> DataFrame:
    """The summed value of each two sources of a language, through signed cells.

    Terms that both sources have are counted by their two counts; terms that only one
    has come from that source's own counts less those, terms of neither from what
    is left of the kept ones. So only sources that share a term meet on it.
    """
    one = used.select("lang", "term", F.col("source").alias("s"), F.col("g").alias("c"))
    two = used.select("lang", "term", F.col("source").alias("t"), F.col("g").alias("d"))
    key = ["lang", "s", "t"]
    joint = one.join(two, ["lang", "term"]).where("s < t").groupBy(*key, "c", "d").agg(F.count("*").alias("m"))
    a = totals.select("lang", F.col("source").alias("s"), F.col("n").alias("ns"), "v")
    b = totals.select("lang", F.col("source").alias("t"), F.col("n").alias("nt"))
    pairs = a.repartition("lang", "s").join(b, "lang").where("s < t")
    own = saved(used.groupBy("lang", "source", "g").agg(F.count("*").alias("h")))
    zero = F.lit(0).cast("long")
    of_s = pairs.join(own.select("lang", F.col("source").alias("s"), "g", "h"), ["lang", "s"])
    of_t = pairs.join(own.select("lang", F.col("source").alias("t"), "g", "h"), ["lang", "t"])
    both = joint.join(pairs, key)

    shares = {"pc": _p("c", "ns", "v"), "pd": _p("d", "nt", "v"), "p0": _p("0", "ns", "v"), "q0": _p("0", "nt", "v")}
    cd, c0, d0, none = (_f(*pq) for pq in (("pc", "pd"), ("pc", "q0"), ("p0", "pd"), ("p0", "q0")))

    def cells(df: DataFrame, c: Column, d: Column, m: Column, f: Column) -> DataFrame:
        counts = df.select(*key, "ns", "nt", "v", c.alias("c"), d.alias("d"), m.cast("decimal(19,0)").alias("m"))
        valued = counts.withColumns({name: F.expr(share) for name, share in shares.items()})
        return valued.select(*key, (F.col("m") * f.cast("decimal(19,0)")).alias("part"))

    g, h, c, d, m = (F.col(x) for x in "ghcdm")
    rows = (
        cells(pairs, zero, zero, F.col("v"), none)
        .unionAll(cells(of_s, g, zero, h, c0 - none))
        .unionAll(cells(of_t, zero, g, h, d0 - none))
        .unionAll(cells(both, c, d, m, cd - c0 - d0 + none))
    )
    summed = rows.groupBy(*key).agg(F.sum("part").alias("total"))
    value = F.coalesce(F.col("total"), F.lit(0)).cast("long").alias("value")
    sides = F.inline(F.array(F.struct(F.col("s").alias("source"), F.col("t").alias("item")), F.struct(F.col("t").alias("source"), F.col("s").alias("item"))))
    each = summed.select("lang", value, sides)
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return each.select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.lit(None).cast("long").alias("q"), "value",
        F.row_number().over(ranked).alias("rank"),
    )


def source_divergence(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_docs: int = 10,
    top: int = 10,
    held: int = HELD,
) -> DataFrame:
    """``lang source part item q value rank``: how the groups (language, source) differ.

    Terms are runs of ASCII letters and non-ASCII characters, A-Z in lower case; a
    language keeps those in ``min_docs`` of its documents. A group's share of a term
    is ``p = 1 + floor(10^9 (count + 2) / (N + 2 V))`` and the divergence of two shares
    ``floor((p - q)^2 / (p + q))``. Part ``pair`` ranks the other sources of the
    language by the sum over all kept terms; part ``term`` the ``top`` terms that the
    group uses more than its language does, with the language's share as ``q``. Ties
    are in UTF-8 order. All sums are integers or decimals without a fraction.

    Tasks count the words of the texts they read and send a row for each (group, term)
    they hold, at most ``held`` at a time, so a hot source or word reaches the shuffle
    as one row from each task. Work after that follows the vocabulary; the pairs of
    sources are those that the result lists.

    Null text, language or source is the empty string. A group whose texts have no
    terms is ranked like the others; a language without kept terms has pair values of
    0 and no term rows. Every row is a document, so repeated rows count again. Very
    long texts are counted in pieces. An empty table has no result rows. Other input
    columns are not read, whatever their names.
    """
    plain = docs.toDF(*[f"in_{i}" for i in range(len(docs.columns))])
    named = [F.coalesce(F.col(f"in_{docs.columns.index(c)}").cast("string"), F.lit("")) for c in (lang_col, source_col, text_col)]
    texts = plain.select(named[0].alias("lang"), named[1].alias("source"), named[2].cast("binary").alias("raw"))
    tallied = texts.mapInArrow(_tally(held), TALLY)
    counts = saved(tallied.groupBy("lang", "source", "term").agg(F.sum("n").alias("g"), F.sum("docs").alias("docs")))
    by_lang = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("g").alias("l"), F.sum("docs").alias("docs"))
    kept = saved(by_lang.where(F.col("docs") >= min_docs).select("lang", "term", "l"))
    used = saved(counts.join(kept, ["lang", "term"]).select("lang", "source", F.col("term").cast("string").alias("term"), "g", "l"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("l").alias("lang_n"))
    sums = used.groupBy("lang", "source").agg(F.sum("g").alias("n"))
    groups = counts.where("term IS NULL").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    totals = saved(groups.na.fill(0, ["n", "v", "lang_n"]))
    return _pairs(used, totals).unionByName(_terms(used, totals, top))


def op11_source_divergence(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("text", "lang", "source")
    return source_divergence(docs).select("lang", "source", "part", "item", "value", "rank")


OP11_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
t AS MATERIALIZED (SELECT r, lang, source, unnest(terms) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS l FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(l) AS n FROM kept GROUP BY lang),
used AS MATERIALIZED (SELECT lang, source, term, count(*) AS g FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
sums AS (SELECT lang, source, sum(g) AS n FROM used GROUP BY lang, source),
totals AS (SELECT g.lang, g.source, coalesce(s.n, 0) AS n, coalesce(l.v, 0) AS v, coalesce(l.n, 0) AS lang_n
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN sums s USING (lang, source) LEFT JOIN langs l USING (lang)),
shares AS MATERIALIZED (
  SELECT t.lang, t.source, k.term, coalesce(u.g, 0) AS g,
    (1 + (1000000000::HUGEINT * (coalesce(u.g, 0) + 2)) // (t.n + 2 * t.v))::BIGINT AS p,
    (1 + (1000000000::HUGEINT * (k.l + 2)) // (t.lang_n + 2 * t.v))::BIGINT AS q
  FROM totals t JOIN kept k USING (lang) LEFT JOIN used u ON u.lang = t.lang AND u.source = t.source AND u.term = k.term),
summed AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM totals a JOIN totals b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value
  FROM shares WHERE g > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
