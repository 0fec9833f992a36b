"""Operator 6, line dedup by the spread of a line over distinct sites.

A line that many sites carry is boilerplate. The sites of every line hash are
gathered in HyperLogLog sketches, which partial aggregation merges; where the
estimate is near the threshold the sites are counted exactly. Lines at or above
the threshold are then removed from the documents that hold them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filmroll.llm.common import documents, materialize, put_back, set_aside, sized_hint

#: Sites from which on a line is boilerplate.
MIN_SITES = 5
#: Sketch size (log2 of its registers); the standard error is about 1.04 / sqrt(2 ** LG_K).
LG_K = 9


def _key(line: Column) -> Column:
    """Hash of a line without the spaces around it; null for a line without a word."""
    trimmed = F.trim(line)
    return F.when(F.length(trimmed) > 0, F.xxhash64(trimmed))


def _lines(docs: DataFrame, site: str) -> DataFrame:
    exploded = docs.select(F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), F.explode(F.split("text", "\n")).alias("line"))
    return exploded.select(_key(F.col("line")).alias("line_key"), "site").where("line_key IS NOT NULL")


def boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """line_key and n_sites of the lines of ``docs`` (text and a site column) that at least ``min_sites`` sites carry.

    Lines are compared without the spaces around them; blank ones are ignored;
    rows without a site form one site. Estimates within four standard errors
    of the threshold, or one site, are replaced by exact counts.
    """
    lines = _lines(docs, site)
    sketched = lines.groupBy("line_key").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"))
    error = max(1.0, 4 * 1.04 / 2 ** (lg_k / 2) * min_sites)
    wide = materialize(sketched.select("line_key", F.hll_sketch_estimate("sketch").alias("estimate")).where(F.col("estimate") >= min_sites - error))
    sure, near = wide.where(F.col("estimate") > min_sites + error), wide.where(F.col("estimate") <= min_sites + error)
    # a line that very many rows share is one row a site before it meets the others
    sites = lines.join(sized_hint(near.select("line_key")), "line_key", "left_semi").groupBy("line_key", "site").agg(F.lit(1).alias("one"))
    exact = sites.groupBy("line_key").agg(F.count("*").alias("n_sites"))
    return sure.select("line_key", F.col("estimate").alias("n_sites")).unionByName(exact.where(F.col("n_sites") >= min_sites))


def remove_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` (doc_id, text, site and any other columns) with the cleaned text and n_lines, n_spread and n_removed.

    Boilerplate lines are taken out of every document but whole copies: rows
    all of whose lines are boilerplate and whose lines, in order, another row
    has as well. Those have equal shingles and are left whole to the
    near-duplicate stage. n_spread counts boilerplate lines, n_removed those
    taken out. Null text stays null, with 0 lines, as has an empty one. Very
    long texts are split whole. Repeated rows each get a row; rows of one
    doc_id share their boilerplate; an empty table gives no rows. Columns named
    like the three counts are replaced.
    """
    cleaned, columns = _clean(docs, site, min_sites), [c for c in docs.columns if c not in COUNTS]
    return cleaned.select(*put_back(cleaned, columns), *COUNTS)


def clean_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """:func:`remove_boilerplate` with the columns of ``docs`` alone; any names are kept."""
    cleaned = _clean(docs, site, min_sites).drop(*COUNTS)
    return cleaned.select(*put_back(cleaned, docs.columns))


COUNTS = ("n_lines", "n_spread", "n_removed")


def _clean(docs: DataFrame, site: str, min_sites: int) -> DataFrame:
    """doc_id, text, the other columns in ``rest``, and the counts."""
    marked = materialize(boilerplate(docs, site, min_sites).select("line_key"))
    docs = set_aside(docs, "doc_id", "text")
    exploded = docs.select(F.col("doc_id").alias("id"), F.explode(F.split("text", "\n")).alias("line")).select("id", _key(F.col("line")).alias("line_key")).where("line_key IS NOT NULL")
    hits = materialize(exploded.join(sized_hint(marked), "line_key", "left_semi").groupBy("id").agg(F.collect_set("line_key").alias("drop")))
    hits = hits.join(_copies(docs, hits).hint("merge"), hits["id"].eqNullSafe(F.col("copy_id")), "left").drop("copy_id")
    joined = docs.join(hits.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")), "left").drop("id")
    return _cleaned(joined)


def _sequence(text: str = "text") -> Column:
    """Keys of the non-blank lines of a text in their order."""
    return F.filter(F.transform(F.split(text, "\n"), _key), lambda k: k.isNotNull())


def _copies(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """copy_id and copies, the hashes of those line sequences that are boilerplate throughout and that two or more rows have."""
    keyed = docs.select("doc_id", _sequence().alias("keys")).join(hits.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")))
    whole = materialize(keyed.where(F.size(F.array_except("keys", "drop")) == 0).select(F.col("doc_id").alias("copy_id"), F.xxhash64("keys").alias("whole")).where("whole IS NOT NULL"))
    repeated = materialize(whole.groupBy("whole").agg(F.count("*").alias("n")).where("n > 1").select("whole"))
    return whole.join(sized_hint(repeated), "whole", "left_semi").groupBy("copy_id").agg(F.collect_set("whole").alias("copies"))


def _cleaned(joined: DataFrame) -> DataFrame:
    """The rows with the lines whose keys ``drop`` holds (null: none) taken out, but for whole ``copies``."""
    lines = joined.withColumn("lines", F.coalesce(F.split("text", "\n"), F.array().cast("array<string>")))
    hit = lambda x: F.coalesce(F.array_contains("drop", _key(x)), F.lit(False))
    counted = lines.withColumn("n_lines", F.size(F.filter("lines", lambda x: F.length(F.trim(x)) > 0)).cast("long"))
    counted = counted.withColumn("n_spread", F.coalesce(F.size(F.when(F.col("drop").isNotNull(), F.filter("lines", hit))), F.lit(0)).cast("long"))
    copy = F.when(F.col("copies").isNotNull() & (F.col("n_spread") == F.col("n_lines")), F.array_contains("copies", F.xxhash64(_sequence())))
    counted = counted.withColumn("cut", (F.col("n_spread") > 0) & ~F.coalesce(copy, F.lit(False)))
    kept = F.array_join(F.filter("lines", lambda x: ~hit(x)), "\n")
    return counted.select("doc_id", F.when(F.col("cut"), kept).otherwise(F.col("text")).alias("text"), "rest", "n_lines", "n_spread", F.when(F.col("cut"), F.col("n_spread")).otherwise(0).cast("long").alias("n_removed"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found and removed in every document, and a digest of the cleaned text."""
    cleaned = remove_boilerplate(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return cleaned.select("doc_id", "n_lines", "n_spread", "n_removed", F.md5(F.coalesce("text", F.lit(""))).alias("clean_md5"))


#: Boilerplate goes out of every document but whole copies: nothing but boilerplate, its lines in order those of another row.
OP6_SQL = """
WITH lines AS (
  SELECT doc_id, source, line, ord FROM (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM documents)),
spread AS (
  SELECT trim(line, ' ') AS line_key FROM lines WHERE length(trim(line, ' ')) > 0
  GROUP BY 1 HAVING count(DISTINCT coalesce(source, '')) >= 5),
marked AS (SELECT l.*, s.line_key IS NOT NULL AS hit FROM lines l LEFT JOIN spread s ON trim(l.line, ' ') = s.line_key),
counted AS (
  SELECT doc_id, count(*) FILTER (length(trim(line, ' ')) > 0) AS n_lines, count(*) FILTER (hit) AS n_spread,
         string_agg(line, chr(10) ORDER BY ord) FILTER (NOT hit) AS rest,
         list(trim(line, ' ') ORDER BY ord) FILTER (length(trim(line, ' ')) > 0) AS lines_in_order
  FROM marked GROUP BY doc_id),
copies AS (SELECT lines_in_order FROM counted WHERE n_spread = n_lines AND n_lines > 0 GROUP BY 1 HAVING count(*) > 1),
judged AS (SELECT *, n_spread > 0 AND NOT (n_spread = n_lines AND lines_in_order IN (SELECT lines_in_order FROM copies)) AS cut FROM counted)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_spread, 0) AS n_spread,
       CASE WHEN cut THEN n_spread ELSE 0 END AS n_removed,
       md5(CASE WHEN cut THEN coalesce(rest, '') ELSE coalesce(d.text, '') END) AS clean_md5
FROM documents d LEFT JOIN judged USING (doc_id)
"""

QUERIES = {"op6_line_dedup": op6_line_dedup}
ORACLE_SQL = {"op6_line_dedup": OP6_SQL}
