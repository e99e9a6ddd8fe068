"""Operator 2: cross-site line deduplication, DataFrame functions only.

A line's spread is the number of distinct sites (sources) that it stands on. Each task
folds its lines into one HyperLogLog sketch per line hash; sketches merge in the shuffle,
so a line that a third of all documents share arrives as one small sketch per task. Lines
estimated clearly under ``min_sites`` are ordinary, clearly over it are boilerplate, and
those near the threshold get an exact distinct count of their sites. Boilerplate lines are
then removed from every document, unless they are more than ``max_share`` of its
characters: such a document is a copy rather than a page with a footer, and is left whole
to the operators on documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pickwise.llm.common import small_join, stored

TRIMMED = " \t\r"


def _with_key(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """128 bits that stand for a row's id and text; rows equal in both share them."""
    return docs.withColumns({"__k1": F.xxhash64(F.col(id_col), F.col(text_col)), "__k2": F.xxhash64(F.col(text_col), F.col(id_col))})


def _lines(keyed: DataFrame, text_col: str, site: Column, min_chars: int) -> DataFrame:
    """(k1, k2, site, pos, h1, h2, size) of every line long enough to count."""
    split = keyed.select("__k1", "__k2", site.alias("site"), F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line"))
    body = F.btrim(F.col("line"), F.lit(TRIMMED))
    return (split.where(F.length(body) >= min_chars)
            .select("__k1", "__k2", "site", "pos", F.xxhash64(body).alias("h1"), F.xxhash64(F.lit(1), body).alias("h2"),
                    F.length(body).alias("size")))


def spread_lines(lines: DataFrame, min_sites: int, margin: float = 0.15, precision: int = 12) -> tuple[DataFrame, DataFrame]:
    """(candidates, occurrences): line hashes estimated at least near ``min_sites``, with ``sure``, and where they stand."""
    sketches = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(precision)).alias("sketch"))
    estimate = F.hll_sketch_estimate("sketch")
    near = sketches.select("h1", "h2", estimate.alias("sites")).where(F.col("sites") >= min_sites * (1 - margin))
    candidates = stored(near.select("h1", "h2", (F.col("sites") > min_sites * (1 + margin)).alias("sure")), "spread")
    return candidates, stored(small_join(lines, candidates, ["h1", "h2"]), "occurrences")


def boilerplate(occurrences: DataFrame, min_sites: int) -> DataFrame:
    """Occurrences of the lines whose spread holds: sure ones, and near ones by exact count."""
    near = occurrences.where(~F.col("sure"))
    pairs = near.select("h1", "h2", "site").distinct()     # one row per line and site: a hot line is combined in each task
    exact = stored(pairs.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites).select("h1", "h2"), "exact")
    return occurrences.where("sure").unionByName(small_join(near, exact, ["h1", "h2"]))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
                min_sites: int = 8, min_chars: int = 15, max_share: float = 0.5) -> DataFrame:
    """Documents without cross-site boilerplate lines, with n_lines and n_removed.

    Lines are the pieces between newlines, compared after trimming blanks, tabs and carriage
    returns; those shorter than ``min_chars`` characters are never boilerplate. A null site
    counts as one site of its own. Null text stays null (0 lines), empty text is one empty
    line and stays. Rows equal in id and text get the same answer. All other columns stay;
    n_lines and n_removed are replaced."""
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    keyed = _with_key(docs.select(*[F.col(f"`{c}`") for c in columns]), text_col, id_col)
    lines = _lines(keyed, text_col, F.coalesce(F.col(site_col).cast("string"), F.lit("\x00")), min_chars)
    _, occurrences = spread_lines(lines, min_sites)
    marks = (boilerplate(occurrences, min_sites).select("__k1", "__k2", "pos", "size").distinct()
             .groupBy("__k1", "__k2").agg(F.collect_set("pos").alias("__drop"), F.sum("size").alias("__size")))
    joined = keyed.join(marks, ["__k1", "__k2"], "left")
    text = F.col(text_col)
    takes = F.col("__drop").isNotNull() & (F.col("__size") <= F.lit(max_share) * F.length(text))
    parts = F.split(text, "\n")
    rest = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__drop"))
    cleaned = F.array_join(F.transform(rest, lambda i: F.get(parts, i)), "\n")
    return joined.select(*[F.when(takes, cleaned).otherwise(text).alias(text_col) if c == text_col else F.col(f"`{c}`") for c in columns],
                         F.when(text.isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"),
                         F.when(takes, F.size("__drop")).otherwise(0).cast("long").alias("n_removed"))


def oracle_sql(min_sites: int = 8, min_chars: int = 15, max_share: float = 0.5) -> str:
    """The same rule for DuckDB over the table ``documents``, by exact counts throughout."""
    return f"""
WITH parts AS (SELECT doc_id, text, source, string_split(text, chr(10)) AS p FROM documents),
lines AS (SELECT doc_id, text, coalesce(source, '?') AS site, unnest(p) AS line, generate_subscripts(p, 1) AS pos FROM parts),
trimmed AS (SELECT doc_id, text, site, pos, trim(line, ' ' || chr(9) || chr(13)) AS body FROM lines),
spread AS (SELECT body FROM trimmed WHERE length(body) >= {min_chars} GROUP BY body HAVING count(DISTINCT site) >= {min_sites}),
marks AS (SELECT doc_id, text, list(DISTINCT pos) AS gone, sum(length(body)) AS size FROM (SELECT DISTINCT doc_id, text, pos, body FROM trimmed SEMI JOIN spread USING (body)) GROUP BY doc_id, text),
judged AS (SELECT parts.*, CASE WHEN size <= {max_share} * length(text) THEN gone END AS gone FROM parts LEFT JOIN marks USING (doc_id, text))
SELECT doc_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(p, lambda x, i: NOT list_contains(gone, i)), chr(10)) END AS text,
       CAST(coalesce(len(p), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed
FROM judged"""
