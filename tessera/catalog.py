"""The engine's own queries over the driver's tables, each with its SQL twin.

Corpora: ``documents`` with path source/lang/doc_id, ``pages`` with their url, ``conversations`` with
conversation/turn-role. Old and new snapshots are both derived from ``documents`` by id.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import bloom
from tessera.functions.text import grouped
from tessera.operators import early, files, formats, groups, index, info, lines, slices, snapshot
from tessera.operators.parts import parts
from tessera.plans.options import parse_options
from tessera.sources import tree
from tessera.sources.config import parse_config
from tessera.workers import importable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DOCS = "docs AS (SELECT source || '/' || lang || '/' || doc_id AS path, doc_id, text AS content FROM documents)"
SPLIT = """{name} AS (
  SELECT path, CAST(line_no AS INTEGER) AS line_no, line, line_no < n AS ended FROM (
    SELECT path, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no, len(ls) AS n
    FROM (SELECT path, string_split(content, chr(10)) AS ls FROM {source} WHERE content <> '')) WHERE line_no < n OR line <> '')"""
LINES = f"{DOCS}, {SPLIT.format(name='lines', source='docs')}"
FOLD = f"translate({{}}, '{UPPER}', '{LOWER}')"


def query(oracle: str):
    def keep(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable(spark)
            return fn(spark, sf_dir)

        QUERIES[fn.__name__], ORACLES[fn.__name__] = run, oracle
        return run

    return keep


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rows.select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("url").alias("path"), F.col("html").alias("content"))


def talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select(F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit("-"), F.col("role")).alias("path"), F.col("text").alias("content"))


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.entries(spark.read.parquet(f"{sf_dir}/pages.parquet").select("url", "page_id"), F.col("page_id"))


# --- lines ------------------------------------------------------------------------------------


@query(rf"WITH {LINES} SELECT path, line_no, line FROM lines WHERE regexp_matches(line, '\bth[a-z]+ing\b')")
def search_regex(spark, sf_dir):
    return lines.ordered(lines.search(documents(spark, sf_dir), r"\bth[a-z]+ing\b")).select("path", "line_no", "line")


@query(f"WITH {LINES} SELECT path, line_no, line FROM lines WHERE contains(line, 'and the.')")
def search_literal(spark, sf_dir):
    return lines.ordered(lines.search(documents(spark, sf_dir), "and the.", parse_options("l"))).select("path", "line_no", "line")


@query(rf"WITH {LINES} SELECT path, line_no, line FROM lines WHERE regexp_matches(line, '\bé')")
def search_wordboundary(spark, sf_dir):
    return lines.search(documents(spark, sf_dir), r"\bé").select("path", "line_no", "line")


@query(f"WITH {LINES} SELECT path, line_no, line FROM lines WHERE regexp_matches({FOLD.format('line')}, '^e[a-z]+ t')")
def search_ignorecase(spark, sf_dir):
    return lines.search(documents(spark, sf_dir), "^E[a-z]+ T", parse_options("i")).select("path", "line_no", "line")


@query(f"""WITH {LINES} SELECT path, line_no, CAST(strlen(regexp_extract(line, '^(.*?)(?:[[:digit:]]{{2,}}|ñ[a-z]*)', 1)) + 1 AS INTEGER) AS col,
  CAST(strlen(regexp_extract(line, '^(.*?)(?:[[:digit:]]{{2,}}|ñ[a-z]*)', 1)) + 1 + strlen(regexp_extract(line, '[[:digit:]]{{2,}}|ñ[a-z]*')) AS INTEGER) AS end_col
  FROM lines WHERE regexp_matches(line, '[[:digit:]]{{2,}}|ñ[a-z]*')""")
def search_columns(spark, sf_dir):
    asked, options = "[[:digit:]]{2,}|ñ[a-z]*", parse_options("CE")
    return lines.columns(lines.search(documents(spark, sf_dir), asked, options), asked, options).select("path", "line_no", "col", "end_col")


@query(f"""WITH {LINES} SELECT path, line_no, CAST(strlen(regexp_extract(line, '^(.*?)(?:e*$)', 1)) + 1 AS INTEGER) AS col FROM lines
  WHERE regexp_matches(line, 'e*$') AND (ended OR strlen(regexp_extract(line, 'e*$')) > 0 OR strlen(regexp_extract(line, '^(.*?)(?:e*$)', 1)) < strlen(line))""")
def search_empty_matches(spark, sf_dir):
    return lines.columns(lines.search(documents(spark, sf_dir), "e*$"), "e*$").select("path", "line_no", "col")


@query(f"""WITH {LINES} SELECT path, line_no, line FROM lines WHERE regexp_matches({FOLD.format('path')}, '^src[0-4]/')
  AND NOT regexp_matches({FOLD.format('path')}, '/(fr|de)/') AND regexp_matches(line, 'tion\\b')""")
def search_include_exclude(spark, sf_dir):
    return lines.search(documents(spark, sf_dir), r"tion\b", parse_options("fi^SRC[0-4]/ fe/(fr|DE)/")).select("path", "line_no", "line")


@query(f"WITH {LINES} SELECT path, line_no, line FROM lines WHERE regexp_matches(line, 'the') ORDER BY path, line_no LIMIT 25")
def search_limit(spark, sf_dir):
    return lines.ordered(lines.search(documents(spark, sf_dir), "the"), 25).select("path", "line_no", "line")


@query(f"WITH {LINES} SELECT path, line_no, line FROM lines WHERE regexp_matches(line, 'e[a-z]+ion\\b') ORDER BY path, line_no LIMIT 300")
def search_first(spark, sf_dir):
    """A limit that ends early, by ranges of paths."""
    return early.search_first(documents(spark, sf_dir), r"e[a-z]+ion\b", parse_options("L300")).select("path", "line_no", "line")


DEEP = "([a-zé]+, )+[a-z]+[.]"
WHOLE = f"{DOCS}, lines AS (SELECT path, 1 AS line_no, replace(content, chr(10), ' ') AS line FROM docs)"


@query(f"""WITH {WHOLE} SELECT path, CAST(strlen(regexp_extract(line, '^(.*?)(?:{DEEP})', 1)) + 1 AS INTEGER) AS col,
  CAST(strlen(regexp_extract(line, '^(.*?)(?:{DEEP})', 1)) + 1 + strlen(regexp_extract(line, '{DEEP}')) AS INTEGER) AS end_col FROM lines WHERE regexp_matches(line, '{DEEP}')""")
def search_deep(spark, sf_dir):
    """Repeated groups over whole documents as one line each, which the JVM's engine would recurse on."""
    whole = documents(spark, sf_dir).withColumn("content", F.translate("content", "\n", " "))
    options = parse_options("CE")
    return lines.columns(lines.search(whole, DEEP, options), DEEP, options).select("path", "col", "end_col")


@query(f"""WITH {LINES} SELECT path, line_no, replace(regexp_replace(line, '(e[a-z]* )+of', '<<\\0>>', 'g'), '>><<', '') AS marked FROM lines WHERE regexp_matches(line, '(e[a-z]* )+of')""")
def highlight_deep(spark, sf_dir):
    found = lines.search(documents(spark, sf_dir), "(e[a-z]* )+of")
    return found.select("path", "line_no", formats.highlighted(F.col("line"), "(e[a-z]* )+of", begin="<<", end=">>").alias("marked"))


@query(f"""WITH {LINES}, pg AS (SELECT url AS path, html AS content FROM pages), {SPLIT.format(name='pl', source='pg')},
  cv AS (SELECT conv_id || '/' || turn || '-' || role AS path, text AS content FROM conversations), {SPLIT.format(name='cl', source='cv')},
  every AS (SELECT 0 AS project_ord, 'documents' AS project, * FROM lines UNION ALL SELECT 1, 'pages', * FROM pl UNION ALL SELECT 2, 'conversations', * FROM cl UNION ALL SELECT 3, 'pages', * FROM pl)
  SELECT project_ord, project, path, line_no, line FROM every WHERE regexp_matches(line, '[A-Z][a-z]+\\. [A-Z]')""")
def search_multi_project(spark, sf_dir):
    chosen = [("documents", documents(spark, sf_dir)), ("pages", pages(spark, sf_dir)), ("conversations", talks(spark, sf_dir)), ("pages", pages(spark, sf_dir))]
    return lines.search_projects(chosen, r"[A-Z][a-z]+\. [A-Z]").select("project_ord", "project", "path", "line_no", "line")


@query(f"""WITH {LINES} SELECT path || ':' || line_no || ':' || (strlen(regexp_extract(line, '^(.*?)(?:[aeiou]{{3}})', 1)) + 1) || ':' || line AS text
  FROM lines WHERE regexp_matches(line, '[aeiou]{{3}}')""")
def format_grep(spark, sf_dir):
    asked, options = "[aeiou]{3}", parse_options("C")
    return formats.rendered(lines.columns(lines.search(documents(spark, sf_dir), asked, options), asked, options), asked, options).select("text")


@query(f"""WITH {LINES} SELECT translate(path, '/', '\\') || '(' || line_no || ',' || (strlen(regexp_extract(line, '^(.*?)(?:[aeiou]{{3}})', 1)) + 1) || ',' ||
  (strlen(regexp_extract(line, '^(.*?)(?:[aeiou]{{3}})', 1)) + 4) || '):' || line AS text FROM lines WHERE regexp_matches(line, '[aeiou]{{3}}')""")
def format_vs(spark, sf_dir):
    asked, options = "[aeiou]{3}", parse_options("V CE")
    return formats.rendered(lines.columns(lines.search(documents(spark, sf_dir), asked, options), asked, options), asked, options).select("text")


@query(f"""WITH {LINES} SELECT path, line_no, replace(regexp_replace(line, 'th[ae]', '<<\\0>>', 'g'), '>><<', '') AS marked FROM lines WHERE regexp_matches(line, 'th[ae]')""")
def highlight(spark, sf_dir):
    found = lines.search(documents(spark, sf_dir), "th[ae]")
    return found.select("path", "line_no", formats.highlighted(F.col("line"), "th[ae]", begin="<<", end=">>").alias("marked"))


# --- paths ------------------------------------------------------------------------------------

URLS = r"u AS (SELECT page_id AS ord, url AS path, regexp_extract(url, '[^/\\]*$') AS name FROM pages WHERE url <> '')"


@query(rf"WITH {URLS} SELECT ord, path FROM u WHERE regexp_matches(path, '/en/[0-9]+(\?page=|#)')")
def files_path_regex(spark, sf_dir):
    return files.find(urls(spark, sf_dir), r"/en/[0-9]+(\?page=|#)").select("ord", "path")


@query(f"WITH {URLS} SELECT ord, path, name FROM u WHERE regexp_matches(name, '^[0-9]*7$')")
def files_name_regex(spark, sf_dir):
    return files.find(urls(spark, sf_dir), "^[0-9]*7$", parse_options("fn")).select("ord", "path", "name")


@query(f"WITH {URLS} SELECT ord, path FROM u WHERE contains({FOLD.format('path')}, '/en') AND contains({FOLD.format('name')}, '7') AND contains({FOLD.format('name')}, 'ref')")
def files_tokens(spark, sf_dir):
    return files.find(urls(spark, sf_dir), "7 /EN ref", parse_options("fs i")).select("ord", "path")


@query(f"WITH {URLS} SELECT ord, path, name FROM u")
def files_dump(spark, sf_dir):
    return files.find(urls(spark, sf_dir), "")


def fuzzy_sql(asked: str, tail: str) -> str:
    """The rank as a chain of joins over the places of each character."""
    side = "CASE WHEN {0} IS NULL THEN 0 WHEN c BETWEEN 'a' AND 'z' OR c IN ('[', '{{') THEN CASE WHEN {0} IN ('/', '.') THEN 1 WHEN {0} IN ('_', '-') THEN 2 ELSE 4 END ELSE 4 END"
    steps = [
        f"WITH u AS (SELECT page_id AS ord, url AS path, {FOLD.format('url')} AS s FROM pages WHERE url <> '')",
        "ch AS (SELECT ord, s, unnest(range(1, length(s) + 1)) AS p FROM u)",
        "nb AS (SELECT ord, p, substr(s, p, 1) AS c, CASE WHEN p > 1 THEN substr(s, p - 1, 1) END AS a, CASE WHEN p < length(s) THEN substr(s, p + 1, 1) END AS b FROM ch)",
        f"pos AS (SELECT ord, p, c, {side.format('a')} AS l, {side.format('b')} AS r FROM nb)",
        f"s1 AS (SELECT ord, p, r, l AS cost FROM pos WHERE c = '{asked[0]}')",
    ]
    cost = "x.cost + CASE WHEN y.p = x.p + 1 THEN 0 ELSE x.r + 8 + y.p - x.p + y.l END"
    for k, c in enumerate(asked[1:-1], 2):
        steps.append(f"s{k} AS (SELECT y.ord, y.p, y.r, min({cost}) AS cost FROM s{k - 1} x JOIN pos y ON y.ord = x.ord AND y.c = '{c}' AND y.p > x.p GROUP BY ALL)")
    last = len(asked) - 1
    steps.append(f"nx AS (SELECT x.ord, x.p, x.r, x.cost, min(y.p) AS q FROM s{last} x JOIN pos y ON y.ord = x.ord AND y.c = '{asked[-1]}' AND y.p > x.p GROUP BY ALL)")
    steps.append(f"sc AS (SELECT x.ord, CAST(min({cost} + y.r) AS INTEGER) AS score FROM nx x JOIN pos y ON y.ord = x.ord AND y.p = x.q GROUP BY x.ord)")
    return ", ".join(steps) + f" SELECT sc.ord, u.path, score FROM sc JOIN u USING (ord) {tail}"


@query(f"WITH {URLS} SELECT ord, path FROM u WHERE regexp_matches({FOLD.format('path')}, '(?s)' || 'e.*?x.*?a.*?m.*?/.*?e.*?n.*?8')")
def files_fuzzy_match(spark, sf_dir):
    return urls(spark, sf_dir).where(files.subsequence("exam/en8")).select("ord", "path")


@query(fuzzy_sql("exam/en8", ""))
def files_fuzzy_rank(spark, sf_dir):
    return files.find(urls(spark, sf_dir), "exam/en8", parse_options("ff")).select("ord", "path", "score")


@query(fuzzy_sql("tp/e", "ORDER BY score, ord LIMIT 15"))
def files_fuzzy_first(spark, sf_dir):
    """The best of many more matches than the limit, with ties in input order."""
    return files.find(urls(spark, sf_dir), "tp/e", parse_options("ff L15")).select("ord", "path", "score")


@query(fuzzy_sql("tion/s1", "ORDER BY score, ord LIMIT 20"))
def files_fuzzy_topk(spark, sf_dir):
    return files.find(urls(spark, sf_dir), "tion/s1", parse_options("ff L20")).select("ord", "path", "score")


@query(f"""WITH cv AS (SELECT conv_id || '/' || turn || '-' || role AS path, text AS content FROM conversations), {SPLIT.format(name='cl', source='cv')}
  SELECT path AS source, line_no, line AS path FROM cl WHERE line <> '' AND regexp_matches({FOLD.format('line')}, '^the[a-z]* o')""")
def filter_lines(spark, sf_dir):
    rows = lines.lines(talks(spark, sf_dir))
    found = files.find(files.entries(rows.select("line", F.struct("path", "line_no").alias("at")), F.col("at")), "^The[a-z]* o", parse_options("i"))
    return found.select(F.col("ord.path").alias("source"), F.col("ord.line_no").alias("line_no"), "path")


KINDS = "CASE lang WHEN 'fr' THEN '.git' WHEN 'de' THEN 'CVS' WHEN 'es' THEN '.github' ELSE 'a.svn' END"


@query(f"""WITH p AS (SELECT source || '/' || {KINDS} || '/' || doc_id AS path FROM documents UNION ALL SELECT {KINDS} || '/' || doc_id FROM documents UNION ALL SELECT source || '/' || {KINDS} FROM documents)
  SELECT path FROM p WHERE len(list_filter(string_split(path, '/'), lambda n: n IN ('CVS', '.bzr', '.git', '.hg', '.svn'))) = 0""")
def skip_versioned(spark, sf_dir):
    """Paths through folders of version control go; names that only begin or end so stay."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", F.expr(KINDS).alias("kind"), F.col("doc_id").cast("string").alias("id"))
    paths = rows.select(F.explode(F.array(F.concat_ws("/", "source", "kind", "id"), F.concat_ws("/", "kind", "id"), F.concat_ws("/", "source", "kind"))).alias("path"))
    return paths.where(tree.not_versioned(F.col("path")))


# --- statistics -------------------------------------------------------------------------------

COUNTED = f"""{LINES}, per AS (SELECT path, count(*) AS n, max(strlen(line)) AS longest FROM lines GROUP BY path),
  f AS (SELECT docs.path, strlen(content) AS bytes, coalesce(n, 0) AS n, coalesce(longest, 0) AS longest FROM docs LEFT JOIN per USING (path))"""


@query(f"""WITH {COUNTED} SELECT count(DISTINCT path) AS files, count(*) AS parts, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(n) AS BIGINT) AS lines,
  max(longest) AS longest_line, (SELECT max(path) FROM f WHERE longest = (SELECT max(longest) FROM f)) AS longest_file FROM f""")
def info_summary(spark, sf_dir):
    return info.summary(documents(spark, sf_dir))


@query(f"WITH {LINES} SELECT path, count(*) AS n_lines, max(strlen(line)) AS longest FROM lines GROUP BY path")
def info_lines(spark, sf_dir):
    return info.line_lengths(documents(spark, sf_dir))


CHUNKS = f"""{DOCS}, sized AS (SELECT path, strlen(content) AS size FROM docs),
  placed AS (SELECT path, size, CAST(coalesce(sum(size) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {info.CHUNK} AS BIGINT) AS chunk_id FROM sized)"""


@query(f"WITH {CHUNKS} SELECT path, CAST(size AS BIGINT) AS size, chunk_id FROM placed")
def chunk_files(spark, sf_dir):
    return info.chunked(documents(spark, sf_dir))


@query(f"""WITH {CHUNKS}, c AS (SELECT chunk_id, sum(size) AS size FROM placed GROUP BY chunk_id)
  SELECT count(*) AS chunks, CAST(sum(size) AS BIGINT) AS total, CAST(min(size) FILTER (WHERE chunk_id < (SELECT max(chunk_id) FROM c)) AS BIGINT) AS least, CAST(max(size) AS BIGINT) AS most, avg(size) AS mean FROM c""")
def info_chunks(spark, sf_dir):
    return info.chunk_stats(info.chunked(documents(spark, sf_dir)))


PARTS = "SELECT doc_id, source || '/' || lang AS path, row_number() OVER w AS part_no, coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN doc_id % 97 = 5 THEN 1 ELSE 0 END AS start_line, n AS n_lines, CASE WHEN doc_id % 89 = 3 THEN 1 ELSE 0 END AS size, 7 AS mtime, doc_id // 100 - CASE WHEN doc_id % 101 = 9 THEN 5 ELSE 0 END AS chunk_id FROM nl WINDOW w AS (PARTITION BY source, lang ORDER BY doc_id)"


@query(f"""WITH nl AS (SELECT doc_id, source, lang, len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) OR text = '' THEN 1 ELSE 0 END AS n FROM documents),
  parts AS ({PARTS}), l AS (SELECT *, lag(chunk_id) OVER w AS pc, lag(size) OVER w AS ps, lag(start_line + n_lines) OVER w AS pe, lag(part_no) OVER w AS pp FROM parts WINDOW w AS (PARTITION BY path ORDER BY part_no))
  SELECT path, CAST(part_no AS INTEGER) AS part_no, pp IS NULL OR chunk_id >= pc AS order_ok, pp IS NULL OR size = ps AS metadata_ok, CASE WHEN pp IS NULL THEN start_line = 0 ELSE start_line = pe END AS lines_ok FROM l""")
def info_integrity(spark, sf_dir):
    from pyspark.sql import Window as W

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.concat_ws("/", "source", "lang").alias("path"), F.col("text").alias("content"))
    rows = info.line_counts(rows)
    own = W.partitionBy("path").orderBy("doc_id")
    rows = rows.withColumn("part_no", F.row_number().over(own))
    start = F.coalesce(F.sum("n_lines").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.when(F.col("doc_id") % 97 == 5, 1).otherwise(0)
    rows = rows.withColumn("start_line", start).withColumn("size", F.when(F.col("doc_id") % 89 == 3, 1).otherwise(0)).withColumn("mtime", F.lit(7))
    return info.integrity(rows.withColumn("chunk_id", F.floor(F.col("doc_id") / 100) - F.when(F.col("doc_id") % 101 == 9, 5).otherwise(0)))


@query("SELECT n_nationkey AS k, replace(format('{:,}', CAST(n_nationkey AS BIGINT) * 1234567), ',', ' ') AS shown FROM nation")
def grouped_integers(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return rows.select(F.col("n_nationkey").alias("k"), grouped(F.col("n_nationkey").cast("long") * 1234567).alias("shown"))


# --- snapshots --------------------------------------------------------------------------------

OLD = "old AS (SELECT path, content, 1000 + doc_id AS mtime, strlen(content) AS size FROM docs WHERE doc_id % 19 <> 0)"
NEW = "new AS (SELECT path, content, 1000 + doc_id AS mtime, strlen(content) AS size FROM (SELECT path, doc_id, CASE WHEN doc_id % 13 = 0 THEN content || chr(10) || 'changed thing' ELSE content END AS content FROM docs WHERE doc_id % 17 <> 0))"
DIFF = f"""{DOCS}, {OLD}, {NEW}, diff AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed'
  WHEN o.mtime = n.mtime AND o.size = n.size THEN 'reused' ELSE 'changed' END AS status FROM old o FULL OUTER JOIN new n ON o.path = n.path)"""


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = documents(spark, sf_dir).withColumn("id", F.element_at(F.split("path", "/"), -1).cast("long"))
    sized = lambda x: x.select("path", "content", (F.col("id") + 1000).alias("mtime"), F.octet_length("content").cast("long").alias("size"))
    later = F.when(F.col("id") % 13 == 0, F.concat("content", F.lit("\nchanged thing"))).otherwise(F.col("content"))
    return sized(rows.where("id % 19 <> 0")), sized(rows.where("id % 17 <> 0").withColumn("content", later))


@query(f"WITH {DIFF} SELECT path, status FROM diff")
def update_diff(spark, sf_dir):
    old, new = snapshots(spark, sf_dir)
    return snapshot.differences(old, new)


@query(f"WITH {DIFF} SELECT status, count(*) AS n FROM diff GROUP BY status")
def update_stats(spark, sf_dir):
    old, new = snapshots(spark, sf_dir)
    return snapshot.difference_counts(snapshot.differences(old, new))


@query(f"WITH {DIFF} SELECT path FROM diff WHERE status <> 'reused' UNION SELECT path FROM docs WHERE doc_id % 50 = 1")
def change_union(spark, sf_dir):
    old, new = snapshots(spark, sf_dir)
    listed = documents(spark, sf_dir).where(F.element_at(F.split("path", "/"), -1).cast("long") % 50 == 1)
    return snapshot.merged_changes(snapshot.changed_paths(old, new), listed)


@query(f"""WITH {DIFF}, now AS (SELECT path, content FROM old WHERE path IN (SELECT path FROM diff WHERE status = 'reused') UNION ALL
  SELECT path, content FROM new WHERE path IN (SELECT path FROM diff WHERE status <> 'reused')), {SPLIT.format(name='lines', source='now')}
  SELECT path, line_no, line FROM lines WHERE regexp_matches(line, 'thing$')""")
def overlay_search(spark, sf_dir):
    old, new = snapshots(spark, sf_dir)
    return snapshot.search_overlaid(old.select("path", "content"), snapshot.changed_paths(old, new), new, "thing$").select("path", "line_no", "line")


@query(f"""WITH {DIFF}, parts AS (SELECT o.path, o.mtime, o.size, doc_id // 100 AS chunk_id FROM old o JOIN docs USING (path))
  SELECT chunk_id, bool_and(coalesce(p.mtime = n.mtime AND p.size = n.size, false)) AS current FROM parts p LEFT JOIN new n USING (path) GROUP BY chunk_id""")
def chunk_currentness(spark, sf_dir):
    old, new = snapshots(spark, sf_dir)
    parts = old.withColumn("chunk_id", F.expr("cast(element_at(split(path, '/'), -1) as bigint) div 100"))
    return snapshot.current_chunks(parts, new)


@query("""WITH f AS (SELECT '/o/' || l_orderkey || '/' || l_linenumber AS path FROM lineitem), r AS (SELECT DISTINCT '/o/' || o_orderkey AS root FROM orders WHERE o_orderpriority = '1-URGENT')
  SELECT path, root, substr(path, length(root) + 2) AS rest FROM f JOIN r ON starts_with(path, root || '/') AND root = regexp_extract(path, '^/o/[0-9]+')""")
def change_membership(spark, sf_dir):
    """Which of thousands of folders hold a path, in one join."""
    paths = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat(F.lit("/o/"), F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string")).alias("path"))
    roots = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("/o/"), F.col("o_orderkey").cast("string"), F.lit("/")).alias("root"))
    return groups.under_roots(paths, roots).select("path", "root", "rest")


CONFIG = """path /corpus
include ^src1
exclude /es$
group
  path /corpus
  include /(EN|fr)/
  exclude [05]$
endgroup
"""


@query(f"""WITH {DOCS} SELECT path, regexp_matches({FOLD.format('path')}, '/(en|fr)/') AND NOT regexp_matches(path, '[05]$') AND NOT regexp_matches(regexp_extract(path, '^[^/]*'), '[05]$')
  AND regexp_matches({FOLD.format('path')}, '^src1') AND NOT regexp_matches({FOLD.format('path')}, '/es$') AND NOT regexp_matches(path, '/es/') AS accepted FROM docs""")
def group_acceptance(spark, sf_dir):
    inner = parse_config(CONFIG, "/").groups[0]
    return documents(spark, sf_dir).select("path", groups.accepted(inner, F.col("path")).alias("accepted"))


@query("""WITH c AS (SELECT l_orderkey AS k FROM lineitem UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)
  SELECT CAST(k AS VARCHAR) AS path FROM c GROUP BY k""")
def project_union(spark, sf_dir):
    """Files that several groups find, each path once."""
    inner = parse_config("path /a\ngroup\npath /b\nendgroup\n", "/")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat(F.lit("/a/"), F.col("l_orderkey").cast("string")).alias("path"))
    more = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey % 3 = 0").select(F.concat(F.lit("/a/"), F.col("o_orderkey").cast("string")).alias("path"))
    return groups.project_files(inner, rows.unionByName(more)).select(F.substring("path", 4, 100).alias("path"))


CODES = ("utf-8", "utf-16-le", "utf-16-be", "utf-32-be")


@query(f"WITH {DOCS} SELECT path, content FROM docs")
def transcoding(spark, sf_dir):
    """All documents, written in one of several encodings with its mark and with CRLF line ends, read back as they were."""
    rows = documents(spark, sf_dir).withColumn("code", F.pmod(F.xxhash64("path"), F.lit(len(CODES))))
    crlf = F.replace("content", F.lit("\n"), F.lit("\r\n"))
    raw = [F.concat(F.unhex(F.lit("EFBBBF")), F.encode(crlf, "UTF-8")), F.concat(F.unhex(F.lit("FFFE")), F.encode(crlf, "UTF-16LE")), F.concat(F.unhex(F.lit("FEFF")), F.encode(crlf, "UTF-16BE")), F.concat(F.unhex(F.lit("0000FEFF")), F.encode(crlf, "UTF-32"))]
    coded = F.when(F.col("code") == 0, raw[0]).when(F.col("code") == 1, raw[1]).when(F.col("code") == 2, raw[2]).otherwise(raw[3])
    return rows.select("path", tree.decoded(coded).alias("content"))


@query(rf"WITH {LINES} SELECT path, line_no, line FROM lines WHERE regexp_matches(line, 'e\.$')")
def search_parts(spark, sf_dir):
    """Lines of files cut into parts have the numbers they have in the whole."""
    return lines.search(parts(documents(spark, sf_dir), 2048), r"e\.$").select("path", "line_no", "line")


@query(f"""WITH {LINES} SELECT chr(27) || '[;0;35m' || path || chr(27) || '[0m' || chr(27) || '[;0;36m:' || chr(27) || '[0m' || chr(27) || '[;0;32m' || line_no || chr(27) || '[0m' || chr(27) || '[;0;36m:' || chr(27) || '[0m' ||
  replace(regexp_replace(line, 'qu[aeiou]', chr(27) || '[;01;31m\\0' || chr(27) || '[0m', 'g'), chr(27) || '[0m' || chr(27) || '[;01;31m', '') AS text FROM lines WHERE regexp_matches(line, 'qu[aeiou]')""")
def format_highlight(spark, sf_dir):
    options = parse_options("H")
    return formats.rendered(lines.search(documents(spark, sf_dir), "qu[aeiou]", options), "qu[aeiou]", options).select("text")


@query(f"WITH {URLS} SELECT ord, path FROM u WHERE regexp_matches(name, '^[a-z]*3')")
def files_style_priority(spark, sf_dir):
    """Of several styles the name wins over the path, tokens and fuzzy."""
    return files.find(urls(spark, sf_dir), "^[a-z]*3", parse_options("ff fs fp fn")).select("ord", "path")


@query(f"WITH {LINES} SELECT count(*) AS matches FROM lines WHERE contains(line, 'the')")
def match_count(spark, sf_dir):
    return lines.search(documents(spark, sf_dir), "the", parse_options("l")).agg(F.count(F.lit(1)).alias("matches"))


@query(f"""WITH {DOCS} SELECT path FROM docs WHERE (starts_with(path, 'src1/') OR starts_with(path, 'src2/en/') OR path = 'src3/en/7')
  AND (path = 'src3/en/7' OR (regexp_matches(regexp_extract(path, '^src1/(.*)$|^src2/en/(.*)$'), '[02468]$') AND NOT regexp_matches(path, '^src1/de/') AND NOT regexp_matches(path, '99')))""")
def change_acceptance(spark, sf_dir):
    """Changed paths count if a folder of the project holds them and its groups accept what follows it, or if they are named."""
    group = parse_config("path /src1\npath /src2/en/\nfile /src3/en/7\ninclude [02468]$\nexclude ^DE$\nexclude 99\n", "/")
    changed = documents(spark, sf_dir).select(F.concat(F.lit("/"), "path").alias("path"))
    return groups.project_files(group, changed).select(F.substring("path", 2, 1000).alias("path"))


# --- index ------------------------------------------------------------------------------------

GRAMS = f"""{DOCS}, bytes AS (SELECT path, hex(encode({FOLD.format('content')})) AS h FROM docs),
  each AS (SELECT path, h, unnest(range(0, length(h) // 2 - 3)) AS i FROM bytes WHERE length(h) > 6), g AS (SELECT path, substr(h, 2 * i + 1, 8) AS g FROM each),
  n AS (SELECT path, count(DISTINCT g) AS n FROM g WHERE substr(g, 1, 2) <> '0A' AND substr(g, 3, 2) <> '0A' AND substr(g, 5, 2) <> '0A' AND substr(g, 7, 2) <> '0A' GROUP BY path)"""


@query(f"WITH {GRAMS} SELECT path, coalesce(n, 0) AS n_grams FROM docs LEFT JOIN n USING (path)")
def gram_count(spark, sf_dir):
    return index.gram_sets(documents(spark, sf_dir)).select("path", F.size("grams").cast("long").alias("n_grams"))


PRUNED = "(pathetic|worthless) [a-z]+"


def chunked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a chunk number; a chunk's rows follow each other in the table."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rows.select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"), F.expr("doc_id div 64").alias("chunk_id"))


@query(f"WITH {LINES} SELECT path, line_no, line FROM lines WHERE regexp_matches(line, '{PRUNED}')")
def gram_prune(spark, sf_dir):
    corpus = chunked_documents(spark, sf_dir)
    return index.search_indexed(corpus, index.blooms(corpus), PRUNED).select("path", "line_no", "line")


@query(f"WITH {LINES} SELECT path, line_no, line FROM lines WHERE regexp_matches(line, '{PRUNED}')")
def gram_bruteforce(spark, sf_dir):
    corpus = chunked_documents(spark, sf_dir)
    return index.search_indexed(corpus, index.blooms(corpus), PRUNED, parse_options("b")).select("path", "line_no", "line")


@query(f"WITH {LINES} SELECT path, line_no, line FROM lines WHERE regexp_matches(line, '{PRUNED}')")
def slice_prune(spark, sf_dir):
    """The same by slices, without Python in the search."""
    corpus = chunked_documents(spark, sf_dir)
    need = index.wanted(PRUNED, parse_options(""))
    return lines.search(slices.pruned(corpus, slices.sliced(corpus), need), PRUNED).select("path", "line_no", "line")


@query("""WITH c AS (SELECT doc_id // 64 AS chunk_id, CAST(sum(strlen(text)) + count(*) - 1 AS BIGINT) AS bytes FROM documents GROUP BY doc_id // 64)
  SELECT chunk_id, bytes, CASE WHEN bytes // 50 < 1024 THEN 0 ELSE bytes // 50 END AS filter_bytes FROM c""")
def bloom_sizes(spark, sf_dir):
    built = index.blooms(chunked_documents(spark, sf_dir).repartition("chunk_id").sortWithinPartitions("chunk_id"))
    return built.select("chunk_id", "bytes", F.octet_length("bloom").cast("long").alias("filter_bytes"))


@query("SELECT doc_id // 64 AS chunk_id, true AS holds FROM documents GROUP BY doc_id // 64")
def bloom_membership(spark, sf_dir):
    """Every chunk's filter holds all 4-grams of its own texts: a filter never rules out what is there."""
    corpus = chunked_documents(spark, sf_dir)

    @F.pandas_udf("boolean")
    def holds(raw: pd.Series, rounds: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([bloom.might_hold(b, bloom.grams(t.encode()), r) for b, r, t in zip(raw, rounds, text, strict=True)], dtype=bool)

    built = index.blooms(corpus.repartition("chunk_id").sortWithinPartitions("chunk_id"))
    return corpus.join(built, "chunk_id").groupBy("chunk_id").agg(F.bool_and(holds("bloom", "rounds", "content")).alias("holds"))


M = 4294967295


#: The two hashes of the numbers ``v`` of a table ``k``, as steps of a query that end in ``hashed(v, h1, h2)``.
HASHED = f"""a AS (SELECT v, (v + {bloom.ADD_1} + (v << 12)) & {M} AS x FROM k),
  b AS (SELECT v, xor(xor(x, {bloom.XOR_2}), x >> 19) AS x FROM a), c AS (SELECT v, (x + {bloom.ADD_3} + (x << 5)) & {M} AS x FROM b),
  d AS (SELECT v, xor((x + {bloom.ADD_4}) & {M}, (x << 9) & {M}) AS x FROM c), e AS (SELECT v, (x + {bloom.ADD_5} + (x << 3)) & {M} AS x FROM d),
  f AS (SELECT v, xor(xor(x, {bloom.XOR_6}), x >> 16) AS h1, (v * {bloom.STEP}) & {M} AS y FROM e), g AS (SELECT v, h1, xor(y, y >> 16) AS y FROM f),
  hashed AS (SELECT v, h1, (xor(y, y >> 14) + {bloom.STEP}) & {M} AS h2 FROM g)"""


#: The distinct 4-grams of each chunk, and their hashes.
CHUNK_GRAMS = f"""texts AS (SELECT doc_id // 64 AS chunk_id, strlen(text) AS n_bytes, hex(encode({FOLD.format('text')})) AS h FROM documents),
  each AS (SELECT chunk_id, h, unnest(range(0, length(h) // 2 - 3)) AS i FROM texts WHERE length(h) > 6), own AS (SELECT DISTINCT chunk_id, substr(h, 2 * i + 1, 8) AS s FROM each),
  grams AS (SELECT chunk_id, CAST('0x' || s AS BIGINT) AS v FROM own WHERE substr(s, 1, 2) <> '0A' AND substr(s, 3, 2) <> '0A' AND substr(s, 5, 2) <> '0A' AND substr(s, 7, 2) <> '0A'),
  k AS (SELECT DISTINCT v FROM grams), {HASHED}"""


@query(f"""WITH {CHUNK_GRAMS} SELECT chunk_id // {slices.GROUP} AS grp, CAST(((h1 + h2) & {M}) % {slices.SIZE} AS INTEGER) AS slice, CAST(count(DISTINCT chunk_id) AS BIGINT) AS chunks
  FROM grams JOIN hashed USING (v) GROUP BY ALL""")
def index_slices(spark, sf_dir):
    """How many chunks of each group have each bit of the index set."""
    built = slices.sliced(chunked_documents(spark, sf_dir)).where("slice >= 0").groupBy("grp", "slice").agg(F.bit_or("word").alias("word"))
    return built.select("grp", "slice", F.bit_count("word").cast("long").alias("chunks"))


@query(f"""WITH {CHUNK_GRAMS},
  sizes AS (SELECT chunk_id, CAST(sum(n_bytes) + count(*) - 1 AS BIGINT) // 50 AS size FROM texts GROUP BY chunk_id), held AS (SELECT chunk_id, count(*) AS n FROM grams GROUP BY chunk_id),
  shape AS (SELECT chunk_id, size * 8 AS bits, CAST(least(16, greatest(1, floor(0.693 * size * 8 / n))) AS INTEGER) AS rounds FROM sizes JOIN held USING (chunk_id) WHERE size >= 1024),
  marked AS (SELECT chunk_id, bits, rounds, h1, h2, unnest(range(1, rounds + 1)) AS r FROM shape JOIN grams USING (chunk_id) JOIN hashed USING (v))
  SELECT chunk_id, CAST(bits AS BIGINT) AS bits, rounds, CAST(count(DISTINCT ((h1 + r * h2) & {M}) % bits) AS BIGINT) AS set_bits FROM marked GROUP BY chunk_id, bits, rounds""")
def filter_bits(spark, sf_dir):
    """Bits, rounds and set bits of each filter that is built from the documents, as the statistics count them."""
    built = index.blooms(chunked_documents(spark, sf_dir).repartition("chunk_id").sortWithinPartitions("chunk_id"))
    bits = (F.octet_length("bloom") * 8).cast("long")
    return built.where("octet_length(bloom) > 0").select("chunk_id", bits.alias("bits"), "rounds", F.round(info.filled(F.col("bloom")) * bits).cast("long").alias("set_bits"))


@query(f"WITH k AS (SELECT DISTINCT l_orderkey * 4093 + l_partkey AS v FROM lineitem), {HASHED} SELECT v, h1, h2 FROM hashed")
def bloom_hash(spark, sf_dir):
    keys = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_orderkey") * 4093 + F.col("l_partkey")).alias("v")).distinct()
    return keys.select("v", bloom.hash_1(F.col("v")).alias("h1"), bloom.hash_2(F.col("v")).alias("h2"))
