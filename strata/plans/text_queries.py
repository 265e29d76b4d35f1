"""Projections and scalar functions over names, paths, texts and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.config import AMBIENT_NAMES, MINHASH_FUNCTIONS, STOPLIST_IDENTS, STOPWORDS
from strata.functions import dates, paths, text
from strata.functions.vectors import l2_normalize, norm
from strata.operators.ids import dense_ids
from strata.operators.similarity import minhash
from strata.plans.inputs import NOISE, SYM, TFIDF, TICKET, UNIT, commits, documents, symbol_weights, symbols
from strata.plans.registry import query
from strata.sources.tables import table


def _list(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


_TEST = r"regexp_matches(lower(file), '(^|/)(conftest\.py$|tests?(/|$)|test_|[^/]*_test\.py(/|$))')"


@query(f"SELECT DISTINCT file, {_TEST} AS is_test FROM symbols WHERE file IS NOT NULL")
def test_path(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "symbols", "file").where("file IS NOT NULL").distinct().withColumn("is_test", paths.is_test_path(F.col("file")))


_SUBWORDS = rf"""
s AS (SELECT doc_id, regexp_split_to_array(regexp_replace(regexp_replace(text, '(\p{{Ll}})(\p{{Lu}})', '\1 \2', 'g'), '([\p{{L}}\p{{N}}])(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g'), '[^\p{{L}}\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(w) AS w FROM s),
subword AS (SELECT doc_id, lower(w) AS term, count(*) AS tf FROM u WHERE strlen(w) >= 2 AND NOT regexp_full_match(w, '\p{{N}}+') AND lower(w) NOT IN ({_list(STOPWORDS)}) GROUP BY ALL)"""


@query(f"WITH {_SUBWORDS} SELECT doc_id, term, tf FROM subword")
def subword_tf(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d, "text").select("doc_id", F.explode(text.subwords(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


@query(f"SELECT DISTINCT repo, commit_id, {TICKET} AS ticket FROM commits")
def ticket_token(spark: SparkSession, d: str) -> DataFrame:
    return commits(spark, d).select("repo", "commit_id", text.first_ticket(F.col("message")).alias("ticket"))


@query(f"SELECT repo, path, {NOISE} AS noise FROM head_files")
def noise_path(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "head_files", "repo", "path").withColumn("noise", paths.is_noise_path(F.col("path")))


@query(r"""
WITH f AS (SELECT DISTINCT file, string_split(file, '/') AS p, string_split(regexp_replace(file, '\.py$', ''), '/') AS m FROM symbols WHERE file IS NOT NULL)
SELECT file, CASE WHEN len(p) > 1 THEN array_to_string(p[:-2], '/') ELSE '.' END AS dir,
  CASE WHEN len(p) > 1 THEN array_to_string(p[1:least(1, len(p) - 1)], '/') ELSE '.' END AS key1,
  CASE WHEN len(p) > 1 THEN array_to_string(p[1:least(2, len(p) - 1)], '/') ELSE '.' END AS key2,
  list_transform(range(1, len(CASE WHEN m[-1] = '__init__' THEN m[:-2] ELSE m END) + 1), lambda i: array_to_string((CASE WHEN m[-1] = '__init__' THEN m[:-2] ELSE m END)[i:], '.')) AS modules FROM f
""")
def path_features(spark: SparkSession, d: str) -> DataFrame:
    f = F.col("file")
    return table(spark, d, "symbols", "file").where("file IS NOT NULL").distinct().select("file", paths.dir_of(f).alias("dir"), paths.dir_key(f, 1).alias("key1"), paths.dir_key(f, 2).alias("key2"), paths.module_suffixes(f).alias("modules"))


@query(r"""
SELECT DISTINCT qname, string_split(qname, '.')[-1] AS base, CASE WHEN qname LIKE '%.\_\_init\_\_' ESCAPE '\' THEN regexp_replace(qname, '\.__init__$', '') END AS cls,
  regexp_full_match(string_split(qname, '.')[-1], '__.*__') AND length(string_split(qname, '.')[-1]) > 4 AS dunder FROM symbols WHERE qname IS NOT NULL
""")
def base_names(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("qname")
    return table(spark, d, "symbols", "qname").where("qname IS NOT NULL").distinct().select("qname", text.base_name(q).alias("base"), text.class_of_init(q).alias("cls"), text.is_dunder(text.base_name(q)).alias("dunder"))


@query(r"""
WITH f AS (SELECT DISTINCT string_split(file, '/') AS p FROM symbols WHERE file IS NOT NULL),
k AS (SELECT d, count(DISTINCT CASE WHEN len(p) > 1 THEN array_to_string(p[1:least(d, len(p) - 1)], '/') ELSE '.' END) AS n FROM f, range(1, 5) r(d) GROUP BY d)
SELECT CAST(coalesce(min(d) FILTER (WHERE n >= 3), 4) AS INT) AS depth FROM k
""")
def color_depth(spark: SparkSession, d: str) -> DataFrame:
    """The smallest folder depth of 1 to 4 with three keys or more, else 4, in one aggregation."""
    f = table(spark, d, "symbols", "file").where("file IS NOT NULL").distinct()
    counts = f.agg(*(F.count_distinct(paths.dir_key(F.col("file"), k)).alias(f"n{k}") for k in range(1, 5)))
    pick = F.lit(4)
    for k in range(4, 0, -1):
        pick = F.when(F.col(f"n{k}") >= 3, k).otherwise(pick)
    return counts.select(pick.cast("int").alias("depth"))


@query(f"""
WITH {SYM}, a AS (SELECT max(dating.last_touched) AS anchor FROM sym)
SELECT id, strftime(make_timestamp(dating.first_seen * 1000000), '%Y-%m-%d') AS first_day, strftime(make_timestamp(dating.last_touched * 1000000), '%Y-%m-%d') AS last_day,
  CASE WHEN dating.last_touched IS NULL OR dating.first_seen IS NULL THEN NULL WHEN anchor - dating.last_touched > 180 * 86400 THEN 'dead' WHEN anchor - dating.first_seen <= 90 * 86400 THEN 'growing' ELSE 'flat' END AS activity,
  round(pow(0.5, (anchor - dating.last_touched) / (182.5 * 86400)), 9) AS recency
FROM sym, a WHERE dating IS NOT NULL
""")
def dated_symbols(spark: SparkSession, d: str) -> DataFrame:
    s = symbols(spark, d, "dating").where("dating IS NOT NULL").select("id", "dating.first_seen", "dating.last_touched")
    anchor = F.lit(s.agg(F.max("last_touched")).first()[0])
    return s.select("id", dates.fmt_date(F.col("first_seen")).alias("first_day"), dates.fmt_date(F.col("last_touched")).alias("last_day"), dates.classify(anchor, F.col("first_seen"), F.col("last_touched")).alias("activity"), F.round(dates.recency(anchor, F.col("last_touched")), 9).alias("recency"))


@query(r"""
SELECT doc_id, CAST(CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END END AS INT) AS n_lines,
  contains(substring(text, 1, 8000), chr(0)) AS binary, CAST(length(text) + len(regexp_extract_all(text, '[\x{10000}-\x{10ffff}]')) AS BIGINT) AS utf16 FROM documents WHERE text IS NOT NULL
""")
def line_counts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return documents(spark, d, "text").where("text IS NOT NULL").select("doc_id", text.line_count(t).cast("int").alias("n_lines"), text.looks_binary(t).alias("binary"), text.utf16_length(t).cast("bigint").alias("utf16"))


@query(f"WITH {SYM} SELECT id, md5(concat(qname, '  (', file, ')', chr(10), line)) AS doc_key, substring(md5(file), 1, 16) AS repo_key FROM sym")
def doc_text_key(spark: SparkSession, d: str) -> DataFrame:
    doc = F.concat("qname", F.lit("  ("), "file", F.lit(")\n"), F.col("line").cast("string"))
    return symbols(spark, d, "qname", "file", "line").select("id", F.md5(doc).alias("doc_key"), F.substring(F.md5("file"), 1, 16).alias("repo_key"))


@query(f"WITH {UNIT} SELECT id, round(list_sum(v), 9) AS s, round(v[1], 9) AS v1, round(list_sum(list_transform(v, lambda x: abs(x))), 9) AS l1 FROM vec")
def l2_normalized(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("id"), l2_normalize(F.col("embedding")).alias("v"))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return v.select("id", F.round(add("v"), 9).alias("s"), F.round(F.col("v")[0], 9).alias("v1"), F.round(add(F.transform("v", F.abs)), 9).alias("l1"))


@query("""
SELECT vec_id, CAST(len(v) AS INT) AS width, round(sqrt(list_sum(list_transform(v, lambda x: CAST(x AS DOUBLE) * x))), 6) AS norm FROM (SELECT DISTINCT vec_id, v FROM emb_cache WHERE v IS NOT NULL)
WHERE len(list_filter(v, lambda x: isnan(x))) = 0
""")
def cached_norms(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "emb_cache", "vec_id", "v").where(F.col("v").isNotNull() & ~F.exists("v", F.isnan)).dropDuplicates(["vec_id"])
    return v.select("vec_id", F.size("v").alias("width"), F.round(norm(F.col("v")), 6).alias("norm"))


@query("""
SELECT id, file, top, bad FROM (VALUES (1, 'a b/c', '3', 'x'), (2, 'é.py', NULL, '%zz%4'), (3, '', '', '100%')) v(id, file, top, bad)
""")
def url_escapes(spark: SparkSession, d: str) -> DataFrame:
    """Parameters with blanks, escapes of several bytes, empty values, missing names and bad escapes, which stay as they are."""
    q = spark.createDataFrame([(1, "file=a+b%2Fc&top=3&bad=x&file=second"), (2, "x=1&file=%C3%A9.py&bad=%zz%4"), (3, "file=&top=&bad=100%")], "id int, q string")
    return q.select("id", *(text.query_param(F.col("q"), c).alias(c) for c in ("file", "top", "bad")))


@query("SELECT doc_id, source, CAST(row_number() OVER (ORDER BY source NULLS FIRST, doc_id) - 1 AS BIGINT) AS number, length(text) AS chars FROM documents")
def document_numbers(spark: SparkSession, d: str) -> DataFrame:
    """All documents with their texts, numbered by source and id without gaps."""
    numbered = dense_ids(documents(spark, d, "source", "text"), "source", "doc_id", name="number")
    return numbered.select("doc_id", "source", "number", F.length("text").cast("bigint").alias("chars"))


@query("SELECT doc_id, CASE WHEN path IS NOT NULL THEN path END AS file, CAST(n_chars AS VARCHAR) AS top FROM documents WHERE path IS NOT NULL")
def url_params(spark: SparkSession, d: str) -> DataFrame:
    """Parameters written into a query string and read back."""
    q = documents(spark, d, "path", "n_chars").where("path IS NOT NULL").select("doc_id", F.concat(F.lit("x=1&file="), F.url_encode("path"), F.when(F.col("n_chars").isNotNull(), F.concat(F.lit("&top="), F.col("n_chars").cast("string"))).otherwise(F.lit("")), F.lit("&file=second")).alias("q"))
    return q.select("doc_id", text.query_param(F.col("q"), "file").alias("file"), text.query_param(F.col("q"), "top").alias("top"))


@query(rf"""
WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g'), '^ | $', '', 'g') AS t FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, t, list_distinct(list_filter(regexp_extract_all(t, '[A-Za-z_][A-Za-z0-9_]+'), lambda x: x NOT IN ({_list(STOPLIST_IDENTS)}))) AS d FROM c)
SELECT doc_id, CAST(length(t) AS INT) AS n_chars, CAST(len(d) AS INT) AS distinctive FROM u
""")
def ws_collapse(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of texts with white space collapsed, and how many distinct identifiers outside the stop list they hold."""
    c = documents(spark, d, "text").where("text IS NOT NULL").select("doc_id", text.collapse_ws(F.col("text")).alias("t"))
    idents = F.filter(F.regexp_extract_all("t", F.lit("([A-Za-z_][A-Za-z0-9_]+)"), 1), lambda x: ~x.isin(STOPLIST_IDENTS))
    return c.select("doc_id", F.length("t").alias("n_chars"), F.size(F.array_distinct(idents)).alias("distinctive"))


@query(f"""
WITH {SYM}, r AS (SELECT id, sqrt(node_count) AS s FROM sym), m AS (SELECT min(s) AS lo, max(s) AS hi FROM r)
SELECT id, round(CASE WHEN hi > lo THEN (2 + 5 * (s - lo) / (hi - lo)) / 832 ELSE 3.5 / 832 END, 9) AS r FROM r, m
""")
def radius_map(spark: SparkSession, d: str) -> DataFrame:
    s = symbols(spark, d, "node_count").select("id", F.sqrt("node_count").alias("s"))
    lo, hi = s.agg(F.min("s"), F.max("s")).first()
    r = (2 + 5 * (F.col("s") - lo) / (hi - lo)) / 832 if lo is not None and hi > lo else F.lit(3.5 / 832)
    return s.select("id", F.round(r, 9).alias("r"))


@query(f"WITH {TFIDF} SELECT id, round(sum(w), 9) AS mass, count(*) AS terms FROM w GROUP BY id")
def weight_mass(spark: SparkSession, d: str) -> DataFrame:
    return symbol_weights(spark, d).groupBy("id").agg(F.round(F.sum("w"), 9).alias("mass"), F.count("*").alias("terms"))


@query(f"WITH {SYM}, c AS (SELECT DISTINCT unnest(calls) AS c FROM sym) SELECT DISTINCT c.base AS base, c.base IN ({_list(AMBIENT_NAMES)}) AS ambient FROM c WHERE c.base IS NOT NULL")
def ambient_names(spark: SparkSession, d: str) -> DataFrame:
    return symbols(spark, d, "calls").select(F.explode("calls").alias("c")).where("c.base IS NOT NULL").select("c.base").distinct().withColumn("ambient", F.col("base").isin(AMBIENT_NAMES))


@query(r"""
WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, s AS seed, ('0x' || substring(md5(s || '|' || x), 1, 15))::BIGINT AS h FROM (SELECT doc_id, unnest(t) AS x FROM t), range(64) r(s))
SELECT doc_id AS id, CAST(seed AS INT) AS seed, min(h) AS h FROM h GROUP BY doc_id, seed
""")
def minhash_signature(spark: SparkSession, d: str) -> DataFrame:
    words = documents(spark, d, "text").where("text IS NOT NULL").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), 1).alias("t"))
    return minhash(words, "doc_id", "t", MINHASH_FUNCTIONS)


@query("SELECT kind, count(*) AS n, count(*) FILTER (WHERE n_chars >= 300) AS kept, count(*) FILTER (WHERE n_chars < 300 OR n_chars IS NULL) AS skipped_small FROM documents GROUP BY kind")
def min_size_filter(spark: SparkSession, d: str) -> DataFrame:
    big = F.col("n_chars") >= 300
    return documents(spark, d, "kind", "n_chars").groupBy("kind").agg(F.count("*").alias("n"), F.count_if(big).alias("kept"), F.count_if(~F.coalesce(big, F.lit(False))).alias("skipped_small"))


@query("SELECT doc_id, path FROM documents WHERE path = 'core' OR starts_with(path, 'core/')")
def prefix_scope(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d, "path").where(paths.under(F.col("path"), "core"))
