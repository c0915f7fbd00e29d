"""Queries over the seller files: sheet structure, labels, periods, numbers, evidence, reviews, names, resent files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..dims import BALANCE_SHEET_ALIASES, FIELD_SCHEMA, TYPE_KEYWORDS, aliases_table, schema_table
from ..functions.numeric import confidence_label, half_up, relative_difference, to_number, to_percent
from ..functions.periods import describe_period, parse_period, year_in
from ..functions.text import LABEL_EXPANSIONS, LEGAL_FORMS, NOISE_PHRASES, NOISE_WORDS, entity_key, humanize, keyword_signal, normalize_label, slug, strip_noise, word_overlap
from ..operators import sheets
from ..operators.entities import greedy_clusters, similar_pairs
from ..operators.matching import ambiguous_labels, coverage, match_labels
from ..operators.relational import best_by, greatest_mode, latest_state, pairs_within, top_k, upsert
from ..session import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _replaced(expr: str, steps: list[tuple[str, str]]) -> str:
    for pattern, text in steps:
        expr = f"regexp_replace({expr}, {_q(pattern)}, {_q(text)}, 'g')"
    return expr


def norm_sql(c: str) -> str:
    return f"trim({_replaced(f'lower(coalesce({c}, {_q('')}))', LABEL_EXPANSIONS)})"


def core_sql(c: str) -> str:
    spaces = r"\s+"
    return f"trim(regexp_replace({_replaced(c, [(p, ' ') for p in NOISE_PHRASES])}, {_q(spaces)}, ' ', 'g'))"


_NOISE = "[" + ", ".join(map(_q, NOISE_WORDS)) + "]"
LABELS_SQL = f"""
WITH raw AS (SELECT DISTINCT c0 AS label FROM (SELECT c0 FROM balance_sheet UNION ALL SELECT c0 FROM ugly_balance_sheet) WHERE c0 IS NOT NULL),
n AS (SELECT label, {norm_sql("label")} AS norm FROM raw), c AS (SELECT label, norm, {core_sql("norm")} AS core FROM n),
labels AS (SELECT *, list_filter(string_split(CASE WHEN core <> '' THEN core ELSE norm END, ' '), lambda w: len(w) > 1 AND NOT list_contains({_NOISE}, w)) AS words FROM c)
"""
_ALIAS_ROWS = ", ".join(f"({_q(f)}, {_q(a)}, {i + 1})" for i, (f, a) in enumerate((f, a) for f, names in BALANCE_SHEET_ALIASES.items() for a in names))
MATCH_SQL = (
    LABELS_SQL
    + f""", ar AS (SELECT * FROM (VALUES {_ALIAS_ROWS}) t(field_name, alias, ordinal)), an AS (SELECT field_name, ordinal, {norm_sql("alias")} AS a_norm FROM ar),
ac AS (SELECT *, {core_sql("a_norm")} AS a_core FROM an),
aw AS (SELECT *, list_filter(string_split(CASE WHEN a_core <> '' THEN a_core ELSE a_norm END, ' '), lambda w: len(w) > 1 AND NOT list_contains({_NOISE}, w)) AS a_words FROM ac),
met AS (SELECT label, norm, core, words, field_name, ordinal, a_norm, a_core, a_words, len(a_words) AS n, len(list_filter(a_words, lambda w: list_contains(words, w))) AS shared FROM labels, aw WHERE norm <> ''),
lsc AS (SELECT *, CASE WHEN a_norm IN (norm, core) OR (a_core <> '' AND a_core IN (norm, core)) THEN 1.0 WHEN n = 0 THEN NULL
    WHEN contains(' ' || norm || ' ', ' ' || a_norm || ' ') OR contains(' ' || core || ' ', ' ' || a_norm || ' ')
      OR (a_core <> '' AND (contains(' ' || norm || ' ', ' ' || a_core || ' ') OR contains(' ' || core || ' ', ' ' || a_core || ' '))) THEN 0.9
    WHEN n > 1 AND shared >= 2 AND CAST(shared AS DOUBLE) / n >= 0.67 THEN floor(greatest(0.55, least((CASE WHEN shared = n THEN CAST(0.82 AS DOUBLE) ELSE 0.68 + (CAST(shared AS DOUBLE) / n - 0.67) * 0.35 END)
      - least(greatest(len(words) - n, 0) * CAST(0.03 AS DOUBLE), CAST(0.12 AS DOUBLE)), CAST(0.89 AS DOUBLE))) * 100 + 0.5) / 100 END AS score FROM met),
bf AS (SELECT label, field_name, arg_max(a_norm, (score, -ordinal)) AS alias, max(CAST(score AS DOUBLE)) AS score, arg_max(ordinal, (score, -ordinal)) AS ordinal FROM lsc WHERE score IS NOT NULL GROUP BY 1, 2),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY score DESC, len(alias) DESC, ordinal) AS INTEGER) AS match_rank FROM bf)
"""
)


def labels(spark: SparkSession, d: str) -> DataFrame:
    """Distinct labels of both balance sheet tables."""
    both = table(spark, d, "balance_sheet").select("c0").unionByName(table(spark, d, "ugly_balance_sheet").select("c0"))
    return both.filter("c0 is not null").select(F.lit("balance_sheet").alias("doc_type"), F.col("c0").alias("label")).distinct()


@query(LABELS_SQL + "SELECT label, norm, core FROM labels")
def label_normalize(spark, d):
    """Labels normalised, and without noise."""
    return labels(spark, d).select("label", normalize_label(F.col("label")).alias("norm")).withColumn("core", strip_noise(F.col("norm")))


@query(MATCH_SQL + "SELECT label, field_name, alias, score, match_rank FROM ranked WHERE match_rank <= 3")
def label_candidates(spark, d):
    """The three best fields of each label."""
    return match_labels(labels(spark, d), aliases_table(spark)).filter("match_rank <= 3").drop("doc_type")


@query(MATCH_SQL + """
, t AS (SELECT *, max(score) OVER (PARTITION BY label) AS top FROM ranked)
SELECT label, count(*) AS n_close, list_aggregate(list_slice(list(field_name ORDER BY match_rank), 1, 4), 'string_agg', ',') AS fields FROM t WHERE score >= top - 0.08 - 1e-9 GROUP BY label HAVING count(*) >= 2""")
def label_ambiguous(spark, d):
    """Labels that could mean several fields."""
    return ambiguous_labels(match_labels(labels(spark, d), aliases_table(spark))).drop("doc_type")


_SCHEMA_ROWS = ", ".join(f"({_q(t)}, {_q(f)}, {r}, {i + 1})" for t, fields in FIELD_SCHEMA.items() for i, (f, r) in enumerate(fields))


@query(MATCH_SQL + f"""
, fs AS (SELECT * FROM (VALUES {_SCHEMA_ROWS}) t(doc_type, field_name, required, ordinal) WHERE doc_type = 'balance_sheet'),
f AS (SELECT DISTINCT file_id, field_name FROM balance_sheet JOIN ranked ON label = c0 AND match_rank = 1 AND score >= 0.6), docs AS (SELECT DISTINCT file_id FROM f)
SELECT file_id, 'balance_sheet' AS doc_type, count(*) AS n_fields, count(f.field_name) AS n_found, count(*) FILTER (WHERE required) AS n_required, count(*) FILTER (WHERE required AND f.field_name IS NOT NULL) AS n_required_found,
       coalesce(string_agg(fs.field_name, ',' ORDER BY fs.ordinal) FILTER (WHERE required AND f.field_name IS NULL), '') AS missing, floor(CAST(count(f.field_name) AS DOUBLE) / count(*) * 100 + 0.5) / 100 AS pct
FROM docs CROSS JOIN fs LEFT JOIN f USING (file_id, field_name) GROUP BY file_id""")
def coverage_by_file(spark, d):
    """How much of the schema each balance sheet file covers."""
    best = match_labels(labels(spark, d), aliases_table(spark)).filter("match_rank = 1 and score >= 0.6")
    found = table(spark, d, "balance_sheet").select("file_id", F.col("c0").alias("label")).join(best, "label").select("file_id", "doc_type", "field_name")
    return coverage(schema_table(spark), found, keys=["file_id"])


_PERIOD_LABELS = """
WITH raw AS (SELECT DISTINCT label FROM (SELECT period_key AS label FROM evidence_resolver UNION ALL SELECT sheet_title FROM revenue_breakdown UNION ALL SELECT sheet_title FROM debt_schedule UNION ALL SELECT c1 FROM ugly_balance_sheet WHERE c0 = 'Caption') WHERE label IS NOT NULL),
s AS (SELECT label, trim(regexp_replace(lower(label), '\\s+', ' ', 'g')) AS s FROM raw),
x AS (SELECT *, regexp_extract(s, '^(?:fy ?)?((?:19|20)\\d{2})e?$', 1) AS y, regexp_extract(s, '(?:^|[^a-z0-9])(?:fy ?)?((?:19|20)\\d{2})e?(?:[^a-z0-9]|$)', 1) AS yw,
    regexp_extract(s, '^q([1-4])[ /-]*((?:19|20)?\\d{2})$', 1) || regexp_extract(s, '^((?:19|20)?\\d{2})[ /-]*q([1-4])$', 2) AS q,
    regexp_extract(s, '^q([1-4])[ /-]*((?:19|20)?\\d{2})$', 2) || regexp_extract(s, '^((?:19|20)?\\d{2})[ /-]*q([1-4])$', 1) AS qy,
    regexp_extract(s, '^((?:19|20)\\d{2})[/-](0?[1-9]|1[0-2])$', 1) AS my, regexp_extract(s, '^((?:19|20)\\d{2})[/-](0?[1-9]|1[0-2])$', 2) AS mm,
    regexp_extract(s, '^(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)[ /,-]+((?:19|20)\\d{2}|\\d{2})$', 1) AS nm,
    regexp_extract(s, '^(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)[ /,-]+((?:19|20)\\d{2}|\\d{2})$', 2) AS ny FROM s),
z AS (SELECT *, CASE WHEN len(qy) = 2 THEN '20' || qy ELSE qy END AS qyy, CASE WHEN mm <> '' THEN lpad(mm, 2, '0') WHEN nm <> '' THEN lpad(CAST(list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], nm[1:3]) AS VARCHAR), 2, '0') END AS mo,
    CASE WHEN mm <> '' THEN my WHEN len(ny) = 2 THEN '20' || ny ELSE ny END AS moy FROM x)
SELECT label, CASE WHEN s IN ('ltm', 'ttm') THEN 'LTM' WHEN y <> '' THEN y WHEN q <> '' THEN qyy || '-Q' || q WHEN mo IS NOT NULL THEN moy || '-' || mo WHEN yw <> '' THEN yw END AS period_key,
    CASE WHEN s IN ('ltm', 'ttm') THEN 'ltm' WHEN y <> '' THEN 'year' WHEN q <> '' THEN 'quarter' WHEN mo IS NOT NULL THEN 'month' WHEN yw <> '' THEN 'year' END AS granularity,
    CAST(coalesce(CASE WHEN s IN ('ltm', 'ttm') THEN 999999 WHEN y <> '' THEN CAST(y AS INT) * 100 WHEN q <> '' THEN CAST(qyy AS INT) * 100 + CAST(q AS INT) WHEN mo IS NOT NULL THEN CAST(moy AS INT) * 100 + CAST(mo AS INT) WHEN yw <> '' THEN CAST(yw AS INT) * 100 END, -1) AS BIGINT) AS sort_value
FROM z"""


@query(_PERIOD_LABELS)
def period_parse(spark, d):
    """Period labels of evidence, titles and headers."""
    one = lambda t, c: table(spark, d, t).select(F.col(c).alias("label"))
    heads = table(spark, d, "ugly_balance_sheet").filter("c0 = 'Caption'").select(F.col("c1").alias("label"))
    raw = one("evidence_resolver", "period_key").unionByName(one("revenue_breakdown", "sheet_title")).unionByName(one("debt_schedule", "sheet_title")).unionByName(heads)
    return raw.filter("label is not null").distinct().select("label", parse_period(F.col("label")).alias("p")).select("label", "p.period_key", "p.granularity", F.coalesce("p.sort_value", F.lit(-1)).alias("sort_value"))


@query("""
SELECT deal_id, count(DISTINCT g) AS n_granularities, bool_or(g = 'quarter') AS has_quarters, count(*) FILTER (WHERE g = 'point_in_time') AS n_points FROM (
    SELECT deal_id, CASE WHEN period_key = '_single' THEN 'point_in_time' WHEN upper(period_key) IN ('LTM', 'TTM') THEN 'ltm' WHEN regexp_matches(period_key, '^\\d{4}-Q[1-4]$') THEN 'quarter' WHEN regexp_matches(period_key, '^\\d{4}$') THEN 'year' ELSE 'other' END AS g FROM evidence_resolver)
GROUP BY deal_id""")
def granularity_mix(spark, d):
    """Deals whose evidence mixes granularities of time."""
    g = describe_period(F.col("period_key"))["granularity"]
    e = table(spark, d, "evidence_resolver").select("deal_id", F.when(g.isin("point_in_time", "ltm", "quarter", "year"), g).otherwise("other").alias("g"))
    return e.groupBy("deal_id").agg(F.count_distinct("g").alias("n_granularities"), F.bool_or(F.col("g") == "quarter").alias("has_quarters"), F.count_if(F.col("g") == "point_in_time").alias("n_points"))


@query("""
WITH raw AS (SELECT DISTINCT v AS raw FROM (SELECT c1 AS v FROM balance_sheet UNION ALL SELECT pct_of_revenue FROM revenue_breakdown UNION ALL SELECT value FROM ar_aging UNION ALL SELECT interest_rate FROM debt_schedule) WHERE v IS NOT NULL),
c AS (SELECT raw, trim(raw) AS t, trim(regexp_replace(trim(raw), '[,$%()]', '', 'g')) AS k FROM raw),
n AS (SELECT raw, CASE WHEN regexp_matches(t, '^\\(.*\\)$') THEN -1 ELSE 1 END * TRY_CAST(CASE WHEN regexp_matches(k, '^[+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?$') THEN k END AS DOUBLE) AS num, TRY_CAST(nullif(regexp_extract(raw, '(-?\\d+(?:\\.\\d+)?)\\s*%', 1), '') AS DOUBLE) AS pc FROM c)
SELECT raw, num AS number, CASE WHEN num IS NULL THEN floor(pc * 100 + 0.5) / 100 WHEN abs(num) <= 1 THEN floor(num * 100 * 100 + 0.5) / 100 ELSE floor(num * 100 + 0.5) / 100 END AS percent FROM n""")
def number_parse(spark, d):
    """Numbers and percentages of typed cells."""
    one = lambda t, c: table(spark, d, t).select(F.col(c).alias("raw"))
    raw = one("balance_sheet", "c1").unionByName(one("revenue_breakdown", "pct_of_revenue")).unionByName(one("ar_aging", "value")).unionByName(one("debt_schedule", "interest_rate"))
    return raw.filter("raw is not null").distinct().select("raw", to_number(F.col("raw")).alias("number"), to_percent(F.col("raw")).alias("percent"))


def _balance_rows(spark: SparkSession, d: str) -> DataFrame:
    return sheets.sheet_rows(table(spark, d, "balance_sheet"), sheet="file_id", place="row_idx", order="row_id", cells=["c0", "c1", "c2", "c3"])


_ROWS_SQL = """
WITH one AS (SELECT file_id AS sheet, row_idx AS place, arg_min([nullif(trim(c0), ''), nullif(trim(c1), ''), nullif(trim(c2), ''), nullif(trim(c3), '')], row_id) AS cells FROM balance_sheet GROUP BY 1, 2),
r AS (SELECT sheet, CAST(row_number() OVER (PARTITION BY sheet ORDER BY place) - 1 AS INTEGER) AS row_no, cells FROM one WHERE len(list_filter(cells, lambda x: x IS NOT NULL)) > 0),
b AS (SELECT *, list(cells) OVER (PARTITION BY sheet ORDER BY row_no ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS below, list_filter(cells, lambda x: x IS NOT NULL) AS filled FROM r),
f AS (SELECT *, len(filled) AS n, len(list_filter(filled, lambda x: regexp_matches(x, '(?i)\\b(?:19|20)\\d{2}\\b|ltm|ttm|fy\\d{2,4}|\\bq[1-4]\\b'))) AS periods,
    len(list_filter(filled, lambda x: regexp_matches(regexp_replace(x, '[,$()%]', '', 'g'), '^\\s*[+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?\\s*$'))) AS numbers,
    len(list_filter([1, 2, 3, 4], lambda i: cells[i] IS NOT NULL AND len(list_filter(below, lambda q: q[i] IS NOT NULL)) > 0)) AS supported,
    len(list_filter([1, 2, 3, 4], lambda i: len(list_filter(below, lambda q: coalesce(regexp_matches(regexp_replace(q[i], '[,$()%]', '', 'g'), '^\\s*[+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?\\s*$'), false))) > 0)) AS numeric_support
    FROM b WHERE row_no < 8),
sc AS (SELECT sheet, row_no, cells, round(CAST(CASE WHEN n >= 2 THEN 1.5 ELSE -2.0 END + least(n * 0.55, 2.2) + least(periods * 0.75, 2.25) - least(numbers * 0.35, 1.4) + CASE WHEN cells[1] IS NOT NULL THEN 0.75 ELSE 0 END
    + least(supported * 0.35, 1.75) + least(numeric_support * 0.18, 0.9) - CASE WHEN n <= 1 OR (n = 2 AND periods = 0) THEN 1.75 ELSE 0 END AS DOUBLE), 6) AS score FROM f),
h AS (SELECT sheet, arg_max(row_no, (score, -row_no)) AS header_row, arg_max(cells, (score, -row_no)) AS header, max(score) AS score FROM sc GROUP BY sheet)
"""


@query(_ROWS_SQL + "SELECT sheet, header_row, score FROM h")
def sheet_headers(spark, d):
    """The header row of each balance sheet file, with its score."""
    return sheets.header_rows(_balance_rows(spark, d)).select("sheet", "header_row", "score")


@query(_ROWS_SQL + """
, up AS (SELECT r.sheet, min(CASE WHEN len(list_filter(cells, lambda x: x IS NOT NULL)) = 1 AND NOT regexp_matches(list_filter(cells, lambda x: x IS NOT NULL)[1], '(?i)\\b(?:19|20)\\d{2}\\b|ltm|ttm|fy\\d{2,4}|\\bq[1-4]\\b') THEN {'r': row_no, 't': list_filter(cells, lambda x: x IS NOT NULL)[1]} END) AS f,
    first(list_filter(header, lambda x: x IS NOT NULL)[1]) AS fb FROM r JOIN h USING (sheet) WHERE row_no <= header_row GROUP BY r.sheet)
SELECT sheet, coalesce(f.t, fb) AS title FROM up""")
def sheet_titles(spark, d):
    """The title of each balance sheet file."""
    rows = _balance_rows(spark, d)
    return sheets.sheet_titles(rows, sheets.header_rows(rows))


@query(_ROWS_SQL + """
, cols AS (SELECT sheet, header_row, unnest([2, 3, 4]) AS i, header FROM h), p AS (SELECT sheet, header_row, i, regexp_extract(trim(lower(header[i])), '^(?:fy ?)?((?:19|20)\\d{2})e?$', 1) AS y FROM cols)
SELECT r.sheet, row_no, cells[1] AS label, CAST(i - 1 AS INTEGER) AS col_no, y AS period_key, 'year' AS granularity, cells[i] AS raw FROM r JOIN p ON p.sheet = r.sheet AND row_no > header_row WHERE y <> '' AND cells[i] IS NOT NULL""")
def unpivot_periods(spark, d):
    """Balance sheet cells as one row per label and period."""
    rows = _balance_rows(spark, d)
    return sheets.unpivot_periods(rows, sheets.header_rows(rows))


@query("""
WITH one AS (SELECT file_id AS sheet, row_idx AS place, arg_min([nullif(trim(c0), ''), nullif(trim(c1), '')], row_id) AS cells FROM ugly_balance_sheet GROUP BY 1, 2),
r AS (SELECT sheet, row_number() OVER (PARTITION BY sheet ORDER BY place) - 1 AS row_no, cells FROM one WHERE len(list_filter(cells, lambda x: x IS NOT NULL)) > 0),
t AS (SELECT sheet, lower(sheet || ' ' || string_agg(array_to_string(list_filter(cells, lambda x: x IS NOT NULL), ' '), ' ' ORDER BY row_no)) AS t FROM r WHERE row_no < 3 GROUP BY sheet)
SELECT sheet, CAST(CASE WHEN regexp_matches(t, '\\(\\$?\\s*000s?\\)|\\$000s?\\b|\\bin thousands?\\b|\\b000s\\b') THEN 1000 WHEN regexp_matches(t, '\\(\\$?\\s*mm\\)|\\(\\$?\\s*millions?\\)|\\bin millions?\\b|\\bmm\\b') THEN 1000000 ELSE 1 END AS BIGINT) AS value_scale FROM t""")
def sheet_scales(spark, d):
    """The value scale that each rough balance sheet file states in its first rows."""
    rows = sheets.sheet_rows(table(spark, d, "ugly_balance_sheet"), sheet="file_id", place="row_idx", order="row_id", cells=["c0", "c1"])
    return sheets.value_scales(rows)


@query()
def sheet_sections(spark, d):
    """Sections of each balance sheet file; the split depends on the section before, so it has no SQL."""
    rows = _balance_rows(spark, d)
    return sheets.sections(rows, sheets.header_rows(rows))


@query(_ROWS_SQL + """
, x AS (SELECT r.sheet, row_no, cells, header FROM r JOIN h USING (sheet) WHERE row_no > header_row), y AS (SELECT sheet, row_no, unnest([1, 2, 3, 4]) AS i, cells, header FROM x),
z AS (SELECT sheet, row_no, coalesce(header[i], 'column_' || CAST(i AS VARCHAR)) AS key, arg_max(coalesce(cells[i], ''), i) AS v FROM y GROUP BY 1, 2, 3)
SELECT sheet, row_no, count(*) AS n_keys, string_agg(key || '=' || v, ';' ORDER BY key) AS record FROM z GROUP BY 1, 2""")
def sheet_records(spark, d):
    """Rows below the header as records; of columns with one name the last counts."""
    rows = _balance_rows(spark, d)
    r = sheets.records(rows, sheets.header_rows(rows))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("record")), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), ";")
    return r.select("sheet", "row_no", F.size("record").cast("bigint").alias("n_keys"), text.alias("record"))


_KEYWORD_ROWS = ", ".join(f"({_q(t)}, [{', '.join(map(_q, ks))}])" for t, ks in TYPE_KEYWORDS.items())


CLASSIFY_SQL = f"""
WITH t AS (SELECT DISTINCT sheet_title AS title FROM (SELECT sheet_title FROM revenue_breakdown UNION ALL SELECT sheet_title FROM debt_schedule) WHERE sheet_title IS NOT NULL), k AS (SELECT * FROM (VALUES {_KEYWORD_ROWS}) v(doc_type, keywords)),
s AS (SELECT title, doc_type, len(list_filter(keywords, lambda w: contains(lower(title), w))) AS hits FROM t, k), sc AS (SELECT title, doc_type, CASE WHEN hits > 0 THEN least(CAST(0.8 AS DOUBLE) + (hits - 1) * CAST(0.08 AS DOUBLE), 1.0) ELSE CAST(0.0 AS DOUBLE) END AS score FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY score DESC, doc_type) AS n, score - lead(score, 1, 0.0) OVER (PARTITION BY title ORDER BY score DESC, doc_type) AS gap FROM sc)"""


@query(CLASSIFY_SQL + """
SELECT title, CASE WHEN score < 0.3 THEN 'unknown' ELSE doc_type END AS doc_type, score, score >= 0.3 AND gap < 0.12 AS ambiguous FROM r WHERE n = 1""")
def classify_titles(spark, d):
    """Document types of sheet titles by keywords, with doubt where the second type is close."""
    t = table(spark, d, "revenue_breakdown").select("sheet_title").unionByName(table(spark, d, "debt_schedule").select("sheet_title")).filter("sheet_title is not null").distinct().withColumnRenamed("sheet_title", "title")
    types = F.explode(F.array(*(F.struct(F.lit(n).alias("doc_type"), F.array(*map(F.lit, words)).alias("keywords")) for n, words in TYPE_KEYWORDS.items())))
    sc = t.select("title", types.alias("k")).select("title", "k.doc_type", keyword_signal(F.lower("title"), F.col("k.keywords"), 0.8, 0.08).alias("score"))
    w = Window.partitionBy("title").orderBy(F.desc("score"), "doc_type")
    r = sc.withColumn("n", F.row_number().over(w)).withColumn("gap", F.col("score") - F.lead("score", 1, 0.0).over(w)).filter("n = 1")
    return r.select("title", F.when(F.col("score") < 0.3, "unknown").otherwise(F.col("doc_type")).alias("doc_type"), "score", ((F.col("score") >= 0.3) & (F.col("gap") < 0.12)).alias("ambiguous"))


_EVIDENCE_SQL = """
WITH e AS (SELECT deal_id, concept_key, evidence_id, period_key, value, CASE WHEN isnan(confidence) OR confidence IS NULL THEN CAST(0 AS DOUBLE) ELSE confidence END AS conf, CAST(coalesce(reviewed, false) AS INTEGER) AS reviewed_n, extracted_at AS seen
    FROM evidence_resolver WHERE value IS NOT NULL AND NOT isnan(value)),
r AS (SELECT *, row_number() OVER (PARTITION BY deal_id, concept_key ORDER BY reviewed_n DESC, conf DESC, seen DESC NULLS LAST, evidence_id) AS n FROM e)
"""


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "evidence_resolver").filter("value is not null and not isnan(value)")
    conf = F.when(F.col("confidence").isNull() | F.isnan("confidence"), 0.0).otherwise(F.col("confidence"))
    return e.select("deal_id", "concept_key", "evidence_id", "period_key", "value", conf.alias("conf"), F.coalesce("reviewed", F.lit(False)).cast("int").alias("reviewed_n"), F.col("extracted_at").alias("seen"))


def _best_first() -> list:
    return [F.desc("reviewed_n"), F.desc("conf"), F.desc_nulls_last("seen"), F.asc("evidence_id")]


@query(_EVIDENCE_SQL + "SELECT deal_id, concept_key, evidence_id, value, CASE WHEN conf >= 0.8 THEN 'high' WHEN conf >= 0.55 THEN 'medium' WHEN conf > 0 THEN 'low' ELSE 'none' END AS trust FROM r WHERE n = 1")
def evidence_selected(spark, d):
    """The leading record of each concept of a deal."""
    s = top_k(_evidence(spark, d), ["deal_id", "concept_key"], _best_first(), 1)
    return s.select("deal_id", "concept_key", "evidence_id", "value", confidence_label(F.col("conf")).alias("trust"))


@query(_EVIDENCE_SQL + """
, s AS (SELECT deal_id, concept_key, value AS v0, period_key AS p0, conf AS c0 FROM r WHERE n = 1),
c AS (SELECT r.deal_id, r.concept_key, evidence_id, abs(value - v0) / greatest(abs(value), abs(v0), 1.0) AS variance, period_key <> p0 AS other_period, abs(conf - c0) AS gap FROM r JOIN s USING (deal_id, concept_key) WHERE n >= 2)
SELECT deal_id, concept_key, evidence_id, floor(variance * 10000 + 0.5) / 10000 AS variance, CASE WHEN variance > 0.09 THEN 'high' WHEN variance > 0.05 OR other_period THEN 'medium' ELSE 'low' END AS severity FROM c WHERE variance > 0.05 OR gap < 0.08 OR other_period""")
def evidence_conflicts(spark, d):
    """Every other record of each concept that disagrees with the leading one in value or period."""
    e = _evidence(spark, d)
    first = best_by(e, ["deal_id", "concept_key"], [F.col("reviewed_n"), F.col("conf"), F.col("seen"), -F.col("evidence_id")])
    s = first.select("deal_id", "concept_key", F.col("evidence_id").alias("e0"), F.col("value").alias("v0"), F.col("period_key").alias("p0"), F.col("conf").alias("c0"))
    c = e.join(s, ["deal_id", "concept_key"]).filter("evidence_id != e0").withColumn("variance", relative_difference(F.col("value"), F.col("v0"))).withColumn("other_period", F.col("period_key") != F.col("p0"))
    c = c.filter((F.col("variance") > 0.05) | (F.abs(F.col("conf") - F.col("c0")) < 0.08) | F.col("other_period"))
    return c.select("deal_id", "concept_key", "evidence_id", half_up(F.col("variance"), 4).alias("variance"), F.when(F.col("variance") > 0.09, "high").when((F.col("variance") > 0.05) | F.col("other_period"), "medium").otherwise("low").alias("severity"))


@query("""
WITH y AS (SELECT deal_id, CAST(nullif(regexp_extract(period_key, '\\b((?:19|20)\\d{2})\\b', 1), '') AS INTEGER) AS y FROM evidence_resolver), c AS (SELECT deal_id, y, count(*) AS n FROM y WHERE y IS NOT NULL GROUP BY 1, 2)
SELECT deal_id, arg_max(y, (n, y)) AS mode, max(n) AS mode_count FROM c GROUP BY 1""")
def reference_years(spark, d):
    """The year that most evidence of a deal is about, the later one on a tie."""
    return greatest_mode(table(spark, d, "evidence_resolver").select("deal_id", year_in(F.col("period_key")).alias("y")), ["deal_id"], "y")


@query("""
WITH f AS (SELECT deal_id, file_id, CAST(row_number() OVER (PARTITION BY deal_id ORDER BY t, file_id) AS BIGINT) AS ord, t FROM (SELECT deal_id, file_id, min(loaded_at) AS t FROM balance_sheet GROUP BY 1, 2))
SELECT a.deal_id, a.file_id AS file_id_a, b.file_id AS file_id_b FROM f a JOIN f b ON a.deal_id = b.deal_id AND a.ord < b.ord AND b.ord - a.ord <= 3""")
def file_neighbours(spark, d):
    """Pairs of a deal's balance sheet files at most three loads apart: a bounded triangular join."""
    f = table(spark, d, "balance_sheet").groupBy("deal_id", "file_id").agg(F.min("loaded_at").alias("t"))
    f = f.withColumn("ord", F.row_number().over(Window.partitionBy("deal_id").orderBy("t", "file_id")).cast("bigint"))
    return pairs_within(f, ["deal_id"], "ord", ["file_id"], 3)


@query("""
SELECT CASE WHEN n = 1 THEN 'once' ELSE 'again' END AS sent, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines FROM (
    SELECT file_id, lines, sig, row_number() OVER (PARTITION BY sig ORDER BY file_id) AS n FROM (
        SELECT file_id, count(*) AS lines, md5(string_agg(CAST(line_no AS VARCHAR) || ':' || coalesce(c0, ''), '|' ORDER BY line_no, c0)) AS sig FROM (SELECT DISTINCT file_id, line_no, c0 FROM ugly_debt_schedule) GROUP BY file_id))
GROUP BY 1""")
def files_resent(spark, d):
    """Files whose whole content was already sent under another id, told by a digest of their lines."""
    lines = table(spark, d, "ugly_debt_schedule").select("file_id", "line_no", "c0").distinct()
    # sums of hashes of the lines with their places: combined before the shuffle, so no file is gathered
    part = lambda salt: F.sum(F.xxhash64(F.lit(salt), "line_no", F.coalesce("c0", F.lit(""))).cast("decimal(38,0)"))
    sig = lines.groupBy("file_id").agg(F.count("*").alias("lines"), part(1).alias("h1"), part(2).alias("h2")).withColumn("sig", F.struct("lines", "h1", "h2"))
    n = F.row_number().over(Window.partitionBy("sig").orderBy("file_id"))
    return sig.withColumn("sent", F.when(n == 1, "once").otherwise("again")).groupBy("sent").agg(F.count("*").alias("files"), F.sum("lines").alias("lines"))


_REVIEW_SQL = "WITH e AS (SELECT event_id, ts, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN event_type IN ('click', 'purchase') THEN 'map' WHEN event_type = 'error' THEN 'ignore' WHEN event_type = 'signup' THEN 'delete' ELSE 'view' END AS action FROM events)"


def decisions(spark: SparkSession, d: str) -> DataFrame:
    """Events read as reviewer decisions about keys."""
    action = F.when(F.col("event_type").isin("click", "purchase"), "map").when(F.col("event_type") == "error", "ignore").when(F.col("event_type") == "signup", "delete").otherwise("view")
    return table(spark, d, "events").select("event_id", "ts", "user_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), action.alias("action"))


@query(_REVIEW_SQL + "SELECT user_id, k, event_id, action FROM (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY ts DESC, event_id DESC) AS n FROM e) WHERE n = 1 AND action <> 'delete'")
def review_state(spark, d):
    """The last decision of each reviewer about each key, deleted ones left out."""
    return latest_state(decisions(spark, d), ["user_id", "k"], ["ts", "event_id"], "action", "delete").select("user_id", "k", "event_id", "action")


@query(_REVIEW_SQL + """
SELECT k, count(*) FILTER (WHERE action = 'map') AS n_map, count(*) FILTER (WHERE action = 'ignore') AS n_ignore, count(DISTINCT user_id) AS n_users,
    greatest(CAST(-0.12 AS DOUBLE), least(CAST(0.12 AS DOUBLE), floor(CAST(0.035 AS DOUBLE) * (count(*) FILTER (WHERE action = 'map') - CAST(0.75 AS DOUBLE) * count(*) FILTER (WHERE action = 'ignore')) * 10000 + 0.5) / 10000)) AS trust FROM e GROUP BY k""")
def review_signals(spark, d):
    """How often each key was mapped or ignored, and the trust that follows."""
    g = decisions(spark, d).groupBy("k").agg(F.count_if(F.col("action") == "map").alias("n_map"), F.count_if(F.col("action") == "ignore").alias("n_ignore"), F.count_distinct("user_id").alias("n_users"))
    return g.withColumn("trust", F.greatest(F.lit(-0.12), F.least(F.lit(0.12), half_up(F.lit(0.035) * (F.col("n_map") - F.lit(0.75) * F.col("n_ignore")), 4))))


@query(_REVIEW_SQL + """
, b AS (SELECT k, arg_max(event_id, (ts, event_id)) AS id FROM e WHERE action = 'map' GROUP BY k), c AS (SELECT k, arg_max(event_id, (ts, event_id)) AS id FROM e WHERE action = 'ignore' AND ts >= TIMESTAMP '2024-01-15' GROUP BY k)
SELECT k, coalesce(c.id, b.id) AS event_id, CASE WHEN b.id IS NULL THEN 'added' WHEN c.id IS NULL THEN 'kept' ELSE 'replaced' END AS change FROM b FULL JOIN c USING (k)""")
def review_merge(spark, d):
    """Stored and incoming decisions merged by key; incoming ones win; what changed is told."""
    e = decisions(spark, d)
    last = lambda x: best_by(x.select("k", "ts", "event_id"), ["k"], [F.col("ts"), F.col("event_id")])
    base, new = last(e.filter("action = 'map'")), last(e.filter("action = 'ignore' and ts >= timestamp '2024-01-15'"))
    merged = upsert(base, new, ["k"], "event_id").select("k", "event_id")
    return merged.join(base.select("k", F.lit(1).alias("b")), "k", "left").join(new.select("k", F.lit(1).alias("n")), "k", "left").select("k", "event_id", F.when(F.col("b").isNull(), "added").when(F.col("n").isNull(), "kept").otherwise("replaced").alias("change"))


_LEGAL = "(" + ", ".join(map(_q, LEGAL_FORMS)) + ")"


@query(f"""
WITH n AS (SELECT DISTINCT deal_id, customer FROM revenue_breakdown WHERE customer IS NOT NULL),
w AS (SELECT deal_id, customer, array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(customer), '&', ' and ', 'g'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x NOT IN {_LEGAL}), ' ') AS k FROM n)
SELECT deal_id, k AS entity_key, count(*) AS spellings, min(customer) AS shown FROM w GROUP BY 1, 2 HAVING count(*) > 1""")
def entity_keys(spark, d):
    """Customers whose spellings are equal but for case, signs and legal form."""
    n = table(spark, d, "revenue_breakdown").filter("customer is not null").select("deal_id", "customer").distinct().withColumn("entity_key", entity_key(F.col("customer")))
    return n.groupBy("deal_id", "entity_key").agg(F.count("*").alias("spellings"), F.min("customer").alias("shown")).filter("spellings > 1")


@query(f"""
WITH n AS (SELECT DISTINCT deal_id, instrument FROM debt_schedule WHERE instrument IS NOT NULL),
k AS (SELECT DISTINCT deal_id, array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(instrument), '&', ' and ', 'g'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x NOT IN {_LEGAL}), ' ') AS k FROM n),
p AS (SELECT a.deal_id, a.k AS key_a, b.k AS key_b, list_distinct(string_split(a.k, ' ')) AS x, list_distinct(string_split(b.k, ' ')) AS y FROM k a JOIN k b ON a.deal_id = b.deal_id AND a.k < b.k WHERE a.k <> '' AND b.k <> '')
SELECT deal_id, key_a, key_b, floor(CAST(len(list_intersect(x, y)) AS DOUBLE) / greatest(len(x), len(y)) * 10000 + 0.5) / 10000 AS similarity FROM p WHERE CAST(len(list_intersect(x, y)) AS DOUBLE) / greatest(len(x), len(y)) >= 0.74""")
def entity_similar(spark, d):
    """Instruments of one deal that share most of their words, found by a prefix filter on their rarest words."""
    n = table(spark, d, "debt_schedule").filter("instrument is not null").select("deal_id", entity_key(F.col("instrument")).alias("k")).distinct().filter("k != ''")
    p = similar_pairs(n, ["deal_id"], "k", 0.74)
    return p.select("deal_id", "key_a", "key_b", half_up(word_overlap(F.col("key_a"), F.col("key_b")), 4).alias("similarity"))


@query()
def entity_clusters(spark, d):
    """Instruments of a deal clustered greedily in the order of their files; order-dependent, so it has no SQL."""
    n = table(spark, d, "debt_schedule").filter("instrument is not null").groupBy("deal_id", "instrument").agg(F.min("row_id").alias("ord"))
    return greedy_clusters(n, ["deal_id"], "instrument", "ord", 0.74)


@query("""
SELECT DISTINCT field_name, array_to_string(list_transform(string_split(regexp_replace(field_name, '([a-z])([A-Z])', '\\1 \\2', 'g'), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title,
    regexp_replace(regexp_replace(lower(trim(doc_label)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS doc_slug FROM doc_fields""")
def field_titles(spark, d):
    """Field names as titles, and documents as slugs."""
    return table(spark, d, "doc_fields").select("field_name", humanize(F.col("field_name")).alias("title"), slug(F.col("doc_label")).alias("doc_slug")).distinct()
