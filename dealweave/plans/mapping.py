"""Queries that map the files of every document type: labels to fields, values in the sheet's scale with where they come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..dims import BALANCE_SHEET_ALIASES, COLUMN_ALIASES, FIELD_SCHEMA, OTHER_ALIASES, aliases_table, all_aliases_table, schema_table
from ..functions.numeric import half_up, to_number
from ..functions.periods import year_in
from ..functions.text import evidence_label, ignorable_label, plain_file_name, review_label
from ..operators import sheets
from ..operators.matching import coverage, match_labels
from ..operators.units import NOTE_ROW, TOTAL_ROW
from ..session import table
from .documents import LABELS_SQL, MATCH_SQL, _q, labels

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


_TYPED_ALIASES = ", ".join(
    f"({_q(t)}, {_q(f)}, {_q(a)}, {i + 1})" for t, fields in ({"balance_sheet": BALANCE_SHEET_ALIASES} | OTHER_ALIASES).items() for i, (f, a) in enumerate((f, a) for f, names in fields.items() for a in names)
)
_KEY_TYPES = ("income_statement", "cash_flow_statement", "debt_schedule", "projections", "tax_return", "qoe_report")
_LABEL_SQL = LABELS_SQL.split("n AS (", 1)[1]


def _match_sql(raw: str, aliases: str) -> str:
    """SQL of the candidates of (doc_type, label) rows ``raw`` among (doc_type, field_name, alias, ordinal) rows."""
    s = "WITH raw AS (" + raw + "),\nn AS (" + _LABEL_SQL + MATCH_SQL[len(LABELS_SQL) :]
    s = s.replace("n AS (SELECT label,", "n AS (SELECT doc_type, label,").replace("c AS (SELECT label, norm,", "c AS (SELECT doc_type, label, norm,", 1)
    head, tail = s.split("ar AS (", 1)
    tail = f"ar AS (SELECT * FROM (VALUES {aliases}) t(doc_type, field_name, alias, ordinal)), an AS (SELECT doc_type, field_name," + tail.split("an AS (SELECT field_name,", 1)[1]
    tail = tail.replace("met AS (SELECT label,", "met AS (SELECT doc_type, label,").replace("FROM labels, aw WHERE", "FROM labels JOIN aw USING (doc_type) WHERE")
    tail = tail.replace("bf AS (SELECT label,", "bf AS (SELECT doc_type, label,").replace("GROUP BY 1, 2),\nranked", "GROUP BY 1, 2, 3),\nranked").replace("PARTITION BY label", "PARTITION BY doc_type, label")
    return head + tail


_HUMAN = "regexp_replace({}, '([a-z])([A-Z])', '\\1 \\2', 'g')"
_TYPED_RAW = (
    "SELECT DISTINCT doc_type, label FROM (SELECT unnest(['ar_aging', 'ap_aging']) AS doc_type, metric AS label FROM ar_aging UNION ALL SELECT 'balance_sheet', c0 FROM balance_sheet UNION ALL SELECT 'balance_sheet', c0 FROM ugly_balance_sheet"
    " UNION ALL SELECT 'revenue_breakdown', customer FROM revenue_breakdown UNION ALL "
    + f"SELECT unnest({list(_KEY_TYPES)}), {_HUMAN.format('concept_key')} FROM evidence_resolver) WHERE label IS NOT NULL"
)


def _typed_labels(spark: SparkSession, d: str) -> DataFrame:
    """``doc_type, label``: what each table's labels may be labels of."""
    of = lambda name, c, types: table(spark, d, name).select(F.explode(F.array(*map(F.lit, types))).alias("doc_type"), c.alias("label"))
    words = F.regexp_replace("concept_key", "([a-z])([A-Z])", "$1 $2")
    out = of("ar_aging", F.col("metric"), ["ar_aging", "ap_aging"]).unionByName(of("balance_sheet", F.col("c0"), ["balance_sheet"])).unionByName(of("ugly_balance_sheet", F.col("c0"), ["balance_sheet"]))
    out = out.unionByName(of("revenue_breakdown", F.col("customer"), ["revenue_breakdown"])).unionByName(of("evidence_resolver", words, list(_KEY_TYPES)))
    return out.filter("label is not null").distinct()


@query(_match_sql(_TYPED_RAW, _TYPED_ALIASES) + "SELECT doc_type, label, field_name, alias, score FROM ranked WHERE match_rank = 1 AND score >= 0.6")
def typed_fields(spark, d):
    """The field that each label of each document type means."""
    return match_labels(_typed_labels(spark, d), all_aliases_table(spark)).filter("match_rank = 1 and score >= 0.6").drop("match_rank")


_SCHEMA_ROWS = ", ".join(f"({_q(t)}, {_q(f)}, {r}, {i + 1})" for t, fields in FIELD_SCHEMA.items() for i, (f, r) in enumerate(fields))


@query(_match_sql(f"SELECT DISTINCT unnest({list(_KEY_TYPES)}) AS doc_type, {_HUMAN.format('concept_key')} AS label FROM evidence_resolver WHERE concept_key IS NOT NULL", _TYPED_ALIASES) + f"""
, fs AS (SELECT * FROM (VALUES {_SCHEMA_ROWS}) t(doc_type, field_name, required, ordinal)),
f AS (SELECT DISTINCT deal_id, ranked.doc_type, ranked.field_name FROM evidence_resolver JOIN ranked ON label = {_HUMAN.format('concept_key')} AND match_rank = 1 AND score >= 0.6 WHERE deal_id IS NOT NULL), docs AS (SELECT DISTINCT deal_id, doc_type FROM f)
SELECT deal_id, doc_type, count(*) AS n_fields, count(f.field_name) AS n_found, count(*) FILTER (WHERE required) AS n_required, count(*) FILTER (WHERE required AND f.field_name IS NOT NULL) AS n_required_found,
       coalesce(string_agg(fs.field_name, ',' ORDER BY fs.ordinal) FILTER (WHERE required AND f.field_name IS NULL), '') AS missing, floor(CAST(count(f.field_name) AS DOUBLE) / count(*) * 100 + 0.5) / 100 AS pct
FROM docs JOIN fs USING (doc_type) LEFT JOIN f USING (deal_id, doc_type, field_name) GROUP BY 1, 2""")
def typed_coverage(spark, d):
    """How much of each document type's schema the evidence of a deal covers."""
    words = F.regexp_replace("concept_key", "([a-z])([A-Z])", "$1 $2")
    e = table(spark, d, "evidence_resolver").filter("concept_key is not null and deal_id is not null").select("deal_id", words.alias("label")).distinct()
    asked = e.select("label").distinct().select(F.explode(F.array(*map(F.lit, _KEY_TYPES))).alias("doc_type"), "label")
    best = match_labels(asked, all_aliases_table(spark)).filter("match_rank = 1 and score >= 0.6")
    return coverage(schema_table(spark), e.join(best, "label").select("deal_id", "doc_type", "field_name"), keys=["deal_id"])


_ROLE_ROWS = ", ".join(f"({_q(t)}, {_q(f)}, {_q(a)}, {i + 1})" for t, fields in COLUMN_ALIASES.items() for i, (f, a) in enumerate((f, a) for f, names in fields.items() for a in names))
_RAW_HEADERS = "SELECT DISTINCT doc_type, trim(unnest(string_split(c0, ','))) AS label FROM (SELECT 'debt_schedule' AS doc_type, c0 FROM ugly_debt_schedule WHERE lower(c0) LIKE '%outstanding%' UNION ALL SELECT 'revenue_breakdown', c0 FROM ugly_revenue_breakdown WHERE lower(c0) LIKE '%revenue%mix%' UNION ALL SELECT 'revenue_breakdown', revenue_header FROM revenue_breakdown) WHERE c0 IS NOT NULL"


@query(_match_sql(_RAW_HEADERS, _ROLE_ROWS) + "SELECT doc_type, label, field_name AS role, score FROM ranked WHERE match_rank = 1")
def column_roles(spark, d):
    """The role that each column header of debt and revenue tables plays."""
    rows = [(t, f, a, i + 1) for t, fields in COLUMN_ALIASES.items() for i, (f, a) in enumerate((f, a) for f, names in fields.items() for a in names)]
    roles = spark.createDataFrame(rows, "doc_type string, field_name string, alias string, ordinal int")
    head = lambda name, t, c, like: table(spark, d, name).filter(F.lower(c).like(like)).select(F.lit(t).alias("doc_type"), F.col(c).alias("c"))
    both = head("ugly_debt_schedule", "debt_schedule", "c0", "%outstanding%").unionByName(head("ugly_revenue_breakdown", "revenue_breakdown", "c0", "%revenue%mix%")).unionByName(head("revenue_breakdown", "revenue_breakdown", "revenue_header", "%"))
    found = both.distinct().select("doc_type", F.explode(F.split("c", ",")).alias("label")).select("doc_type", F.trim("label").alias("label")).distinct()
    return match_labels(found, roles).filter("match_rank = 1").select("doc_type", "label", F.col("field_name").alias("role"), "score")


def _ugly_rows(spark: SparkSession, d: str) -> DataFrame:
    return sheets.sheet_rows(table(spark, d, "ugly_balance_sheet"), sheet="file_id", place="row_idx", order="row_id", cells=["c0", "c1"])


_BALANCE_ROWS = ", ".join(f"({_q('balance_sheet')}, {_q(f)}, {_q(a)}, {i + 1})" for i, (f, a) in enumerate((f, a) for f, names in BALANCE_SHEET_ALIASES.items() for a in names))


@query(_match_sql("SELECT DISTINCT 'balance_sheet' AS doc_type, c0 AS label FROM (SELECT c0 FROM balance_sheet UNION ALL SELECT c0 FROM ugly_balance_sheet) WHERE c0 IS NOT NULL", _BALANCE_ROWS) + """
, one AS (SELECT file_id AS sheet, row_idx AS place, arg_min([nullif(trim(c0), ''), nullif(trim(c1), '')], row_id) AS cells FROM ugly_balance_sheet GROUP BY 1, 2),
r AS (SELECT sheet, CAST(row_number() OVER (PARTITION BY sheet ORDER BY place) - 1 AS INTEGER) AS row_no, cells FROM one WHERE cells[1] IS NOT NULL OR cells[2] IS NOT NULL),
t AS (SELECT sheet, lower(sheet || ' ' || string_agg(coalesce(cells[1] || ' ', '') || coalesce(cells[2], ''), ' ' ORDER BY row_no)) AS t FROM r WHERE row_no < 3 GROUP BY 1),
sc AS (SELECT sheet, CAST(CASE WHEN regexp_matches(t, '\\(\\$?\\s*000s?\\)|\\$000s?\\b|\\bin thousands?\\b|\\b000s\\b') THEN 1000 WHEN regexp_matches(t, '\\(\\$?\\s*mm\\)|\\(\\$?\\s*millions?\\)|\\bin millions?\\b|\\bmm\\b') THEN 1000000 ELSE 1 END AS BIGINT) AS value_scale FROM t),
m AS (SELECT trim(label) AS label, field_name, max(score) AS score, min(alias) AS alias FROM ranked WHERE match_rank = 1 AND score >= 0.6 GROUP BY 1, 2),
v AS (SELECT r.sheet AS file_id, row_no, cells[1] AS label, cells[2] AS raw, CASE WHEN regexp_matches(trim(cells[2]), '^\\(.*\\)$') THEN -1 ELSE 1 END * TRY_CAST(CASE WHEN regexp_matches(trim(regexp_replace(trim(cells[2]), '[,$%()]', '', 'g')), '^[+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?$') THEN trim(regexp_replace(trim(cells[2]), '[,$%()]', '', 'g')) END AS DOUBLE) AS n FROM r)
SELECT file_id, row_no, label, field_name, alias, score, raw, value_scale, n * value_scale AS value FROM v JOIN m USING (label) JOIN sc ON sc.sheet = file_id WHERE n IS NOT NULL""")
def scaled_values(spark, d):
    """Balance sheet values in whole currency by the scale that their sheet states, each with its row, label, alias and raw cell."""
    rows = _ugly_rows(spark, d)
    best = match_labels(labels(spark, d), aliases_table(spark)).filter("match_rank = 1 and score >= 0.6")
    best = best.groupBy(F.trim("label").alias("label"), "field_name").agg(F.max("score").alias("score"), F.min("alias").alias("alias"))
    cells = rows.select("sheet", "row_no", F.get("cells", F.lit(0)).alias("label"), F.get("cells", F.lit(1)).alias("raw")).withColumn("n", to_number(F.col("raw"))).filter("n is not null")
    out = cells.join(best, "label").join(sheets.value_scales(rows), "sheet")
    return out.select(F.col("sheet").alias("file_id"), "row_no", "label", "field_name", "alias", "score", "raw", "value_scale", (F.col("n") * F.col("value_scale")).alias("value"))


@query(f"""
WITH x AS (SELECT file_id, regexp_matches(customer, {_q(TOTAL_ROW)}) AS is_total, TRY_CAST(replace(replace(revenue, ',', ''), '$', '') AS DOUBLE) AS n FROM revenue_breakdown WHERE customer IS NOT NULL AND NOT regexp_matches(customer, {_q(NOTE_ROW)}))
SELECT file_id, floor(coalesce(max(n) FILTER (WHERE is_total), sum(n) FILTER (WHERE NOT is_total)) * 100 + 0.5) / 100 AS total, count(*) FILTER (WHERE is_total) > 0 AS stated FROM x WHERE n IS NOT NULL GROUP BY 1""")
def revenue_totals(spark, d):
    """The total of each revenue file as written: its own total row, else the sum of its customers."""
    x = table(spark, d, "revenue_breakdown").filter("customer is not null").filter(~F.col("customer").rlike(NOTE_ROW))
    n = F.regexp_replace("revenue", r"[,$]", "").try_cast("double")
    x = x.select("file_id", F.col("customer").rlike(TOTAL_ROW).alias("is_total"), n.alias("n")).filter("n is not null")
    total = F.coalesce(F.max(F.when(F.col("is_total"), F.col("n"))), F.sum(F.when(~F.col("is_total"), F.col("n"))))
    return x.groupBy("file_id").agg(half_up(total).alias("total"), (F.count_if("is_total") > 0).alias("stated"))


@query("""
WITH l AS (SELECT DISTINCT c0 AS label FROM balance_sheet WHERE c0 IS NOT NULL)
SELECT label, trim(regexp_replace(regexp_replace(replace(lower(label), '&', ' and '), '[_./()\\\\-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS review_form, trim(regexp_replace(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g'), '\\s+', ' ', 'g')) AS evidence_form,
    translate(lower(label), '_-.', '   ') AS file_form, regexp_full_match(trim(lower(label)), '\\d+') OR regexp_matches(trim(lower(label)), '^(?:note |notes|see accompanying|page |continued)') AS ignorable FROM l""")
def label_forms(spark, d):
    """Balance sheet labels in the forms in which reviews, evidence and file names are compared, and whether they are none."""
    c = F.col("label")
    l = table(spark, d, "balance_sheet").filter("c0 is not null").select(F.col("c0").alias("label")).distinct()  # noqa: E741
    return l.select("label", review_label(c).alias("review_form"), evidence_label(c).alias("evidence_form"), plain_file_name(c).alias("file_form"), ignorable_label(c).alias("ignorable"))


@query("""
WITH p AS (SELECT deal_id, evidence_id, concept_key, TRY_CAST(nullif(regexp_extract(period_key, '\\b((?:19|20)\\d{2})\\b', 1), '') AS INTEGER) AS y FROM evidence_resolver WHERE deal_id IS NOT NULL),
k AS (SELECT deal_id, concept_key, max(y) AS y FROM p WHERE y IS NOT NULL AND concept_key IS NOT NULL GROUP BY 1, 2),
g AS (SELECT deal_id, max(y) AS newest, min(y) AS oldest, count(*) FILTER (WHERE y < m - 1) AS stale FROM (SELECT *, max(y) OVER (PARTITION BY deal_id) AS m FROM k) GROUP BY 1)
SELECT deal_id, newest, oldest, newest - oldest AS gap, stale, CAST(greatest(0, 100 - 9 * stale) AS BIGINT) AS score FROM g""")
def staleness(spark, d):
    """How far the concepts of a deal lie apart in their latest years, and a score that falls with every stale one."""
    p = table(spark, d, "evidence_resolver").filter("deal_id is not null and concept_key is not null").select("deal_id", "concept_key", year_in(F.col("period_key")).alias("y")).filter("y is not null")
    k = p.groupBy("deal_id", "concept_key").agg(F.max("y").alias("y"))
    k = k.withColumn("m", F.max("y").over(Window.partitionBy("deal_id")))  # one row per concept of a deal
    g = k.groupBy("deal_id").agg(F.max("y").alias("newest"), F.min("y").alias("oldest"), F.count_if(F.col("y") < F.col("m") - 1).alias("stale"))
    return g.select("deal_id", "newest", "oldest", (F.col("newest") - F.col("oldest")).alias("gap"), "stale", F.greatest(F.lit(0), 100 - 9 * F.col("stale")).cast("bigint").alias("score"))
