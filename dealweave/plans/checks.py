"""Queries from typed cells to checked facts: facts, wide statements, balance checks, findings, merges, overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..dims import aliases_table
from ..functions.numeric import half_up, relative_difference, to_number
from ..functions.periods import to_day
from ..operators import sheets
from ..operators.matching import MAX_ALIASES, match_labels
from ..operators.relational import best_by, penalty_fold, top_k, upsert, wildcard_anti
from ..session import bounded_broadcast, table
from .documents import _ROWS_SQL, CLASSIFY_SQL, MATCH_SQL, _balance_rows, classify_titles, labels
from .problems import p3_wide
from .problems_sql import P3_SQL

Q: dict = {}
SQL: dict[str, str] = {}

_FACTS = (
    MATCH_SQL
    + ", "
    + _ROWS_SQL.strip().removeprefix("WITH ")
    + """, pcol AS (SELECT sheet, header_row, i, regexp_extract(trim(lower(header[i])), '^(?:fy ?)?((?:19|20)\\d{2})e?$', 1) AS period_key FROM (SELECT sheet, header_row, unnest([2, 3, 4]) AS i, header FROM h)),
cell AS (SELECT r.sheet, row_no, period_key, cells[1] AS label, cells[i] AS raw FROM r JOIN pcol ON pcol.sheet = r.sheet AND row_no > header_row WHERE period_key <> '' AND cells[i] IS NOT NULL),
num AS (SELECT c.*, CASE WHEN regexp_matches(trim(raw), '^\\(.*\\)$') THEN -1 ELSE 1 END * TRY_CAST(CASE WHEN regexp_matches(trim(regexp_replace(trim(raw), '[,$%()]', '', 'g')), '^[+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?$') THEN trim(regexp_replace(trim(raw), '[,$%()]', '', 'g')) END AS DOUBLE) AS value FROM cell c),
cand AS (SELECT n.sheet AS file_id, period_key, m.field_name, value, m.score, row_no, row_number() OVER (PARTITION BY n.sheet, period_key, m.field_name ORDER BY m.score DESC, row_no DESC) AS place FROM num n JOIN (SELECT trim(label) AS label, field_name, max(score) AS score FROM ranked WHERE match_rank = 1 AND score >= 0.6 GROUP BY 1, 2) m USING (label) WHERE value IS NOT NULL),
facts AS (SELECT file_id, period_key, field_name, value, score FROM cand WHERE place = 1)
"""
)
_WIDE = ", ".join(f"max(value) FILTER (WHERE field_name = '{f}') AS {f}" for f in ("cash", "accountsReceivable", "inventory", "totalCurrentAssets", "totalAssets", "totalCurrentLiabilities", "totalLiabilities", "equity"))
FIELDS = ["cash", "accountsReceivable", "inventory", "totalCurrentAssets", "totalAssets", "totalCurrentLiabilities", "totalLiabilities", "equity"]


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query(_FACTS + "SELECT * FROM facts")
def balance_facts(spark, d):
    """One value per file, period and field; a later row replaces an earlier one unless its label fits less."""
    rows = _balance_rows(spark, d)
    long = sheets.unpivot_periods(rows, sheets.header_rows(rows)).select(F.col("sheet").alias("file_id"), "row_no", "label", "period_key", to_number(F.col("raw")).alias("value")).filter("value is not null")
    best = match_labels(labels(spark, d), aliases_table(spark)).filter("match_rank = 1 and score >= 0.6")
    best = best.groupBy(F.trim("label").alias("label"), "field_name").agg(F.max("score").alias("score"))
    facts = long.join(best, "label").select("file_id", "period_key", "field_name", "row_no", "value", "score")
    return best_by(facts, ["file_id", "period_key", "field_name"], [F.col("score"), F.col("row_no")]).select("file_id", "period_key", "field_name", "value", "score")


@query(_FACTS + f"SELECT file_id, period_key, {_WIDE} FROM facts GROUP BY 1, 2")
def balance_wide(spark, d):
    """Facts as one row per file and period."""
    return balance_facts(spark, d).groupBy("file_id", "period_key").pivot("field_name", FIELDS).agg(F.max("value"))


_CHECKS_SQL = (
    _FACTS
    + f""", w AS (SELECT file_id, period_key, {_WIDE} FROM facts GROUP BY 1, 2),
chk AS (SELECT file_id, period_key, 1 AS ord, 'balance' AS code, abs(totalAssets - (totalLiabilities + equity)) / greatest(abs(totalAssets), abs(totalLiabilities + equity), 1.0) AS gap, CAST(0.08 AS DOUBLE) AS hard, CAST(0.03 AS DOUBLE) AS warn FROM w
 UNION ALL SELECT file_id, period_key, 2, 'current_assets', CASE WHEN totalCurrentAssets > totalAssets THEN (totalCurrentAssets - totalAssets) / greatest(abs(totalAssets), 1.0) ELSE CAST(0 AS DOUBLE) END, CAST(0.02 AS DOUBLE), CAST(0 AS DOUBLE) FROM w
 UNION ALL SELECT file_id, period_key, 3, 'current_liabilities', CASE WHEN totalCurrentLiabilities > totalLiabilities THEN (totalCurrentLiabilities - totalLiabilities) / greatest(abs(totalLiabilities), 1.0) ELSE CAST(0 AS DOUBLE) END, CAST(0.02 AS DOUBLE), CAST(0 AS DOUBLE) FROM w),
fnd AS (SELECT file_id, period_key, ord, code, CASE WHEN gap IS NULL THEN 'missing' WHEN gap > hard THEN 'hard' ELSE 'warning' END AS severity, CASE WHEN gap IS NOT NULL THEN floor(gap * 10000 + 0.5) / 10000 END AS gap FROM chk WHERE gap IS NULL OR gap > warn)
"""
)


@query(_CHECKS_SQL + "SELECT file_id, period_key, code, severity, gap FROM fnd")
def balance_findings(spark, d):
    """Statements that do not balance, parts above their whole, and totals that are missing."""
    return _findings(spark, d).drop("ord")


def _findings(spark: SparkSession, d: str) -> DataFrame:
    w = balance_wide(spark, d)
    whole = F.col("totalLiabilities") + F.col("equity")
    over = lambda a, b: F.when(F.col(a) > F.col(b), (F.col(a) - F.col(b)) / F.greatest(F.abs(F.col(b)), F.lit(1.0))).otherwise(0.0)
    checks = F.array(*(
        F.struct(F.lit(i).alias("ord"), F.lit(code).alias("code"), gap.alias("gap"), F.lit(hard).alias("hard"), F.lit(warn).alias("warn"))
        for i, (code, gap, hard, warn) in enumerate([("balance", relative_difference(F.col("totalAssets"), whole), 0.08, 0.03), ("current_assets", over("totalCurrentAssets", "totalAssets"), 0.02, 0.0), ("current_liabilities", over("totalCurrentLiabilities", "totalLiabilities"), 0.02, 0.0)], 1)
    ))
    # the greatest of nulls is no check: a missing side makes the balance missing
    known = F.col("totalAssets").isNotNull() & whole.isNotNull()
    c = w.select("file_id", "period_key", known.alias("known"), F.explode(checks).alias("c")).select("file_id", "period_key", "known", "c.*")
    c = c.withColumn("gap", F.when((F.col("code") != "balance") | F.col("known"), F.col("gap"))).filter(F.col("gap").isNull() | (F.col("gap") > F.col("warn")))
    severity = F.when(F.col("gap").isNull(), "missing").when(F.col("gap") > F.col("hard"), "hard").otherwise("warning")
    return c.select("file_id", "period_key", "ord", "code", severity.alias("severity"), half_up(F.col("gap"), 4).alias("gap"))


@query(_CHECKS_SQL + """
, p AS (SELECT file_id, list(CASE severity WHEN 'hard' THEN CAST(0.12 AS DOUBLE) WHEN 'warning' THEN CAST(0.05 AS DOUBLE) ELSE CAST(0.02 AS DOUBLE) END ORDER BY period_key, ord) AS xs, count(*) FILTER (WHERE severity = 'hard') AS n_hard, count(*) FILTER (WHERE severity = 'warning') AS n_warning, count(*) FILTER (WHERE severity = 'missing') AS n_missing FROM fnd GROUP BY 1)
SELECT file_id, n_hard, n_warning, n_missing, list_reduce(list_prepend(CAST(0.0 AS DOUBLE), xs), lambda a, x: floor(least(CAST(0.45 AS DOUBLE), a + x) * 100 + 0.5) / 100) AS penalty FROM p""")
def file_penalties(spark, d):
    """Findings of each file counted, and their penalties added in order with rounding."""
    f = _findings(spark, d)
    counts = f.groupBy("file_id").agg(*(F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in ("hard", "warning", "missing")))
    amount = F.when(F.col("severity") == "hard", 0.12).when(F.col("severity") == "warning", 0.05).otherwise(0.02)
    seq = f.select("file_id", F.concat_ws("|", "period_key", F.col("ord").cast("string")).alias("o"), amount.alias("a"))
    return counts.join(penalty_fold(seq, ["file_id"], "o", "a"), "file_id").select("file_id", "n_hard", "n_warning", "n_missing", "penalty")


@query(_FACTS + """
, df AS (SELECT b.deal_id, facts.*, b.t FROM facts JOIN (SELECT deal_id, file_id, max(loaded_at) AS t FROM balance_sheet GROUP BY 1, 2) b USING (file_id))
SELECT deal_id, period_key, field_name, value, file_id FROM (SELECT *, row_number() OVER (PARTITION BY deal_id, period_key, field_name ORDER BY t DESC, file_id DESC) AS n FROM df) WHERE n = 1""")
def deal_facts(spark, d):
    """A deal's files merged: periods complement each other, and of one value the latest file's counts."""
    loaded = table(spark, d, "balance_sheet").groupBy("deal_id", "file_id").agg(F.max("loaded_at").alias("t"))
    f = balance_facts(spark, d).join(loaded, "file_id").select("deal_id", "period_key", "field_name", "value", "file_id", "t")
    return best_by(f, ["deal_id", "period_key", "field_name"], [F.col("t"), F.col("file_id")]).select("deal_id", "period_key", "field_name", "value", "file_id")


@query(_FACTS + """
, rules AS (SELECT DISTINCT field_name, CASE WHEN field_name = 'goodwill' THEN 'ignore' WHEN field_name = 'intangibles' THEN 'map' END AS action FROM facts WHERE field_name IN ('goodwill', 'intangibles'))
SELECT file_id, period_key, CASE WHEN action = 'map' THEN 'otherAssets' ELSE field_name END AS field_name, value, action = 'map' AS overridden FROM facts LEFT JOIN rules USING (field_name) WHERE action IS DISTINCT FROM 'ignore'""".replace("action = 'map' AS overridden", "coalesce(action = 'map', false) AS overridden"))
def overridden_facts(spark, d):
    """Reviewer rules applied to facts: some fields ignored, some mapped to another."""
    rules = spark.createDataFrame([("goodwill", "ignore", None), ("intangibles", "map", "otherAssets")], "field_name string, action string, to string")
    f = balance_facts(spark, d).join(F.broadcast(rules), "field_name", "left").filter("action is distinct from 'ignore'")
    return f.select("file_id", "period_key", F.coalesce("to", "field_name").alias("field_name"), "value", F.coalesce(F.col("action") == "map", F.lit(False)).alias("overridden"))


@query(_FACTS + """
, df AS (SELECT DISTINCT b.deal_id, facts.file_id, CAST(period_key AS INTEGER) AS y FROM facts JOIN (SELECT DISTINCT deal_id, file_id FROM balance_sheet) b USING (file_id))
SELECT deal_id, count(DISTINCT file_id) AS files, count(DISTINCT y) AS periods, max(y) AS last_year, max(y) - min(y) + 1 - count(DISTINCT y) AS holes FROM df GROUP BY 1""")
def deal_timelines(spark, d):
    """Years that each deal's files cover, and years missing between them."""
    files = table(spark, d, "balance_sheet").select("deal_id", "file_id").distinct()
    f = balance_facts(spark, d).select("file_id", F.col("period_key").cast("int").alias("y")).distinct().join(files, "file_id")
    return f.groupBy("deal_id").agg(F.count_distinct("file_id").alias("files"), F.count_distinct("y").alias("periods"), F.max("y").alias("last_year"), (F.max("y") - F.min("y") + 1 - F.count_distinct("y")).alias("holes"))


@query("""
WITH e AS (SELECT evidence_id, deal_id, lower(doc_type) AS a, lower(field_name) AS b FROM evidence_resolver), k AS (SELECT DISTINCT lower(field_name) AS k FROM doc_fields)
SELECT e.evidence_id, e.deal_id FROM e WHERE a IN (SELECT k FROM k) OR b IN (SELECT k FROM k)""")
def evidence_named(spark, d):
    """Evidence whose type or field is a known field name: an OR of keys as the union of two equi semi joins."""
    e = table(spark, d, "evidence_resolver").select("evidence_id", "deal_id", F.lower("doc_type").alias("a"), F.lower("field_name").alias("b"))
    k = table(spark, d, "doc_fields").select(F.lower("field_name").alias("k")).distinct()
    k = bounded_broadcast(k, MAX_ALIASES)
    either = e.join(k, F.col("a") == F.col("k"), "left_semi").unionByName(e.join(k, F.col("b") == F.col("k"), "left_semi"))
    return either.select("evidence_id", "deal_id").distinct()


@query("""
WITH c AS (SELECT deal_id, customer, max(CAST(replace(pct_of_revenue, '%', '') AS DOUBLE)) AS p FROM revenue_breakdown WHERE customer IS NOT NULL AND pct_of_revenue IS NOT NULL AND NOT regexp_matches(lower(customer), 'total') GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY deal_id ORDER BY p DESC, customer) AS n FROM c)
SELECT deal_id, CAST(n AS INTEGER) AS rank, customer, p AS share FROM r WHERE n <= 3""")
def top_shares_stated(spark, d):
    """The three largest stated shares of each deal."""
    c = table(spark, d, "revenue_breakdown").filter(F.col("customer").isNotNull() & F.col("pct_of_revenue").isNotNull() & ~F.lower("customer").contains("total"))
    c = c.groupBy("deal_id", "customer").agg(F.max(to_number(F.col("pct_of_revenue"))).alias("share"))
    r = c.withColumn("rank", F.row_number().over(Window.partitionBy("deal_id").orderBy(F.desc("share"), "customer"))).filter("rank <= 3")
    return r.select("deal_id", "rank", "customer", "share")


@query("""
WITH m AS (SELECT deal_id, file_id, coalesce(strftime(min(coalesce(try_strptime(maturity, '%Y-%m-%d'), try_strptime(maturity, '%m/%d/%Y'))), '%Y-%m-%d'), '') AS iso, count(*) AS n, count(annual_debt_service) AS serviced, count(*) FILTER (WHERE maturity IS NULL) AS undated FROM debt_schedule WHERE instrument IS NOT NULL GROUP BY 1, 2)
SELECT deal_id, file_id, iso AS nearest, n, serviced, undated FROM m""")
def debt_files(spark, d):
    """Instruments, nearest maturity of either date style and gaps of each debt file."""
    m = table(spark, d, "debt_schedule").filter("instrument is not null")
    nearest = F.min(to_day(F.col("maturity"))).cast("string")
    return m.groupBy("deal_id", "file_id").agg(F.coalesce(nearest, F.lit("")).alias("nearest"), F.count("*").alias("n"), F.count("annual_debt_service").alias("serviced"), F.count_if(F.col("maturity").isNull()).alias("undated"))


@query("""
WITH d AS (SELECT source, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE source IS NOT NULL GROUP BY 1)
SELECT coalesce(d.source, m.source) AS source, coalesce(docs, 0) AS docs, coalesce(chars, 0) AS chars, target_share IS NOT NULL AS wanted FROM d FULL JOIN mix_targets m ON d.source = m.source""")
def source_coverage(spark, d):
    """Sources of documents against the wanted ones, either side missing."""
    have = table(spark, d, "documents").filter("source is not null").groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))
    want = table(spark, d, "mix_targets").select("source", F.lit(True).alias("wanted"))
    return have.join(want, "source", "full").select("source", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("chars", F.lit(0)).alias("chars"), F.coalesce("wanted", F.lit(False)).alias("wanted"))


@query("""
WITH s AS (SELECT field_name AS k, 'base' AS v FROM doc_fields WHERE ordinal <= 2), n AS (SELECT field_name AS k, 'new' AS v FROM doc_fields WHERE ordinal >= 2)
SELECT coalesce(n.k, s.k) AS k, coalesce(n.v, s.v) AS v FROM (SELECT DISTINCT * FROM s) s FULL JOIN (SELECT DISTINCT * FROM n) n ON s.k = n.k""")
def merged_registry(spark, d):
    """Two registries merged by key, the newer winning."""
    f = table(spark, d, "doc_fields")
    side = lambda c, v: f.filter(c).select(F.col("field_name").alias("k"), F.lit(v).alias("v"), F.lit(1).alias("seq")).distinct()
    return upsert(side("ordinal <= 2", "base"), side("ordinal >= 2", "new"), ["k"], "seq").select("k", "v")


@query("""
WITH e AS (SELECT evidence_id, concept_key, lower(doc_type) AS doc, coalesce(source_ref, '') AS ref FROM evidence_resolver),
r AS (SELECT * FROM (VALUES ('revenue', 'projections', ''), ('ebitda', 'qoe_report', '::Sheet1::::page-1'), ('totalDebt', 'debt_schedule', '::FS::::page-2')) v(concept_key, doc, ref))
SELECT evidence_id, concept_key FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.concept_key = e.concept_key AND r.doc = e.doc AND (r.ref = '' OR r.ref = e.ref))""")
def evidence_unsuppressed(spark, d):
    """Evidence that no suppression rule hits, also without a type; a rule without a reference holds for all of its document type."""
    e = table(spark, d, "evidence_resolver").select("evidence_id", "concept_key", F.lower("doc_type").alias("doc"), F.coalesce("source_ref", F.lit("")).alias("ref"))
    rules = spark.createDataFrame([("revenue", "projections", ""), ("ebitda", "qoe_report", "::Sheet1::::page-1"), ("totalDebt", "debt_schedule", "::FS::::page-2")], "concept_key string, doc string, ref string")
    return wildcard_anti(e, rules, ["concept_key", "doc"], "ref").select("evidence_id", "concept_key")


_TITLES = """
WITH t AS (SELECT DISTINCT sheet_title AS title, 'revenue_breakdown' AS truth FROM revenue_breakdown WHERE sheet_title IS NOT NULL UNION ALL SELECT DISTINCT sheet_title, 'debt_schedule' FROM debt_schedule WHERE sheet_title IS NOT NULL),
"""


@query(_TITLES + CLASSIFY_SQL.strip().removeprefix("WITH ").replace("t AS (", "tt AS (", 1).replace("FROM t, k", "FROM tt, k") + """
, c AS (SELECT t.truth, r.doc_type, score FROM t JOIN (SELECT title, CASE WHEN score < 0.3 THEN 'unknown' ELSE doc_type END AS doc_type, score FROM r WHERE n = 1) r USING (title))
SELECT truth, count(*) AS n, count(*) FILTER (WHERE doc_type = truth) AS n_right, count(*) FILTER (WHERE doc_type = 'unknown') AS n_unknown, count(*) FILTER (WHERE doc_type NOT IN (truth, 'unknown') AND score >= 0.8) AS n_false_confident FROM c GROUP BY 1""")
def title_accuracy(spark, d):
    """How well titles alone tell the kind of file: right, unknown, and confidently wrong."""
    one = lambda t: table(spark, d, t).filter("sheet_title is not null").select(F.col("sheet_title").alias("title"), F.lit(t).alias("truth")).distinct()
    c = one("revenue_breakdown").unionByName(one("debt_schedule")).join(classify_titles(spark, d), "title")
    wrong = ~F.col("doc_type").isin("unknown") & (F.col("doc_type") != F.col("truth")) & (F.col("score") >= 0.8)
    return c.groupBy("truth").agg(F.count("*").alias("n"), F.count_if(F.col("doc_type") == F.col("truth")).alias("n_right"), F.count_if(F.col("doc_type") == "unknown").alias("n_unknown"), F.count_if(wrong).alias("n_false_confident"))


@query(_FACTS + """
, wide AS (""" + P3_SQL.strip() + """), arx AS (SELECT deal_id, arg_max(CAST(value_key AS DOUBLE), (t, file_id)) AS ar FROM wide JOIN (SELECT file_id, min(deal_id) AS deal_id, max(loaded_at) AS t FROM ar_aging GROUP BY 1) USING (file_id) WHERE field_name = 'total_ar' GROUP BY 1),
bsx AS (SELECT deal_id, arg_max(value, (period_key, t, facts.file_id)) AS bs FROM facts JOIN (SELECT file_id, min(deal_id) AS deal_id, max(loaded_at) AS t FROM balance_sheet GROUP BY 1) b USING (file_id) WHERE field_name = 'accountsReceivable' GROUP BY 1)
SELECT coalesce(arx.deal_id, bsx.deal_id) AS deal_id, CASE WHEN ar IS NULL OR bs IS NULL THEN 'missing' WHEN abs(ar - bs) / greatest(abs(ar), abs(bs), 1.0) > 0.5 THEN 'hard' WHEN abs(ar - bs) / greatest(abs(ar), abs(bs), 1.0) > 0.15 THEN 'warning' ELSE 'ok' END AS severity FROM arx FULL JOIN bsx ON arx.deal_id = bsx.deal_id""")
def aging_vs_balance(spark, d):
    """Receivables of a deal's latest aging against its latest balance sheet; either side may be missing."""
    files = table(spark, d, "ar_aging").groupBy("file_id").agg(F.min("deal_id").alias("deal_id"), F.max("loaded_at").alias("t"))
    ar = p3_wide(spark, d).filter("total_ar is not null").join(files, "file_id").groupBy("deal_id").agg(F.max_by("total_ar", F.struct("t", "file_id")).cast("double").alias("ar"))
    files = table(spark, d, "balance_sheet").groupBy("file_id").agg(F.min("deal_id").alias("deal_id"), F.max("loaded_at").alias("t"))
    bs = balance_facts(spark, d).filter("field_name = 'accountsReceivable'").join(files, "file_id").groupBy("deal_id").agg(F.max_by("value", F.struct("period_key", "t", "file_id")).alias("bs"))
    gap = relative_difference(F.col("ar"), F.col("bs"))
    severity = F.when(F.col("ar").isNull() | F.col("bs").isNull(), "missing").when(gap > 0.5, "hard").when(gap > 0.15, "warning").otherwise("ok")
    return ar.join(bs, "deal_id", "full").select("deal_id", severity.alias("severity"))


@query(_ROWS_SQL + """
, l AS (SELECT r.sheet, row_no, cells[1] AS label, row_number() OVER (PARTITION BY r.sheet ORDER BY row_no) AS n FROM r JOIN h USING (sheet) WHERE row_no > header_row AND cells[1] IS NOT NULL)
SELECT sheet, string_agg(label, '|' ORDER BY n) AS labels FROM l WHERE n <= 8 GROUP BY sheet""")
def metric_labels(spark, d):
    """The first eight labels below each header, as a hint of what the sheet holds."""
    rows = _balance_rows(spark, d)
    below = rows.join(sheets.header_rows(rows).select("sheet", "header_row"), "sheet").filter((F.col("row_no") > F.col("header_row")) & F.get("cells", F.lit(0)).isNotNull())
    first = top_k(below.select("sheet", "row_no", F.get("cells", F.lit(0)).alias("label")), ["sheet"], [F.asc("row_no")], 8)
    return first.groupBy("sheet").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]), "|").alias("labels"))


@query()
def section_records(spark, d):
    """Rows of every section of the balance sheet files, numbered from their own header; sections have no SQL."""
    rows = _balance_rows(spark, d)
    return sheets.section_rows(rows, sheets.sections(rows, sheets.header_rows(rows))).select("sheet", "row_no", F.size("cells").alias("n_cells"))
