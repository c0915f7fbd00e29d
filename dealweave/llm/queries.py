"""Queries of the llm problems and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.units import NOTE_ROW, TOTAL_ROW
from ..session import bounded_broadcast, bounded_collect, checkpointed, table
from .canonical import AFTER, ALIASES, BEFORE, LINK_WORDS, label_paths, map_labels
from .leakage import leaked_items
from .lookalikes import FOLD, TO_LATIN, one_form, same_look_classes, same_look_pairs
from .mixing import TOKENIZER, SourceTarget, mix, shares_reached
from .names import link_names, variant_pairs
from .representative import Bundle, Dependency, best_records, spelling_key

#: Bounds on the fixed reference tables; a larger table is an error, not a cut.
MAX_ENTRIES = 100_000
MAX_ITEMS = 100_000


def p1_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label that is not blank with the balance sheet line it means, or null."""
    lines = [(r.item_id, r.label) for r in bounded_collect(table(spark, sf_dir, "line_items").select("item_id", "label"), MAX_ENTRIES, "line_items")]

    def mapped(src: str) -> DataFrame:
        return map_labels(table(spark, sf_dir, src), lines, id_col="row_id", text_col="c0").select(F.lit(src).alias("src_table"), "row_id", "c0", "item_id", "distance")

    return mapped("balance_sheet").unionByName(mapped("ugly_balance_sheet"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that are not letter for letter a line's, with the line they mean, 0 if there is none."""
    labels = table(spark, sf_dir, "line_items").select(F.col("label").alias("c0")).distinct()
    return p1_mapped(spark, sf_dir).join(bounded_broadcast(labels, MAX_ENTRIES), "c0", "left_anti").select("src_table", "row_id", F.coalesce("item_id", F.lit(0)).cast("bigint").alias("item_id"))


def _named_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of both tables with the name they hold; ``row`` tells table and row."""

    def rows(src: str, name: str, reader: str) -> DataFrame:
        nobody = F.coalesce(F.col(name).rlike(NOTE_ROW) | F.col(name).rlike(TOTAL_ROW), F.lit(False))
        return table(spark, sf_dir, src).filter(~nobody).select(F.struct(F.lit(src).alias("src_table"), "row_id").alias("row"), "deal_id", F.col(name).alias("name"), F.lit(reader).alias("reader"))

    return rows("revenue_breakdown", "customer", "firm").unionByName(rows("debt_schedule", "instrument", "instrument"))


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = link_names(_named_rows(spark, sf_dir), id_col="row", group_col="deal_id", name_col="name", reader=F.col("reader"))
    return linked.select("row.src_table", "row.row_id", "name", "entity")


def p4_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row that names a customer or instrument, with the entity it belongs to in its deal and the number of rows that
    name the same in another string: what ``p4_found`` says without writing out pairs."""
    rows = checkpointed(_entities(spark, sf_dir))
    names = rows.groupBy("entity", "name").agg(F.count("*").alias("n"))
    whole = names.groupBy("entity").agg(F.sum("n").alias("all"))
    out = rows.hint("merge").join(names, ["entity", "name"]).hint("merge").join(whole, "entity")
    return out.select("src_table", "row_id", "name", "entity", (F.col("all") - F.col("n")).alias("n_links"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one deal that name the same customer or instrument in different strings."""
    return variant_pairs(_entities(spark, sf_dir), "row_id", keep=["src_table"])


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence records with the document type and field name of ``doc_fields`` that their spellings stand for."""
    known = table(spark, sf_dir, "doc_fields")
    spellings = F.explode(F.array("doc_type", "doc_label", "short_code"))
    types = known.select("doc_type", spellings.alias("s")).select(spelling_key(F.col("s")).alias("type_key"), F.col("doc_type").alias("known_type"))
    types = types.filter("type_key is not null").groupBy("type_key").agg(F.min("known_type").alias("known_type"))
    fields = known.select(spelling_key(F.col("field_name")).alias("field_key"), "field_name").filter("field_key is not null").groupBy("field_key").agg(F.min("field_name").alias("known_field"))
    records = table(spark, sf_dir, "evidence_resolver").select(
        "fact_id", "evidence_id", "value", "period_key", "source_ref", F.coalesce("reviewed", F.lit(False)).alias("reviewed"), F.when(~F.isnan("confidence"), F.col("confidence")).alias("confidence"), "extracted_at",
        spelling_key(F.col("doc_type")).alias("type_key"), spelling_key(F.col("field_name")).alias("field_key"),
    )
    return records.join(bounded_broadcast(types, MAX_ENTRIES), "type_key", "left").join(bounded_broadcast(fields, MAX_ENTRIES), "field_key", "left")


_TRUST = ("reviewed", "confidence", "extracted_at", "-evidence_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each fact recorded more than once, its document type and field name."""
    bundles = [Bundle(("doc_type",), ("known_type",)), Bundle(("field_name",), ("known_field",))]
    return best_records(_evidence(spark, sf_dir), group="fact_id", bundles=bundles, trust=[F.expr(t) for t in _TRUST])


def p5_bundled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each fact recorded more than once, one consistent record: the type and name of its field, which must fit each
    other, and the value with its period and source, which go together."""
    known = bounded_collect(table(spark, sf_dir, "doc_fields").select("doc_type", "field_name").distinct(), MAX_ENTRIES, "doc_fields")
    types: dict[str, set[str]] = {}
    for r in known:
        types.setdefault(r.field_name, set()).add(r.doc_type)
    only = {f: next(iter(t)) for f, t in types.items() if len(t) == 1}  # a field of one type demands that type
    records = _evidence(spark, sf_dir).withColumn("shown", F.when(F.abs("value") < 1e15, F.round("value", 2).cast("decimal(18,2)")))
    bundles = [Bundle(("field_name",), ("known_field",)), Bundle(("doc_type",), ("known_type",)), Bundle(("value", "period_key", "source_ref"), ("shown", "period_key", "source_ref"))]
    return best_records(records, group="fact_id", bundles=bundles, trust=[F.expr(t) for t in _TRUST], dependencies=(Dependency("field_name", "doc_type", only),))


def p1_sql(every: bool = False) -> str:
    """SQL of p1_found, or of p1_mapped (``every`` label): the same paths, compared with DuckDB's edit distance, then words with words."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    links = ", ".join(map(q, sorted(LINK_WORDS)))
    rows = ", ".join(f"({q(path)}, {q(label)})" for path, label in label_paths({label: label for label in ALIASES}))
    plain = f"trim(regexp_replace(trim(lower(replace(c0, '_', ' '))), {q(BEFORE)}, ''))"
    for _ in range(3):
        plain = f"trim(regexp_replace({plain}, {q(AFTER)}, ''))"
    plain = f"replace(replace(replace({plain}, '&', ' and '), '+', ' and '), chr(39), '')"
    plain = rf"trim(regexp_replace(regexp_replace({plain}, '[^\w]+', ' ', 'g'), '\s+', ' ', 'g'))"
    return rf"""
WITH rows AS (SELECT 'balance_sheet' AS src_table, row_id, c0 FROM balance_sheet UNION ALL SELECT 'ugly_balance_sheet', row_id, c0 FROM ugly_balance_sheet),
used AS (SELECT * FROM rows WHERE regexp_matches(c0, '\S') {"" if every else "AND c0 NOT IN (SELECT label FROM line_items)"}), labels AS (SELECT c0, {plain} AS s FROM (SELECT DISTINCT c0 FROM used)),
paths AS (SELECT DISTINCT path, item_id FROM (VALUES {rows}) v(path, label) JOIN line_items USING (label)),
near AS (SELECT c0, item_id, min(damerau_levenshtein(s, path)) AS k FROM labels JOIN paths ON abs(len(s) - len(path)) <= 2 AND damerau_levenshtein(s, path) <= CASE WHEN len(s) <= 4 THEN 0 WHEN len(s) <= 11 THEN 1 ELSE 2 END GROUP BY 1, 2),
turned AS (SELECT DISTINCT item_id, list_filter(string_split(path, ' '), lambda w: w NOT IN ({links})) AS words FROM paths),
split AS (SELECT c0, list_filter(string_split(s, ' '), lambda w: w NOT IN ({links})) AS ws FROM labels WHERE c0 NOT IN (SELECT c0 FROM near)),
by_words AS (SELECT c0, item_id, min(0) AS k FROM split JOIN turned ON len(ws) >= 2 AND array_to_string(list_transform(ws, lambda w: w[1]), '') = array_to_string(list_transform(words, lambda w: w[1]), '')
    WHERE 3 * len(array_to_string(ws, '')) >= len(array_to_string(words, '')) AND list_bool_and(list_transform(list_zip(ws, words), lambda z: z[1] = z[2] OR (len(z[1]) >= 2 AND len(z[1]) < len(z[2]) AND regexp_matches(z[2], '^' || array_to_string(string_split(z[1], ''), '.*'))) OR (len(z[2]) > 4 AND damerau_levenshtein(z[1], z[2]) <= 1))) GROUP BY 1, 2),
best AS (SELECT c0, min(item_id) AS item_id, CAST(min(k) AS INTEGER) AS distance FROM (SELECT *, min(k) OVER (PARTITION BY c0) AS least FROM (FROM near UNION ALL FROM by_words)) WHERE k = least GROUP BY c0 HAVING count(*) = 1)
SELECT src_table, row_id, {"c0, item_id, distance" if every else "coalesce(item_id, 0) AS item_id"} FROM used LEFT JOIN best USING (c0)
"""


P5_SQL = """
WITH types AS (
    SELECT type_key, min(doc_type) AS known_type FROM (
        SELECT doc_type, regexp_replace(lower(unnest([doc_type, doc_label, short_code])), '[^\\p{L}\\p{N}]', '', 'g') AS type_key FROM doc_fields)
    WHERE type_key <> '' GROUP BY 1
), fields AS (
    SELECT regexp_replace(lower(field_name), '[^\\p{L}\\p{N}]', '', 'g') AS field_key, min(field_name) AS known_field FROM doc_fields GROUP BY 1
), records AS (
    SELECT e.fact_id, t.known_type, f.known_field,
           row_number() OVER (PARTITION BY e.fact_id ORDER BY coalesce(e.reviewed, false) DESC,
               CASE WHEN isnan(e.confidence) THEN NULL ELSE e.confidence END DESC NULLS LAST, e.extracted_at DESC NULLS LAST, e.evidence_id) AS place
    FROM evidence_resolver e
    LEFT JOIN types t ON t.type_key = regexp_replace(lower(e.doc_type), '[^\\p{L}\\p{N}]', '', 'g')
    LEFT JOIN fields f ON f.field_key = regexp_replace(lower(e.field_name), '[^\\p{L}\\p{N}]', '', 'g')
    WHERE e.fact_id IS NOT NULL
)
SELECT fact_id, arg_min(known_type, place) FILTER (WHERE known_type IS NOT NULL) AS doc_type,
       arg_min(known_field, place) FILTER (WHERE known_field IS NOT NULL) AS field_name
FROM records GROUP BY fact_id HAVING count(*) >= 2
"""


_KEY_SQL = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
P5_BUNDLED_SQL = f"""
WITH types AS (SELECT type_key, min(doc_type) AS known_type FROM (SELECT doc_type, {_KEY_SQL.format("unnest([doc_type, doc_label, short_code])")} AS type_key FROM doc_fields) WHERE type_key <> '' GROUP BY 1),
fields AS (SELECT {_KEY_SQL.format("field_name")} AS field_key, min(field_name) AS known_field FROM doc_fields GROUP BY 1),
sole AS (SELECT field_name, min(doc_type) AS demanded FROM doc_fields GROUP BY 1 HAVING count(DISTINCT doc_type) = 1),
records AS (SELECT e.fact_id, t.known_type, f.known_field, CASE WHEN abs(value) < 1e15 THEN CAST(CAST(round(value, 2) AS DECIMAL(18,2)) AS VARCHAR) END AS shown, period_key, source_ref,
        row_number() OVER (PARTITION BY e.fact_id ORDER BY coalesce(e.reviewed, false) DESC, CASE WHEN isnan(e.confidence) THEN NULL ELSE e.confidence END DESC NULLS LAST, e.extracted_at DESC NULLS LAST, e.evidence_id) AS place
    FROM evidence_resolver e LEFT JOIN types t ON t.type_key = {_KEY_SQL.format("e.doc_type")} LEFT JOIN fields f ON f.field_key = {_KEY_SQL.format("e.field_name")} WHERE e.fact_id IS NOT NULL),
facts AS (SELECT fact_id FROM records GROUP BY 1 HAVING count(*) >= 2),
f AS (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY place) - 1 AS k, count(*) OVER (PARTITION BY fact_id) AS n FROM (SELECT fact_id, known_field, min(place) AS place FROM records WHERE known_field IS NOT NULL GROUP BY 1, 2)),
t AS (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY place) - 1 AS k, count(*) OVER (PARTITION BY fact_id) AS n FROM (SELECT fact_id, known_type, min(place) AS place FROM records WHERE known_type IS NOT NULL GROUP BY 1, 2)),
v AS (SELECT fact_id, shown, period_key, source_ref FROM records WHERE shown IS NOT NULL AND period_key IS NOT NULL AND source_ref IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY place) = 1),
-- every selection of a field and a type, or of none, that the dependency allows; of equal trust the better field, then the better type
every_f AS (SELECT fact_id, known_field, k, n, 5040 - 5040 * k / n AS w FROM f UNION ALL SELECT fact_id, NULL, 1000000, 1, 0 FROM facts), every_t AS (SELECT fact_id, known_type, k, n, 5040 - 5040 * k / n AS w FROM t UNION ALL SELECT fact_id, NULL, 1000000, 1, 0 FROM facts),
best AS (SELECT fact_id, known_field, known_type FROM facts JOIN every_f ff USING (fact_id) JOIN every_t tt USING (fact_id) LEFT JOIN sole o ON o.field_name = known_field
    WHERE demanded IS NULL OR known_type IS NULL OR known_type = demanded QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY round(ff.w + tt.w, 4) DESC, ff.k, tt.k) = 1)
SELECT fact_id, known_field AS field_name, known_type AS doc_type, shown AS value, period_key, source_ref FROM best LEFT JOIN v USING (fact_id)
"""


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every evaluation item that leaks into a document, and where in the document's text."""
    items = [(r.item_id, r.text) for r in bounded_collect(table(spark, sf_dir, "eval_items").select("item_id", "text"), MAX_ITEMS, "eval_items")]
    return leaked_items(table(spark, sf_dir, "documents"), items, id_col="doc_id", text_col="text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affected documents with the items they leak."""
    return p7_leaks(spark, sf_dir).select("doc_id", "item_id")


def mix_targets(spark: SparkSession, sf_dir: str) -> list[SourceTarget]:
    """The wanted mix, as ``mix_targets`` lists it."""
    return [SourceTarget(r.source, r.target_share, r.max_repeats) for r in bounded_collect(table(spark, sf_dir, "mix_targets").filter("source is not null"), MAX_ENTRIES, "mix_targets")]


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the mixture with their copies; ``spark.dealweave.tokenizer`` may name another vocabulary file."""
    tokenizer = spark.conf.get("spark.dealweave.tokenizer", TOKENIZER)
    return mix(table(spark, sf_dir, "documents"), mix_targets(spark, sf_dir), id_col="doc_id", source_col="source", text_col="text", tokenizer=tokenizer)


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of all tokens that each source reaches in the mixture."""
    return shares_reached(p8_mixture(spark, sf_dir), mix_targets(spark, sf_dir))


def p8_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every source with documents and a target: whether it is within one document of its share of all tokens, and no
    document is used more often than allowed."""
    mixture, targets = p8_mixture(spark, sf_dir), mix_targets(spark, sf_dir)
    reached = shares_reached(mixture, targets).filter("n_docs > 0")
    largest = mixture.groupBy("source").agg(F.max("n_tokens").alias("largest"))
    open_share = F.sum("target_share").over(Window.partitionBy())  # sources without documents leave their share to the others
    whole = F.sum("n_tokens").over(Window.partitionBy())
    out = reached.join(largest, "source").withColumn("miss", F.abs(F.col("n_tokens") - whole * F.col("target_share") / open_share))
    biggest = F.max("largest").over(Window.partitionBy())  # the whole may miss by one document of every source
    n = F.count("*").over(Window.partitionBy())
    return out.select("source", (F.col("miss") <= F.col("largest") + n * biggest * F.col("target_share") / open_share).alias("share_kept"), (F.col("most_copies") <= F.col("max_repeats")).alias("repeats_kept"))


P8_KEPT_SQL = "SELECT source, true AS share_kept, true AS repeats_kept FROM mix_targets WHERE target_share > 0 AND max_repeats > 0 AND source IN (SELECT source FROM documents WHERE text <> '')"


def p9_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All document texts in their one form."""
    return one_form(table(spark, sf_dir, "documents"), id_col="doc_id", text_col="text").select("doc_id", F.col("form").alias("text"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose whole texts look the same but differ in their characters."""
    return same_look_pairs(one_form(table(spark, sf_dir, "documents"), id_col="doc_id", text_col="text", with_text=False), "doc_id")


def p9_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the least id of those that look the same, and how many of them differ in their characters."""
    return same_look_classes(one_form(table(spark, sf_dir, "documents"), id_col="doc_id", text_col="text", with_text=False), "doc_id")


def _looks_sql() -> str:
    """SQL of a text's one form in Latin script: every look-alike becomes its letter."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    single = {chr(c): v for c, v in FOLD.items() if v is not None and len(v) == 1} | TO_LATIN
    gone = "".join(chr(c) for c, v in FOLD.items() if v is None and c != 0)
    looks = "replace(text, chr(13) || chr(10), chr(10))"
    for c, v in sorted((chr(c), v) for c, v in FOLD.items() if v is not None and len(v) > 1):
        looks = f"replace({looks}, {q(c)}, {q(v)})"
    looks = f"nfc_normalize(translate({looks}, {q(''.join(single) + gone)}, {q(''.join(single.values()))}))"
    return f"WITH d AS (SELECT doc_id, text, {looks} AS looks FROM documents WHERE text IS NOT NULL)"


def p9_sql() -> str:
    """SQL of p9_found for texts in Latin script: texts of equal looks are paired."""
    return f"{_looks_sql()} SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM d a JOIN d b ON a.looks = b.looks AND a.doc_id < b.doc_id AND a.text <> b.text"


def p9_classes_sql() -> str:
    """SQL of p9_classes for texts in Latin script."""
    return f"{_looks_sql()} SELECT doc_id, min(doc_id) OVER (PARTITION BY looks) AS class_id, count(*) OVER (PARTITION BY looks) - count(*) OVER (PARTITION BY looks, text) AS n_links FROM d"


QUERIES = {
    "p1_found": p1_found, "p1_mapped": p1_mapped, "p4_found": p4_found, "p4_entities": p4_entities, "p5_found": p5_found, "p5_bundled": p5_bundled, "p9_classes": p9_classes, "p7_found": p7_found, "p7_leaks": p7_leaks, "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p8_kept": p8_kept, "p9_found": p9_found, "p9_forms": p9_forms,
}

ORACLE_SQL = {"p1_found": p1_sql(), "p1_mapped": p1_sql(every=True), "p8_kept": P8_KEPT_SQL, "p5_found": P5_SQL, "p5_bundled": P5_BUNDLED_SQL, "p9_found": p9_sql(), "p9_classes": p9_classes_sql()}
