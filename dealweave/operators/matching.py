"""Labels matched to the fields of a schema by aliases: scored candidates, the best of each field, ambiguity, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import half_up
from ..functions.text import has_phrase, label_words, normalize_label, strip_noise
from ..session import bounded_broadcast

MAX_ALIASES = 100_000


def analyzed(df: DataFrame, label: str) -> DataFrame:
    """Adds ``norm``, ``core`` and ``words`` of a label: normalised, without noise, and its words that carry meaning."""
    df = df.withColumn("norm", normalize_label(F.col(label)))
    df = df.withColumn("core", strip_noise(F.col("norm")))
    return df.withColumn("words", label_words(F.when(F.col("core") != "", F.col("core")).otherwise(F.col("norm"))))


def alias_table(aliases: DataFrame) -> DataFrame:
    """``doc_type, field_name, alias, ordinal`` with what matching needs of each alias; repeated aliases of a field once."""
    a = aliases.groupBy("doc_type", "field_name", "alias").agg(F.min("ordinal").alias("ordinal"))
    a = analyzed(a, "alias").withColumnsRenamed({"norm": "a_norm", "core": "a_core", "words": "a_words"})
    return a.filter("a_norm != ''")


def _score() -> Column:
    """Score of an alias for a label: exact 1, phrase .9, else by the share of the alias's words that the label has."""
    exact = F.col("a_norm").isin(F.col("norm"), F.col("core")) | ((F.col("a_core") != "") & F.col("a_core").isin(F.col("norm"), F.col("core")))
    phrase = has_phrase(F.col("norm"), F.col("a_norm")) | has_phrase(F.col("core"), F.col("a_norm")) | has_phrase(F.col("norm"), F.col("a_core")) | has_phrase(F.col("core"), F.col("a_core"))
    n = F.size("a_words")
    shared = F.size(F.filter("a_words", lambda w: F.array_contains("words", w)))
    cover = shared / n
    extra = F.least(F.greatest(F.size("words") - n, F.lit(0)) * 0.03, F.lit(0.12))
    base = F.when(shared == n, 0.82).otherwise(0.68 + (cover - 0.67) * 0.35)
    partial = half_up(F.greatest(F.lit(0.55), F.least(base - extra, F.lit(0.89))))
    return F.when(exact, 1.0).when(n == 0, None).when(phrase, 0.9).when((n > 1) & (shared >= 2) & (cover >= 0.67), partial)


def _tokens(*texts: str) -> Column:
    """All words of some texts, once each; a text without any is none."""
    return F.filter(F.array_distinct(F.flatten(F.array(*(F.split(t, " ") for t in texts)))), lambda w: w != "")


def match_labels(labels: DataFrame, aliases: DataFrame, *, label: str = "label") -> DataFrame:
    """``doc_type, <label>, field_name, alias, score, match_rank``: candidates of every label, best first.

    ``labels`` has one row per distinct (doc_type, label). Each field counts with its best alias; equal scores rank by the
    longer alias, then by the registry's order. A score needs a word in common, so both sides are joined on their words: a
    label only meets aliases that share one with it, however many its type has. The registry is broadcast behind a check of
    its size.
    """
    listed = alias_table(aliases).withColumn("token", F.explode(_tokens("a_norm", "a_core")))
    asked = analyzed(labels, label).filter("norm != ''").withColumn("token", F.explode(_tokens("norm", "core")))
    met = asked.join(bounded_broadcast(listed, MAX_ALIASES), ["doc_type", "token"])
    met = met.withColumn("score", _score())
    best = met.groupBy("doc_type", label, "field_name").agg(F.expr("max_by(struct(a_norm, score, ordinal), struct(score, -ordinal)) filter (where score is not null)").alias("b")).filter("b is not null")
    best = best.select("doc_type", label, "field_name", F.col("b.a_norm").alias("alias"), F.col("b.score").alias("score"), F.col("b.ordinal").alias("ordinal"))
    w = Window.partitionBy("doc_type", label).orderBy(F.desc("score"), F.desc(F.length("alias")), "ordinal")
    return best.select("doc_type", label, "field_name", "alias", "score", F.row_number().over(w).alias("match_rank"))


def ambiguous_labels(matches: DataFrame, *, label: str = "label", gap: float = 0.08, listed: int = 4) -> DataFrame:
    """``doc_type, <label>, n_close, fields``: labels with two or more candidates within ``gap`` of the best."""
    w = Window.partitionBy("doc_type", label)
    close = matches.withColumn("top", F.max("score").over(w)).filter(F.col("score") >= F.col("top") - gap - 1e-9)
    named = F.array_sort(F.collect_list(F.struct("match_rank", "field_name")))
    return close.groupBy("doc_type", label).agg(F.count("*").alias("n_close"), F.array_join(F.slice(F.transform(named, lambda x: x["field_name"]), 1, listed), ",").alias("fields")).filter("n_close >= 2")


def learned_aliases(base: DataFrame, learned: DataFrame) -> DataFrame:
    """The registry with learned aliases appended that it does not have yet, after its own in order."""
    known = base.select("doc_type", "field_name", normalize_label(F.col("alias")).alias("k")).distinct()
    new = learned.withColumn("k", normalize_label(F.col("alias"))).filter("k != ''").join(known, ["doc_type", "field_name", "k"], "left_anti")
    new = new.groupBy("doc_type", "field_name", "k").agg(F.min("alias").alias("alias"))
    return base.select("doc_type", "field_name", "alias", "ordinal").unionByName(new.select("doc_type", "field_name", "alias", (F.lit(1_000_000) + F.abs(F.xxhash64("k")) % 1_000_000).cast("int").alias("ordinal")))


def coverage(schema: DataFrame, found: DataFrame, *, keys: list[str]) -> DataFrame:
    """``<keys>, n_fields, n_found, n_required, n_required_found, missing, pct`` of documents against their schema.

    ``schema``: doc_type, field_name, required, ordinal. ``found``: keys, doc_type and field_name, one row per value.
    """
    docs = found.select(*keys, "doc_type").distinct()
    have = found.select(*keys, "doc_type", "field_name").distinct().withColumn("have", F.lit(1))
    wanted = docs.join(bounded_broadcast(schema, MAX_ALIASES), "doc_type").join(have, [*keys, "doc_type", "field_name"], "left")
    missing = F.array_sort(F.collect_list(F.when(F.col("have").isNull() & F.col("required"), F.struct("ordinal", "field_name"))))
    return wanted.groupBy(*keys, "doc_type").agg(
        F.count("*").alias("n_fields"), F.count("have").alias("n_found"), F.count_if("required").alias("n_required"), F.count_if(F.col("required") & F.col("have").isNotNull()).alias("n_required_found"),
        F.array_join(F.transform(missing, lambda x: x["field_name"]), ",").alias("missing"), half_up(F.count("have") / F.count("*")).alias("pct"),
    )


def mapping_confidence(required_found: Column, required: Column, direct: Column, found: Column, total: Column, derived: Column) -> Column:
    """How far a mapping can be trusted: required fields, direct hits and overall coverage, less for derived fields."""
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    raw = 0.55 * share(required_found, required) + 0.35 * F.least(share(direct, total), F.lit(1.0)) + 0.1 * share(found, total) - F.least(0.03 * derived, F.lit(0.15))
    return half_up(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)))
