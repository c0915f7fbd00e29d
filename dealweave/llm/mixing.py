"""Mixing sources to target shares of all tokens, by pivotal dependent rounding over a reduction tree."""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import bounded_broadcast, bounded_collect, checkpointed

#: Documents that one task rounds against each other; also the fan-in of the reduction tree.
FAN_IN = 4096
MAX_SOURCES = 100_000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How a byte-level BPE of this kind splits text before merging.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@dataclass(frozen=True)
class SourceTarget:
    """What a source should contribute, and how often one of its documents may be used."""

    source: str
    share: float
    max_repeats: int


def copy_rates(targets: list[SourceTarget], tokens: dict[str, int], total: float | None = None) -> dict[str, float]:
    """Copies per document that every source needs.

    ``total`` is the size of the mixture in tokens; by default the greatest at which every source that has any tokens
    reaches its share within its repeats. Sources without tokens stay empty. With a greater ``total``, sources that are too
    small are used ``max_repeats`` times and the others share out what is missing in proportion to their shares.
    """
    live = [t for t in targets if tokens.get(t.source) and t.share > 0 and t.max_repeats > 0]
    if not live:
        return {}
    cap = {t.source: tokens[t.source] * t.max_repeats for t in live}
    if total is None:
        return {t.source: _snap(min(cap[x.source] / x.share for x in live) * t.share / tokens[t.source], t.max_repeats) for t in live}
    rates: dict[str, float] = {}
    left, open_ = float(total), list(live)
    while open_:
        unit = left / sum(t.share for t in open_)
        full = [t for t in open_ if unit * t.share >= cap[t.source]]
        if not full:
            return rates | {t.source: _snap(unit * t.share / tokens[t.source], t.max_repeats) for t in open_}
        for t in full:
            rates[t.source] = float(t.max_repeats)
            left -= cap[t.source]
        open_ = [t for t in open_ if t not in full]
    return rates


def _snap(rate: float, most: int) -> float:
    near = round(rate)
    return float(min(most, near if abs(rate - near) < 1e-9 else rate))


def _coin(*parts: int) -> float:
    """A number in [0, 1) that depends on the parts only."""
    x = 0x9E3779B97F4A7C15
    for p in parts:
        x = (x ^ (p & 0xFFFFFFFFFFFFFFFF)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        x = (x ^ x >> 27) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 31
    return (x >> 11) / 2.0**53


def pivot(units: list[int], sizes: list[int], probs: list[float], seed: int) -> list[float]:
    """Rounds copy probabilities to 0 or 1 so that the total size in expectation is kept exactly; at most one stays open.

    Two open units are paired and size is moved from one to the other, in a random direction that keeps both expectations,
    until one of them is 0 or 1; the other goes on. Units without size are rounded alone, as they move no total.
    """
    out = list(probs)
    held = -1
    for i, p in enumerate(out):
        if p <= 1e-12 or p >= 1 - 1e-12:
            out[i] = float(round(p))
            continue
        if sizes[i] <= 0:
            out[i] = 1.0 if _coin(seed, units[i]) < p else 0.0
            continue
        if held < 0:
            held = i
            continue
        a, b = held, i
        up = min((1 - out[a]) * sizes[a], out[b] * sizes[b])  # from b to a
        down = min((1 - out[b]) * sizes[b], out[a] * sizes[a])  # from a to b
        if _coin(seed, units[a], units[b]) * (up + down) < down:
            out[a] += up / sizes[a]
            out[b] -= up / sizes[b]
        else:
            out[a] -= down / sizes[a]
            out[b] += down / sizes[b]
        held = -1
        for k in (a, b):
            if out[k] <= 1e-9 or out[k] >= 1 - 1e-9:
                out[k] = float(round(out[k]))
            else:
                held = k
    return out


def count_tokens(df: DataFrame, *, id_col: str, source_col: str, text_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``__id, __source, __tokens, __unit`` of every row: tokens of its whole text under the vocabulary in ``tokenizer``, and a
    number that depends on the row's contents only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(n) for a, n in map(bytes.split, f)}
        encoding = tiktoken.Encoding("mix", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), b.column(3)], names=["__id", "__source", "__tokens", "__unit"])

    kind = df.schema[id_col].dataType.simpleString()
    unit = F.xxhash64(F.col(id_col), F.col(source_col), F.col(text_col)).alias("__unit")
    return df.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), F.col(text_col).alias("__text"), unit).mapInArrow(run, f"__id {kind}, __source string, __tokens bigint, __unit bigint")


def mix(df: DataFrame, targets: list[SourceTarget], *, id_col: str, source_col: str, text_col: str, total: float | None = None, seed: int = 7, tokenizer: str = TOKENIZER) -> DataFrame:
    """``<id_col>, source, n_tokens, copies``: the documents of the mixture, each with how often it is used (1 or more).

    Every document of a source has the same expected number of copies; the fractions are rounded by pivotal sampling, so
    the tokens of a source miss its target by less than one document. Results depend on the rows and
    ``seed`` only, not on the files they come in.

    Defined results: rows with a null source or one without a target stay out; null and empty texts have no tokens and
    are rounded alone; a source without tokens contributes nothing; repeated rows are documents of their own; an empty
    table or list gives an empty mixture; other columns are ignored, whatever their names.

    Plan: one pass counts tokens, and only (id, source, tokens) goes on, to a shared checkpoint. Sources are split into
    buckets of about ``FAN_IN`` documents, so a source with a third of all rows is many tasks; each bucket leaves at most
    one open document, and these are rounded on in a tree of the same fan-in, three levels for 10^10 documents. The
    driver only sees one row of totals per source.
    """
    spark = df.sparkSession
    named = spark.createDataFrame([(t.source,) for t in targets], "__named string").distinct()
    rows = df.join(bounded_broadcast(named, MAX_SOURCES), F.col(source_col) == F.col("__named"), "left_semi")
    sized = checkpointed(count_tokens(rows, id_col=id_col, source_col=source_col, text_col=text_col, tokenizer=tokenizer))
    totals = bounded_collect(sized.groupBy("__source").agg(F.sum("__tokens").alias("tokens"), F.count("*").alias("docs")), MAX_SOURCES, "sources of the corpus")
    rates = copy_rates(targets, {r["__source"]: r["tokens"] for r in totals}, total)
    docs = {r["__source"]: r["docs"] for r in totals}
    kind = df.schema[id_col].dataType.simpleString()
    plan = spark.createDataFrame([(s, float(math.floor(r)), r - math.floor(r), math.ceil(docs[s] / FAN_IN)) for s, r in rates.items()], "__source string, __whole double, __prob double, __buckets long")
    todo = sized.join(F.broadcast(plan), "__source").withColumn("__bucket", F.pmod(F.xxhash64("__unit", F.lit(seed)), F.col("__buckets")))
    schema = f"__id {kind}, __source string, __tokens bigint, __unit bigint, __whole double, __prob double, __bucket bigint"
    columns = [f.split(" ")[0] for f in schema.split(", ")]

    def rounded(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["__unit", "__tokens"], kind="stable")
        group["__prob"] = pivot(group["__unit"].tolist(), group["__tokens"].tolist(), group["__prob"].tolist(), seed)
        return group[columns]

    done, most = [], max((math.ceil(n / FAN_IN) for n in docs.values()), default=1)
    level = todo.select(*columns)
    while True:
        level = checkpointed(level.groupBy("__source", "__bucket").applyInPandas(rounded, schema))
        is_open = (F.col("__prob") > 0) & (F.col("__prob") < 1)
        done.append(level.filter(~is_open))
        last = level.filter(is_open)
        if most <= 1:
            break
        most = math.ceil(most / FAN_IN)
        level = last.withColumn("__bucket", F.floor(F.col("__bucket") / FAN_IN).cast("bigint")).select(*columns)
    # at most one open document per source is left: it is rounded alone
    flip = F.pmod(F.xxhash64("__unit", F.lit(seed), F.lit("last")), F.lit(1 << 30)) / float(1 << 30)
    done.append(last.withColumn("__prob", F.when(flip < F.col("__prob"), 1.0).otherwise(0.0)))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    copies = (F.col("__whole") + F.col("__prob")).cast("int")
    return out.select(F.col("__id").alias(id_col), F.col("__source").alias("source"), F.col("__tokens").alias("n_tokens"), copies.alias("copies")).filter("copies > 0")


def shares_reached(mixture: DataFrame, targets: list[SourceTarget]) -> DataFrame:
    """``source, target_share, max_repeats, n_docs, n_tokens, most_copies, actual_share`` for every target, empty ones too."""
    wanted = mixture.sparkSession.createDataFrame([(t.source, float(t.share), int(t.max_repeats)) for t in targets], "source string, target_share double, max_repeats int")
    got = mixture.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("n_tokens") * F.col("copies")).alias("n_tokens"), F.max("copies").alias("most_copies"))
    # a row per target: the whole is summed over this small table
    joined = wanted.join(got, "source", "left").withColumn("whole", F.sum("n_tokens").over(Window.partitionBy()))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select("source", "target_share", "max_repeats", zero("n_docs").alias("n_docs"), zero("n_tokens").alias("n_tokens"), zero("most_copies").alias("most_copies"), F.when(F.col("whole") > 0, zero("n_tokens") / F.col("whole")).otherwise(0.0).alias("actual_share"))
