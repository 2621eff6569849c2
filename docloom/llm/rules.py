"""Quality rules with adaptive thresholds from mergeable quantile sketches (operator 8).

Base rules judge a text by itself. The adaptive rules compare three ratios of a text with fences
that its own language and source set: each group's values are counted into fixed-resolution
histogram sketches without an upper end, of which only filled bins are rows (a sketch of a union is
the sum of sketches, so partial aggregation merges them), the 25 % and 75 % quantiles are read from the counts, and a text falls outside when it lies
beyond the quantile by three times their distance, or by the rule's least spread where the group
hardly varies. Groups of fewer than MIN_GROUP texts merge their sketches with their language's,
and languages that small with the whole corpus.

Defined results: null or empty text: no words, base_failed. Null lang or source: a group of their
own. Repeated rows each count and each get a verdict. Ties at a fence are kept. An empty table
gives an empty result. The added column is one struct whose name gives way to existing columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm import _words
from docloom.llm._shared import map_texts, unused, written

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
MIN_GROUP = 100
#: More groups than this are joined by shuffle instead of broadcast (about 100 bytes each).
BROADCAST_GROUPS = 50_000
#: Rule: (bins per unit as an SQL ratio, least spread in bins, two-sided).
RULES = {
    "symbols": ("(100 * n_symbols) div n_words", 15, False),
    "dup_lines": ("(100 * n_dup_lines) div n_lines", 30, False),
    "word_length": ("(10 * word_chars) div n_words", 40, True),
}

COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_lines bigint, n_dup_lines bigint, n_repeat_words bigint"
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


def count_texts(texts: pa.Array) -> pa.Array:
    """The base counts of each text."""
    out: list[list[np.ndarray]] = [[] for _ in range(6)]
    for chunk in _words.chunks(texts):
        chars, symbols = chunk.char_counts(), np.zeros(len(chunk.buf) + 1, np.int64)
        np.cumsum(_SYMBOL[chunk.buf], out=symbols[1:])
        at, window = chunk.windows(chunk.word_hashes(), WINDOW)
        repeated = _words.covered(at[_words.repeated_in_text(chunk, at, window)], WINDOW, len(chunk.start))
        raw, lines, dups = chunk.buf.tobytes(), np.zeros(chunk.n, np.int64), np.zeros(chunk.n, np.int64)
        for i, (a, b) in enumerate(zip(chunk.off[:-1].tolist(), chunk.off[1:].tolist())):
            full = [x for x in raw[a:b].split(b"\n") if x.strip()]
            lines[i], dups[i] = len(full), len(full) - len(set(full))
        for kept, values in zip(out, (chunk.counts, _words.grouped_sum(chars[chunk.end] - chars[chunk.start], chunk.word_off), symbols[chunk.off[1:]] - symbols[chunk.off[:-1]], lines, dups, _words.grouped_sum(repeated, chunk.word_off))):
            kept.append(np.asarray(values, np.int64))
    names = [x.split()[0] for x in COUNTS.split(", ")]
    return pa.StructArray.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in out], names)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def _counted(docs: DataFrame, text: str, name: str, carry: list[str]) -> DataFrame:
    """The columns carry of docs and a struct column with the base counts and base_failed."""
    counted = map_texts(docs, text, carry, lambda texts: pa.StructArray.from_arrays([count_texts(texts)], ["c"]), f"`{name}` struct<{COUNTS.replace(' bigint', ': bigint')}>")
    return counted.withColumn(name, F.col(name).withField("base_failed", base_failed(F.col(f"{name}.n_words"), F.col(f"{name}.n_repeat_words"))))


def sketches(counted: DataFrame, name: str, lang: str, source: str) -> DataFrame:
    """Counts by lang, source, rule and bin, of the texts that pass the base rules."""
    bins = F.expr("stack(3, " + ", ".join(f"'{rule}', {ratio}" for rule, (ratio, _, _) in RULES.items()) + ") as (rule, bin)")
    passed = counted.where(~F.col(f"{name}.base_failed")).select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{source}`").alias("source"), f"{name}.*")
    return passed.select("lang", "source", bins).groupBy("lang", "source", "rule", "bin").agg(F.count("*").alias("c"))


def fences(sketch: DataFrame) -> DataFrame:
    """A row per lang and source with the lower and upper fence of each rule, in bins."""
    groups = sketch.select("lang", "source").distinct()
    levels = []
    for level, keys in enumerate((["lang", "source"], ["lang"], [])):
        merged = sketch.groupBy(*keys, "rule", "bin").agg(F.sum("c").alias("c"))
        whole = Window.partitionBy(*keys, "rule")
        merged = merged.withColumn("total", F.sum("c").over(whole)).withColumn("below", F.sum("c").over(whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
        quantile = [F.min(F.when(100 * F.col("below") >= p * F.col("total"), F.col("bin"))).alias(f"q{p}") for p in (25, 75)]
        table = merged.groupBy(*keys, "rule").agg(F.max("total").alias("total"), *quantile)
        same = F.lit(True)
        for k in keys:
            same = same & F.col(f"g.{k}").eqNullSafe(F.col(f"t.{k}"))
        joined = groups.alias("g").join(table.alias("t"), same) if keys else groups.alias("g").crossJoin(F.broadcast(table.alias("t")))
        levels.append(joined.select("g.lang", "g.source", "t.rule", "t.total", "t.q25", "t.q75", F.lit(level).alias("level")))
    usable = levels[0].unionByName(levels[1]).unionByName(levels[2]).where((F.col("total") >= MIN_GROUP) | (F.col("level") == 2))
    first = usable.groupBy("lang", "source", "rule").agg(F.min_by(F.struct("q25", "q75"), "level").alias("q"))
    wide = [F.max(F.when(F.col("rule") == rule, F.col("q"))).alias(rule) for rule in RULES]
    per_group = first.groupBy("lang", "source").agg(*wide)
    columns = []
    for rule, (_, spread, both) in RULES.items():
        reach = F.greatest(3 * (F.col(f"{rule}.q75") - F.col(f"{rule}.q25")), F.lit(spread))
        columns.append((F.col(f"{rule}.q75") + reach).alias(f"{rule}_most"))
        if both:
            columns.append((F.col(f"{rule}.q25") - reach).alias(f"{rule}_least"))
    return per_group.select("lang", "source", *columns)


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", carry: list[str] | None = None) -> tuple[DataFrame, str]:
    """docs (or its columns carry, with lang and source) and the struct column of counts, base_failed and kept; and that column's name."""
    name = unused(docs, "rules")
    sketch = written(sketches(_counted(docs, text, name, [lang, source]), name, lang, source), "rules-sketch")
    table = written(fences(sketch), "rules-fences")
    if table.count() <= BROADCAST_GROUPS:
        table = F.broadcast(table)
    of_lang, of_source, fence = (unused(docs, x) for x in ("fence_lang", "fence_source", "fence"))
    limits = table.select(F.col("lang").alias(of_lang), F.col("source").alias(of_source), F.struct(*[c for c in table.columns if c.endswith(("_most", "_least"))]).alias(fence))
    inside = F.lit(True)
    for rule, (ratio, _, both) in RULES.items():
        value = F.expr(_on(ratio, name))
        inside = inside & (value <= F.col(f"{fence}.{rule}_most"))
        if both:
            inside = inside & (value >= F.col(f"{fence}.{rule}_least"))
    on = F.col(f"`{lang}`").eqNullSafe(F.col(of_lang)) & F.col(f"`{source}`").eqNullSafe(F.col(of_source))
    kept = ~F.col(f"{name}.base_failed") & F.coalesce(inside, F.lit(True))
    counted = _counted(docs, text, name, docs.columns if carry is None else carry)
    joined = counted.join(limits, on, "left").withColumn(name, F.col(name).withField("kept", kept))
    return joined.select(*[F.col(f"`{c}`") for c in counted.columns]), name


def _on(ratio: str, name: str) -> str:
    for field in ("n_symbols", "n_dup_lines", "word_chars", "n_words", "n_lines"):
        ratio = ratio.replace(field, f"`{name}`.{field}")
    return ratio


def keep_quality(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs."""
    out, name = judged(docs, text, lang, source)
    return out.where(F.col(f"{name}.kept")).drop(name)


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    out, name = judged(docs, carry=["doc_id", "lang", "source"])
    return out.select("doc_id", *[f"{name}.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def _counts_sql(table: str) -> str:
    return rf"""
  words AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM {table}),
  lines AS (SELECT doc_id, [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM words),
  starts AS (SELECT doc_id, unnest(range(1, len(w) - {WINDOW - 2})) AS i, w FROM words WHERE len(w) >= {WINDOW}),
  windows AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM starts),
  twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows),
  repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, {WINDOW}) AS r(k) WHERE c > 1 GROUP BY doc_id),
  counts AS (SELECT words.doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
      coalesce(n, 0) AS n_repeat_words FROM words JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)),
  base AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counts),
  bins AS (SELECT lang, source, unnest(['symbols', 'dup_lines', 'word_length']) AS rule,
      unnest([100 * n_symbols // n_words, 100 * n_dup_lines // n_lines, 10 * word_chars // n_words]) AS bin
      FROM base WHERE NOT base_failed),
  near AS (SELECT lang, source, rule, count(*) AS total, quantile_disc(bin, 0.25) AS q25, quantile_disc(bin, 0.75) AS q75 FROM bins GROUP BY ALL),
  wider AS (SELECT lang, rule, count(*) AS total, quantile_disc(bin, 0.25) AS q25, quantile_disc(bin, 0.75) AS q75 FROM bins GROUP BY ALL),
  widest AS (SELECT rule, quantile_disc(bin, 0.25) AS q25, quantile_disc(bin, 0.75) AS q75 FROM bins GROUP BY ALL),
  chosen AS (SELECT near.lang, near.source, rule,
      CASE WHEN near.total >= {MIN_GROUP} THEN near.q25 WHEN wider.total >= {MIN_GROUP} THEN wider.q25 ELSE widest.q25 END AS q25,
      CASE WHEN near.total >= {MIN_GROUP} THEN near.q75 WHEN wider.total >= {MIN_GROUP} THEN wider.q75 ELSE widest.q75 END AS q75
      FROM near JOIN wider USING (rule) JOIN widest USING (rule) WHERE near.lang IS NOT DISTINCT FROM wider.lang),
  fence AS (SELECT lang, source, rule, q75 + greatest(3 * (q75 - q25), CASE rule WHEN 'symbols' THEN 15 WHEN 'dup_lines' THEN 30 ELSE 40 END) AS most,
      q25 - greatest(3 * (q75 - q25), 40) AS least FROM chosen),
  verdict AS (SELECT doc_id, bool_and(CASE rule WHEN 'symbols' THEN 100 * n_symbols // n_words <= most WHEN 'dup_lines' THEN 100 * n_dup_lines // n_lines <= most
      ELSE 10 * word_chars // n_words BETWEEN least AND most END) AS ok
      FROM base JOIN fence ON base.lang IS NOT DISTINCT FROM fence.lang AND base.source IS NOT DISTINCT FROM fence.source WHERE NOT base_failed GROUP BY doc_id)"""


def op8_sql(table: str = "documents") -> str:
    return f"""WITH {_counts_sql(table)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(ok, true) AS kept
FROM base LEFT JOIN verdict USING (doc_id)"""
