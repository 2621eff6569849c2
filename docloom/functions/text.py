"""Column functions on text: stripping, word sets, overlap, sentences, base names."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: What ends a sentence, what is a word, and what begins a caption; (?U): white space and digits of all scripts.
SENTENCE_END = r"(?U)(?<=[.!?])\s+(?=[A-Z0-9])"
WORD = "[a-z0-9]+"
CAPTION = r"^(table|figure|fig\.)\s*\d+"
_CAPTION = re.compile(CAPTION, re.IGNORECASE)
#: Unicode white space at either end.
_ENDS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _ENDS, "")


def strip_each(texts: Column) -> Column:
    """An array's texts stripped; those that begin and end with printable ASCII have nothing to strip, and no pattern is tried on them."""
    bare = lambda c: F.ascii(c).between(33, 126)
    return F.transform(texts, lambda x: F.when(bare(x) & bare(F.substring(x, -1, 1)), x).otherwise(strip(x)))


def word_set(text: Column) -> Column:
    """Distinct ASCII words of the lower-cased text; null gives none."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)))


def overlap_score(sentence: Column, passage: Column) -> Column:
    """Share of the sentence's words that the passage has; 0 without words."""
    words = word_set(sentence)
    return F.when(F.size(words) == 0, 0.0).otherwise(F.size(F.array_intersect(words, word_set(passage))) / F.size(words))


def split_sentences(text: Column) -> Column:
    """Sentences end at white space after . ! or ? and before a capital or a digit."""
    parts = F.split(strip(F.coalesce(text, F.lit(""))), SENTENCE_END)
    return F.filter(parts, lambda s: s != "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_caption(text: Column) -> Column:
    return strip(text).rlike("(?iU)" + CAPTION)


def caption_like(text: str) -> bool:
    return bool(_CAPTION.match(text.strip()))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null if either is null, empty or all zero."""
    wide = lambda v: v.cast("array<double>")
    dot = lambda x, y: F.aggregate(F.zip_with(wide(x), wide(y), lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def register(spark: SparkSession) -> None:
    """SQL functions word_set, overlap_score, split_sentences, cosine_similarity and detect_type, and the table function html_blocks."""
    from pyspark.sql.functions import udf, udtf

    from docloom.operators.detection import sniff
    from docloom.sources.html import blocks_of

    made = "CREATE OR REPLACE TEMPORARY FUNCTION"
    spark.sql(f"{made} word_set(t STRING) RETURNS ARRAY<STRING> RETURN array_distinct(regexp_extract_all(lower(coalesce(t, '')), '{WORD}', 0))")
    spark.sql(f"{made} overlap_score(s STRING, p STRING) RETURNS DOUBLE RETURN CASE WHEN size(word_set(s)) = 0 THEN 0.0D ELSE size(array_intersect(word_set(s), word_set(p))) / size(word_set(s)) END")
    spark.sql(f"{made} split_sentences(t STRING) RETURNS ARRAY<STRING> RETURN filter(split(regexp_replace(coalesce(t, ''), r'{_ENDS}', ''), r'{SENTENCE_END}'), x -> x <> '')")
    dot = "aggregate(zip_with({}, {}, (x, y) -> x * y), 0.0D, (s, x) -> s + x)"
    spark.sql(f"{made} cosine_similarity(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {dot.format('a', 'b')} / nullif(sqrt({dot.format('a', 'a')}) * sqrt({dot.format('b', 'b')}), 0.0D)")
    spark.udf.register("detect_type", udf(lambda content: sniff(bytes(content or b""))[0], "string"))

    class HtmlBlocks:
        def eval(self, html: str):
            for i, (kind, text, path, caption) in enumerate(blocks_of(html or "")):
                yield i, kind, text, path, caption

    spark.udtf.register("html_blocks", udtf(HtmlBlocks, returnType="place int, block_type string, text string, section_path array<string>, caption string"))
