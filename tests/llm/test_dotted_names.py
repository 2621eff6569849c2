"""Keys and texts whose column names have dots."""

from docloom.llm import packing, substring

PASSAGE = " ".join(f"w{i}" for i in range(40))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_dotted_names_give_the_same_rows(spark):
    plain = spark.createDataFrame([(1, f"a {PASSAGE}"), (2, f"{PASSAGE} b"), (3, None), (4, "")], "doc_id long, text string")
    dotted = plain.toDF("doc.id", "the.text")
    found = substring.without_repeats(dotted, "the.text", "doc.id")
    assert found.columns[0] == "doc.id" and rows(found) == rows(substring.without_repeats(plain))
    pieces = packing.packed(dotted, "the.text", "doc.id")
    assert pieces.columns[0] == "doc.id" and rows(pieces) == rows(packing.packed(plain))
    assert [r["n_removed"] for r in found.orderBy("`doc.id`").collect()] == [40, 40, 0, 0]
