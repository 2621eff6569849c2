"""The column and the function that detect types decode alike."""

import random

from docloom.operators import detection
from pyspark.sql import functions as F


def cases():
    rng = random.Random(4)
    texts = ["café " * 47, "plain", "a�b", "<html><p>é", "中文" * 3000, "\U0001f600" * 1500, "x" * 4095 + "é" * 9, "x" * 4094 + "中" * 9, "\x07bell" * 9, "é" * 90 + "\t\n"]
    for t in texts:
        for coding in ("utf-8", "latin-1", "utf-16", "utf-16-le", "utf-16-be"):
            data = t.encode(coding, "replace")
            yield from (data, data[:-1], b"\xfe\xff" + data)
    yield ("café" * 60).encode("latin-1")[:235]
    yield b"\xff" * 5000
    yield b"x" * 4095 + b"\xff" + b"y" * 50
    for _ in range(300):  # units of halves of pairs among others, without zero bytes
        yield b"".join(bytes([rng.randrange(1, 256), rng.choice([0x41, 0xD8, 0xDB, 0xDC, 0xDF, 0x4E])]) for _ in range(rng.randrange(1, 9)))
        yield bytes(rng.randrange(1, 256) for _ in range(rng.randrange(1, 12)))


def test_the_column_agrees_with_the_function(spark):
    every = [c for c in cases() if detection.PDF_MARK not in c and not c.startswith(detection.ZIP_MARKS)]
    got = spark.createDataFrame(list(enumerate(map(bytearray, every))), "i int, c binary").select("i", detection.detect(F.col("c")).alias("d")).orderBy("i").collect()
    for r, data in zip(got, every):
        kind, confidence, _ = detection.sniff(data)
        assert (r["d"]["doc_type"], round(r["d"]["confidence"], 6)) == (kind, round(confidence, 6)), data[:60]
    assert {r["d"]["doc_type"] for r in got} == {"plain_text", "html", "unknown"}
    odd = ("café" * 60).encode("latin-1")[:235]
    assert detection.sniff(odd)[0] == "plain_text" and round(detection.sniff(odd)[1], 6) == 0.9
