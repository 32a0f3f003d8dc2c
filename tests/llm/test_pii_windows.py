"""Terms that stand whole at the edge of a line or text count."""

from catastra.llm import pii


def test_first_and_last_terms(spark):
    texts = ["Zurbaran: ann@acme.org", "other words\nZurbaran: ann@acme.org", "+51 987 654 321 Velazquez", "+51 987 654 321 Velazquez\nmore words"] * 3 + ["filler text here " * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.sanitise(docs).collect():
        assert "Zurbaran" not in r.sanitised and "Velazquez" not in r.sanitised


def test_places_in_texts_of_many_terms(spark):
    """Spans of long texts, found in stretches, are those of a plain search; running sums and maxima are whole."""
    import re
    import time

    from pyspark.sql import functions as F

    from catastra.llm import pii

    text = " ".join(f"word{i}x" if i % 7 else "é" * (i % 5) + "," for i in range(60_000))
    df = spark.createDataFrame([(text,), ("",), (None,), ("one",)], "t string")
    start = time.time()
    got = [r.s for r in df.select(F.transform(pii.spans(F.coalesce("t", F.lit("")), pii.TERM, 0), lambda s: F.struct(s["start"], s["end"], s["value"])).alias("s")).collect()]
    assert time.time() - start < 30
    for t, spans in zip((text, "", "", "one"), got, strict=True):
        assert [tuple(s) for s in spans] == [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\W_]{3,}", t)]
    ends = list(range(1_000, 0, -3)) + [5_000, 1, 2]
    most = spark.createDataFrame([(ends,), ([],)], "e array<long>").select(pii.running(F.col("e"), F.lit(0).cast("long"), lambda a, x: F.greatest(a, x)).alias("r")).collect()
    assert most[0].r == [max([0, *ends[:i]]) for i in range(len(ends))] and most[1].r == []
