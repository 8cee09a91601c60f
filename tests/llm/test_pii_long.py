"""Personal data in very long texts: spans and redaction against Python's regular expressions, and texts made of overlapping kinds."""

import re

from pyspark.sql import functions as F

from streetworth.llm.pii import find_pii, redact


def test_long_text(spark):
    """Three megabytes with 64,000 spans, a long stretch without any, and characters beyond 16 bits."""
    text = "".join(f"Bitte an jane.{i}@example.org 😀 zahlen, card 4111 1111 1111 1111. " for i in range(32_000)) + "é " * 400_000 + "x@y.zz"
    found = find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    (row,) = found.select("spans").collect()
    want = [("email", *m.span()) for m in re.finditer(r"[a-z0-9.]+@[a-z]+\.[a-z]+", text)] + [("card", *m.span()) for m in re.finditer(r"4111 1111 1111 1111", text)]
    assert [(s["kind"], s["start"], s["end"]) for s in row["spans"]] == sorted(want, key=lambda s: s[1])
    assert {s["score"] for s in row["spans"] if s["kind"] == "card"} == {max(s["score"] for s in row["spans"] if s["kind"] == "card")}
    (clean,) = redact(found).select("text").collect()
    assert clean["text"] == re.sub(r"4111 1111 1111 1111", "[CARD]", re.sub(r"[a-z0-9.]+@[a-z]+\.[a-z]+", "[EMAIL]", text))


def test_overlapping_spans(spark):
    """Redaction as a walk over the sorted spans, where spans meet, overlap or hold each other."""
    texts = ["+1 4111 1111 1111 1111 a@b.cc", "1.2.3.4@5.6", "a@b.cc+49 30 1234567 1.2.3.4", "4111-1111-1111-1111@x.yy", "", None, "DE89370400440532013000 (555) 123-4567", "call 555-123-4567 +1 555-123-4567 DE89 3704 0044 0532 0130 00@a.bb"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("whole", F.lit(1)).withColumn("points", F.lit(2))
    found = find_pii(frame)
    clean = {r["doc_id"]: r for r in redact(found).collect()}
    assert found.columns == [*frame.columns, "spans"]
    for r in found.collect():
        out, at, text = "", 0, r["text"]
        for s in r["spans"]:
            assert not any(o is not s and o["rank"] < 4 <= s["rank"] and o["start"] < s["end"] and s["start"] < o["end"] for o in r["spans"])
            if s["start"] >= at:
                out += text[at : s["start"]] + f"[{s['kind'].upper()}]"
            at = max(at, s["end"])
        assert clean[r["doc_id"]]["text"] == (None if text is None else out + text[at:])
        assert (clean[r["doc_id"]]["whole"], clean[r["doc_id"]]["points"]) == (1, 2)
