"""Importance resampling against counters and a plain sort, with nulls, repeated rows, ties and hot words."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from streetworth.llm.importance import inverted, resample

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest):
    words = WORD.findall((text or "").encode().lower())
    return words, [b" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, seed, longest, buckets, least, share):
    of = lambda text: Counter(zlib.crc32(f) % buckets for f in features(text, longest)[1])
    s, t = (sum((of(x) for x in texts), Counter()) for texts in ([x for _, x in docs], target))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in s}
    rows = []
    for d, text in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        words, found = features(text, longest)
        weight = sum(gain[b] * n for b, n in of(text).items())
        rows.append([d, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    ranked = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(ranked[: share[0] * len(ranked) // share[1]]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(3)
    words = "the The a house Straße дом, x9 of-it".split()
    out = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(200)]
    return out + [(500, None), (501, ""), (None, "the house " * 20), (None, "the house " * 20), (7, "a " * 30), (502, "the " * 400_000), (503, "!!! --")]


@pytest.mark.parametrize("longest, share", [(1, (10, 100)), (3, (1, 2))])
def test_resample(spark, docs, longest, share):
    target = ["the house of дом", None, "unseen words", "the house"]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, bucket int, place string").repartition(4)
    found = resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), 5, longest, 50, 20, share)
    got = sorted((tuple(r) for r in found.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)
    assert got == brute(docs, target, 5, longest, 50, 20, share)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample(none, none.select("text"), 1).count() == 0
    one = spark.createDataFrame([(1, "a " * 30), (2, None)], "doc_id long, text string")
    assert [(r["doc_id"], r["n_features"]) for r in resample(one, none.select("text"), 1).orderBy("doc_id").collect()] == [(1, 30), (2, 0)]


def test_chunks_are_bounded(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    rows = inverted(frame, buckets=50, most=1000)
    sizes = rows.where("bucket is null").groupBy("chunk").agg({"n_features": "sum", "*": "count"}).collect()
    assert len(sizes) > 5 and sum(r["count(1)"] for r in sizes) == len(docs)
    assert rows.where("bucket is not null").count() == rows.where("bucket is not null").select("chunk", "bucket").distinct().count()
