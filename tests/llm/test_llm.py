"""The ten operators against brute force and known cases, with nulls, empty and repeated texts, ties, empty tables and extra columns."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from streetworth.llm import quality, suffix_dedup
from streetworth.llm.language import identify, train, viterbi
from streetworth.llm.license_scan import scan_licenses
from streetworth.llm.mixing import mix
from streetworth.llm.ngram_join import ngram_jaccard
from streetworth.llm.packing import best_fit_runs, pack
from streetworth.llm.pii import find_pii, listed, redact
from streetworth.llm.queries import tokenizer_path
from streetworth.llm.suffix_dedup import dedup_substrings, front_coded, merge_runs
from streetworth.llm.vectors import near_vectors, top_k

SCHEMA = "doc_id long, text string, lang string, source string, block string, _text string, id long"
rng = np.random.default_rng(5)
VOCAB = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(3000)]


def words(n):
    return [VOCAB[i] for i in rng.integers(0, len(VOCAB), n)]


@pytest.fixture(scope="module")
def texts():
    out = {1: None, 2: "", 3: " \n ", 4: "One", 5: "one", 6: "a b c d", 7: "é" * 900, 8: "x" * 3000}
    passage = " ".join(words(90))
    base = words(200)
    for i in range(10, 40):
        w = list(base)
        for j in rng.integers(0, 200, i % 9):
            w[j] = VOCAB[int(rng.integers(0, 3000))]
        out[i] = " ".join(w)
    for i in range(40, 60):
        out[i] = " ".join(words(60)) + (f" {passage} " if i % 2 else " ") + " ".join(words(40))
    out |= {60: out[40], 61: out[40], 62: " ".join(words(4000))}
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(k, v, "en", "s", "b", "t", 0) for k, v in texts.items()], SCHEMA).repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", t)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_ngram_jaccard(docs, texts, empty):
    sets = {k: shingles(t) for k, t in texts.items()}
    label = {k: k for k in sets}
    changed = True
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard(docs).collect()}
    assert got == {k: (len(sets[k]), label[k]) for k in sets}
    assert ngram_jaccard(docs, hot=10).where("doc_id <> component_id").count() == sum(k != v for k, v in label.items())
    assert ngram_jaccard(empty).count() == 0


def test_suffix_dedup(docs, texts, empty):
    raw = {k: (t or "").encode() for k, t in texts.items()}
    times = {}
    for t in raw.values():
        for i in range(len(t) - 399):
            times[t[i : i + 400]] = times.get(t[i : i + 400], 0) + 1
    got = {r["doc_id"]: tuple(r)[1:] for r in dedup_substrings(docs).collect()}
    for k, t in raw.items():
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 399):
            if times[t[i : i + 400]] > 1:
                gone[i : i + 400] = True
        runs = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(t) else 0
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        assert got[k] == (len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()), k
    assert dedup_substrings(empty).count() == 0


def test_half_digests_that_clash_join_nothing(docs, texts, monkeypatch):
    """With two bits for half a digest, most texts share theirs with another one; the other halves tell them apart."""
    from pyspark import cloudpickle

    from streetworth.llm import _text, ngram_join

    plain_sets = sorted(map(tuple, ngram_jaccard(docs).select("doc_id", "n_shingles", "component_id").collect()))
    plain_bytes = sorted(map(tuple, dedup_substrings(docs).collect()))
    whole, text_id = _text.digests, suffix_dedup._text_id
    monkeypatch.setattr(_text, "digests", lambda x: (whole(x)[0] % 4, whole(x)[1]))
    monkeypatch.setattr(suffix_dedup, "_text_id", lambda sha: sha[0] % 4 if len(sha) == 32 else text_id(sha))
    for module in (_text, ngram_join, suffix_dedup):
        cloudpickle.register_pickle_by_value(module)
    try:
        assert sorted(map(tuple, ngram_jaccard(docs).select("doc_id", "n_shingles", "component_id").collect())) == plain_sets
        assert sorted(map(tuple, dedup_substrings(docs).collect())) == plain_bytes
    finally:
        for module in (_text, ngram_join, suffix_dedup):
            cloudpickle.unregister_pickle_by_value(module)


def test_loser_tree_merges_front_coded_runs():
    entries = [(bytes(rng.integers(97, 100, int(rng.integers(0, 9))).astype(np.uint8)), b"", i, 0) for i in range(300)]
    runs = [front_coded(sorted(entries[i::7])) for i in range(7)]
    merged = list(merge_runs(runs))
    order = [m[1][0] for m in merged]
    assert order == sorted(e[0] for e in entries)
    for (p, entry), before in zip(merged[1:], order[:-1], strict=True):
        n = next((i for i, (x, y) in enumerate(zip(entry[0], before, strict=False)) if x != y), min(len(entry[0]), len(before)))
        assert p == n


def test_pii(spark, empty):
    iban = "GB82 WEST 1234 5698 7654 32"
    rows = {1: "mail é a.b@c.org_x@y.com now", 2: "ip 1.2.3.4 and 256.1.1.1 and 1.2.3.4.5", 3: "card 4111 1111 1111 1111, not 4111 1111 1111 1112", 4: "call +1 (743) 555-3824 or phone 743 555 3824", 5: f"account {iban}.", 6: None, 7: "", 8: "1" * 40}
    found = find_pii(spark.createDataFrame([(k, v, "x") for k, v in rows.items()], "doc_id long, text string, spans string"))
    got = {r["doc_id"]: r["s"] for r in found.select("doc_id", listed(F.col("spans")).alias("s")).collect()}
    mails = re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", rows[1])
    assert got[1] == ",".join(f"email:{m.start()}:{m.end()}" for m in mails) == "email:7:16,email:16:24"
    assert got[2] == "ip:3:10,ip:29:36"
    assert got[3] == "card:5:24"
    assert got[4] == "phone:5:22,phone_local:32:44"
    assert got[5] == f"iban:8:{8 + len(iban)}"
    assert got[6] == got[7] == got[8] == ""
    clean = {r["doc_id"]: r["text"] for r in redact(found).collect()}
    assert clean[1] == "mail é [EMAIL][EMAIL] now" and clean[6] is None and clean[8] == "1" * 40
    assert find_pii(empty).count() == 0


def test_packing(docs, texts, empty):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(tokenizer_path())
    rows = pack(docs, tokenizer_path(), capacity=64).toPandas()
    for doc, own in rows.sort_values("piece").groupby("doc_id"):
        ids = [*coder.encode(texts[doc] or "", add_special_tokens=False).ids, 0]
        assert own["length"].sum() == len(ids)
        for p in own.itertuples():
            assert zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
    placed = rows.sort_values(["sequence_id", "offset"])
    assert (placed.groupby("sequence_id")["length"].cumsum() - placed["length"] == placed["offset"]).all()
    assert placed.groupby("sequence_id")["length"].sum().max() <= 64 and rows["doc_id"].nunique() == len(texts)
    assert pack(empty, tokenizer_path()).count() == 0


def test_best_fit_runs_are_best_fit_decreasing():
    lengths = sorted((int(x) for x in rng.integers(1, 100, 500)), reverse=True)
    rooms = []
    for n in lengths:
        fit = min((i for i, r in enumerate(rooms) if r >= n), key=lambda i: rooms[i], default=None)
        if fit is None:
            rooms.append(100 - n)
        else:
            rooms[fit] -= n
    runs = best_fit_runs({n: lengths.count(n) for n in set(lengths)}, 100)
    filled = {}
    by = {n: lengths.count(n) for n in set(lengths)}
    for n, count in by.items():
        own = sorted(r for r in runs if r[0] == n)
        for rank in range(count):
            r = [x for x in own if x[1] <= rank][-1]
            filled.setdefault(r[3] + (rank - r[1]) // r[2], []).append(n)
    assert sorted(100 - sum(x) for x in filled.values()) == sorted(rooms)


def test_language(spark, docs, empty):
    rows = [(i, " ".join(rng.choice(["the", "and", "with", "house"], 30)), "en") for i in range(20)] + [(i, " ".join(rng.choice(["der", "und", "mit", "straße"], 30)), "de") for i in range(20, 40)]
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    tests = spark.createDataFrame([(1, "the house and the house " * 4 + "mit der straße und der " * 8), (2, None), (3, "123 !?"), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in identify(tests, model, penalty=4.0).collect()}
    assert got[1]["lang_pred"] == "de" and [s.split(":")[0] for s in got[1]["lang_spans"].split(",")] == ["en", "de"]
    assert all(got[i]["lang_pred"] == "und" and got[i]["lang_score"] == 0 for i in (2, 3, 4))
    assert identify(empty, model).count() == 0 and train(empty)[0] == []
    scores = rng.normal(size=(7, 3))
    labels = viterbi(scores, np.array([0, 3, 3, 7]), 1.0)
    best = max(((a, b, c) for a in range(3) for b in range(3) for c in range(3)), key=lambda p: sum(scores[i, x] for i, x in enumerate(p)) - (p[0] != p[1]) - (p[1] != p[2]))
    assert tuple(labels[:3]) == best


def test_quality(spark, empty):
    rows = [(i, (" ".join(words(50)) + ".") if i % 2 else "!!! ".join(w.upper() for w in words(50)), i % 2) for i in range(80)]
    measured = quality.measure(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    model = quality.train(measured)
    got = quality.score(measured, model).toPandas()
    assert got[got.label == 1].score.min() > got[got.label == 0].score.max()
    assert quality.score(quality.measure(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")), model).where("score between 0 and 1").count() == 2
    assert quality.train(quality.measure(empty.withColumn("label", F.lit(1)))) == (None, 0.5)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, key string")


def test_near_vectors(spark):
    base = rng.normal(size=(12, 8))
    rows = [(i, (base[i % 12] + 0.12 * rng.normal(size=8) * (i % 5)).astype(np.float32).tolist(), i % 3, "k") for i in range(300)]
    rows += [(300, rows[0][1], 0, "k"), (301, rows[0][1], 0, "k"), (302, None, 1, "k"), (303, [0.0] * 8, 1, "k"), (304, [float("nan")] * 8, 1, "k"), (305, rows[0][1], None, "k"), (306, [1.0, None], 1, "k")]
    x = np.array([r[1] if r[1] and None not in r[1] else [0.0] * 8 for r in rows], float)
    with np.errstate(all="ignore"):
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = np.array([[i != j and a[2] is not None and a[2] == b[2] and bool(u[i] @ u[j] >= 0.93) for j, b in enumerate(rows)] for i, a in enumerate(rows)])
    comp = np.arange(len(rows))
    for _ in rows:
        comp = np.minimum(comp, np.where(link, comp[None], 10**9).min(1))
    got = near_vectors(vectors(spark, rows), size=16).toPandas().set_index("vec_id").loc[range(len(rows))]
    assert got.n_links.tolist() == link.sum(1).tolist() and got.component_id.tolist() == comp.tolist() and link.sum() > 100
    assert near_vectors(vectors(spark, [])).count() == 0


def test_top_k(spark):
    rows = [(i, rng.normal(size=20).astype(np.float32).tolist(), 0, "k") for i in range(200)]
    rows += [(200, rows[3][1], 0, "k"), (201, rows[3][1], 0, "k"), (202, None, 0, "k"), (250, [float("inf")] * 20, 0, "k"), (300, [1.0] * 5, 0, "k")]
    got = top_k(vectors(spark, rows).repartition(3), F.col("vec_id") % 50 == 0, k=5).toPandas().sort_values(["query_id", "rank"])
    w = {r[0]: np.floor(np.array(r[1], float) * 256) for r in rows if r[1] and np.isfinite(r[1]).all() and len(r[1]) == 20}
    for q in (0, 50, 100, 150, 200):
        best = sorted((-int(w[q] @ v), i) for i, v in w.items() if i != q)[:5]
        own = got[got.query_id == q]
        assert own.vec_id.tolist() == [i for _, i in best] and own.score.tolist() == [-s for s, _ in best]
    assert 300 not in set(got.query_id) and 250 not in set(got.query_id)
    assert top_k(vectors(spark, []), F.col("vec_id") % 50 == 0).count() == 0


def test_mixing(spark, empty):
    rows = [(i, " ".join(words(10)), "en" if i % 2 else None, f"src{i % 4}") for i in range(400)] + [(1000, None, "en", "src1"), (1001, "", "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mix(docs, F.col("source"), {"domain": {"src1": 3.0, "src3": 0.0}}, share=0.5, max_epochs=2).toPandas()
    taken = got.groupby("domain").taken.sum().to_dict()
    assert taken == {"src0": 400, "src1": 1200, "src2": 400} and not got.duplicated(["doc_id", "epoch"]).any()
    short = mix(docs, F.col("source"), {"domain": {"src1": 100.0}}, share=0.9, max_epochs=1).toPandas().groupby("domain").taken.sum()
    assert short["src1"] == 1000 and abs(short.sum() - 3600) <= 8
    assert mix(empty, F.col("source"), {}).count() == 0


def test_licenses(spark, docs, empty):
    rows = [(1, "é text Released under the MIT License. more"), (2, "permission is hereby granted free of charge to any person obtaining"), (3, None), (4, "Licensed under CC BY-NC 4.0."), (5, "Released under the\n MIT license twice. released under the MIT License")]
    got = sorted((r["doc_id"], r["license"], r["start"], r["end"]) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got[0] == (1, "MIT (statement)", 7, 37) and [g[1] for g in got if g[0] == 4] == ["CC-BY-NC-4.0 (statement)"]
    assert sum(g[0] == 5 for g in got) == 2 and not [g for g in got if g[0] in (2, 3)]
    assert scan_licenses(empty).count() == 0 and scan_licenses(docs).count() == 0


def test_suffix_dedup_splits_hot_grams(spark, monkeypatch):
    letters = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage, long, exact = letters(390), letters(900), letters(1500)
    rows = [letters(int(rng.integers(0, 300))) + passage + "xy"[i % 2] * int(rng.integers(0, 40)) + letters(300) for i in range(150)]  # few pairs share a window
    rows += [letters(int(rng.integers(0, 300))) + long[: int(rng.integers(395, 900))] + letters(200) for _ in range(150)]
    rows += [exact + letters(50) for _ in range(80)] + [letters(3) + passage + passage + long for _ in range(20)]
    texts = dict(enumerate(rows))
    docs = spark.createDataFrame([*texts.items(), (0, rows[0])], "doc_id long, text string").repartition(4)
    times = {}
    for t in set(rows):
        for i in range(len(t) - 399):
            times[t[i : i + 400]] = times.get(t[i : i + 400], 0) + 1
    merged = suffix_dedup._merged

    def guarded(length, gram):
        run = merged(length, gram)

        def small(pdf):
            keys = {}
            for r in pdf["run"]:
                for _, suffix, *_ in suffix_dedup.read_run(r):
                    keys[suffix[:gram]] = keys.get(suffix[:gram], 0) + 1
            if max(keys.values()) > 100:
                raise ValueError("a hot gram came to one task")
            return run(pdf)

        return small

    monkeypatch.setattr(suffix_dedup, "_merged", guarded)
    monkeypatch.setattr(suffix_dedup.dedup_substrings, "__defaults__", (400, 100, 30)[: len(suffix_dedup.dedup_substrings.__defaults__)])
    got = {r["doc_id"]: tuple(r)[1:] for r in dedup_substrings(docs).collect()}
    for k, t in texts.items():
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 399):
            if times[t[i : i + 400]] > 1 or k == 0:
                gone[i : i + 400] = True
        runs = int((gone & ~np.concatenate(([False], gone[:-1]))).sum())
        kept = bytes(np.frombuffer(t.encode(), np.uint8)[~gone])
        assert got[k] == (len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()), k
