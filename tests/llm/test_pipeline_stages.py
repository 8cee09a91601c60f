"""Every stage of the pipeline against a plain version of it, alone and one after the other; clashing names, repeated ids, nulls, empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from streetworth.llm import queries as Q

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the house and a garden with it of water they were three old trees near some quiet river bank".split(), "de": "der Garten und das Haus mit ihm wäre über Straße schön zwei alte Bäume am stillen Ufer".split()}
WORD = "[^\x20\x09-\x0d]+"
CLASHING = ["rest", "whole", "_place", "_partly", "domain", "epoch", "taken", "n_tokens", "place", "nth", "ties", "_text", "_base", "spans", "base", "more", "email", "_p", "_word", "_bits", "_maybe", "lang_pred", "lang_score", "lang_share", "lang_spans", "others", "set_id", "second_id", "goes", "root", "doc", "row", "none", "kept", "last_taken", "bucket"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(21)
    prose = lambda lang, n: " ".join(rng.choice(WORDS[lang], n))
    out = [(i, prose(lang, int(rng.integers(30, 120))), lang, f"src{i % 3}") for i, lang in enumerate(["en", "de"] * 30)]
    near = out[0][1].split()
    near[3] = "different"
    out += [(100, out[0][1], "en", "src1"), (101, " ".join(near) + " and more", "en", "src2"), (102, "".join(c.upper() if c.isascii() else c for c in out[5][1]), "de", "src0"), (5, out[5][1], "de", "src2"), (5, out[5][1], "de", "src2"), (6, prose("en", 50), "en", "src0")]
    out += [(110, f"{prose('en', 40)} write to a.b@mail.example or 192.168.1.7, card 4111 1111 1111 1111", "en", "src1"), (111, None, "en", "src1"), (112, "", None, None), (113, "12 34 -- €", "en", "src0"), (114, prose("de", 40), None, None), (None, prose("en", 35), "en", "src1"), (115, prose("en", 20) + " " + prose("de", 22), "de", "src1")]
    return [(i, t, lang, source, len(t or "")) for i, t, lang, source in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def known(frame):
    return Counter(tuple(r) for r in frame.collect())


def grams(word):
    raw = b" " + b"".join(c.lower().encode() for c in word) + b" "
    return [((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761 % 2**32) >> 16 for i in range(len(raw) - 2)]


def language(rows):
    """Latin letters only. Kept: the best path of languages gives one of them half of the letters."""
    counts = defaultdict(Counter)
    words = lambda t: re.findall("[A-Za-zÀ-ÖØ-öø-ÿ]+", t or "")
    for i, t, lang, *_ in rows:
        if lang and zlib.crc32(str(i).encode()) % 3 != 1 and i is not None:
            for w in words(t):
                counts[lang].update(grams(w))
    langs = sorted(counts)
    logs = lambda x, g: float(np.float32(math.log((counts[x][g] + 0.5) / (sum(counts[x].values()) + 0.5 * 65536))))
    out = []
    for row in rows:
        best = None
        for w in words(row[1]):
            own = {x: sum(logs(x, g) for g in grams(w)) for x in langs}
            s = {x: v - max(own.values()) for x, v in own.items()}
            best = {x: (s[x], [x]) for x in langs} if best is None else {x: max(((v + s[x] - 8.0 * (path[-1] != x), [*path, x]) for v, path in best.values()), key=lambda p: p[0]) for x in langs}
        if best:
            labels = max(best.values(), key=lambda p: p[0])[1]
            letters = Counter()
            for w, x in zip(words(row[1]), labels, strict=True):
                letters[x] += len(w)
            if max(letters.values()) / sum(letters.values()) >= 0.5:
                out.append(row)
    return out


def near_duplicates(rows):
    def shingles(t):
        w = re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingles(r[1]) for r in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and label[a] != label[b]:
                gone = label[a]
                label = [label[b] if x == gone else x for x in label]
    groups = defaultdict(list)
    for i, x in enumerate(label):
        groups[x].append(i)
    sizes = []
    for own in groups.values():
        ids = [rows[i][0] for i in own if rows[i][0] is not None and sets[i]]
        lone = [rows[i] for i in own if rows[i][0] is None or not sets[i]]
        sizes.append((min(ids) if ids else None, lone))
    return Counter(i for i, _ in sizes if i is not None), [r for _, lone in sizes for r in lone]


def mixed(rows):
    """Rows of a leaf in the order of md5("17:0:doc_id") and tokens, up to its budget."""
    def split(budget, rooms, weights):
        given, open_ = dict.fromkeys(rooms, 0.0), {k for k in rooms if weights[k]}
        while open_ and budget > 1e-9:
            unit = budget / sum(weights[k] for k in open_)
            full = {k for k in open_ if rooms[k] - given[k] <= unit * weights[k]} or set(open_)
            for k in full:
                add = min(rooms[k] - given[k], unit * weights[k])
                given[k], budget = given[k] + add, budget - add
            open_ -= full
        return given

    leaves = defaultdict(list)
    for r in rows:
        n = len(re.findall(WORD, r[1] or ""))
        if n:
            source = r[3] or "?"
            leaves["domain" + str(int(source[-1]) % 4) if r[3] else "?", r[2] or "?", source].append((hashlib.md5(f"17:0:{r[0]}".encode()).hexdigest() if r[0] is not None else hashlib.md5(b"17:0").hexdigest(), n, r))
    tokens = {k: sum(x[1] for x in v) for k, v in leaves.items()}

    def down(budget, prefix):
        if len(prefix) == 3:
            return {prefix: math.floor(budget + 1e-9)}
        rooms = Counter()
        for leaf, n in tokens.items():
            if leaf[: len(prefix)] == prefix:
                rooms[leaf[len(prefix)]] += n
        own = Q.MIX_WEIGHTS.get(("domain", "lang", "source")[len(prefix)], {})
        out = {}
        for k, b in split(budget, rooms, {k: own.get(k, 1.0) for k in rooms}).items():
            out |= down(b, (*prefix, k))
        return out

    out = []
    for leaf, budget in down(Q.MIX_SHARE * sum(tokens.values()), ()).items():
        for _, n, r in sorted(leaves[leaf], key=lambda x: x[:2]):
            if budget > 0:
                out.append(r)
                budget -= n
    return out


def test_each_stage_and_all_of_them(spark, rows, docs, tmp_path):
    kept = P.language(spark, docs, "")
    assert kept.columns == docs.columns and known(kept) == Counter(language(rows))
    lost = {r[0] for r in rows} - {r["doc_id"] for r in kept.collect()}
    assert lost == {111, 112, 113}

    now = [tuple(r) for r in kept.collect()]
    one = P.near_duplicates(spark, kept, "")
    ids, lone = near_duplicates(now)
    got = [tuple(r) for r in one.collect()]
    assert Counter(r[0] for r in got) == ids + Counter(r[0] for r in lone) and set(got) <= set(now) and one.columns == docs.columns
    assert {100, 101, 102}.isdisjoint(r[0] for r in got) and {0, 5, 110, None} <= {r[0] for r in got} and Counter(r[0] for r in got)[5] == 1
    everything = P.near_duplicates(spark, docs, "")  # nulls and texts without words stay
    assert {111, 112} <= {r["doc_id"] for r in everything.collect()}

    now = got
    clean = P.personal_data(spark, spark.createDataFrame(now, SCHEMA), "")
    marks = lambda t: t if t is None else re.sub(r"4111 1111 1111 1111", "[CARD]", re.sub(r"192\.168\.1\.7", "[IP]", t.replace("a.b@mail.example", "[EMAIL]")))
    assert known(clean) == Counter((i, marks(t), lang, s, len(marks(t))) for i, t, lang, s, _ in now)
    assert sum("[" in r["text"] for r in clean.collect()) == 1

    now = [tuple(r) for r in clean.collect()]
    taken = P.target_mix(spark, spark.createDataFrame(now, SCHEMA), "")
    assert known(taken) == Counter(mixed(now)) and 0 < taken.count() < len(now)

    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    packed = P.run(spark, str(tmp_path)).toPandas()
    want = Counter(r[0] for r in mixed(now))
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(Q.tokenizer_path())
    by = defaultdict(list)
    for r in mixed(now):
        by[r[0]].append(r[1])
    assert Counter(None if x != x else int(x) for x in packed[packed.piece == 0].doc_id) == want
    for p in packed[packed.piece == 0].itertuples():
        options = [[*coder.encode(t, add_special_tokens=False).ids, 0] for t in by[None if p.doc_id != p.doc_id else int(p.doc_id)]]
        assert any(zlib.crc32(np.array(o, "<u4").tobytes()) == p.ids_crc32 and len(o) == p.length for o in options)
    placed = packed.sort_values(["sequence_id", "offset"])
    assert (placed.groupby("sequence_id")["length"].cumsum() - placed["length"] == placed["offset"]).all() and packed.groupby("sequence_id")["length"].sum().max() <= 2048


def test_names_of_other_columns_never_matter(spark, docs):
    extra = docs
    for c in CLASHING:
        extra = extra.withColumn(c, F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))))
    for name, stage in P.STAGES[:-1]:
        plain, more = stage(spark, docs, ""), stage(spark, extra, "")
        assert more.columns == extra.columns, name
        assert known(more.select(docs.columns)) == known(plain), name
        wrong = [F.col(f"`{c}`") != F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))) for c in CLASHING]
        assert more.where(F.coalesce(*[F.when(w, True) for w in wrong])).count() == 0, name
    assert P.packed(spark, extra, "").count() == P.packed(spark, docs, "").count()


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA + ", rest string, spans int")
    for name, stage in P.STAGES:
        out = stage(spark, empty, "")
        assert out.count() == 0 and (name == "packed" or out.columns == empty.columns)
