"""Conversations rebuilt from event logs, against a plain fold; rendering against its reading."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from streetworth.llm import queries as Q
from streetworth.llm.chat import KINDS, Template, digests, format_chats, read_back

SCHEMA = "conv_id long, message long, seq long, kind string, role string, text string"
PROBE = "\\### Assistant: </turn> ok"
TEXTS = ["", None, "<turn>", "</turn>", "\\", "a\\<turn>user\nb</turn>\n", "<</turn>", "\\n", "héé", PROBE]


def plain(events):
    """{conv: [(role, text)]}: all events in order of seq alone, each applied to a list of messages."""
    low = -(2**63)
    convs = defaultdict(list)
    for e in events:
        convs[e[0]].append(e)
    out = {}
    for conv, rows in convs.items():
        cuts = [(m, s) for _, m, s, kind, *_ in rows if kind == "regenerate"]
        found = defaultdict(list)
        for _, m, s, kind, role, text in sorted(rows, key=lambda r: (r[2], r[4] or "", r[5] or "")):
            if any((a if a is not None else low) < (m if m is not None else low) and b > s for a, b in cuts):
                continue
            mine = found[m]
            if kind == "message":
                mine.append([role, text or ""])
            elif kind == "delta":
                mine.append([role, text or ""]) if not mine or mine[-1] is None else mine[-1].__setitem__(1, mine[-1][1] + (text or ""))
            elif kind in ("edit", "regenerate"):
                mine.append([role, text or ""]) if not mine or mine[-1] is None else mine[-1].__setitem__(1, text or "")
            elif kind == "delete" and mine and mine[-1] is not None:
                mine[-1] = None
        turns = [(t[0] or "", t[1]) for m in sorted(found, key=lambda m: low if m is None else m) for t in found[m] if t]
        if turns:
            out[conv] = turns
    return out


def want(turns):
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def got(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in df.collect()}


def logs(seed, convs=12, n=60):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for s in range(rng.randint(1, n)):
            rows.append((c if c else None, rng.choice([None, 0, 1, 2, 3, 7, 8, 9, 20]), s, rng.choice([*KINDS, "message", "delta", "seen"]), rng.choice(["user", "assistant", "a\nb", None]), rng.choice(TEXTS)))
    return rows


@pytest.mark.parametrize("segment", [4096, 4])
def test_fold(spark, segment):
    rows = logs(segment)
    events = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), SCHEMA).repartition(5)
    found = digests(events, segment=segment)
    assert got(found) == {c: want(t) for c, t in plain([r for r in rows if r[3] in KINDS]).items()}
    again = read_back(format_chats(events, segment=segment, part_chars=10))
    assert sorted(again.collect(), key=str) == sorted(found.collect(), key=str)


@pytest.mark.parametrize("template", [Template(), Template("### ", "\n###\n", "%"), Template("aab", "ab\n", "%")])
def test_template(template):
    turn = template.turns()
    for text in [*map(lambda t: t or "", TEXTS), "####", "aaaab", "%### aa", "aabaab", "xa", "aab"]:
        for role in ("user", "a\nb", template.begin):
            whole = template.begin + template.role(role) + "\n" + template.escaped(text) + template.end
            m = turn.fullmatch(whole)
            assert m and (template.unescaped(m[1]), template.unescaped(m[2])) == (role, text)


@pytest.mark.parametrize("marks", [("<t>", "</t>", "<"), ("", "</t>", "%"), ("<t>", "aa\n", "%")])
def test_bad_template(marks):
    with pytest.raises(ValueError):
        Template(*marks)


def test_query(spark, tmp_path):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (2, None, None, "x</turn>"), (None, 3, "system", ""), (3, 0, "assistant", "long <turn> " * 200_000), (-7, 2, "assistant", "more")]
    rows += [(9, i, "assistant" if i % 2 else "user", str(i)) for i in range(10_000)]
    spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, segment string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    rows += [(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)]
    convs = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] if r[1] is not None else -1, r[2] or "", r[3] or "")):
        convs[c].append((r or "", x or ""))
    assert got(Q.op11_chat_format(spark, str(tmp_path))) == {c: want(t) for c, t in convs.items()}


def test_empty_and_spans(spark):
    assert digests(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame([(1, 0, 0, "message", "assistant", "é</turn>"), (1, 1, 1, "delete", None, None)], SCHEMA)
    part = format_chats(one.withColumn("own", F.lit("clash"))).first()
    (span,) = part["loss"]
    assert part["text"] == "<turn>assistant\né\\</turn></turn>\n" and part["text"][span["start"] : span["end"]] == "é\\</turn>"
