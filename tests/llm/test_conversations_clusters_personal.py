"""Conversation repair, centroid clustering and personal data against brute force and on odd rows."""

import hashlib
import math
import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

from assayer.llm import centroid_clusters, conversation_repair, personal_data, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
TALK = "conv_id long, turn long, role string, text string"


def repaired_of(df, **kw):
    return {r["conv_id"]: tuple(r[1:]) for r in conversation_repair.repaired(df, **kw).collect()}


def wanted(rows):
    return {c: brute.repaired_conversation(own) for c, own in brute.damaged_conversations(rows).items()}


def random_talk(convs, most, seed):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "", " \n ", "What?", "a. ", "b.　", "Ünder.", "x\x1c"]
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(most)):
            rows.append((c, rng.choice([t, t, t, t // 2, None]), rng.choice(["user", "assistant", "system", "User", "tool", "", None]),
                         rng.choice(texts + [f"text {rng.randrange(4)}.", f"say {t}.", None])))
    return rows + rows[:7] + [(None, 1, "user", "Hi."), (None, None, None, None)]


# 11 conversations
def test_repair_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    got = queries.op11_conversation_repair(spark, SF).collect()
    assert {r["conv_id"]: tuple(r[1:]) for r in got} == wanted(rows)
    assert len(got) == len({r[0] for r in rows})


@pytest.mark.parametrize("pieces", [1, 3, 1024])
def test_repair_of_odd_rows_in_pieces(spark, pieces):
    rows = random_talk(120, 14, 5) + [(999, t, r, f"turn {t % 90}{e}") for t in range(300) for r, e in [(("user", "assistant", "user")[t % 3], (".", "")[t % 7 == 0])]]
    df = spark.createDataFrame([(*r, "x") for r in rows], TALK + ", costs string").repartition(5)
    assert repaired_of(df, piece_rows=pieces) == wanted(rows)


def test_repair_of_a_hot_conversation_with_equal_rows(spark):
    rows = [(7, 3, "user", "Again.")] * 3000 + [(7, t, "assistant", f"Answer {t}.") for t in range(400)] + [(8, 0, "system", "S."), (8, 1, "system", "T.")]
    assert repaired_of(spark.createDataFrame(rows, TALK).repartition(8), piece_rows=16) == wanted(rows)


def test_repair_without_rows(spark):
    assert repaired_of(spark.createDataFrame([], TALK)) == {}
    gone = next(c for c in range(1000) if brute.damaged_conversations([(c, 0, "user", "x.")])[c] == [])
    empty = hashlib.sha256(b"").hexdigest()
    assert repaired_of(spark.createDataFrame([(gone, 0, "user", "x.")], TALK)) == {gone: (0, 0, 0, 0, 0, 0, "", empty)}


def test_least_audits_by_rank():
    rng = random.Random(3)
    pieces = []
    for _ in range(300):
        p = conversation_repair.Piece(0)
        for t in range(rng.randrange(9)):
            p.add(t, rng.choice(["user", "assistant", "system", "x"]), 1, False, rng.choice(["a.", "b"]))
        pieces.append(p)
    solved = conversation_repair.Solved(pieces, [conversation_repair.LAST] * len(pieces))
    audits, states = solved.audits(np.arange(len(pieces)), np.zeros(len(pieces), dtype=int))
    for p, audit, state, cost in zip(pieces, audits, states.tolist(), solved.matrix()[:, 0].tolist()):
        rows = [(t, r, f"{x} {t}" + ("" if c else ".")) for t, (r, x, c) in enumerate(zip(p.roles, p.texts, p.cut))]
        want = brute.repaired_conversation(rows)
        assert (cost, audit + conversation_repair.closing(state)[0]) == want[5:7]


# 12 clusters
def test_clusters_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = sorted((v, n, d, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for v, n, d, c in brute.clusters(rows))
    got = queries.op12_centroid_clusters(spark, SF).collect()
    assert sorted((r["vec_id"], r["cluster"], r["distance"], r["centroid_sha256"]) for r in got) == want
    sums = {}
    for _, n, d, _ in want:
        sums[n] = sums.get(n, 0) + d
    assert {r["cluster"]: r["cluster_inertia"] for r in got} == sums and {r["inertia"] for r in got} == {sum(sums.values())}


def test_clusters_of_odd_vectors(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.25, 1 / 3, 2.5]) for _ in range(64)]) for i in range(60)]
    rows += [(i + 100, rows[3][1]) for i in range(200)]  # one vector that is a third of all and more
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (500, [0.0] * 64), (501, [5000.0] + [0.0] * 63), (502, [-9000.5, 1e6] + [0.1] * 62)]
    bad = [(600, None), (601, []), (602, [1.0] * 63), (603, [None] + [1.0] * 63), (604, [math.nan] + [1.0] * 63), (605, [math.inf] + [1.0] * 63)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows + bad], "vec_id long, embedding array<double>, cluster int, distance int").repartition(4)
    got = centroid_clusters.cluster(df).collect()
    assert sorted(map(str, ((r["vec_id"], r["cluster"], r["distance"]) for r in got))) == sorted(map(str, ((v, n, d) for v, n, d, _ in brute.clusters(rows))))
    few = centroid_clusters.cluster(df.where("vec_id in (0, 1, 602)")).collect()
    assert sorted((r["vec_id"], r["distance"]) for r in few) == [(0, 0), (1, 0)]
    assert centroid_clusters.cluster(df.where("vec_id = 602")).collect() == []
    huge = spark.createDataFrame([(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.0] * 64)], "vec_id long, embedding array<double>")
    assert {r["vec_id"]: r["distance"] for r in centroid_clusters.cluster(huge, k=1).collect()}.keys() == {1, 2, 3}


def test_progressive_search_is_exact():
    rng = np.random.default_rng(4)
    for low, kind in ((3, np.int64), (400, np.int64), (400, object)):
        x, c = rng.integers(-low, low, (500, 64)), rng.integers(-low, low, (40, 64))
        c[7] = c[3]
        x[:40] = c
        scale = 10 ** 12 if kind is object else 1
        d = ((x[:, None] - c[None]) ** 2).sum(axis=-1)
        number, distance = centroid_clusters.nearest(x.astype(kind) * scale, c.astype(kind) * scale)
        assert (number == d.argmin(axis=1)).all() and [int(v) for v in distance] == [int(v) * scale ** 2 for v in d.min(axis=1)]


# 13 personal data
def base_of(text):
    return sorted((s.start, personal_data.BASE.index(s.kind), s.end) for s in personal_data.find(text)[0])


def test_personal_base_spans_are_the_plain_patterns():
    rng = random.Random(6)
    parts = ["a@b.c", "x", "@", ".", "-", " ", "+", "1", "255", "256", "4111 1111 1111 1111", "378282246310005", "+1 (310) 555-0199", "é", "_", "%", "9.8.7.6", "(", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        assert base_of(text) == brute.personal(text), text


def test_personal_data_of_the_table_and_odd_rows(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    got = queries.op13_personal_data(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        base = brute.personal(texts[r["doc_id"]])
        names = [f"{personal_data.BASE[k]}:{a}:{b}" for a, k, b in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert set(names) <= set(r["spans"].split(",") if r["spans"] else [])
    odd = spark.createDataFrame([(d, t, 1, "s") for d, t in brute.odd_texts() + [(None, "a@b.cd"), (3, "a@b.cd"), (3, "a@b.cd")]],
                                "doc_id long, text string, n_email int, spans string")
    assert sorted(r["n_email"] for r in personal_data.scan(odd).collect())[-4:] == [0, 1, 1, 1]
    assert personal_data.scan(odd.limit(0)).collect() == []
    out = personal_data.redacted(odd)
    assert out.columns == odd.columns and out.where("text = '[EMAIL]'").count() == 3 and out.where("text is null").count() == 1


def kinds(text):
    return {(s.kind, text[s.start:s.end]) for s in personal_data.find(text)[1]}


def test_added_personal_data_is_validated_and_weighed_by_context():
    assert kinds("pay to DE89 3704 0044 0532 0130 00 BIC") == {("iban", "DE89 3704 0044 0532 0130 00")}
    assert kinds("pay to DE88 3704 0044 0532 0130 00 BIC") == set()
    assert kinds("my ssn is 123-45-6789") == {("ssn", "123-45-6789")} and kinds("code 123-45-6789") == set()
    assert kinds("ssn of order 123-45-6789") == set() and kinds("ssn 666-45-6789") == set()
    assert kinds("host 2001:db8:1::42 up") == {("ip6", "2001:db8:1::42")} and kinds("at 12:30:45 and ::1") == set()
    assert kinds("born 31.12.1980") == {("birth", "31.12.1980")} and kinds("born 31.02.1980") == set() and kinds("on 31.12.1980") == set()
    assert kinds("call (310) 555-4510") == {("local_phone", "(310) 555-4510")} and kinds("part (310) 555-4510") == set()
    assert kinds("+1 (743) 555-3824") == {("phone", "+1 (743) 555-3824")}
    text = "pay order 4785380592391139"
    assert personal_data.score("card", text, 10, 26) < personal_data.score("card", "my card 4785380592391139", 8, 24)


def test_personal_scan_is_linear():
    import time

    began = time.time()
    personal_data.find("a" * 10 ** 6 + "1" * 10 ** 6 + "A1" * 10 ** 5 + " 1.2" * 10 ** 5 + "@" * 10 ** 5 + "+1" * 10 ** 5)
    assert time.time() - began < 20
