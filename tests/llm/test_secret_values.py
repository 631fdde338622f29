"""Random values behind any name and an equals sign, and in runs that mix alphabets."""

from __future__ import annotations

import base64
import random

from tallystone.llm import secrets

SHAPES = ["sig={}", "private_key={} x", "AUTH={}==", "a_rather_long_name_of_2_values={}", "q?sig={}&x=1", "my-dir/of_files/{}", "{}"]


def _value(r, i):
    raw = base64.b64encode(r.randbytes(36)) if i % 2 else base64.urlsafe_b64encode(r.randbytes(36))
    return raw.decode()


def test_values_behind_names_are_found(spark, docs_of):
    r = random.Random(5)
    values = [_value(r, i) for i in range(140)]
    texts = [SHAPES[i // 2 % len(SHAPES)].format(v) for i, v in enumerate(values)]
    rows = secrets.secret_spans(docs_of(texts)).select("doc_id", "spans").collect()
    found = 0
    for x in rows:
        at = texts[x["doc_id"]].index(values[x["doc_id"]])
        found += any(s["rank"] == 3 and s["start"] < at + 48 and s["end"] > at + 24 for s in x["spans"])
    assert found >= 0.9 * len(texts)


def test_tokens_end_at_the_other_alphabet(spark, docs_of):
    a, b = "abcdefgh1jklmnopqrstuv", "ABCDEFGH1JKLMNOPQRSTUV"
    texts = [f"n={a}", f"{a}==", f"{a}=={b}", f"{a}+{b}", f"{a}-{b}", f"{a}+{b}-{a}", f"x={a[:18]}== {a[:18]}"]
    rows = docs_of(texts).select("doc_id", secrets._tokens(secrets.F.col("text")).alias("t")).orderBy("doc_id").collect()
    assert [sorted((t["start"], t["end"]) for t in x["t"]) for x in rows] == [[(2, 24)], [(0, 24)], [(0, 22), (24, 46)], [(0, 45)], [(0, 45)], [(0, 45), (23, 68)], [(2, 22)]]


def _spans(df):
    return {r["doc_id"]: [(x["start"], x["end"]) for x in r["spans"] if x["rank"] == 3] for r in secrets.secret_spans(df, "doc_id").collect()}


def test_plain_tokens_are_left_alone_and_random_ones_found(spark, docs_of):
    words = "order invoice customer account number total section chapter report annual user profile name email street postal summary release version value table index".split()
    r = random.Random(11)

    def plain():
        w = [r.choice(words) + (str(r.randrange(2000)) if r.random() < 0.3 else "") for _ in range(r.randrange(4, 9))] + [str(r.randrange(10, 99))]
        return r.choice([lambda: "".join(x.capitalize() for x in w), lambda: "".join(w), lambda: "_".join(w), lambda: "/".join(w), lambda: "-".join(w), lambda: "".join(w).upper()])()

    alphabets = ["abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"]
    rand = ["k " + "".join(r.choice(alphabets[i % 4]) for _ in range(r.randrange(28, 80))) for i in range(200)]
    texts = ["see " + plain() for _ in range(600)] + rand + ["chapter12sectionthreeb", "GetUserProfileById2024x"] + ["000000000000000000000A12"] * 5
    got = _spans(docs_of(texts))
    reported = sum(bool(got[i]) for i in range(600))
    found = sum(bool(got[i]) for i in range(600, 800))
    assert found >= 190 and reported <= 0.2 * (found + reported)
    assert not any(got[i] for i in range(800, len(texts)))


def test_plain_tokens_alone_are_hardly_reported(spark, docs_of):
    rows = secrets.plain_tokens(spark, 30).collect()
    got = _spans(docs_of([r["token"] for r in rows]))
    assert sum(bool(x) for x in got.values()) <= 0.02 * len(rows)


def test_cuts_follow_the_step_up_rule():
    # 1000 tokens, 20 of them at a tail probability of 1e-4 (bin 40), 100 at a tenth.
    assert secrets.cuts({3: {0: 880, 10: 100, 40: 20}}, 0.1) == {3: 40}
    assert secrets.cuts({3: {0: 100, 10: 1}}, 0.1) == {3: secrets.BINS}
    assert secrets.cuts({3: {-1: 500, 20: 500}, 4: {-1: 9}}, 0.1) == {3: 20, 4: secrets.BINS}


def test_many_matches_in_one_text(spark, docs_of):
    import time

    n = 100_000
    text = "token=abcdef " * n + "k=" + "0123456789abcdef" * 2 + " 9bFlIkpYt5HfavHYMD5hzYbDQ7xZ"
    began = time.time()
    row = secrets.secret_spans(docs_of([text]), "doc_id").selectExpr("size(base) AS n", "base[99999] AS last", "element_at(base, -1) AS hex").first()
    assert row["n"] == n + 1 and (row["last"]["start"], row["last"]["end"]) == (13 * (n - 1), 13 * (n - 1) + 12) and row["hex"]["rank"] == 2
    assert time.time() - began < 60


def test_tokens_that_meet_base_spans_are_left_out(spark, docs_of):
    value = "9bFlIkpYt5HfavHYMD5hzYbDQ7xZ"
    texts = [f"secret={value} k={value}", f"k={value} secret={value}"]
    got = _spans(docs_of(texts))
    assert got == {0: [(38, 66)], 1: [(2, 30)]}


def test_odd_tables(spark, docs_of):
    empty = secrets.secret_spans(docs_of([]), "doc_id")
    assert empty.count() == 0 and empty.columns == ["doc_id", "base", "spans"]
    rows = docs_of(["secret=abcdef1", None, None]).selectExpr("*", "1 AS base", "2 AS spans", "3 AS tested", "4 AS keep_0", "5 AS _tokens")
    got = secrets.secret_spans(rows.union(rows))
    assert got.count() == 6 and {"tested", "keep_0", "_tokens", "base", "spans"} <= {*got.columns}
    assert sorted(len(r["base"]) for r in got.collect()) == [0, 0, 0, 0, 1, 1]
