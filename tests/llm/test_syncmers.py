import hashlib
import re

import pytest
from conftest import SF
from pyspark.sql import functions as F

from lexigauge.llm import syncmers as sm


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()[:8]


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute_print(text, k=5):
    w = words(text)
    n = [md5(x) for x in w]
    places = [i for i in range(len(w) - k + 1) if min(n[i], n[i + k - 1]) <= min(n[i + 1 : i + k - 1])]
    if not places:
        return "0" + md5(" ".join(w)) if w else ""
    return "".join(f"{p - b:x}" + md5(" ".join(w[p : p + k])) for p, b in zip(places, [0, *places]))


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5((r[1] or "").encode()).hexdigest()))
    out = []
    for r, nxt in zip(order, order[1:] + order[:1]):
        t, e = r[1] or "", nxt[1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + e[:half]
        a, b, c = brute_print(t), brute_print(edited), brute_print(e)
        out.append((r[0], len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, likeness(a, b), likeness(a, c)))
    return sorted(out, key=str)


def likeness(a, b):
    x, y = (set(re.findall("[0-9a-f]([0-9a-f]{8})", p)) for p in (a, b))
    return 1.0 if not x and not y else 2 * len(x & y) / (len(x) + len(y))


ODD = [
    (1, "one two three four five six seven eight nine ten eleven twelve"), (2, None), (3, ""), (4, "..."), (5, "short text"),
    (6, "a b c d e"), (7, "Ünïcode 𝔘 words, mixed CASE and 中文 字 Ünïcode again and again"), (8, "same same same same same same same"),
    (9, "one two three four five six seven eight nine ten eleven twelve"), (None, "no id at all, not one"), (None, None),
    (10, "twice"), (10, "twice"), (10, "thrice under one id with some more words in it"), (11, "x " * 60_000),
]


def test_odd_rows(spark, make_docs):
    got = [tuple(r) for r in sm.fingerprint_edits(make_docs(ODD)).collect()]
    assert sorted(got, key=str) == brute(ODD)
    assert sm.fingerprint_edits(make_docs([])).collect() == []
    assert [tuple(r) for r in sm.fingerprint_edits(make_docs([(5, "alone in here")])).collect()] == brute([(5, "alone in here")])


@pytest.mark.parametrize("most", [1, 3, 1 << 16])
def test_stretches_only_deal_the_work(spark, make_docs, most):
    """One or many stretches, ids in no order, some of them shared: the next document is the same."""
    rows = [((i * 37) % 101 // 2, f"document number {i} " * 4) for i in range(101)] + [(None, "z"), (None, "y")]
    got = sm.with_next(make_docs(rows), stretch=7, max_stretches=most).select("doc_id", "text", "next_text").collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).hexdigest()))
    want = [(a[0], a[1], b[1]) for a, b in zip(order, order[1:] + order[:1])]
    assert sorted([tuple(r) for r in got], key=str) == sorted(want, key=str)


def test_anchors_do_not_depend_on_what_stands_around_them(spark):
    base = " ".join(f"word{(i * i) % 97}" for i in range(200))
    rows = [(1, base), (2, "some new words ahead of it " + base), (3, base + " and some words behind"), (4, "quite another text here " * 20)]
    prints = spark.createDataFrame(rows, "id bigint, text string").select("id", sm.fingerprint(F.col("text")).alias("fingerprint"))
    own = {r["id"]: set(re.findall("[0-9a-f]([0-9a-f]{8})", r["fingerprint"])) for r in prints.collect()}
    assert own[1] <= own[2] and own[1] <= own[3] and not own[1] & own[4]
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "a bigint, b bigint")
    found = sm.aligned(prints, pairs).collect()
    best = {}
    for r in found:
        best[r["b"]] = max(best.get(r["b"], (0, 0)), (r["matches"], r["shift"]))
    assert best[2][1] == 6 and best[3][1] == 0 and 4 not in best


def test_anchors_are_never_far_apart(spark):
    text = " ".join(f"w{(i * 7919) % 1009}" for i in range(3000))
    row = spark.createDataFrame([(text,)], "text string").select(sm.fingerprint(F.col("text")).alias("f")).first()
    gaps = [int(x, 16) for x in row["f"][::9]]
    assert max(gaps) <= 4 and row["f"] == brute_print(text)


def test_no_python_in_the_plan(spark):
    df = sm.fingerprint_edits(spark.read.parquet(f"{SF}/documents.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "CartesianProduct" not in plan


def test_given_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted([tuple(r) for r in sm.fingerprint_edits(docs).collect()], key=str)
    assert got == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
