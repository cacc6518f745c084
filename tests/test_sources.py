import csv
import json

import pytest
from pyspark.sql import functions as F

from lexigauge import ModelConfig
from lexigauge.operators import evaluation as ev
from lexigauge.operators import lsa
from lexigauge.operators import matrix as mx
from lexigauge.plans.evaluate import evaluate_study
from lexigauge.sources import corpus as cp
from lexigauge.sources import model_store as ms
from lexigauge.sources import questionnaire as qn
from lexigauge.sources import study


def test_tagged_and_plain_files(spark, tmp_path):
    a, b = tmp_path / "x" / "a.txt", tmp_path / "x" / "b.txt"
    a.parent.mkdir()
    a.write_text("<ROOT><DOC><TEXT> Mr. A. paid $5.50 in 1989. </TEXT></DOC><DOC><TEXT>two</TEXT></DOC></ROOT>")
    b.write_text("<ROOT><DOC><TEXT>three</TEXT></DOC></ROOT>")
    rows = cp.from_tagged_files(spark, str(a.parent)).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == [
        (0, "doc0", "Mr. A. paid $5.50 in 1989."), (1, "doc1", "two"), (2, "doc2", "three")
    ]
    rows = cp.from_files(spark, str(a.parent)).orderBy("doc_id").collect()
    assert [r["title"] for r in rows] == ["a.txt", "b.txt"] and rows[1]["text"] == b.read_text()


@pytest.mark.parametrize("n", [8, 9])
def test_prefix_and_regroup(spark, n):
    texts = [f"t{i} same" for i in range(n)]
    corpus = spark.createDataFrame([(10 * i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    assert [r["text"] for r in cp.prefix(corpus, 3).orderBy("doc_id").collect()] == texts[: n // 3]
    assert cp.prefix(corpus, 1).count() == n - 1 and cp.prefix(corpus, 100).count() == 0
    grouped = cp.regroup(corpus, n // 4)
    got = [r["text"] for r in grouped.orderBy("doc_id").collect()]
    want = ["".join(t + "\n" for t in texts[i : i + 4]) for i in range(0, n, 4)] + ([""] if n % 4 == 0 else [])
    assert got == want
    counts = cp.regroup_counts(mx.term_counts(mx.document_bags(corpus)), cp.regroup_map(corpus, n // 4))
    direct = mx.term_counts(mx.document_bags(grouped))
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, direct.collect()))


def test_questionnaire(spark, tmp_path):
    path = tmp_path / "q.json"
    path.write_text(json.dumps([
        {"lp_id": "LP1", "answer": "lead", "possible_answers": [{"id": "SP1", "text": "a"}, {"id": "SP2", "text": "b"}]},
        {"lp_id": "LP2", "answer": "none", "possible_answers": []},
    ]))
    q = qn.read_questionnaire(spark, str(path))
    assert sorted(map(tuple, qn.candidate_rows(q).collect())) == [("LP1", "SP1", "lead", "a"), ("LP1", "SP2", "lead", "b")]
    texts, pairs = qn.texts_and_pairs(q)
    assert texts.count() == 3 and pairs.count() == 2 and qn.most_candidates(q) == 2
    (tmp_path / "bad.json").write_text('[{"lp_id": "LP1", "possible_answers": [],},]')
    with pytest.raises(Exception):
        qn.read_questionnaire(spark, str(tmp_path / "bad.json")).collect()


def test_sheet(spark, tmp_path):
    path = tmp_path / "sheet.csv"
    head = "LP,leadParagraph," + ",".join(f"similarParagraph_{i}" for i in range(1, 7))
    path.write_text(head + '\nLP1,"lead, one",a,"b ""q""",c,d,e,f\nLP2,two,g,h,i,j,k,l\n')
    sheet = qn.read_sheet(spark, str(path))
    nested = qn.sheet_to_questionnaire(sheet)
    qn.write_questionnaire(nested, str(tmp_path / "q"))
    back = spark.read.schema(qn.SCHEMA).json(str(tmp_path / "q"))
    rows = {r["lp_id"]: r for r in back.collect()}
    assert rows["LP1"]["answer"] == "lead, one"
    assert [tuple(a) for a in rows["LP1"]["possible_answers"]][:2] == [("SP1", "a"), ("SP2", 'b "q"')]
    qn.write_sheet_tasks(sheet, str(tmp_path / "tasks"))
    assert sorted(p.name for p in (tmp_path / "tasks").glob("LP=*")) == ["LP=LP1", "LP=LP2"]


def test_answer_files_in_different_column_orders(spark, tmp_path):
    first = ["AssignmentStatus", "Input.LP", *study.ANSWERS]
    for name, columns in (("a.csv", first), ("b.csv", [*reversed(first), "More"])):
        values = {"AssignmentStatus": "Approved", "Input.LP": name, "More": "x", **{c: str(i) for i, c in enumerate(study.ANSWERS, 1)}}
        (tmp_path / name).write_text(",".join(columns) + "\n" + ",".join(values[c] for c in columns) + "\n")
    rows = study.read_worker_answers(spark, str(tmp_path)).collect()
    got = sorted((r.lp_id, r.status, r.sp_id, r.score) for r in rows)
    assert got == sorted((f, "Approved", f"SP{i}", i) for f in ("a.csv", "b.csv") for i in range(1, 7))


def test_worker_files_of_other_widths(spark, tmp_path):
    """A later file with columns ahead, one with quoted line breaks, an empty one; a lacking column is named."""
    base = ["AssignmentStatus", "Input.LP", *study.ANSWERS]

    def write(name, columns, rows):
        with open(tmp_path / name, "w", newline="") as f:
            out = csv.writer(f)
            out.writerows([columns, *[[r.get(c, "x,\ny") for c in columns] for r in rows]])

    def row(lp):
        return {"AssignmentStatus": "Approved", "Input.LP": lp, **{c: str(i) for i, c in enumerate(study.ANSWERS, 1)}}

    write("1.csv", base, [row("LP1")])
    write("2.csv", ["A", "B", "C", *base, "D"], [row("LP2"), row("LP3")])
    (tmp_path / "3.csv").write_text("")
    got = sorted((r.lp_id, r.worker, r.sp_id, r.score) for r in study.read_worker_answers(spark, str(tmp_path)).collect())
    workers = {"LP1": 0, "LP2": 1 << 32, "LP3": (1 << 32) + 1}
    assert got == sorted((lp, w, f"SP{i}", i) for lp, w in workers.items() for i in range(1, 7))
    write("4.csv", base[:-1], [row("LP4")])
    with pytest.raises(Exception, match="4.csv has no column Answer.s6"):
        study.read_worker_answers(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("buckets", [2, 7, 4096])
def test_kth_id_without_a_sort(spark, buckets):
    ids = [-(2**62), -5, 0, 3, 4, 1000, 2**40, 2**62, 2**63 - 1]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id bigint")
    assert [cp.kth_id(df, k, buckets) for k in (1, 2, 5, 8, 9)] == [ids[0], ids[1], ids[4], ids[7], ids[8]]
    assert cp.kth_id(df, 0) is None and cp.kth_id(df, 10) is None and cp.kth_id(df.limit(0), 1) is None


def test_prefix_neither_sorts_nor_writes(spark, tiny):
    plan = cp.prefix(tiny, 2)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Sort" not in plan
    assert sorted(r["doc_id"] for r in cp.prefix(tiny, 2).collect()) == [0, 1]
    assert cp.prefix(tiny, 1).count() == 3 and cp.prefix(tiny, 9).count() == 0


def test_wide_and_block_files(spark, tiny, tmp_path):
    fitted = mx.fit_matrix(tiny)
    cells = mx.cells(fitted.rows("tfidf", 1)).select("term", "doc_id", "weight")
    want = sorted((r["term"], r["doc_id"], round(r["weight"], 12)) for r in cells.collect())

    def read(df):
        return sorted((r["term"], r["doc_id"], round(r["weight"], 12)) for r in df.collect())

    ms.write_wide_csv(cells, str(tmp_path / "wide"), [0, 1, 2, 3])
    assert read(ms.read_wide_csv(spark, str(tmp_path / "wide"))) == want
    vocab = mx.vocab_index(fitted.vocab(1))
    for name, columns in (("sparse", None), ("dense", 4)):
        ms.write_blocks(cells, vocab, str(tmp_path / name), columns, block_terms=5)
        assert read(ms.read_blocks(spark, str(tmp_path / name))) == want
    assert spark.read.parquet(str(tmp_path / "sparse")).count() == 3


# The answers of one question of a published study, two of its models, and what
# it reports for them. Two candidates tie in their means.
ACCEPTED = """
6 5 2 4 3 1, 6 5 4 3 2 1, 6 5 4 1 3 2, 6 2 3 5 1 4, 6 2 5 1 3 4,
6 5 4 2 3 1, 6 4 5 1 3 2, 6 5 4 1 2 3, 6 3 2 4 1 5, 6 5 4 2 3 1
"""
REJECTED = "1 2 3 5 4 6, 4 5 6 1 3 2, 3 4 5 1 6 2"
MODELS = {
    ("docbyterm", "zeroone"): ["SP4", "SP6", "SP3", "SP5", "SP1", "SP2"],
    ("lsa", "zeroone"): ["SP4", "SP3", "SP6", "SP5", "SP1", "SP2"],
}
REPORTED = {
    "lsa:- dim:- sco:zeroone sw:yes": (0.7714285714285715, 0.6, 0.8),
    "lsa:yes dim:300 sco:zeroone sw:yes": (0.7142857142857143, 0.4666666666666666, 0.7333333333333333),
}


def test_study_reproduces_reported_measures(spark, tmp_path):
    answers = tmp_path / "answers"
    answers.mkdir()
    head = '"AssignmentStatus","Input.LP","Note",' + ",".join(f'"Answer.s{i}"' for i in range(1, 7))
    lines = [head]
    for status, block in (("Approved", ACCEPTED), ("Rejected", REJECTED)):
        for ranks in block.split(","):
            lines.append(f'"{status}","LP7","a ""note""\non two lines",' + ",".join(f'"{r}"' for r in ranks.split()))
    (answers / "batch_LP7.csv").write_text("\n".join(lines) + "\n")
    rows = []
    for (action, score), order in MODELS.items():
        args = (action, 2, True, score, 300, 1000, None)
        rows += [(f"{action}-{score}", args, "LP7", "lead", sp, f"text {sp}", i, 1 - i / 10) for i, sp in enumerate(order, 1)]
    ranked = spark.createDataFrame(
        rows, f"filename string, args {study.ARGS}, lp_id string, lead_text string, sp_id string, "
        "cand_text string, rank int, similarity double")
    study.write_results(study.nest_results(ranked, "qa"), str(tmp_path / "results"))
    back = study.read_results(spark, str(tmp_path / "results"))
    flat = study.result_rows(back)
    assert sorted((r["filename"], r["sp_id"], r["rank"], r["similarity"]) for r in flat.collect()) == sorted(
        (f, sp, rank, s) for f, _, _, _, sp, _, rank, s in rows)
    first = back.filter("model.filename = 'lsa-zeroone'").first()
    assert first["items"][0]["result_only_id"] == MODELS["lsa", "zeroone"]
    assert first["items"][0]["result_as_pdf"]["text"]["SP4"] == "text SP4"

    out = evaluate_study(spark, str(tmp_path / "results"), str(answers))
    got = {r["model"]: r for r in out.collect()}
    assert got.keys() == REPORTED.keys()
    for model, want in REPORTED.items():
        r = got[model]
        assert (r["spearman_corr"], r["kendall_corr"], r["order_preservation_measure"]) == pytest.approx(want, abs=1e-9)
    study.write_evaluation(out, str(tmp_path / "eval"), ["LP7"])
    table = spark.read.csv(str(tmp_path / "eval_kendall"), header=True, inferSchema=True).collect()
    assert {r["model"]: r["LP7"] for r in table} == {m: pytest.approx(w[1]) for m, w in REPORTED.items()}
    assert spark.read.json(str(tmp_path / "eval")).count() == 2
    study.write_similarity_table(flat, str(tmp_path / "table"))
    table = spark.read.csv(str(tmp_path / "table"), header=True, inferSchema=True)
    assert table.columns == ["model", *[f"LP7-SP{i}" for i in range(1, 7)]] and table.count() == 2
    wide = study.similarity_table(flat, ["LP7-SP4", "LP7-SP2"]).collect()
    assert all(r["LP7-SP4"] == pytest.approx(0.9) for r in wide)
    points = ev.worker_points(study.read_worker_answers(spark, str(answers)).filter(study.accepted()), ["lp_id"], "sp_id", F.col("worker"), "score")
    assert points.count() == 60


def test_model_round_trip(spark, tiny, tmp_path):
    fitted = mx.fit_matrix(tiny)
    config = ModelConfig(min_document_frequency=2, score="tfidf")
    ms.save_matrix(fitted, config, str(tmp_path / "m"))
    rows, vocab, loaded, n_docs = ms.load_matrix(spark, str(tmp_path / "m"))
    assert loaded == config and n_docs == 4 and vocab.count() == 5
    meta = ms.read_meta(spark, str(tmp_path / "m")).first()
    assert (meta["wordcount"], meta["ignored"], meta["dataSize"]) == (5, 9, [5, 4])

    def cells(df):
        return sorted((r["term"], r["doc_id"], round(r["weight"], 12)) for r in df.collect())

    assert cells(mx.cells(rows)) == cells(mx.cells(fitted.rows("tfidf", 2)))
    ms.write_cells_csv(rows, str(tmp_path / "csv"))
    read = ms.read_cells_csv(spark, str(tmp_path / "csv"))
    assert cells(read) == cells(mx.cells(rows))
    wide = {r["term"]: r for r in ms.wide_matrix(read, [0, 1, 2, 3]).collect()}
    assert wide["lamp"]["0"] == 0.0 and wide["lamp"]["1"] > 0
    reduced = ModelConfig("lsa", 2, False, "count", 2)
    model = lsa.fit_lsa(fitted, reduced)
    ms.save_lsa(model, reduced, str(tmp_path / "l"))
    back, config2 = ms.load_lsa(spark, str(tmp_path / "l"))
    assert config2 == reduced and back.unknown == pytest.approx(model.unknown)
    with pytest.raises(Exception):
        ms.read_meta(spark, str(tmp_path / "absent")).first()
