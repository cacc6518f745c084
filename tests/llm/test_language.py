import numpy as np
from pyspark.sql import functions as F

from lexigauge.llm import language as lg


def test_parse_against_brute_force():
    draw = np.random.default_rng(3)
    train = {"x": "abab cab bac", "y": "ddd abd dab"}
    model = lg.fit(train)
    for n in (0, 1, 5, 700):
        text = "".join(draw.choice(list("abcd  é"), n))
        phrases, letters = model.parse(*lg.code_points([text.encode()]))
        assert letters[0] == sum(c.isalpha() for c in text)
        s = model.symbols(lg.code_points([text.encode()])[0])
        keep = [c for i, c in enumerate(s) if c or (i and s[i - 1])]
        for k, name in enumerate(model.names):
            known = model.symbols(np.frombuffer(train[name].encode("utf-32-le"), np.uint32)).tolist()
            learned = "".join(map(chr, known))
            count = 0
            for b in range(0, len(keep), lg.BLOCK):
                block, at = "".join(map(chr, keep[b : b + lg.BLOCK])), 0
                while at < len(block):
                    end = at + 1
                    while end <= len(block) and block[at:end] in learned:
                        end += 1
                    at = max(at + 1, end - 1)
                    count += 1
            assert phrases[k, 0] == count


def test_held_out_accuracy_and_odd_texts(spark, make_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = lg.train(docs)
    got = lg.identify(docs, model).join(docs, "doc_id").filter("held_out AND length(text) > 40")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    odd = make_docs([(1, None), (2, ""), (3, "123 !!"), (4, "the"), (4, "the"), (5, "Das ist " * 30000), (None, "x")])
    found = {(r.doc_id, r.lang_pred) for r in lg.identify(odd, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (5, "de")} <= found and lg.identify(odd, model).count() == 7
    assert all(0 <= r.score <= 1 for r in lg.identify(odd, model).collect())
    kept = lg.keep_known(odd, model)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {4, 5}
    assert kept.filter("doc_id IN (1, 2, 3)").count() == 0


def test_nothing_learned(make_docs):
    docs = make_docs([(1, "words", None), (2, "more", None)])
    model = lg.train(docs)
    assert {r.lang_pred for r in lg.identify(docs, model).collect()} == {"und"}
    assert lg.identify(make_docs([]), lg.train(make_docs([]))).count() == 0


def test_short_texts_and_copies_teach_whole_shares(spark, monkeypatch):
    learned = {}
    monkeypatch.setattr(lg, "fit", lambda chosen, *rest: learned.update(chosen))
    short = spark.range(4000).selectExpr("id AS doc_id", "concat('short text ', md5(cast(id AS string))) AS text", "'s' AS lang")
    copies = spark.range(300000).selectExpr("id + 10000 AS doc_id", "if(id < 298000, 'one text', concat('other ', repeat(md5(cast(id AS string)), 8))) AS text", "'c' AS lang")
    scarce = spark.range(40).selectExpr("id + 900000 AS doc_id", "md5(cast(id AS string)) AS text", "'f' AS lang")
    lg.train(short.unionAll(copies).unionAll(scarce), 60_000)
    sizes = {k: len(v.replace("\n", "")) for k, v in learned.items()}
    there = scarce.filter(~lg.held_out()).count() * 32
    assert sizes == {"s": 20_000, "c": 20_000, "f": there}
    assert learned["c"].split("\n").count("one text") <= 1


def test_every_letter_counts():
    draw = np.random.default_rng(5)

    def words(first, n, size, k):
        return " ".join("".join(chr(c) for c in draw.integers(first, first + n, k)) for _ in range(size))

    latin = words(0x61, 26, 3000, 5)
    model = lg.fit({"a": latin, "cyr": words(0x430, 32, 100, 5), "han1": words(0x4E00, 300, 300, 8), "han2": words(0x6000, 300, 300, 8), "got": words(0x10330, 27, 100, 5)})
    texts = [words(0x61, 26, 50, 5), words(0x430, 32, 50, 5), words(0x4E00, 300, 50, 8), words(0x6000, 300, 50, 8), words(0x10330, 27, 50, 5)]
    names, score, rate = model.predict([t.encode() for t in texts])
    assert names == ["a", "cyr", "han1", "han2", "got"] and (score > 0.05).all()
    # no letter of an untaught script goes on with a phrase; characters that are no letters do not count
    strange = [words(0x531, 38, 50, 6).encode(), words(0x20000, 300, 50, 6).encode(), ("\U0001F600" * 50).encode()]
    names, score, rate = model.predict(strange)
    assert (rate[:2] > lg.REJECT_SCORE).all() and rate[0] >= 1 and rate[1] >= 1
    assert names[2] == lg.UNDETERMINED and score[2] == 0


def test_interleaved_rows_are_the_automaton():
    draw = np.random.default_rng(7)
    for alphabet, n in ((3, 400), (900, 2000)):
        text = draw.integers(2, 2 + alphabet, n)
        go = lg.suffix_automaton(text)
        table = lg.interleave(go)
        assert (table >= 0).sum() == sum(map(len, go)) and table[-1] == -1
        place, todo = {0: 0}, [0]
        while todo:
            k = todo.pop()
            for c, to in go[k].items():
                entry = int(table[place[k] + c])
                assert entry >> 32 == place[k]
                if to not in place:
                    todo.append(to)
                assert place.setdefault(to, entry & 0xFFFFFFFF) == entry & 0xFFFFFFFF
        assert len(place) == len(set(place.values())) == len(go)
