import pytest
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from lexigauge import ModelConfig, sweep_configs
from lexigauge.functions import labels
from lexigauge.functions import text as tx
from lexigauge.functions.stopwords import ENGLISH

CASES = [
    ("It cost $33,333.34 in 1999", "it cost @PRICE@ in @YEAR@"),
    ("$5 only", "5 only"),
    ("$12 and £5.5", "@PRICE@ and @PRICE@"),
    ("12345", "@YEAR@ 5"),
    ("O'Leary's", "o leary s"),
    ("a@b@c", "a @b@ c"),
    ("été ñu", "été ñu"),
    ("home 2020 maybe $190,900.45", "home @YEAR@ maybe @PRICE@"),
    ("...", ""),
    ("", ""),
    (None, ""),
]


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,want", CASES)
def test_tokens(spark, text, want):
    assert one(spark, text, tx.tokens(F.col("text"))) == want.split()


def test_guard_bag_and_stop_words(spark):
    assert one(spark, "The", tx.guarded(tx.tokens(F.col("text"), ENGLISH))) == [""]
    assert [tuple(r) for r in one(spark, "b a b", tx.bag(tx.tokens(F.col("text"))))] == [("a", 1), ("b", 2)]
    assert one(spark, "...", tx.bag(tx.tokens(F.col("text")))) == []


def test_own_pattern_and_preprocessing(spark):
    found = tx.tokens(F.col("text"), preprocess=F.upper, pattern="[A-Z]+")
    assert one(spark, "ab 1 c", found) == ["AB", "C"]


def test_stop_list_is_sparks(spark):
    assert sorted(ENGLISH) == sorted(StopWordsRemover.loadDefaultStopWords("english"))


def test_split_words_and_tags(spark):
    assert one(spark, " The  Cat, ", tx.split_words(F.col("text"))) == ["the", "cat,"]
    assert one(spark, "<P a=1>x\ny</P><pre>no</pre><p>z</p>", tx.tagged(F.col("text"), "p")) == ["x\ny", "z"]


def test_labels(spark):
    configs = sweep_configs()
    assert len(configs) == 18 and len(set(configs)) == 18
    rows = [(c.action, c.svd_components, c.score, c.stopwords, c.label()) for c in configs]
    df = spark.createDataFrame(rows, "a string, d int, s string, w boolean, want string")
    args = [F.col(c) for c in "adsw"]
    got = df.select("want", labels.model_name(*args).alias("n"), labels.model_description(*args).alias("d")).collect()
    assert all(r["want"] == r["n"] for r in got)
    assert "lsa:yes dim:300 sco:tfidf sw:yes" in {r["d"] for r in got}


def test_config_rules():
    c = ModelConfig(action="lsa", svd_components=100, truncate_matrix=1000)
    assert (c.components_for(101), c.components_for(100)) == (100, 99)
    assert (c.truncation_for(100), c.truncation_for(101)) == (None, 1000)
    with pytest.raises(ValueError):
        ModelConfig(score="bm25")


def test_tail_of_the_error_function(spark):
    import math

    from lexigauge.functions.stats import erfc

    xs = [0.0, 0.3, 1.0, 1.9, 1.999, 2.0, 2.5, 4.0, 6.5, 12.0, 20.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", erfc(F.col("x")).alias("y")).collect():
        assert abs(r.y - math.erfc(r.x)) < 1e-12 + 1e-9 * math.erfc(r.x)
        assert r.x < 2 or abs(r.y / math.erfc(r.x) - 1) < 1e-9
