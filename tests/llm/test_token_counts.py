import random

import pytest
from tokenizers import Tokenizer, models

from lexigauge.llm import token_counts as tc


def exact(vocabulary, text):
    tok = Tokenizer(models.Unigram(list(vocabulary.scores.items()), unk_id=0, byte_fallback=vocabulary.byte_fallback))
    return len(tok.encode(tc.SPACE + text.replace(" ", tc.SPACE)).ids) if text else 0


def test_against_the_tokenizer(spark, make_docs):
    vocabulary = tc.read_vocabulary()
    assert vocabulary.cut and vocabulary.byte_fallback
    draw = random.Random(1)
    texts = ["", " ", "  a   b ", "a\nb\n\nc", "日本語 ✓✓ 😀x", "<s> <0x0A>", "x" * 3000, "der die das " * 3000]
    texts += ["".join(draw.choice(" \nabcdefé日😀▁<>") for _ in range(draw.randrange(60))) for _ in range(300)]
    tok = Tokenizer(models.Unigram(list(vocabulary.scores.items()), unk_id=0, byte_fallback=True))
    want = {k: len(tok.encode(tc.SPACE + t.replace(" ", tc.SPACE)).ids) if t else 0 for k, t in enumerate(texts)}
    docs = make_docs([*enumerate(texts), (9000, None), (3, texts[3])])
    got = tc.count_tokens(docs, vocabulary).collect()
    assert len(got) == len(texts) + 2 and all(r.n_tokens == want.get(r.doc_id, 0) for r in got)
    assert tc.count_tokens(make_docs([]), vocabulary).count() == 0


@pytest.mark.parametrize("fallback", [False])
def test_ties_and_unknown_runs(fallback):
    scores = {"<unk>": 0.0, "a": -1.0, "b": -1.0, "ab": -2.0, "ba": -2.0, "aba": -3.0, tc.SPACE: -1.5, tc.SPACE + "a": -2.5, "c" + tc.SPACE: -1.0}
    vocabulary, draw = tc.Vocabulary(scores, fallback), random.Random(2)
    assert not vocabulary.cut
    counter = tc.Counter(vocabulary)
    for _ in range(500):
        text = "".join(draw.choice("ab cz?") for _ in range(draw.randrange(1, 20)))
        assert counter.tokens(text) == exact(vocabulary, text), text
