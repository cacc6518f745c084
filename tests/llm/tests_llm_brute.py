"""Plain versions of two stages, for the pipeline's test."""

from test_decontaminate import words
from test_ngram_join import brute


def groups(docs):
    return {i: c for i, _, c in brute([(int(i), t) for i, t in docs])}


def contaminated(text, items):
    w = words(text)
    own = {n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for n in range(1, 11)}
    return any((k := min(10, len(v))) and any(tuple(v[i : i + k]) in own[k] for i in range(len(v) - k + 1)) for v in map(words, items))
