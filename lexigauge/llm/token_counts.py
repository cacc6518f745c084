"""Token counts of a unigram tokenizer without its tokens.

An Aho-Corasick automaton finds all vocabulary pieces in a stretch of text; dynamic programming over
its ends carries the best score and the number of pieces of that best way. Ties go to the longer last
piece, as in the tokenizer. Stretches that no piece crosses are counted on their own and remembered.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from lexigauge.llm.common import Shared, map_pieces, texts_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
# What a character without a piece scores below the lowest piece; fixed value of the tokenizer.
UNKNOWN_PENALTY = 10.0
# Stretches that a task remembers, and the longest of them.
CACHE_ENTRIES = 300_000
CACHE_LENGTH = 64

DIGEST = "doc_id bigint, n_chars bigint, n_tokens bigint"


@dataclass
class Vocabulary:
    """Pieces and scores; ``byte_fallback``: a character without a piece becomes its bytes, else one
    token for each run of such characters."""

    scores: dict[str, float]
    byte_fallback: bool
    cut: bool = field(init=False)

    def __post_init__(self) -> None:
        # text may be cut before a space mark and around a line end if no piece runs across, and if sums
        # of scores are exact, so that ties do not hang on what came before
        crossing = re.compile(f"[^{SPACE}]{SPACE}|.\n|\n.", re.S)
        self.cut = self.byte_fallback and all(float(s).is_integer() for s in self.scores.values()) and not any(crossing.search(p) for p in self.scores)


def read_vocabulary(path: str = MODEL) -> Vocabulary:
    """Pieces of a SentencePiece file, with their scores; read by the driver alone."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.GetPieceSize()
    scores = {model.IdToPiece(i): model.GetScore(i) for i in range(n)}
    return Vocabulary(scores, all(f"<0x{b:02X}>" in scores for b in range(256)))


class Counter(dict):
    """Stretch of text -> its number of tokens, counted when first asked for."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.scores.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(vocabulary.scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.byte_fallback, self.cut = vocabulary.byte_fallback, vocabulary.cut
        self.pattern = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+")

    def count(self, text: str) -> int:
        """Pieces of the best way through ``text``: the highest sum of scores, at each end the
        longest last piece among equals."""
        n = len(text)
        best, pieces, unknown = [0.0] + [0.0] * n, [0] * (n + 1), [False] * (n + 1)
        end, found = 0, []

        def close(e: int, matches: list) -> None:
            top, count, odd = None, 0, False
            for size, score in matches:  # the longest first
                value = best[e - size] + score
                if top is None or value > top:
                    top, count = value, pieces[e - size] + 1
            if not any(size == 1 for size, _ in matches):
                value = best[e - 1] + self.unknown
                if top is None or value > top:
                    more = len(text[e - 1].encode("utf-8", "replace")) if self.byte_fallback else int(not unknown[e - 1])
                    top, count, odd = value, pieces[e - 1] + more, True
            best[e], pieces[e], unknown[e] = top, count, odd

        for last, match in self.automaton.iter(text):
            while end <= last - 1:
                end += 1
                close(end, found)
                found = []
            found.append(match)
        while end < n:
            end += 1
            close(end, found)
            found = []
        return pieces[n]

    def __missing__(self, text: str) -> int:
        n = self.count(text)
        if len(text) <= CACHE_LENGTH:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[text] = n
        return n

    def tokens(self, text: str) -> int:
        """Tokens of a whole text: spaces become marks, and one stands before the first word."""
        if not text:
            return 0
        marked = SPACE + text.replace(" ", SPACE)
        if not self.cut:
            return self.count(marked)
        return sum(map(self.__getitem__, self.pattern.findall(marked)))


def count_tokens(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``(doc_id, n_chars, n_tokens)`` for every document, whole texts.

    A null or empty text has no characters and no tokens. Repeated rows each get their row; other
    columns are not looked at.
    """
    shared, memory = Shared(docs.sparkSession, vocabulary), {}

    def f(piece: pa.RecordBatch) -> pa.RecordBatch:
        if "counter" not in memory:
            memory["counter"] = Counter(shared.value)
        texts = [t.decode("utf-8", "replace") if t else "" for t in texts_of(piece)]
        return pa.RecordBatch.from_arrays(
            [piece.column("doc_id").cast(pa.int64()), pa.array(np.array([len(t) for t in texts], np.int64)),
             pa.array([memory["counter"].tokens(t) for t in texts], pa.int64())],
            names=["doc_id", "n_chars", "n_tokens"])

    return map_pieces(docs.select("doc_id", "text"), f, DIGEST)
