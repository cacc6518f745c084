"""Language of a text by cross-parsing against suffix automata.

Labelled text of each language becomes a suffix automaton. A text is parsed into the longest phrases
that occur in a language's text; the language that needs the fewest phrases for a letter wins. The
parses of many blocks of text run side by side in numpy.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigauge.llm.common import Shared, keep_rows, map_pieces, texts_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Characters of labelled text for all languages together; what is learned never exceeds this.
TRAIN_CHARS = 120_000
# Characters taken of one labelled document, so that no single one speaks for a language.
DOC_CHARS = 2_000
# Symbols of the automata: 0 stands for everything between words, 1 for a letter never learned, which
# no phrase holds; every learned letter has its own.
GAP, STRANGE = 0, 1
# Places that are tried for a row of a transition table before the search moves on.
TRIES = 32
# A parse starts anew after so many symbols; all of a text is parsed.
BLOCK = 256
UNDETERMINED = "und"
# Texts whose best language needs more phrases than this for a letter are in none of them.
REJECT_SCORE = 0.55

DIGEST = "doc_id bigint, held_out boolean, lang_pred string, score double"


def code_points(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points, and each text's number of them."""
    wide = [t.decode("utf-8", "replace").encode("utf-32-le") if t else b"" for t in texts]
    return np.frombuffer(b"".join(wide), np.uint32), np.array([len(w) // 4 for w in wide], np.int64)


def letter_table() -> np.ndarray:
    """True for the letters among all code points."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)])


def lower_table() -> np.ndarray:
    """Lower-cased code point where that is a single one."""
    low = [chr(c).lower() if not 0xD800 <= c < 0xE000 else chr(c) for c in range(sys.maxunicode + 1)]
    return np.array([ord(s) if len(s) == 1 else c for c, s in enumerate(low)], np.uint32)


def suffix_automaton(symbols: np.ndarray) -> list[dict[int, int]]:
    """Transitions symbol -> state of every state, of all substrings of ``symbols``; the start is state 0
    and nothing leads back to it."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0

    def state(size: int, to: int, out: dict[int, int]) -> int:
        length.append(size)
        link.append(to)
        go.append(out)
        return len(length) - 1

    for c in symbols.tolist():
        new = state(length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = state(length[p] + 1, link[q], dict(go[q]))
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return go


def interleave(go: list[dict[int, int]]) -> np.ndarray:
    """The transitions in one table: a state is the place where its row begins, and the entry at state +
    symbol holds the state whose row it is in (upper half) and the next one (lower half), -1 where no row
    has it. Rows lie between each other, so the table grows with the transitions, whatever the alphabet.
    The start is 0; the last entry is empty."""
    base, taken, begun = [0] * len(go), bytearray(1 << 12), bytearray(1 << 12)
    low = 0  # the search for a place begins here
    for k in [0, *sorted(range(1, len(go)), key=lambda k: -len(go[k]))]:
        row = sorted(go[k]) or [0]
        at, tries = low, 0
        while k:
            at = taken.find(0, at)  # a free entry for the first symbol
            if at < 0:
                at = len(taken)
            need = at + row[-1] - row[0] + 1
            if need > len(taken):
                taken.extend(bytes(need))
                begun.extend(bytes(need))
            b = at - row[0]
            if b > 0 and not begun[b] and not any(taken[b + c] for c in row):
                break
            at += 1
            tries += 1
            if tries == TRIES:
                low, tries = max(low, at - TRIES // 2), 0
        b = at - row[0] if k else 0
        if b + row[-1] >= len(taken):
            taken.extend(bytes(b + row[-1] + 1))
            begun.extend(bytes(b + row[-1] + 1))
        base[k], begun[b] = b, 1
        for c in go[k]:
            taken[b + c] = 1
    table = np.full(taken.rfind(1) + 2, -1, np.int64)
    for k, row in enumerate(go):
        for c, to in row.items():
            table[base[k] + c] = base[k] << 32 | base[to]
    return table


@dataclass
class LanguageModel:
    names: list[str]
    symbol_of: np.ndarray  # code point -> symbol
    letters: np.ndarray
    automata: list[np.ndarray]

    def symbols(self, points: np.ndarray) -> np.ndarray:
        return self.symbol_of[points]

    def parse(self, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that each text needs in each language, and its letters."""
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        symbols = self.symbols(points)
        is_letter = self.letters[points]
        n_letters = np.bincount(owner[is_letter], minlength=len(sizes))
        # one gap between words, however long
        keep = symbols > 0
        keep[1:] |= symbols[:-1] > 0
        symbols, owner = symbols[keep], owner[keep]
        kept = np.bincount(owner, minlength=len(sizes))
        begin = np.cumsum(kept) - kept
        n_blocks = -(-kept // BLOCK)
        block_owner = np.repeat(np.arange(len(sizes)), n_blocks)
        first = begin[block_owner] + (np.arange(len(block_owner)) - (np.cumsum(n_blocks) - n_blocks)[block_owner]) * BLOCK
        width = np.minimum(BLOCK, (begin + kept)[block_owner] - first)
        order = np.argsort(-width, kind="stable")
        block_owner, first, width = block_owner[order], first[order], width[order]
        alive = np.searchsorted(-width, -np.arange(BLOCK), "left")  # blocks with more than t symbols
        phrases = np.zeros((len(self.names), len(sizes)), np.int64)
        columns = [symbols[first[:n] + t] for t, n in enumerate(alive.tolist())]
        for k, table in enumerate(self.automata):
            state = np.zeros(len(first), np.int64)
            count = np.zeros(len(first), np.int32)
            for c in columns:
                n = len(c)
                if not n:
                    break
                # a phrase begins at the start, after a symbol of no phrase, and where none goes on
                entry = table.take(state[:n] + c, mode="clip")
                broken = np.flatnonzero(entry >> 32 != state[:n])
                count[:n] += state[:n] == 0
                count[broken] += state[broken] != 0
                again = table.take(c[broken], mode="clip")
                entry[broken] = np.where(again >> 32 == 0, again, 0)
                state[:n] = entry & 0xFFFFFFFF
            phrases[k] = np.bincount(block_owner, weights=count, minlength=len(sizes)).astype(np.int64)
        return phrases, n_letters

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language of each text; how far it is ahead of the next; its phrases for a letter."""
        points, sizes = code_points(texts)
        phrases, n_letters = self.parse(points, sizes)
        rate = phrases / np.maximum(n_letters, 1)
        known = (n_letters > 0) & (len(self.names) > 0)
        if not self.names:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts))
        best = rate.argmin(axis=0)
        low = rate[best, np.arange(len(texts))]
        others = rate.copy()
        others[best, np.arange(len(texts))] = np.inf
        second = others.min(axis=0)
        score = np.where(np.isinf(second), 1.0, 1.0 - low / np.maximum(second, 1e-12))
        names = [self.names[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)]
        return names, np.where(known, np.clip(score, 0.0, 1.0), 0.0), np.where(known, low, 1.0)


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def first_texts(rows: DataFrame, parts: dict[str, float], share: int) -> DataFrame:
    """``(lang, place, text)``: the distinct texts of each language in that part of the hash range, in the
    order of the hash, until they hold ``share`` characters."""
    part = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair])[F.col("lang")]
    near = rows.filter(F.pmod("h", F.lit(1 << 20)) < part * (1 << 20))
    once = near.groupBy("lang", "h").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 20)), "h")
    before = F.sum(F.length("text")).over(order) - F.length("text")
    return once.select("lang", F.row_number().over(order).alias("place"), "text", before.alias("before")).filter(F.col("before") < share).drop("before")


def train(docs: DataFrame, train_chars: int = TRAIN_CHARS) -> LanguageModel:
    """Automata of the languages in ``lang``, from documents that are not held out.

    Of each language as many documents as its share of ``train_chars`` needs, or all where they hold
    less, by the order of a hash of the text, which copies share and which therefore count once.
    """
    rows = docs.filter(~held_out() & F.col("lang").isNotNull() & (F.length("text") > 0))
    rows = rows.select("lang", F.xxhash64("text").alias("h"), F.substring("text", 1, DOC_CHARS).alias("text"))
    once = rows.groupBy("lang", "h").agg(F.min(F.length("text")).alias("n"))
    there = {r[0]: r[1] for r in once.groupBy("lang").agg(F.sum("n")).collect()}
    langs = sorted(there)
    if not langs:
        return fit({})
    share = train_chars // len(langs)
    # a slice of the hash range that holds several times as much, so that little is ordered
    parts = {k: min(1.0, (4 * share + 16 * DOC_CHARS) / there[k]) for k in langs}
    texts: dict[str, list[tuple[int, str]]] = {}
    while parts:
        for lang, place, text in first_texts(rows, parts, share).toLocalIterator():
            texts.setdefault(lang, []).append((place, text))
        # a slice that held less than expected is read again, wider
        short = [k for k in parts if parts[k] < 1 and sum(len(t) for _, t in texts.get(k, [])) < min(share, there[k])]
        parts = {k: min(1.0, 8 * parts[k]) for k in short}
        for k in short:
            texts.pop(k, None)
    lower, letters = lower_table(), letter_table()
    chosen = {}
    for lang in langs:
        out, n = [], 0
        for _, text in sorted(texts.get(lang, [])):
            out.append(text[: share - n])
            n += len(out[-1])
            if n >= share:
                break
        chosen[lang] = "\n".join(out)
    return fit({k: v for k, v in chosen.items() if v}, lower, letters)


def fit(chosen: dict[str, str], lower: np.ndarray | None = None, letters: np.ndarray | None = None) -> LanguageModel:
    """Model of given text for each language."""
    lower = lower_table() if lower is None else lower
    letters = letter_table() if letters is None else letters
    points = {k: lower[np.frombuffer(v.encode("utf-32-le", "replace"), np.uint32)] for k, v in chosen.items()}
    every = np.concatenate([*points.values(), np.zeros(0, np.uint32)])
    found, n = np.unique(every[letters[every]], return_counts=True)
    symbol_of = np.where(letters, STRANGE, GAP).astype(np.int32)
    symbol_of[found[np.lexsort((found, -n))]] = np.arange(2, 2 + len(found))
    symbol_of = symbol_of[lower]
    names = sorted(points)
    automata = []
    for name in names:
        s = symbol_of[points[name]]
        keep = s > 0
        keep[1:] |= s[:-1] > 0
        automata.append(interleave(suffix_automaton(s[keep])))
    return LanguageModel(names, symbol_of, letters, automata)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every document.

    ``score`` is 1 - phrases / phrases of the next language. A null text, or one without a letter, is
    ``und`` with score 0. Repeated rows each get their row. With no labelled text all are ``und``.
    """
    shared = Shared(docs.sparkSession, model)

    def f(piece: pa.RecordBatch) -> pa.RecordBatch:
        names, score, _ = shared.value.predict(texts_of(piece))
        return pa.RecordBatch.from_arrays(
            [piece.column("doc_id").cast(pa.int64()), piece.column("held_out"), pa.array(names, pa.string()), pa.array(score)],
            names=["doc_id", "held_out", "lang_pred", "score"])

    return map_pieces(docs.select("doc_id", "text", held_out().alias("held_out")), f, DIGEST)


def keep_known(docs: DataFrame, model: LanguageModel, languages: frozenset[str] | None = None, most_phrases: float = REJECT_SCORE) -> DataFrame:
    """Documents in one of ``languages`` (all learned ones by default), with all their columns.

    Rejected are texts without letters and texts that need more than ``most_phrases`` phrases for a
    letter even in their best language, which are in none of them.
    """
    shared = Shared(docs.sparkSession, model)

    def mask(piece: pa.RecordBatch) -> np.ndarray:
        names, _, rate = shared.value.predict(texts_of(piece))
        wanted = np.array([n != UNDETERMINED and (languages is None or n in languages) for n in names])
        return wanted & (rate <= most_phrases)

    return keep_rows(docs, mask)
