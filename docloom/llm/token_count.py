"""Token counts of a unigram tokenizer, without building the tokens.

An Aho-Corasick automaton of the vocabulary finds every piece at every place of a word, and dynamic programming carries
only two numbers to each place: the best score of the pieces up to it, and how many they are. The rules are the tokenizer's:
the best sum of scores; of equal ones the path whose last piece begins first; a character that is no piece by itself may
stand alone at ten below the lowest score, and counts as one for each byte where the vocabulary has pieces for bytes, while
neighbours of that kind count as one together where it has none.

Words are cut where the vocabulary cannot reach across, so that equal words of a task are counted once.
"""

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.worker import kept, sums, text_parts

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
KEPT_WORDS = 500_000


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their scores; `bytes` tells that unknown characters become pieces of bytes."""

    scores: dict[str, float]
    bytes: bool

    @staticmethod
    def read(path: str) -> "Vocabulary":
        """From a sentencepiece model: its normal pieces, as they are, and their scores."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(model.vocab_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        return Vocabulary({model.id_to_piece(i): model.get_score(i) for i in normal}, any(model.is_byte(i) for i in range(model.vocab_size())))


class Counter:
    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.scores.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.bytes = vocabulary.bytes
        self.unknown = min(vocabulary.scores.values(), default=0.0) - UNKNOWN_PENALTY
        # A space mark that only stands at the beginning of pieces, or in pieces of nothing else, ends the reach of a word.
        self.cut = not any(SPACE in p.lstrip(SPACE) for p in vocabulary.scores)
        self.words_in = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall
        self.known: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Pieces of the best path."""
        n = len(word)
        # Best score and pieces up to each place, and whether the last piece is unknown.
        best, count, unknown = [0.0] + [-math.inf] * n, [0] * (n + 1), [False] * (n + 1)

        def alone(end: int):
            total = best[end - 1] + self.unknown
            if total > best[end]:
                best[end], unknown[end] = total, True
                if self.bytes:
                    count[end] = count[end - 1] + len(word[end - 1].encode("utf-8", "surrogatepass"))
                else:
                    count[end] = count[end - 1] + (not unknown[end - 1])

        # Matches come by their ends, and those of one end by length, the longest first: so the first of equals begins first.
        at, by_itself = 0, True
        for end, (length, score) in self.automaton.iter(word):
            end += 1
            if end != at:
                if not by_itself:
                    alone(at)
                for k in range(at + 1, end):
                    alone(k)
                at, by_itself = end, False
            total = best[end - length] + score
            if total > best[end]:
                best[end], count[end] = total, count[end - length] + 1
            by_itself = by_itself or length == 1
        if not by_itself:
            alone(at)
        for k in range(at + 1, n + 1):
            alone(k)
        return count[n]

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text: spaces become marks, and a mark is put before a text that is not empty."""
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        marked = [(SPACE + t.replace(" ", SPACE)) if t else "" for t in texts]
        words = [self.words_in(t) if self.cut else [t] for t in marked]
        known, count = self.known, self.count
        for w in set(chain.from_iterable(words)).difference(known):
            known[w] = count(w)
        flat = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.int64)
        return sums(flat, np.array([len(w) for w in words], np.int64))


def token_counts(df: DataFrame, text: str, vocabulary: Vocabulary, out: str = "n_tokens") -> DataFrame:
    """Add the number of tokens of a text column. `out` replaces a column of that name.

    Null and empty texts have none. Texts are whole, however long. No shuffle.
    """
    names = [c for c in df.columns if c != out]
    at = names.index(text)
    shared = df.sparkSession.sparkContext.broadcast((vocabulary.scores, vocabulary.bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, has_bytes = shared.value
        counter = kept(("unigram", has_bytes, hash(frozenset(scores.items()))), lambda: Counter(Vocabulary(scores, has_bytes)))
        for part in text_parts(batches, at):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(counter.counts(part.column(at).to_pylist()))], [*names, out])

    rows = df.select(*[F.col("`" + c.replace("`", "``") + "`") for c in names])
    return rows.mapInArrow(run, rows.withColumn(out, F.lit(0).cast("long")).schema)
