"""Token counts of a unigram tokenizer without making the tokens.

An Aho-Corasick automaton finds every vocabulary piece in a word; dynamic
programming over the ends of the matches carries the best score and the number
of pieces of the best path, and nothing else. Ties go as in the tokenizer: of
equal scores the path whose last piece starts first wins. A character that no
piece of its own length covers costs the least score less 10 and stands for
its UTF-8 bytes (byte fallback) or, with its neighbours, for one unknown piece.

Words are what the metaspace rule makes: blanks become U+2581, one is put
before the text, and each word starts at one. Counts of words are remembered by
the Python worker in a table of bounded size, which changes speed only.

Cases: null or empty text: 0 tokens. Texts are taken whole, whatever their
length; time is linear in it. Rows are independent, so repeated rows and
further columns pass through, and an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shutterlake.llm.common import tidied

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Words that a worker remembers.
REMEMBER = 1_000_000
_LOADED: dict = {}


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and log probabilities of a sentencepiece file.

    A unigram model's own scores are kept. A BPE file has ranks in their place;
    the n-th piece then gets Zipf's -log(n + 1) - log(H), H normalising them.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    scores = [sp.get_score(i) for i in ids]
    if all(s == int(s) for s in scores):  # ranks
        total = math.log(sum(1 / (n + 1) for n in range(len(ids))))
        scores = [-math.log(n + 1) - total for n in range(len(ids))]
    return [(sp.id_to_piece(i), s) for i, s in zip(ids, scores, strict=True)]


class Counter(dict):
    """Maps a word without its leading mark to its number of pieces."""

    def __init__(self, vocab: list[tuple[str, float]], byte_fallback: bool = True):
        import ahocorasick

        super().__init__()
        self.byte_fallback = byte_fallback
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocab:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocab) - UNKNOWN_PENALTY

    def __missing__(self, word: str) -> int:
        n = self.pieces(SPACE + word)
        if len(self) >= REMEMBER:
            self.clear()
        if len(word) <= 64:
            self[word] = n
        return n

    def pieces(self, word: str) -> int:
        """Pieces of the best path over a word.

        Matches come by their end, and of one end the longest first, so that a
        strict comparison prefers the earlier start; the single unknown
        character, the latest start of all, is tried when an end is closed.
        """
        size = len(word)
        best, count = [0.0] * (size + 1), [0] * (size + 1)
        unknown: set[int] = set()
        now, top, came, single = 0, None, 0, True

        def close(to: int) -> None:
            """Settles the ends up to `to`; of the first of them matches have been seen."""
            nonlocal top, single
            for end in range(now, to):
                if not single and (top is None or best[end - 1] + self.unknown > top):
                    if self.byte_fallback:
                        n = count[end - 1] + len(word[end - 1].encode("utf-8", "surrogatepass"))
                    else:
                        n = count[end - 1] + (end - 1 not in unknown)
                    best[end], count[end] = best[end - 1] + self.unknown, n
                    unknown.add(end)
                elif end:
                    best[end], count[end] = top, count[came] + 1
                top, single = None, False

        for last, (length, score) in self.automaton.iter(word):
            if last >= now:
                if now < last or not single or top is None:
                    close(last + 1)
                else:
                    best[now], count[now] = top, count[came] + 1
                now, top, single = last + 1, None, False
            total = score + best[now - length]
            if top is None or total > top:
                top, came = total, now - length
            if length == 1:
                single = True
        close(size + 1)
        return count[size]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        words = text.replace(SPACE, " ").split(" ")
        if len(words) > 1 and not words[0]:
            del words[0]
        return sum(map(self.__getitem__, words))


def counter(path: str, byte_fallback: bool = True) -> Counter:
    """The worker's counter for a file."""
    if (path, byte_fallback) not in _LOADED:
        _LOADED[path, byte_fallback] = Counter(vocabulary(path), byte_fallback)
    return _LOADED[path, byte_fallback]


def count_tokens(df: DataFrame, path: str, text_col: str = "text", out_col: str = "n_tokens", byte_fallback: bool = True) -> DataFrame:
    """df with the number of tokens of its text; a column of the name out_col is replaced."""
    kept = df.drop(out_col)
    schema = T.StructType([*kept.schema.fields, T.StructField(out_col, T.LongType())])
    at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path, byte_fallback)
        for batch in batches:
            n = pa.array([c.count(t) for t in batch.column(at).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, n], names=[*batch.schema.names, out_col])

    return kept.mapInArrow(tidied(run), schema)


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and n_tokens of every document; the text does not return from Python."""
    only = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            n = pa.array([c.count(t) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n], names=["doc_id", "n_tokens"])

    return only.mapInArrow(tidied(run), T.StructType([only.schema["doc_id"], T.StructField("n_tokens", T.LongType())]))
