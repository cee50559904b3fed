"""Token counts by a Viterbi pass that carries scores and piece counts only.

The tokenizer is a unigram model over the pieces and scores of a vocabulary file. Blanks
become U+2581, one is put in front unless the text starts with it, and segments begin at
each of them. An Aho-Corasick automaton enumerates the pieces that end at a place, longest
first; dynamic programming keeps the best score up to the place and the number of pieces
on its path. Ties follow the public ``tokenizers`` library: the path whose last piece
starts first wins, as a later one must score strictly more. A character that is no piece
costs the least score less 10 and counts as its UTF-8 bytes (byte fallback). Control,
unknown and byte pieces of the file never match text.

No public unigram vocabulary is at hand and tokenizers are not trained here, so the default
file is that of a BPE tokenizer: its scores are merge ranks, read as log-probabilities. The
counts are those of the unigram model over that vocabulary, not of the file's own encoder,
which merges pairs and gives fewer pieces. Any unigram file of the same format gives its
own tokenizer's counts.

The vocabulary (one file, a few MB) is read on the driver and broadcast. Segments repeat
between texts, so each is counted once per ``CACHE`` segments.

Defined cases: null and empty texts have no tokens; repeated rows count alike; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, whole_text

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
CACHE = 1_000_000


def vocabulary(path: str = MODEL) -> list[tuple[str, float]]:
    """Pieces that text can match, and their scores, of a SentencePiece file in id order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return [(model.id_to_piece(i), model.get_score(i)) for i in own]


class SegmentCounts(dict):
    """Number of pieces by segment without its blank; computed when first asked for."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - 10.0

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = count = self.best(BLANK + word)
        return count

    def best(self, segment: str) -> int:
        n = len(segment)
        score: list[float | None] = [None] * (n + 1)
        count = [0] * (n + 1)
        score[0] = 0.0
        at = 0  # characters whose places are done

        def close(end: int, single: bool) -> None:
            """The place behind character ``end``: without a piece of one character, the unknown one is tried last."""
            if not single:
                found = score[end] + self.unknown
                if score[end + 1] is None or found > score[end + 1]:
                    score[end + 1] = found
                    count[end + 1] = count[end] + len(segment[end].encode("utf-8", "surrogatepass"))

        single = False
        for end, (size, gain) in self.automaton.iter(segment):
            while at < end:
                close(at, single)
                at, single = at + 1, False
            found = score[end + 1 - size] + gain
            if score[end + 1] is None or found > score[end + 1]:
                score[end + 1] = found
                count[end + 1] = count[end + 1 - size] + 1
            single = single or size == 1
        while at < n:
            close(at, single)
            at, single = at + 1, False
        return count[n]

    def tokens(self, text: str | None) -> int:
        if not text:
            return 0
        words = text.replace(BLANK, " ").split(" ")
        return sum(map(self.__getitem__, words[1:] if words[0] == "" else words))


def token_count(text: Column, pieces: list[tuple[str, float]], spark: SparkSession) -> Column:
    """Number of tokens of ``text``, as long."""
    sent = spark.sparkContext.broadcast(pieces)

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counts = SegmentCounts(sent.value)
        for texts in batches:
            yield pd.Series([counts.tokens(t) for t in texts], dtype="int64")

    return counted(text)


def op7(spark: SparkSession, sf_dir: str, path: str = MODEL) -> DataFrame:
    """Token count of every document."""
    return documents(spark, sf_dir).select("doc_id", F.length(whole_text()).cast("long").alias("n_chars"), token_count(whole_text(), vocabulary(path), spark).alias("n_tokens"))
