"""Token counts under a unigram vocabulary: a count-only Viterbi.

An Aho-Corasick automaton lists every vocabulary match; dynamic programming carries the best score
and its piece count, nothing else. Ties go to the path found first by the usual tokenizer, which
extends positions from left to right and replaces a path only by a strictly better one: at each
end the earlier start, so the longer last piece, wins. A character that is no piece costs the least
score less 10 and counts as its UTF-8 bytes (byte fallback).
"""

from __future__ import annotations

import re
import uuid

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Fixed by the tokenizer: how far an unknown character's score lies below the least score.
UNKNOWN_PENALTY = 10.0
#: Units whose counts a worker remembers at a time; the others are counted again.
REMEMBERED = 200_000
#: Places of a long unit that are kept besides those that a piece can reach back to.
KEPT = 1 << 16
_NO_MATCH = (-1, None)
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def read_pieces(model_file: str = MODEL) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model, without control, unknown, unused and byte pieces.
    A BPE vocabulary's scores are minus its merge ranks; they serve as unigram scores all the same."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model_file)
    special = lambda i: p.is_control(i) or p.is_unknown(i) or p.is_unused(i) or p.is_byte(i)
    return [(p.id_to_piece(i), p.get_score(i)) for i in range(p.get_piece_size()) if not special(i)]


class Counter:
    """Counts pieces of whole texts. Texts fall into units that no piece crosses; equal units are
    counted once as long as they are remembered."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.matches = ahocorasick.Automaton()
        for piece, score in pieces:
            self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        self.single = frozenset(p for p, _ in pieces if len(p) == 1)
        self.longest = max((len(p) for p, _ in pieces), default=0) + 1
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        whole = any(SPACE in p.lstrip(SPACE) for p, _ in pieces)  # a piece crosses words: no units then
        lone = "" if any("\n" in p for p, _ in pieces) else "\n"
        self.units = None if whole else re.compile(f"{lone}|{SPACE}*[^{SPACE}{lone}]+|{SPACE}+" if lone else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.known: dict[str, tuple[int, float]] = {}

    def unit(self, text: str) -> tuple[int, float]:
        """Only the places that a piece can still reach back to are kept, however long the unit is."""
        if len(text) <= KEPT and self.single.issuperset(text):
            return self.plain(text)
        best, count, base = [0.0], [0], 0
        found = self.matches.iter(text)
        ahead = next(found, _NO_MATCH)
        for end in range(1, len(text) + 1):
            top, pieces, first, single = float("-inf"), 0, end, False
            while ahead[0] == end - 1:
                length, score = ahead[1]
                start = end - length
                score += best[start - base]
                if score > top or score == top and start < first:
                    top, pieces, first = score, count[start - base] + 1, start
                single |= length == 1
                ahead = next(found, _NO_MATCH)
            if not single and best[-1] + self.unknown > top:
                top, pieces = best[-1] + self.unknown, count[-1] + len(text[end - 1].encode())
            best.append(top)
            count.append(pieces)
            if len(best) > KEPT + self.longest:
                base += len(best) - self.longest
                del best[: -self.longest], count[: -self.longest]
        return count[-1], best[-1]

    def plain(self, text: str) -> tuple[int, float]:
        """A unit all of whose characters are pieces, so that none is unknown and each place is reached."""
        best, count = [0.0] + [float("-inf")] * len(text), [0] * (len(text) + 1)
        for last, (length, score) in self.matches.iter(text):  # the longest of an end comes first, and stays in a tie
            score += best[last + 1 - length]
            if score > best[last + 1]:
                best[last + 1], count[last + 1] = score, count[last + 1 - length] + 1
        return count[-1], best[-1]

    def text(self, text: str) -> tuple[int, float]:
        """(pieces, score) of a text, with a space put in front; (0, 0) of an empty one."""
        if not text:
            return 0, 0.0
        text = SPACE + text.replace(" ", SPACE)
        known, n, total = self.known, 0, 0.0
        for u in self.units.findall(text) if self.units else [text]:
            got = known.get(u)
            if got is None:
                got = self.unit(u)
                if len(known) >= REMEMBERED:
                    known.clear()
                known[u] = got
            n += got[0]
            total += got[1]
        return n, total


_counters: dict[str, Counter] = {}


def count_tokens(df: DataFrame, pieces: list[tuple[str, float]], text: str = "text") -> Column:
    """struct<n_tokens long, score double> of a row's whole text; a null text counts as empty.

    The vocabulary is broadcast (its size is the tokenizer's); each worker builds the automaton once.
    Repeated rows get equal counts, other columns are ignored, an empty table stays empty. Sums are exact for whole-number scores, and the same at any partitioning."""
    name, shared = uuid.uuid4().hex, df.sparkSession.sparkContext.broadcast(pieces)

    @F.pandas_udf("n_tokens long, score double")
    def count(texts: pd.Series) -> pd.DataFrame:
        if name not in _counters:
            _counters.clear()
            _counters[name] = Counter(shared.value)
        counter = _counters[name]
        return pd.DataFrame([counter.text(t) for t in texts], columns=["n_tokens", "score"]).astype({"n_tokens": "int64", "score": "float64"})

    return count(F.coalesce(df[text], F.lit("")))
