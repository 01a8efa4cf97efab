"""Packing: documents into sequences of a fixed length, shortest pack first over the length histogram.

A document's tokens are its ids and one end id. Whole sequences are cut from its front; what is left, its
rest, is packed. The histogram of the rests' lengths has fewer bins than a sequence has tokens, at any corpus
size, so the plan is made from it alone: lengths are placed longest first, each into the pack with the
most room, as counts of packing patterns. Packs that stay short are then made full: the emptiest ones are
laid end to end on a line, the gaps of the others on a second line of the same length, and a rest
of the first line is cut where the gaps end. The few tokens left over go into sequences whose lengths are powers of two.
Patterns meet the documents again by the rank of a rest among those of its length.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import written

#: Tokens of a sequence; the id after each document; bytes of text encoded at once; units a worker remembers.
LENGTH, END, CHUNK, REMEMBERED = 1024, 0, 8 << 20, 1 << 20
VOCABULARY, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
#: White space of the tokenizer's pattern. Texts with other runs of it than one character, or a line end before
#: one more line end or blank, can't be cut before each blank and line end; nor can those with the mark itself.
SPACE, MARK = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}", "\x01"
UNCUT = rf"[{SPACE}]{{3}}|[{SPACE}]{{2}}\z|[{SPACE.replace(r'\n', '')}][{SPACE}]|\n[{SPACE.replace(r'\n', '').replace(' ', '')}]|{MARK}"


class Encoder:
    """Ids of texts. A text is cut before blanks and line ends, where no token crosses; each distinct unit of a
    chunk is encoded once and remembered, up to a bound that changes no id. Units are encoded by the same
    vocabulary as ranks, which is quicker; what lies beyond the basic plane by the tokenizer itself."""

    def __init__(self, vocabulary: str = VOCABULARY, ranks_file: str = RANKS):
        self.whole = Tokenizer.from_file(vocabulary)
        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special = {t.content: i for i, t in self.whole.get_added_tokens_decoder().items()}
        self.units = tiktoken.Encoding("units", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.known: dict[str, bytes] = {}

    def one(self, text: str) -> bytes:
        if not text.isascii() and max(text) > "\uffff":
            ids = self.whole.encode(text, add_special_tokens=False).ids
        elif "<|" in text:
            ids = self.units.encode(text, allowed_special="all")
        else:
            ids = self.units.encode_ordinary(text)
        return array("H", ids).tobytes()

    def chunk(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, without the end."""
        uncut = pc.match_substring_regex(texts, UNCUT)
        marked = pc.replace_substring(pc.replace_substring(texts, " ", MARK + " "), "\n", MARK + "\n")
        parts = pc.split_pattern(pc.if_else(uncut, "", marked), MARK)
        units = parts.flatten().dictionary_encode()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        distinct = units.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, distinct))
        for i, ids in enumerate(found):
            if ids is None:
                found[i] = self.known[distinct[i]] = self.one(distinct[i])
        sizes = np.fromiter((len(x) // 2 for x in found), np.int64, len(found))
        flat, at = np.frombuffer(b"".join(found), "<u2"), np.cumsum(sizes) - sizes
        index = units.indices.to_numpy()
        n = sizes[index]
        ends = np.cumsum(n)
        ids = flat[np.repeat(at[index] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.concatenate(([0], ends))[parts.offsets.to_numpy()[1:-1] - parts.offsets[0].as_py()]
        out = np.split(ids, cuts)
        for i in np.flatnonzero(uncut.to_numpy(zero_copy_only=False)):
            out[i] = np.frombuffer(self.one(texts[int(i)].as_py()), "<u2")
        return out


_encoders: dict[tuple[str, str], Encoder] = {}


def encode(texts: pa.Array, files: tuple[str, str] = (VOCABULARY, RANKS)) -> Iterator[np.ndarray]:
    """Yields the ids of each text, null as empty; chunks of bounded size are encoded together."""
    encoder = _encoders.get(files) or _encoders.setdefault(files, Encoder(*files))
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    size = np.cumsum(pc.binary_length(texts).to_numpy())
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK, "right")))
        yield from encoder.chunk(texts[at:to])
        at = to


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


@dataclass
class Plan:
    """Where the rests go. ``places``: for a length, (first rank, copies in a pack, place in the pack, run) by
    rank. A run of packs is kept whole (its first sequence) or lies on the line of what is dealt out (its
    start there, the size of a pack). ``gaps``: (start on the line, size, sequence, offset) by start."""

    length: int
    sequences: int = 0
    places: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)
    runs: list[tuple[bool, int, int]] = field(default_factory=list)
    gaps: list[tuple[int, int, int, int]] = field(default_factory=list)

    def pieces(self, n: int, rank: int):
        """(start within the rest, length, sequence, offset) of the rest of length ``n`` with this rank."""
        own = self.places[n]
        first, copies, place, run = own[bisect_right(own, (rank, self.length + 1)) - 1]
        pack, copy = divmod(rank - first, copies)
        kept, base, size = self.runs[run]
        place += copy * n
        if kept:
            yield 0, n, base + pack, place
            return
        at, start = base + pack * size + place, 0
        while start < n:
            begin, gap, sequence, offset = self.gaps[bisect_right(self.gaps, (at + start, self.length + 1)) - 1]
            k, within = divmod(at + start - begin, gap)
            size = min(n - start, gap - within)
            yield start, size, sequence + k, offset + within
            start += size


def shortest_pack_first(histogram: dict[int, int], length: int) -> list[tuple[int, int, tuple[tuple[int, int], ...]]]:
    """(fill, count, ((piece length, copies), ...)) of packing patterns: each length, longest first, goes into the
    packs with the least in them; where it doesn't fit, packs are opened. A length splits one
    pattern and opens two at most, so patterns are a few times the lengths, whatever the counts."""
    packs: list[list[tuple[int, tuple]]] = [[] for _ in range(length + 1)]
    shortest = length
    for n in sorted(histogram, reverse=True):
        left = histogram[n]
        while left:
            while shortest < length and not packs[shortest]:
                shortest += 1
            if shortest + n <= length:
                count, pattern = packs[shortest].pop()
                if count > left:
                    packs[shortest].append((count - left, pattern))
                    count = left
                packs[shortest + n].append((count, (*pattern[:-1], (n, pattern[-1][1] + 1)) if pattern[-1][0] == n else (*pattern, (n, 1))))
                left -= count
            else:
                most = length // n
                for copies, count in ((most, left // most), (left % most, 1)):
                    if copies and count:
                        packs[copies * n].append((count, ((n, copies),)))
                        shortest = min(shortest, copies * n)
                left = 0
    return [(fill, count, pattern) for fill, own in enumerate(packs) for count, pattern in own]


def plan(histogram: dict[int, int], length: int = LENGTH) -> Plan:
    """The plan for rests with these counts by length; no sequence needs padding."""
    out = Plan(length)
    patterns = sorted(shortest_pack_first(histogram, length), reverse=True)
    short = sum(fill * count for fill, count, _ in patterns if fill < length)
    keep, left = divmod(short, length)  # of the short packs the fullest ``keep`` are filled up from the others
    ranks, line, gap = dict.fromkeys(histogram, 0), 0, 0
    for fill, count, pattern in patterns:
        kept = count if fill == length else min(count, keep)
        keep -= 0 if fill == length else kept
        for whole, n in ((True, kept), (False, count - kept)):
            if not n:
                continue
            place = 0
            for piece, copies in pattern:
                out.places.setdefault(piece, []).append((ranks[piece], copies, place, len(out.runs)))
                ranks[piece] += n * copies
                place += piece * copies
            out.runs.append((whole, out.sequences if whole else line, fill))
            if whole:
                if fill < length:
                    out.gaps.append((gap, length - fill, out.sequences, fill))
                    gap += n * (length - fill)
                out.sequences += n
            else:
                line += n * fill
    for bit in reversed(range(length.bit_length())):
        if left >> bit & 1:
            out.gaps.append((gap, 1 << bit, out.sequences, 0))
            gap += 1 << bit
            out.sequences += 1
    assert gap == line
    return out


REST = "doc_id long, part int, n long, length int, pos long, whole long, before long, crcs array<long>, rest binary"


def tokenised(docs: DataFrame, length: int = LENGTH, files: tuple[str, str] = (VOCABULARY, RANKS)) -> DataFrame:
    """Each document's token count, the CRCs of its whole sequences, and its rest as 16-bit ids. ``pos`` counts the
    rests of a length, and ``before`` the whole sequences, that came before in the same task (``part``)."""

    def run(batches):
        part, seen, before = TaskContext.get().partitionId(), {}, 0
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1), files), strict=True):
                ids = np.append(ids, np.uint16(END))
                whole, n = divmod(len(ids), length)
                rows.append((doc, part, len(ids), n, seen.get(n, 0), whole, before, [crc(ids[i * length : (i + 1) * length]) for i in range(whole)], ids[whole * length :].astype("<u2").tobytes()))
                seen[n] = seen.get(n, 0) + 1
                before += whole
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()), strict=True)], [x.split()[0] for x in REST.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, REST)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, length: int = LENGTH, files: tuple[str, str] = (VOCABULARY, RANKS)) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): the pieces of all documents, none
    padded but by less than a power of two asks for: sequences hold ``length`` tokens, a few at the end a power of two.

    Null and empty texts are one end id. Rows are documents of their own, also with equal or null ids; other columns
    are ignored; an empty table packs into nothing. A long text is encoded alone. The tokens are written once in the
    shared folder, 16 bits each and rests only, so that ranks hold if executors are lost. Ranks are running counts within
    a task plus the counts of the tasks before, so that a length which a third of all rows share is
    no one task's. To the driver comes the histogram, fewer bins than ``length``. ``files``: the tokenizer's vocabulary, and the same as
    ranks, by paths that all executors have; ids must fit 16 bits."""
    t = written(tokenised(docs, length, files))
    counts = t.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"), F.sum("whole").alias("whole"))
    histogram = {r.length: r.n for r in counts.where("length > 0").groupBy("length").agg(F.sum("n").alias("n")).collect()}
    made = plan(histogram, length)
    earlier = lambda c, w: F.coalesce(F.sum(c).over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = counts.groupBy("part").agg(F.sum("whole").alias("whole"))  # a row for each task
    tasks = parts.select("part", earlier("whole", Window.partitionBy(F.lit(0))).alias("_whole"))
    ranks = counts.select("part", "length", earlier("n", Window.partitionBy("length")).alias("_rank")).join(tasks, "part")
    placed = t.join(ranks, ["part", "length"]).select("doc_id", "n", "length", (F.col("pos") + F.col("_rank")).alias("rank"), (F.col("before") + F.col("_whole")).alias("sequence"), "crcs", "rest")
    shared = docs.sparkSession.sparkContext.broadcast(made)

    def run(batches):
        made = shared.value
        for batch in batches:
            rows = []
            for doc, n, left, rank, sequence, crcs, rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(doc, i * length, length, x, n, made.sequences + sequence + i, 0) for i, x in enumerate(crcs)]
                if left:
                    ids = np.frombuffer(rest, "<u2")
                    rows += [(doc, n - left + a, size, crc(ids[a : a + size]), n, s, o) for a, size, s, o in made.pieces(left, rank)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    return placed.mapInArrow(run, PIECES)
