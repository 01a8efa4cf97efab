"""Language-model scores from a probabilistic suffix tree over words.

Tokens are words lower-cased in ASCII and one end per text. The root's distribution is the add-half
unigram one, over every word seen in training. A context of one to ``depth`` words is a state if it was
seen ``least`` times in training and if its next-symbol distribution diverges from that of its suffix by
more than its description costs. A state's distribution is its own counts, smoothed towards that of its
longest suffix that is a state, or of the root. Scoring takes the longest suffix of the history that is
a state. ``least`` and the test are the same at every size, so the tree grows with the corpus.

The tree is never held in one place. Documents are packed into chunks of some million tokens. A
chunk asks for its distinct grams, of one to ``depth + 1`` words, with its own training counts; the asks
meet by ranges of the grams' hashes, where a gram is counted once for each chunk at most, so no gram is
hot; and the totals go back to the chunks, in the order in which they were asked. The divergence test is
a sum over training tokens, so chunks add up their parts and meet in the same way. At last each chunk
holds what its own documents need of the tree. Nothing is broadcast, and the driver gets three numbers.

Words and grams are told apart by hashes of 53 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

END = b" "  # no word holds a space
#: Characters that are cut into words at once, tokens of a chunk, tokens for each range of grams.
CHUNK_CHARS, CHUNK, RANGE = 2 << 20, 1 << 20, 1 << 20
SMOOTHING = 5.0
#: Grams are numbers of 56 bits, the last three of which tell the words in them.
BITS, LENGTH = 56, 7
ASKS = "chunk long, bucket long, n long, keys binary, counts binary"
ANSWERS = "chunk long, bucket long, totals binary, tokens long, words long"


def _tokens(text: str) -> list[bytes]:
    words = text.encode().lower().split()
    words.append(END)
    return words


def _hashes(words) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for w in words), np.uint64, len(words))


def _pack(a: np.ndarray) -> bytes:
    """An array's bytes, those of equal weight together, compressed."""
    return zstandard.ZstdCompressor(3).compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes())


def _unpack(body: bytes, dtype) -> np.ndarray:
    raw, wide = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8), np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(wide, -1).T).reshape(-1).view(dtype)


def _pack_keys(keys: np.ndarray, start: int) -> bytes:
    """Rising keys from ``start`` on by their distances: the lower four bytes plain, the others compressed."""
    steps = np.diff(keys, prepend=start)
    return steps.astype(np.uint32).tobytes() + _pack((steps >> 32).astype(np.int32))


def _unpack_keys(body: bytes, n: int, start: int) -> np.ndarray:
    steps = _unpack(body[4 * n :], np.int32).astype(np.int64) << 32 | np.frombuffer(body, np.uint32, n)
    return start + np.cumsum(steps)


def _chunks(df: DataFrame) -> DataFrame:
    """(key string, trains, text) -> one row for each chunk: its tokens as places in its list of word hashes."""

    def gather(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, size = TaskContext.get().partitionId() << 32, [], 0

        def chunk() -> pd.DataFrame:
            words, ids, times = np.unique(np.concatenate([h for *_, h in held]), return_inverse=True, return_counts=True)
            order = np.argsort(-times, kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            keys = [k for ks, *_ in held for k in ks]
            trains, lengths = (np.concatenate([x[i] for x in held]) for i in (1, 2))
            return pd.DataFrame({"chunk": [at], "tokens": len(ids), "keys": [keys], "trains": [_pack(trains)], "lengths": [_pack(lengths)], "words": [_pack(words[order])], "ids": [_pack(rank[ids])]})

        for pdf in frames:
            if not len(pdf):
                continue
            parts = np.cumsum(pdf.text.str.len().to_numpy()) // CHUNK_CHARS
            for _, part in pdf.groupby(parts, sort=True):
                rows = [_tokens(t) for t in part.text]
                words = np.empty(sum(map(len, rows)), object)
                words[:] = [w for r in rows for w in r]
                codes, distinct = pd.factorize(words)
                held.append((part.key.tolist(), part.trains.to_numpy(np.uint8), np.array([len(r) for r in rows], np.int64), _hashes(distinct)[codes]))
                size += len(words)
                if size >= CHUNK:
                    yield chunk()
                    at, held, size = at + 1, [], 0
        if held:
            yield chunk()

    return df.mapInPandas(gather, "chunk long, tokens long, keys array<string>, trains binary, lengths binary, words binary, ids binary")


def _sorted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers, rising, and the places they had. Plain numbers sort much quicker than places do, so the upper
    bits are sorted with the place below them; the few that only lower bits tell apart are put right after it."""
    if not len(x):
        return x, np.empty(0, np.int64)
    low, wide = x.min(), len(x).bit_length()
    cut = max(0, int(x.max() - low).bit_length() + wide - 63)
    order = x - low
    order >>= cut
    order <<= wide
    order |= np.arange(len(x))
    order.sort()
    order &= (1 << wide) - 1
    rising = x[order]
    if (rising[1:] < rising[:-1]).any():
        again = np.argsort(rising, kind="stable")
        rising, order = rising[again], order[again]
    return rising, order


def _distinct(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers of the parts, rising, and where each number stands among them. Empties the list."""
    x = np.concatenate(parts)
    parts.clear()
    x, order = _sorted(x)
    first = np.diff(x, prepend=-1) > 0
    at = np.empty(len(x), np.int32)
    at[order] = np.cumsum(first, dtype=np.int32) - 1
    return x[first], at


class Chunk:
    """A chunk's tokens: ``place`` in the document, ``trains``, and for each n from 1 to depth + 1 the places
    of tokens that end a gram of n words, and where these stand in the chunk's rising list of ``grams``."""

    def __init__(self, row, depth: int):
        self.keys = list(row["keys"])
        self.lengths = _unpack(row["lengths"], np.int64)
        n = self.lengths.sum()
        self.row = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)
        self.place = (np.arange(n) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)).astype(np.int32)
        self.trains = _unpack(row["trains"], np.uint8)[self.row].astype(bool)
        word = _unpack(row["words"], np.uint64)[_unpack(row["ids"], np.int32)]
        self.ends, ids, so_far = [], [], np.zeros(n, np.uint64)
        for length in range(1, depth + 2):
            before = np.concatenate((np.zeros(1, np.uint64), so_far[:-1])) if n else so_far
            so_far = (before ^ (before >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + word
            so_far = (so_far ^ (so_far >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            so_far[self.place < length - 1] = 0
            self.ends.append(np.flatnonzero(self.place >= length - 1).astype(np.int32))
            ids.append((so_far[self.ends[-1]] >> np.uint64(64 - BITS)).view(np.int64) & ~LENGTH | length)
        cuts = np.cumsum([len(x) for x in ids])[:-1]
        self.grams, at = _distinct(ids)
        self.at = np.split(at, cuts)

    def contexts(self, totals: np.ndarray, least: int) -> np.ndarray:
        """The grams that may be states, where they stand in ``grams``."""
        return np.flatnonzero((self.grams & LENGTH < self.grams_most) & (totals >= least))

    @property
    def grams_most(self) -> int:
        return len(self.ends)

    def steps(self, totals: np.ndarray, root: np.ndarray, states: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """From contexts of one word up: (tokens after one of the ``states``, the state, the count of both, the
        token's probability before). ``root`` comes to hold the probabilities after the longest state."""
        for n in range(1, self.grams_most):
            context = np.full(len(self.place), -1, np.int32)
            context[self.ends[n - 1]] = self.at[n - 1]
            tokens, gram = self.ends[n], self.at[n]
            context = context[tokens - 1]
            on = states[context]
            tokens, context, count = tokens[on], context[on], totals[gram[on]]
            yield tokens, context, count, root[tokens]
            root[tokens] = (count + SMOOTHING * root[tokens]) / (totals[context] + SMOOTHING)

    def root(self, totals: np.ndarray, tokens: int, distinct: int) -> np.ndarray:
        return (totals[self.at[0]] + 0.5) / (tokens + 0.5 * (distinct + 1))


def _ranges(grams: np.ndarray, width: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, first, end) of the ranges of ``width`` that hold some of the rising grams."""
    bucket = grams // width
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    yield from zip(bucket[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(grams)])


def _met(pdf: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A range's distinct grams, where each ask's grams stand in them, and where asks end."""
    keys = [_unpack_keys(k, n, b * width) for k, n, b in zip(pdf["keys"], pdf.n, pdf.bucket)]
    grams, at = _distinct(keys)
    return grams, at, np.cumsum(pdf.n.to_numpy())[:-1]


def suffix_tree_scores(df: DataFrame, trains: Column, depth: int = 2, least: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) for each row, learnt from those where ``trains``.

    ``base_score`` and ``score``: log10 probability under the root's distribution and under the tree;
    ``n_known``: tokens whose word training rows hold. Repeated rows each count and return; null texts count
    as empty, and so as one end; null keys return as such; rows where ``trains`` is null aren't learnt from;
    without training rows both scores are the root's; an empty table gives none; other columns are ignored.
    ``depth`` is from 1 to 6.
    """
    if not 1 <= depth <= 6:
        raise ValueError("depth is from 1 to 6")
    texts = df.select(F.col(key).cast("string").alias("key"), F.coalesce(trains, F.lit(False)).alias("trains"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chunks = written(_chunks(texts))
    total = chunks.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    buckets = 1 + int(total) // RANGE
    width = (1 << BITS) // buckets + 1

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for _, row in pdf.iterrows():
                c = Chunk(row, depth)
                counts = np.zeros(len(c.grams), np.int32)
                for end, at in zip(c.ends, c.at):
                    counts += np.bincount(at[c.trains[end]], minlength=len(counts)).astype(np.int32)
                parts = [(row["chunk"], b, e - s, _pack_keys(c.grams[s:e], b * width), _pack(counts[s:e])) for b, s, e in _ranges(c.grams, width)]
                yield pd.DataFrame(parts, columns=["chunk", "bucket", "n", "keys", "counts"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        grams, at, cuts = _met(pdf, width)
        totals = np.bincount(at, np.concatenate([_unpack(c, np.int32) for c in pdf.counts]), len(grams)).astype(np.int64)
        single = totals[grams & LENGTH == 1]
        out = pd.DataFrame({"chunk": pdf.chunk, "bucket": pdf.bucket, "totals": [_pack(x) for x in np.split(totals[at], cuts)], "tokens": 0, "words": 0})
        out.loc[out.index[0], ["tokens", "words"]] = int(single.sum()), int((single > 0).sum())
        return out

    slim = chunks.drop("tokens")
    answers = written(slim.mapInPandas(ask, ASKS).groupBy("bucket").applyInPandas(answer, ANSWERS))
    tokens, distinct = (int(x) for x in answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first())
    answers = answers.select("chunk", "bucket", "totals")

    def totals_of(told: pd.DataFrame) -> np.ndarray:
        return np.concatenate([_unpack(t, np.int64) for t in told.totals])

    def parts_of_test(chunk: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        """What the chunk's training tokens gain by each context, and its share of the context's next symbols."""
        c, totals = Chunk(chunk.iloc[0], depth), totals_of(told.sort_values("bucket"))
        may = c.contexts(totals, least)
        states = np.zeros(len(totals), bool)
        states[may] = True
        gain, entries = np.zeros(len(totals)), np.zeros(len(totals))
        for at, context, count, before in c.steps(totals, c.root(totals, tokens, distinct), states):
            on = c.trains[at]
            gain += np.bincount(context[on], np.log(count[on] / totals[context[on]] / before[on]), len(totals))
            entries += np.bincount(context[on], 1 / count[on], len(totals))
        grams, sums = c.grams[may], np.stack([gain[may], entries[may]], 1).astype(np.float32)
        parts = [(chunk.chunk.iloc[0], b, e - s, _pack_keys(grams[s:e], b * width), _pack(sums[s:e].reshape(-1))) for b, s, e in _ranges(grams, width)]
        return pd.DataFrame(parts, columns=["chunk", "bucket", "n", "keys", "counts"])

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        grams, at, cuts = _met(pdf, width)
        sums = np.concatenate([_unpack(c, np.float32) for c in pdf.counts]).reshape(-1, 2).astype(float)
        gain, entries = (np.bincount(at, sums[:, i], len(grams)) for i in (0, 1))
        passes = gain > 0.5 * (entries + 1) * np.log(max(tokens, 2))
        return pd.DataFrame({"chunk": pdf.chunk, "bucket": pdf.bucket, "states": [_pack(x.astype(np.uint8)) for x in np.split(passes[at], cuts)]})

    parts = slim.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(parts_of_test, ASKS)
    states = parts.groupBy("bucket").applyInPandas(test, "chunk long, bucket long, states binary")

    def scores(chunk: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        told = told.sort_values("bucket")
        c, totals = Chunk(chunk.iloc[0], depth), totals_of(told[told.totals.notna()])
        passes = [_unpack(s, np.uint8) for s in told.states if s is not None]
        states = np.zeros(len(totals), bool)
        if passes:
            states[c.contexts(totals, least)] = np.concatenate(passes).astype(bool)
        p, n = c.root(totals, tokens, distinct), len(c.lengths)
        base = np.bincount(c.row, np.log10(p), n)
        for _ in c.steps(totals, p, states):
            pass
        known = np.bincount(c.row, totals[c.at[0]] > 0, n).astype(np.int64)
        return pd.DataFrame({"key": c.keys, "n_tokens": c.lengths, "n_known": known, "train_tokens": tokens, "base_score": base, "score": np.bincount(c.row, np.log10(p), n)})

    # Both cogroups take the chunks by one exchange, and what is told needs no join to meet them.
    told = answers.unionByName(states, allowMissingColumns=True)
    out = slim.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(scores, "key string, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumn("key", F.col("key").cast(df.schema[key].dataType)).withColumnRenamed("key", key)


def held_out(key: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of its key as text, mod 5, is 1 (a null key's is not)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 5 == 1
