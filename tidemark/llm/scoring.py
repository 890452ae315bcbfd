"""Language-model scores by a weighted backoff automaton, built for each block of texts from counts over the whole corpus.

The model is an n-gram model with Dirichlet smoothing: p(w | h) = (c(hw) + K p(w | h')) / (c(h) + K), h' being h without its
first word, and words alone with one added to each count. As an automaton, a history that occurs is a state, an n-gram an
arc that bears the whole probability of its last word, and a failure arc to the shorter history's state weighs K / (c(h) + K),
so that following failures until an arc fits gives the model's probability of any word.

No task holds the model. Texts are dealt into blocks by hash. Each block sends its distinct n-grams with its own training
counts to buckets by the n-gram's hash, where all blocks' counts are summed; back comes, in the block's own order, what the
other blocks add to each count. The block then has the counts of every n-gram in its texts, builds the part of the automaton that they can reach,
and scores them in one traversal from left to right, all texts of the block at once, each carrying its state. The blocks'
texts are one shuffle, read twice. N-grams go as sorted hashes, of WORD_BITS or GRAM_BITS, as differences in byte planes: of ten
billion n-grams one in half a million shares its hash with another one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import chunks_of, hash_words, mix

#: Bytes of text in a block and distinct n-grams in a bucket, about; parts of the documents, and the one that isn't learned from.
BLOCK_BYTES, BUCKET, FOLDS, HELD_OUT = 1 << 23, 1 << 21, 7, 2
#: Tokens of a piece that is traversed by itself; bits of the hashes of words and of longer n-grams.
SEGMENT, WORD_BITS, GRAM_BITS = 1 << 10, 56, 52
#: K for histories of one word, two words, and so on; their number is the model's order less one.
STRENGTHS = (1000.0, 20.0)

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
BEGIN, END = _U(0x51ED270B9F3C6A11), _U(0x2545F4914F6CDD1D)


def bits(order: int) -> int:
    return WORD_BITS if order == 1 else GRAM_BITS


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of bytes; small or sorted-and-subtracted ones leave most planes empty."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    planes = np.frombuffer(pa.decompress(packed[8:], 8 * n, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<u8")[:, 0]


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=_U(0)))


def unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack(packed), dtype=_U)


class Block:
    """Some texts as one row of token hashes, each text with a sign for its beginning before and one for its end behind.

    grams[o]: the hashes of the o tokens that end at each place; inside[o]: the places at which they lie in one text."""

    def __init__(self, texts: list[bytes], order: int):
        words, counts = [], []
        for first, last in chunks_of(texts):
            h, n, *_ = hash_words(texts[first:last], lower=True)
            words.append(h)
            counts.append(n)
        n = np.concatenate([np.zeros(0, np.int64), *counts]) + 2
        self.ends = np.cumsum(n)
        self.starts = self.ends - n
        self.sizes = n
        tokens = np.empty(int(n.sum()), _U)
        own = np.ones(len(tokens), bool)
        own[self.starts] = own[self.ends - 1] = False
        tokens[own] = np.concatenate([np.zeros(0, _U), *words])
        tokens[self.starts], tokens[self.ends - 1] = BEGIN, END
        place = (np.arange(len(tokens)) - np.repeat(self.starts, n)).astype(np.int32)
        self.grams, self.inside = {}, {}
        chain = tokens
        for o in range(1, order + 1):
            if o > 1:
                chain = np.concatenate([chain[:1], mix(chain[:-1] * _STEP + tokens[1:])])
            self.grams[o], self.inside[o] = chain >> _U(64 - bits(o)), np.flatnonzero(place >= o - 1).astype(np.int32)

    def learned(self, held_out: np.ndarray) -> np.ndarray:
        """1 at the places of texts that are learned from."""
        return np.repeat(~held_out, self.sizes).astype(np.uint8)


def own_counts(block: Block, order: int, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a block, sorted, with how often they occur in texts that are learned from."""
    at = block.inside[order]
    both = block.grams[order][at]
    both <<= _U(1)
    both |= learned[at]
    both.sort()
    keys = both >> _U(1)
    first = np.flatnonzero(np.diff(keys, prepend=~_U(0)))
    return keys[first], np.add.reduceat(both & _U(1), first) if len(first) else keys


class Automaton:
    """States, arcs and failure arcs for the n-grams of a block, whose counts in the corpus are `totals[o]` for the sorted `keys[o]`.

    State 0 knows no history; its arcs are `root`, one for every token of the block. arcs are sorted by state and token."""

    def __init__(self, block: Block, keys: dict, totals: dict, n_tokens: int, n_words: int, strengths: tuple[float, ...]):
        order = self.order = len(strengths) + 1
        ids = {o: np.full(int(block.sizes.sum()), -1, np.int32) for o in keys}
        for o in keys:
            ids[o][block.inside[o]] = np.searchsorted(keys[o], block.grams.pop(o)[block.inside[o]])  # not needed any more
        self.tokens, self.width = ids[1], max(1, len(keys[1]))
        p = (totals[1] + 1) / (n_tokens + n_words + 1)
        self.root, self.root_to = np.log10(p), np.where(totals[1] > 0, 1 + np.arange(len(keys[1])), 0)
        self.known = totals[1] > 0
        self.fail, self.weight, arcs = [np.zeros(1, np.int64)], [np.zeros(1)], []
        offset, shorter_to = 1, np.zeros(len(keys[1]), np.int64)
        for o in range(1, order):  # histories of o tokens, and the arcs that leave them
            k = strengths[o - 1]
            self.fail.append(shorter_to)
            self.weight.append(np.log10(k / (totals[o] + k)))
            place = np.zeros(len(keys[o + 1]), np.int32)
            place[ids[o + 1][block.inside[o + 1]]] = block.inside[o + 1]  # any place at which the n-gram ends
            seen = totals[o + 1] > 0
            history, shorter = ids[o][place - 1], ids[o][place]
            p = (totals[o + 1] + k * p[shorter]) / (totals[o][history] + k) if len(place) else np.zeros(0)
            to = np.where(totals[o][shorter] > 0, offset + shorter, 0) if len(place) else place
            after = offset + len(keys[o]) + np.arange(len(keys[o + 1])) if o + 1 < order else to
            arcs.append((((offset + history.astype(np.int64)) * self.width + self.tokens[place])[seen], np.log10(p)[seen], after[seen]))
            offset, shorter_to = offset + len(keys[o]), to
        self.fail, self.weight = np.concatenate(self.fail), np.concatenate(self.weight)
        arc, logp, to = (np.concatenate(x) for x in zip(*arcs, strict=True)) if arcs else (np.zeros(0, np.int64),) * 3
        by = np.argsort(arc)
        self.arc, self.logp, self.to = np.append(arc[by], -1), np.append(logp[by], 0.0), np.append(to[by], 0)
        self.begin = self.root_to[self.tokens[block.starts]] if len(block.starts) and order > 1 else np.zeros(len(block.starts), np.int64)
        if order == 1:
            self.root_to = np.zeros_like(self.root_to)

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after a token each, and the log-probabilities of these tokens."""
        out, now, left = np.zeros(len(state)), state.copy(), np.flatnonzero(state > 0)
        after = self.root_to[token]
        at_root = state == 0
        while len(left):
            wanted = now[left] * self.width + token[left]
            j = np.searchsorted(self.arc[:-1], wanted)
            hit = self.arc[j] == wanted
            out[left[hit]] += self.logp[j[hit]]
            after[left[hit]] = self.to[j[hit]]
            left = left[~hit]
            out[left] += self.weight[now[left]]
            now[left] = self.fail[now[left]]
            fallen = now[left] == 0
            at_root[left[fallen]] = True
            left = left[~fallen]
        out[at_root] += self.root[token[at_root]]
        return after, out

    def traverse(self, block: Block) -> np.ndarray:
        """The log-probability of each text, its end included: one step a token for all texts that are as long.

        A long text goes in pieces of SEGMENT tokens: the state knows no more than the last tokens, so a piece comes to its
        state by reading them first, from the root, without counting them."""
        pieces = -(-(block.sizes - 1) // SEGMENT)
        text = np.repeat(np.arange(len(pieces)), pieces)
        k = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        warm = np.where(k > 0, self.order - 1, 0)
        start = block.starts[text] + 1 + k * SEGMENT - warm
        size = np.minimum(block.ends[text], block.starts[text] + 1 + (k + 1) * SEGMENT) - start
        by = np.argsort(-size, kind="stable")
        text, warm, start, size = text[by], warm[by], start[by], size[by]
        state, total = np.where(warm > 0, 0, self.begin[text]), np.zeros(len(by))
        for t in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -t, side="left"))
            state, logp = self.step(state[:n], self.tokens[start[:n] + t])
            total[:n] += np.where(warm[:n] <= t, logp, 0.0) if t < self.order else logp
        return np.bincount(text, weights=total, minlength=len(pieces))


def _blocks(docs: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """doc_id, held_out, text (bytes) and block of every row, and the number of bytes."""
    text = F.coalesce("text", F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text) + 8)).first()[0] or 0
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(FOLDS))
    block = F.pmod(F.xxhash64("doc_id", text), F.lit(-(-size // block_bytes) or 1)).cast("int")
    return docs.select("doc_id", (fold == HELD_OUT).alias("held_out"), text.cast("binary").alias("text"), block.alias("block")), size


def score(docs: DataFrame, strengths: tuple[float, ...] = STRENGTHS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs(doc_id, text).

    Tokens: words between ASCII white space, A-Z lower-cased, and one end. The model learns from the rows whose crc32(doc_id)
    modulo FOLDS isn't HELD_OUT; a text's beginning is a history, not a token. n_known: tokens that occur in training texts;
    train_tokens: all tokens of those; base_score by words alone. Logarithms are to base 10. Null text: empty, with the end alone;
    null doc_id: learned from; repeated rows count each; an empty table: no rows; nothing to learn from: every token as
    unknown; other columns are ignored. A block's memory follows block_bytes, or its longest text."""
    order = len(strengths) + 1
    rows, size = _blocks(docs, block_bytes)
    buckets = 1 << max(0, (order * size // 8 // BUCKET).bit_length())
    depth = buckets.bit_length() - 1

    def count(t: pa.Table) -> pa.Table:
        texts = Block(t["text"].to_pylist(), order)
        learned = texts.learned(t["held_out"].to_numpy())
        out = []
        for o in range(1, order + 1):
            keys, counts = own_counts(texts, o, learned)
            edges = np.searchsorted(keys >> _U(bits(o) - depth), np.arange(buckets + 1, dtype=_U))
            out += [(b, o, pack_sorted(keys[i:j]), pack(counts[i:j])) for b, (i, j) in enumerate(zip(edges, edges[1:], strict=False)) if o == 1 or j > i]
        of = [t["block"][0].as_py()] * len(out)
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("block", "bucket", "n", "grams", "counts"), (of, *zip(*out, strict=True)), kinds, strict=True)})

    def total(t: pa.Table) -> pa.Table:
        out, tokens, words = [], 0, 0
        whole = [t.filter(pc.equal(t["n"], o)) for o in range(1, order + 1)]
        for o, own in enumerate(whole, 1):
            keys, counts = [unpack_sorted(x) for x in own["grams"].to_pylist()], [unpack(x) for x in own["counts"].to_pylist()]
            if not keys:
                continue
            every = np.concatenate(keys)
            by = np.argsort(every)
            first = np.flatnonzero(np.diff(every[by], prepend=~_U(0)))
            unique = every[by][first]
            sums = np.add.reduceat(np.concatenate(counts)[by], first) if len(first) else unique
            if o == 1:
                is_word = unique != BEGIN >> _U(64 - WORD_BITS)
                tokens, words = int(sums[is_word].sum()), int((sums[is_word] > 0).sum())
            for block, k, c in zip(own["block"].to_pylist(), keys, counts, strict=True):
                others = sums[np.searchsorted(unique, k)] - c
                out.append((block, t["bucket"][0].as_py(), o, pack(others), tokens if o == 1 else 0, words if o == 1 else 0))
        cols = list(zip(*out, strict=True))
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("block", "bucket", "n", "others", "tokens", "words"), cols, kinds, strict=True)})

    def judge(t: pa.Table, sums: pa.Table) -> pa.Table:
        texts = Block(t["text"].to_pylist(), order)
        learned = texts.learned(t["held_out"].to_numpy())
        keys, totals = {}, {}
        for o in range(1, order + 1):
            keys[o], counts = own_counts(texts, o, learned)
            own = sums.filter(pc.equal(sums["n"], o)).sort_by("bucket")  # the buckets are ranges of the hashes
            totals[o] = (counts + np.concatenate([counts[:0], *map(unpack, own["others"].to_pylist())])).astype(np.int64)
        n, words = (pc.sum(sums[c]).as_py() or 0 for c in ("tokens", "words"))
        machine = Automaton(texts, keys, totals, n, words, strengths)
        token = np.ones(len(machine.tokens), bool)
        token[texts.starts] = False
        summed = lambda x: np.add.reduceat(np.where(token, x, 0), texts.starts)
        return pa.table({
            "doc_id": t["doc_id"], "held_out": t["held_out"], "n_tokens": texts.sizes - 1, "n_known": summed(machine.known[machine.tokens].astype(np.int64)),
            "train_tokens": np.full(len(t), n), "base_score": summed(machine.root[machine.tokens]), "score": machine.traverse(texts),
        })

    by_block = rows.groupBy("block")
    asked = by_block.applyInArrow(count, "block int, bucket int, n int, grams binary, counts binary")
    sums = asked.groupBy("bucket").applyInArrow(total, "block int, bucket int, n int, others binary, tokens long, words long")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return by_block.cogroup(sums.groupBy("block")).applyInArrow(judge, schema)
