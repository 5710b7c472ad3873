"""Language-model scores from a weighted backoff automaton over the n-grams (to order three) of the whole corpus.

Model. States are the root, one state per known word and one per seen pair of words (the history). From a
state an arc leads along each word seen after it; a failure arc leads to the state of the history without its
first word and carries the backoff weight. With c(x) the count of an n-gram, h a history and h' its failure state:

    T(h)     = c(h) ** beta        expected number of distinct followers; one beta for each length of history is
                                   solved from the corpus so that the sum of T over all h is the number of
                                   distinct n-grams that are one longer
    g(h)     = T(h) / (c(h) + T(h))
    p(w)     = (c(w) + V / (V + 1)) / (N + V)          N tokens, V distinct; one more class: unknown
    p(w | h) = c(h w) / (c(h) + T(h)) + g(h) p(w | h')     on the arc, if h w was seen; else g(h) p(w | h') by failure

For each h this sums to 1. A text is read once from left to right: the state is carried from token to token,
failure arcs are followed until there is an arc for the token (the root has one for every word), and log10 of
what is passed adds up. The state after a token is the longest known history that ends with it. The history
of the first token is the end-of-text token.

Distribution. The automaton grows with the corpus, so no task or driver ever holds it. Texts are dealt into
blocks of bounded size by a hash. A block asks for the counts of its distinct n-grams (sorted hashes with its
own training counts, cut into lanes by hash range); a shard sums the counts over all blocks and answers every
asker in its own order; the block then builds the part of the automaton that its texts can reach and walks it. An
n-gram that is everywhere costs one entry per block, so no key is hot. With more than `fan` shards there is a
hop between: blocks send to the square root of the number of shards of lanes, as many blocks share a relay for
a lane, and a relay sums, asks the shards of its lane and passes the answers on. So messages keep their size, and what is sent
grows with the input.

n-grams are told apart by hashes with so many bits that one n-gram collides with probability 2 ** -20 at most.
Defined results: null text = empty; an empty text is one end token; a null id counts as the empty text for
the split; repeated ids are scored row by row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from array import array

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, ship, whole

ORDER = 3
BETAS = np.linspace(0.2, 1.0, 33)
STATS = 1 + ORDER + (ORDER - 1) * len(BETAS)  # N; distinct n-grams of each order; per length of history the sums of c ** beta
TAG = 2  # low bits of a key: the order
C = np.uint64(0x9E3779B97F4A7C15)


def tokenize(text: str) -> list[bytes]:
    """A-Z in lower case, words between ASCII white space; the end token is not in the list."""
    return text.encode().lower().split()


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Block:
    """Some texts as n-grams: keys (sorted, distinct, of all orders), and for each position the places of the n-grams that end there."""

    def __init__(self, texts: list[str], bits: int = 62):
        ids = _Ids()
        ids[b""]  # the end token is no word
        parts, lengths = [], []
        for t in texts:
            words = tokenize(t)
            part = np.zeros(len(words) + 1, np.int64)
            part[:-1] = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
            parts.append(part)
            lengths.append(len(part))
        self.lengths = np.array(lengths, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        gram = np.concatenate(parts)
        words = hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in ids), np.uint64, len(ids))
        word, place = gram, np.arange(len(gram)) - np.repeat(self.starts, self.lengths)
        # a text's first token has no longer history than the end token, so only places from order - 2 on have an n-gram of that order
        self.real = [place >= order - 2 for order in range(1, ORDER + 1)]
        keys, places = [self._tagged(hashes, 1, bits)], [gram]
        for order, real in enumerate(self.real[1:], 2):
            # an n-gram is the one that ends before its last word, and the word; every text ends with the end token, the first history of the next
            shorter = np.concatenate([gram[:1] * 0, gram[:-1]])
            pairs, inverse = np.unique((shorter * len(words) + word)[real], return_inverse=True)
            hashes = mix64(hashes[pairs // len(words)] * C + mix64(words[pairs % len(words)]))
            gram = np.zeros(len(word), np.int64)
            gram[real] = inverse
            keys.append(self._tagged(hashes, order, bits))
            places.append(gram)
        self.keys, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        ends = np.cumsum([len(k) for k in keys])
        self.at = [np.where(real, np.append(inverse[e - len(k) : e], 0)[p], 0).astype(np.int32) for e, k, p, real in zip(ends, keys, places, self.real, strict=True)]

    @staticmethod
    def _tagged(hashes: np.ndarray, order: int, bits: int) -> np.ndarray:
        return (hashes >> np.uint64(64 - bits)) << np.uint64(TAG) | np.uint64(order)

    def counts(self, train: np.ndarray) -> np.ndarray:
        held = np.repeat(train, self.lengths)
        return sum(np.bincount(at[held & real], minlength=len(self.keys)) for at, real in zip(self.at, self.real, strict=True))

    def score(self, c: np.ndarray, stats: np.ndarray) -> dict[str, np.ndarray]:
        """c: the counts of keys in the training texts. The part of the automaton that the texts can reach, and the walk."""
        n, v = stats[0], stats[1]
        word = self.at[0]
        base = np.log10((c[word] + 1) / (n + v + 1))
        # failure arcs: of each n-gram as a history
        weight = np.ones(len(c))
        for order, beta in enumerate(solve_betas(stats), 1):
            mine = (self.keys & np.uint64(3) == order) & (c > 0)
            weight[mine] = c[mine] ** beta
        total = c + weight
        back = np.where(c > 0, weight / total, 1.0)
        # arcs: of each n-gram its probability after its history, shorter ones first
        p = np.zeros(len(c))
        p[word] = (c[word] + (v / (v + 1) if n else 1.0)) / (n + v if n else 1.0)
        shorter = p[word]
        for order in range(2, ORDER + 1):
            at, history, real = self.at[order - 1], self._history(order), self.real[order - 1]
            shorter = np.where(real, c[at] / total[history] * (c[at] > 0) + back[history] * shorter, shorter)
            p[at[real]] = shorter[real]
        arc, failure = array("d"), array("d")
        arc.frombytes(np.where(c > 0, np.log10(np.maximum(p, 1e-300)), 1.0).tobytes())  # no log probability is above 0: no arc
        failure.frombytes(np.log10(back).tobytes())
        unknown = np.log10(p[word]) if len(word) else p[word]
        score = np.empty(len(self.lengths))
        for k, (a, size) in enumerate(zip(self.starts.tolist(), self.lengths.tolist(), strict=True)):
            places = [x[a : a + size].tolist() for x in self.at]
            score[k] = walk(arc, failure, int(word[a - 1]) if a else int(self.at[0][a + size - 1]), *places, unknown[a : a + size].tolist())
        add = np.add.reduceat
        return {"n_tokens": self.lengths, "n_known": add((c[word] > 0).astype(np.int64), self.starts), "base_score": add(base, self.starts), "score": score}

    def _history(self, order: int) -> np.ndarray:
        """The place of the history of each position's n-gram: the shorter n-gram that ends before it."""
        x = self.at[order - 2]
        head = self.at[0][self.lengths[0] - 1] if len(x) else 0  # the end token's place
        return np.concatenate([[head], x[:-1]]).astype(np.int32)


def walk(arc: array, failure: array, state: int, words: list[int], pairs: list[int], triples: list[int], unknown: list[float]) -> float:
    """The sum of log10 weights along a text.

    arc: per n-gram the weight of the arc that ends it, above 0 where there is none. failure: per n-gram the weight of its state's
    failure arc. state: the end token's state. Each token follows its arc or fails to a shorter history first.
    """
    total, depth, last = 0.0, (1 if arc[state] <= 0 else 0), state
    for w, pair, triple, bare in zip(words, pairs, triples, unknown, strict=True):
        if depth == 2:
            x = arc[triple]
            if x > 0:
                total += failure[state]  # to the state of the last word
                depth = 1
        if depth == 1:
            x = arc[pair]
            if x > 0:
                total += failure[last]  # to the root
                depth = 0
        total += x if depth else bare
        # the longest history that is a state
        if arc[pair] <= 0:
            state, depth = pair, 2
        elif arc[w] <= 0:
            state, depth = w, 1
        else:
            state, depth = w, 0
        last = w
    return total


def solve_betas(stats: np.ndarray) -> list[float]:
    """For each length of history the exponent at which the expected followers add up to the distinct n-grams that are one longer."""
    out = []
    for order in range(1, ORDER):
        sums = stats[1 + ORDER + (order - 1) * len(BETAS) :][: len(BETAS)]
        longer = stats[1 + order]
        out.append(float(np.interp(math.log(longer), np.log(np.maximum(sums, 1e-9)), BETAS)) if longer > 0 else 1.0)
    return out


def stats_of(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What shards report: N, distinct n-grams, sums of c ** beta; they add up over shards."""
    out = np.zeros(STATS)
    for order in range(1, ORDER + 1):
        seen = counts[(keys & np.uint64(3) == order) & (counts > 0)].astype(np.float64)
        out[order] = len(seen)
        if order == 1:
            out[0] = seen.sum()
        if order < ORDER:
            values, times = np.unique(seen, return_counts=True)
            out[1 + ORDER + (order - 1) * len(BETAS) :][: len(BETAS)] = [(times * values**b).sum() for b in BETAS]
    return out


class BackoffAutomaton:
    """The same model in memory, by dictionaries; for small corpora and as a yardstick in tests."""

    def __init__(self, texts: list[str]):
        self.count: dict[tuple[bytes, ...], int] = {}
        for t in texts:
            line = [b"", *tokenize(t), b""]
            for k in range(1, len(line)):
                for order in range(1, min(ORDER, k + 1) + 1):
                    g = tuple(line[k - order + 1 : k + 1])
                    self.count[g] = self.count.get(g, 0) + 1
        stats = np.zeros(STATS)
        for g, c in self.count.items():
            stats[len(g)] += 1
            stats[0] += c * (len(g) == 1)
            if len(g) < ORDER:
                stats[1 + ORDER + (len(g) - 1) * len(BETAS) :][: len(BETAS)] += float(c) ** BETAS
        self.n, self.v, self.betas = int(stats[0]), int(stats[1]), solve_betas(stats)

    def probability(self, state: tuple[bytes, ...], w: bytes) -> float:
        if not state:
            return (self.count.get((w,), 0) + self.v / (self.v + 1)) / (self.n + self.v) if self.n else 1.0
        c = self.count[state]
        t = c ** self.betas[len(state) - 1]
        return self.count.get((*state, w), 0) / (c + t) + t / (c + t) * self.probability(state[1:], w)

    def score(self, text: str) -> float:
        state, total = ((b"",) if (b"",) in self.count else ()), 0.0
        for w in [*tokenize(text), b""]:
            total += math.log10(self.probability(state, w))
            state = (*state, w)[-(ORDER - 1) :]
            while state and state not in self.count:
                state = state[1:]
        return total


# -- wire format: differences of sorted keys, bytes of equal weight together, then zstandard


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    gaps = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    body = gaps.tobytes() + counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(keys).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(body)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    body = zstandard.ZstdDecompressor().decompress(data[8:], max_output_size=16 * n + 1)
    gaps = np.frombuffer(body, np.uint8, 8 * n).reshape(8, n).T.copy().view(np.uint64).ravel()
    return np.cumsum(gaps, dtype=np.uint64), np.frombuffer(body, np.uint8, 8 * n, 8 * n).reshape(8, n).T.copy().view("<u8").ravel().astype(np.int64)


def pack_counts(counts: np.ndarray) -> bytes:
    body = counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(counts).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(body)


def unpack_counts(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    body = zstandard.ZstdDecompressor().decompress(data[8:], max_output_size=8 * n + 1)
    return np.frombuffer(body, np.uint8, 8 * n).reshape(8, n).T.copy().view("<u8").ravel().astype(np.int64)


def cut(keys: np.ndarray, bits: int, lanes: int, low: int = 0, high: int | None = None) -> np.ndarray:
    """Where each lane's range of the sorted keys begins and ends; lanes divide the keys from low to high (all of them) evenly."""
    high = 1 << (bits + TAG) if high is None else high
    edges = np.array([low + (high - low) * i // lanes for i in range(1, lanes)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _merged(packed: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each asker where its keys are among all distinct ones, these keys, and their summed counts."""
    got = [unpack(x) for x in packed]
    keys, inverse = np.unique(np.concatenate([k for k, _ in got]), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate([c for _, c in got]), minlength=len(keys)).astype(np.int64)
    return np.split(inverse, np.cumsum([len(k) for k, _ in got])[:-1]), keys, total


def score_texts(docs: DataFrame, id_col: str, text_col: str, held_out: Column, block_bytes: int = 8 << 20, shard_bytes: int = 8 << 20, fan: int = 1024) -> DataFrame:
    """Score every text by the automaton trained on the rows where held_out is false.

    Returns id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.
    block_bytes and shard_bytes bound the memory of a task; the number of tasks follows the input. fan: the most
    shards that a block asks directly; with more, relays stand between.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    blocks, shards = max(1, math.ceil(size / block_bytes)), max(1, math.ceil(size / shard_bytes))
    bits = min(62, max(32, math.ceil(math.log2(max(2, ORDER * size))) + 20))
    hop = shards > fan
    lanes = math.ceil(math.sqrt(shards)) if hop else shards
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))
    id_type = dealt.schema["id"].dataType.simpleString()

    def ask(group: pa.Table) -> pa.Table:
        b = Block(group["text"].to_pylist(), bits)
        c, e = b.counts(~np.array(group["held_out"].to_pylist(), bool)), cut(b.keys, bits, lanes)
        block = group["block"][0].as_py()
        relay = block // lanes * lanes if hop else 0  # the blocks that share relays
        return pa.table({"to": pa.array([relay + s for s in range(lanes)], pa.int64()), "frm": pa.array([block] * lanes, pa.int64()), "grams": pa.array([pack(b.keys[e[s] : e[s + 1]], c[e[s] : e[s + 1]]) for s in range(lanes)], pa.binary())})

    def relay_ask(group: pa.Table) -> pa.Table:
        _, keys, total = _merged(group["grams"].to_pylist())
        me = group["to"][0].as_py()
        lane, e = me % lanes, _lane_cut(keys, me % lanes)
        return pa.table({"to": pa.array([lane * lanes + s for s in range(lanes)], pa.int64()), "frm": pa.array([me] * lanes, pa.int64()), "grams": pa.array([pack(keys[e[s] : e[s + 1]], total[e[s] : e[s + 1]]) for s in range(lanes)], pa.binary())})

    def _lane_cut(keys: np.ndarray, lane: int) -> np.ndarray:
        edge = lambda i: (1 << (bits + TAG)) * i // lanes
        return cut(keys, bits, lanes, edge(lane), edge(lane + 1))

    def answer(group: pa.Table) -> pa.Table:
        asked, keys, total = _merged(group["grams"].to_pylist())
        stats = stats_of(keys, total).tobytes()
        return pa.table({"to": group["frm"].combine_chunks(), "frm": group["to"].combine_chunks(), "counts": pa.array([pack_counts(total[places]) for places in asked], pa.binary()), "stats": pa.array([stats] * len(group), pa.binary())})

    def gathered(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        got = sorted(zip(*(answers[k].to_pylist() for k in ("frm", "counts", "stats")), strict=True))
        return np.concatenate([unpack_counts(x[1]) for x in got]), sum(np.frombuffer(x[2]) for x in got)

    def relay_answer(asks: pa.Table, answers: pa.Table) -> pa.Table:
        asked, _, _ = _merged(asks["grams"].to_pylist())
        total, stats = gathered(answers)
        return pa.table({"to": asks["frm"].combine_chunks(), "frm": asks["to"].combine_chunks(), "counts": pa.array([pack_counts(total[places]) for places in asked], pa.binary()), "stats": pa.array([stats.tobytes()] * len(asks), pa.binary())})

    def finish(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(texts):
            return pa.table({"id": texts["id"], "held_out": texts["held_out"], **{k: pa.array([], t) for k, t in (("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))}})
        b = Block(texts["text"].to_pylist(), bits)
        c, stats = gathered(answers)
        r = b.score(c, stats)
        return pa.table({k: texts[k].combine_chunks() for k in ("id", "held_out")} | {"n_tokens": r["n_tokens"], "n_known": r["n_known"], "train_tokens": np.full(len(texts), int(stats[0]), np.int64), "base_score": r["base_score"], "score": r["score"]})

    message, reply = "to long, frm long, grams binary", "to long, frm long, counts binary, stats binary"
    asked = dealt.groupBy("block").applyInArrow(ask, message)
    if hop:
        relayed = asked.groupBy("to").applyInArrow(relay_ask, message).groupBy("to").applyInArrow(answer, reply)
        answers = asked.groupBy("to").cogroup(relayed.groupBy("to")).applyInArrow(relay_answer, reply)
    else:
        answers = asked.groupBy("to").applyInArrow(answer, reply)
    done = dealt.groupBy("block").cogroup(answers.groupBy("to")).applyInArrow(finish, f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return done.withColumnRenamed("id", id_col)
