"""SentencePiece BPE encoding and decoding with a merge-type prefix table.

For a byte-pair vocabulary whose merges are ranked by the merged piece, every prefix of a text has
one last token: the token t ending there such that the prefix before t is encoded with last token s
and "s t" is left unmerged by the merge rules. So one pass of an Aho-Corasick automaton over the
text, which reports every piece ending at each position, fills a table of last tokens; a candidate
is kept if the pair (s, t) is compatible. The ids are then read off backwards. The work is linear in
the text, however long it is.

Pair compatibility needs no encoding: s and t were each built by their own merges; the first merge
that would join material across the border must not come before the merges that build the two sides.
`_compatible` walks down the right edge of s and the left edge of t in order of merge rank.

No piece contains a space mark after another character, and characters outside the vocabulary become
byte tokens which never merge; so a text falls into spans that are encoded apart. Spans repeat, and a
bounded cache holds their ids.

Defined results: null text = empty; an empty text has no ids and decodes to an empty text; repeated
rows are encoded row by row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, whole

MARK = "▁"
CACHE = 300_000


class PrefixTableCodec:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)  # read for its vocabulary only
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)}
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        usable = [i for i in range(n) if i not in special]
        self.id_of = {self.pieces[i]: i for i in usable}
        if len(self.byte_ids) != 256 or any(MARK in p.lstrip(MARK) for p in self.id_of):
            raise ValueError("the vocabulary needs byte fallback, and space marks only at the start of pieces")
        order = sorted(usable, key=lambda i: -model.get_score(i))
        self.rank = {t: k for k, t in enumerate(order)}
        self.parts: dict[int, tuple[int, int]] = {}
        self.automaton = ahocorasick.Automaton()
        for t in usable:
            piece = self.pieces[t]
            if len(piece) == 1 or self._split(t):
                self.automaton.add_word(piece, (t, len(piece)))
        self.automaton.make_automaton()
        single = "".join(re.escape(p) for p in self.id_of if len(p) == 1 and p != MARK)
        self.spans = re.compile(f"{MARK}*[{single}]+|{MARK}+|[^{single}{MARK}]+").findall
        self.known = {p for p in self.id_of if len(p) == 1}
        self.bytes_of = [p.replace(MARK, " ").encode() for p in self.pieces]
        for b, i in self.byte_ids.items():
            self.bytes_of[i] = bytes([b])
        for i in special - set(self.byte_ids.values()):
            self.bytes_of[i] = b""
        self.pair_ok: dict[int, bool] = {}
        self.cache: dict[str, tuple[int, ...]] = {}

    def _split(self, t: int) -> bool:
        """Merge a piece's characters by rank; record its last merge if the piece itself comes out."""
        piece = self.pieces[t]
        if any(c not in self.id_of for c in piece):
            return False
        parts = [self.id_of[c] for c in piece]
        last = None
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                m = self.id_of.get(self.pieces[parts[i]] + self.pieces[parts[i + 1]])
                if m is not None and (best is None or self.rank[m] < best):
                    best, at, made = self.rank[m], i, m
            if best is None:
                return False
            last = (parts[at], parts[at + 1])
            parts[at : at + 2] = [made]
        self.parts[t] = last
        return True

    def _compatible(self, s: int, t: int) -> bool:
        """Do the merge rules leave s and t apart?

        Undo the later of the two sides' last merges again and again. While the border then lies
        between a and b, a merge of a with b happens before the last undone merge exactly if its rank
        is lower (at equal rank the leftmost goes first); in that case s and t would not both arise.
        """
        pieces, parts, rank, get = self.pieces, self.parts, self.rank, self.id_of.get
        limit = len(pieces) << 1  # ranks doubled; the odd value lets an equal merge further right lose
        a, b = s, t
        while True:
            m = get(pieces[a] + pieces[b])
            if m is not None and 2 * rank[m] < limit:
                return False
            pa, pb = parts.get(a), parts.get(b)
            ra, rb = rank[a] if pa else -1, rank[b] if pb else -1
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = 2 * ra, pa[1]
            else:
                limit, b = 2 * rb + 1, pb[0]

    def _span(self, span: str) -> tuple[int, ...]:
        if span[0] not in self.known:
            return tuple(self.byte_ids[b] for b in span.encode())
        n = len(span)
        last = [-1] * (n + 1)
        ok, compatible = self.pair_ok, self._compatible
        for end, (t, size) in self.automaton.iter(span):
            end += 1
            if last[end] >= 0:
                continue
            if size == end:
                last[end] = t
                continue
            s = last[end - size]
            if s < 0:
                continue
            key = s << 20 | t
            fits = ok.get(key)
            if fits is None:
                if len(ok) > CACHE:
                    ok.clear()
                ok[key] = fits = compatible(s, t)
            if fits:
                last[end] = t
        ids, at = [], n
        while at:
            t = last[at]
            ids.append(t)
            at -= len(self.pieces[t])
        return tuple(reversed(ids))

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        cache = self.cache
        for span in self.spans(MARK + text.replace(" ", MARK)):
            ids = cache.get(span)
            if ids is None:
                ids = self._span(span)
                if len(span) < 64:
                    if len(cache) > CACHE:
                        cache.clear()
                    cache[span] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """Bytes of the pieces; the space put before the text goes, and broken UTF-8 becomes U+FFFD, byte by byte."""
        data = b"".join(map(self.bytes_of.__getitem__, ids))
        if data[:1] == b" ":
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return data.decode(errors="replace")


_codecs: dict[str, PrefixTableCodec] = {}


def codec(path: str) -> PrefixTableCodec:
    if path not in _codecs:
        _codecs[path] = PrefixTableCodec(path)
    return _codecs[path]


def encode_decode(docs: DataFrame, id_col: str, text_col: str, model: str) -> DataFrame:
    """Every text's ids and the text decoded from them: id_col, ids array<int>, decoded string."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(texts: list[str]) -> list[tuple]:
        c = codec(model)
        return [(ids := c.encode(t), c.decode(ids)) for t in texts]

    src = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text"))
    return map_rows(src, run, f"id {kind}, ids array<long>, decoded string", ["ids", "decoded"]).withColumnRenamed("id", id_col)


def digests(docs: DataFrame, id_col: str, text_col: str, model: str) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of encode_decode, without moving the ids out of the worker."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(texts: list[str]) -> list[tuple]:
        c, out = codec(model), []
        names = _names(c)
        for t in texts:
            ids = c.encode(t)
            out.append((len(ids), hashlib.sha256(b",".join(map(names.__getitem__, ids))).hexdigest(), hashlib.sha256(c.decode(ids).encode()).hexdigest()))
        return out

    src = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text"))
    return map_rows(src, run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", ["n_tokens", "ids_sha256", "decoded_sha256"]).withColumnRenamed("id", id_col)


def _names(c: PrefixTableCodec) -> list[bytes]:
    if not hasattr(c, "names"):
        c.names = [str(i).encode() for i in range(len(c.pieces))]
    return c.names
