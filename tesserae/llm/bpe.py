"""Byte-level BPE encoding of a corpus without a regular expression.

A batch of texts becomes one array of code points and one of their classes. Where the pieces of the public pre-tokeniser
begin is found by a finite automaton: every symbol is a transition function over its few states, functions compose
associatively, so the states before all symbols come from a blocked scan (functions of blocks composed first, then run
through each block) in numpy. The slices are merged by rank with a cache per worker; offsets are kept for decoding.
"""

from __future__ import annotations

import base64
import functools
import os
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tesserae.workspace import ship

#: Folder of the public vocabularies, and the one used where no other is named.
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: A worker forgets its cached pieces beyond so many, and so never grows with the corpus.
CACHE_PIECES = 200_000
BATCH_CHARS = 1_000_000

# Classes of code points.
LETTER, NUMBER, SPACE, BLANK, QUOTE, OTHER = range(6)
# Symbols of the automaton: a class seen with the code points after it.
#   S1 a blank that joins the piece after it; W other white space; W0 white space that ends a run before a piece;
#   A1, A2 an apostrophe before one or two letters of a contraction.
S_L, S_N, S_O, S_JOIN, S_W, S_W0, S_A1, S_A2 = range(8)
# States: what the last piece is made of so far. J a joined blank only; W in a run of white space; C2, C1 letters of a
# contraction still due; CE a contraction that is complete.
ST_START, ST_L, ST_N, ST_O, ST_J, ST_W, ST_C2, ST_C1, ST_CE = range(9)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a piece begins here) for every symbol and state."""
    nxt, cut = np.zeros((8, 9), np.uint8), np.zeros((8, 9), bool)
    for sym in range(8):
        for st in range(9):
            if st == ST_C2:  # the symbol is a letter of the contraction
                nxt[sym, st], cut[sym, st] = ST_C1, False
            elif st == ST_C1:
                nxt[sym, st], cut[sym, st] = ST_CE, False
            elif sym in (S_L, S_N, S_O):
                own = {S_L: ST_L, S_N: ST_N, S_O: ST_O}[sym]
                nxt[sym, st], cut[sym, st] = own, st not in (own, ST_J)
            elif sym == S_JOIN:
                nxt[sym, st], cut[sym, st] = ST_J, True
            elif sym in (S_W, S_W0):
                # the last white space before a piece stands alone, unless it joins that piece
                nxt[sym, st], cut[sym, st] = ST_W, sym == S_W0 or st != ST_W
            elif st in (ST_O, ST_J):  # an apostrophe within a run of marks is a mark
                nxt[sym, st], cut[sym, st] = ST_O, False
            else:
                nxt[sym, st], cut[sym, st] = (ST_C1 if sym == S_A1 else ST_C2), True
    return nxt, cut


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point, from the Unicode general categories."""
    table = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        k = unicodedata.category(chr(cp))[0]
        if k == "L":
            table[cp] = LETTER
        elif k == "N":
            table[cp] = NUMBER
    # fixed values: the code points with the property White_Space
    for lo, hi in ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        table[lo : hi + 1] = SPACE
    table[0x20], table[0x27] = BLANK, QUOTE
    return table


def _symbols(cp: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The automaton's symbol of every code point; ``ends`` marks the last code point of each text."""
    cls = _classes()[cp]
    sym = np.array([S_L, S_N, S_W, S_W, S_O, S_O], np.uint8)[cls]
    n = cp.size
    c1, c2 = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    c1[:-1] = np.where(ends[:-1], 0, cp[1:])
    c2[:-1] = np.where(ends[:-1], 0, c1[1:])
    white = (cls == SPACE) | (cls == BLANK)
    before = np.zeros(n, bool)  # white space right before a piece of the same text
    before[:-1] = white[:-1] & ~white[1:] & ~ends[:-1]
    sym[before & (cls == BLANK)] = S_JOIN
    sym[before & (cls == SPACE)] = S_W0
    mark = cls == QUOTE
    s, t, m, d, r, e, v, l = (ord(x) for x in "stmdrevl")
    sym[mark & ((c1 == s) | (c1 == t) | (c1 == m) | (c1 == d))] = S_A1
    sym[mark & (((c1 == r) & (c2 == e)) | ((c1 == v) & (c2 == e)) | ((c1 == l) & (c2 == l)))] = S_A2
    return sym


def piece_starts(cp: np.ndarray, ends: np.ndarray, block: int = 256) -> np.ndarray:
    """Whether a piece begins at each code point of the texts laid end to end."""
    n = cp.size
    if n == 0:
        return np.zeros(0, bool)
    nxt, cut = _automaton()
    sym = _symbols(cp, ends)
    # the state is reset after the last code point of a text: 8 more symbols that lead to the start
    table = np.vstack([nxt, np.zeros_like(nxt)])
    code = sym.astype(np.intp) + 8 * ends
    rows = -(-n // block)
    code = np.concatenate([code, np.full(rows * block - n, S_L, np.intp)]).reshape(rows, block)
    # 1. the function of every block: the composition of its symbols' functions, all blocks and states at once
    f = np.broadcast_to(np.arange(9, dtype=np.uint8), (rows, 9)).copy()
    for j in range(block):
        f = table[code[:, j][:, None], f]
    # 2. the state before every block
    first, st = np.zeros(rows, np.uint8), 0
    for i in range(rows):
        first[i] = st
        st = f[i, st]
    # 3. the states within the blocks
    states = np.empty((rows, block), np.uint8)
    at = first
    for j in range(block):
        states[:, j] = at
        at = table[code[:, j], at]
    starts = cut[sym, states.reshape(-1)[:n]]
    starts[0] = True
    starts[1:] |= ends[:-1]
    return starts


class Encoder:
    """Encodes texts by the ranks of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one piece: neighbours whose join has the least rank are joined first."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        if len(piece) > 128:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = self.ranks
        while len(parts) > 1:
            low, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (low is None or r < low):
                    low, at = r, i
            if low is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(ranks[p] for p in parts)

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same by a heap over a linked list, for pieces so long that scanning again and again is too slow."""
        import heapq

        n, ranks = len(piece), self.ranks
        end = [i + 1 for i in range(n)]
        prev, alive = [i - 1 for i in range(n)], [True] * n
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = end[i]
            if j < n:
                r = ranks.get(piece[i : end[j]])
                if r is not None:
                    heapq.heappush(heap, (r, i, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i] if alive[i] else n
            if not alive[i] or j >= n or end[j] != stop:
                continue
            alive[j] = False
            end[i] = stop
            if stop < n:
                prev[stop] = i
            offer(i)
            if prev[i] >= 0:
                offer(prev[i])
        return tuple(ranks[piece[i : end[i]]] for i in range(n) if alive[i])

    def pieces(self, texts: Sequence[str]) -> tuple[str, np.ndarray, np.ndarray]:
        """(the texts laid end to end, where pieces begin and end in it, the number of pieces up to each text's end)."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        whole = "".join(texts)
        cp = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        stops = np.cumsum(lengths)
        ends = np.zeros(cp.size, bool)
        ends[stops[lengths > 0] - 1] = True
        at = np.flatnonzero(piece_starts(cp, ends))
        return whole, np.append(at, cp.size), np.searchsorted(at, stops)

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        whole, at, upto = self.pieces(texts)
        cache, merge = self.cache, self.merge
        if len(cache) > CACHE_PIECES:
            cache.clear()
        cuts, out, lo = at.tolist(), [], 0
        for hi in upto.tolist():
            ids: list[int] = []
            for k in range(lo, hi):
                piece = whole[cuts[k] : cuts[k + 1]]
                got = cache.get(piece)
                if got is None:
                    got = merge(piece.encode("utf-8", "surrogatepass"))
                    if len(piece) <= 64:
                        cache[piece] = got
                ids += got
            out.append(ids)
            lo = hi
        return out

    def decode(self, ids: Sequence[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")

    def offsets(self, ids: Sequence[int]) -> list[int]:
        """Where each token begins, in bytes of the text."""
        sizes = [len(self.bytes_of[i]) for i in ids]
        return [0, *np.cumsum(sizes[:-1]).tolist()] if sizes else []


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _batches(texts: Sequence[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BATCH_CHARS code points each; a longer text is a range of its own."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BATCH_CHARS:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def _texts(s: pd.Series) -> list[str]:
    return [t if isinstance(t, str) else "" for t in s]


def encode_column(df: DataFrame, text: str = "text", path: str = "", count_only: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns with ``ids``, the token ids of ``text``, or with ``n_tokens`` alone if ``count_only``.

    Null and empty texts give an empty list (0 tokens). Strings that look like special tokens are ordinary text. Whole texts
    are encoded, however long. The vocabulary is read once per worker from ``path``, which all executors must have.
    """
    ship(df.sparkSession)
    path = path or f"{TOKENIZER_DIR}/{VOCABULARY}"
    keep = list(keep)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for f in frames:
            texts = _texts(f["_text"])
            for lo, hi in _batches(texts):
                ids = enc.encode(texts[lo:hi])
                part = f[keep].iloc[lo:hi].copy()
                if count_only:
                    part["n_tokens"] = [len(x) for x in ids]
                else:
                    part["ids"] = ids
                yield part

    schema = df.select(*keep).schema.add("n_tokens", "long") if count_only else df.select(*keep).schema.add("ids", ArrayType(IntegerType()))
    return df.select(*keep, F.col(text).alias("_text")).mapInPandas(run, schema)


def decode_column(df: DataFrame, ids: str = "ids", path: str = "", keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns with ``text``, the text of the ids; null ids give null."""
    ship(df.sparkSession)
    path = path or f"{TOKENIZER_DIR}/{VOCABULARY}"
    keep = list(keep)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for f in frames:
            out = f[keep].copy()
            out["text"] = [None if x is None else enc.decode(list(x)) for x in f["_ids"]]
            yield out

    return df.select(*keep, F.col(ids).alias("_ids")).mapInPandas(run, df.select(*keep).schema.add("text", "string"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_column(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])


def p8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, n_docs, n_tokens) of the whole corpus."""
    n = encode_column(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["source"], count_only=True)
    return n.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
