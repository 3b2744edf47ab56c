"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding.

The pattern public_tokenizers.PATTERN is located without a regular expression. Each code point gets a
class from an array, each position a symbol from its class and its right neighbours' (the pattern looks
ahead by at most two), and each symbol is a function from states to states. Functions compose
associatively, so the text is cut into blocks: the blocks' functions are composed for all states at
once, a doubling scan over the blocks gives each block's first state, and a second pass marks the
positions where a slice begins. Slices go to a bounded cache of merged pairs.

Null texts count as empty: no slice, no id. A text of any length is handled whole, its slices being located in stretches of
STEP_CHARS that begin where a slice does. Repeated rows and null keys are rows like others; other columns aren't read, whatever their names. An
empty table gives no row.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidelog.llm.common import STEP_CHARS, ship, steps

# The code points of Unicode's White_Space property.
WHITE_SPACE = (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004,
    0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
OTHER, LETTER, NUMBER, SPACE = range(4)
#: Bytes of a slice that is merged on plain lists; what stands for no rank there.
SHORT, NO_RANK = 48, 1 << 62

# Symbols: a space or other white space is "last" if text that isn't white space follows it.
LET, NUM, OTH, SP_LAST, WS_LAST, WS_MID, APOS1, APOS2, RESET = range(9)
# States: a slice ends here; in letters; in numbers; in others; after a space that joins what follows;
# in white space; one or two letters of a contraction to go.
FRESH, IN_L, IN_N, IN_O, GLUE, IN_S, ONE, TWO = range(8)


@functools.cache
def class_table() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[list(WHITE_SPACE)] = SPACE
    return out


@functools.cache
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a slice begins, each at symbol * 8 + state."""
    goes = {LET: IN_L, NUM: IN_N, OTH: IN_O, SP_LAST: GLUE, WS_LAST: FRESH, WS_MID: IN_S, APOS1: ONE, APOS2: TWO, RESET: FRESH}
    stays = {(LET, IN_L), (NUM, IN_N), (OTH, IN_O), (APOS1, IN_O), (APOS2, IN_O), (WS_MID, IN_S)}
    joins = {(s, GLUE) for s in (LET, NUM, OTH, APOS1, APOS2)} | {(LET, ONE), (LET, TWO)}
    nxt, begins = np.zeros(72, np.intp), np.zeros(72, bool)
    for symbol, to in goes.items():
        for state in range(8):
            at, on = symbol * 8 + state, (symbol, state)
            begins[at] = on not in stays and on not in joins and symbol != RESET
            if symbol in (APOS1, APOS2) and state in (IN_O, GLUE):
                to_state = IN_O
            elif on == (LET, ONE):
                to_state = FRESH
            elif on == (LET, TWO):
                to_state = ONE
            else:
                to_state = to
            nxt[at] = to_state
    return nxt, begins


def symbols(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The symbol of each code point; ends: positions that separate texts."""
    kind = class_table()[points]
    white = kind == SPACE
    black = ~white
    black[ends] = False
    followed = np.zeros(len(points), bool)
    followed[:-1] = black[1:]
    out = np.array([OTH, LET, NUM, WS_MID], np.intp)[kind]
    out[white & followed] = WS_LAST
    out[(points == 0x20) & followed] = SP_LAST
    at = np.flatnonzero(points[:-1] == 0x27)
    if len(at):
        a, b = points[at + 1], points[np.minimum(at + 2, len(points) - 1)]
        out[at[np.isin(a, [ord(c) for c in "stmd"])]] = APOS1
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        out[at[two & (at + 2 < len(points))]] = APOS2
    out[ends] = RESET
    return out


def scan(symbol: np.ndarray, blocks: int = 2048) -> np.ndarray:
    """Where slices begin, by composing the symbols' functions block by block."""
    nxt, begins = automaton()
    n = len(symbol)
    blocks = max(1, min(blocks, n // 64 or 1))
    length = -(-n // blocks)
    padded = np.full(blocks * length, RESET, np.intp)
    padded[:n] = symbol
    by_step = np.ascontiguousarray(padded.reshape(blocks, length).T) * 8
    if blocks > 1:
        f = np.repeat(np.arange(8, dtype=np.intp)[:, None], blocks, axis=1)
        for row in by_step:
            f = nxt[f + row]
        reach = 1
        while reach < blocks:  # after this, f[s, b] is where blocks 0 to b lead from state s
            ahead = f.copy()
            ahead[:, reach:] = f[f[:, :-reach], np.arange(reach, blocks)]
            f, reach = ahead, reach * 2
        state = np.concatenate([[FRESH], f[FRESH, :-1]])
    else:
        state = np.zeros(1, np.intp)
    marks = np.empty((length, blocks), bool)
    for t, row in enumerate(by_step):
        at = row + state
        marks[t] = begins[at]
        state = nxt[at]
    return np.flatnonzero(marks.T.ravel()[:n])


def boundaries(texts: list[str]) -> list[np.ndarray]:
    """For each text, the code-point offsets where its slices begin."""
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    ends = np.cumsum(sizes + 1) - 1
    points = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le"), np.uint32)
    begins = scan(symbols(points, ends))
    first = ends - sizes
    cuts = np.searchsorted(begins, np.concatenate([first, [len(points)]]))
    return [begins[cuts[i] : cuts[i + 1]] - first[i] for i in range(len(texts))]


def long_boundaries(text: str, size: int = STEP_CHARS) -> np.ndarray:
    """boundaries() of one text, a stretch at a time: each begins where the last slice but for the stretch's end begins, as a slice's start needs nothing before it."""
    out, pos, room = [], 0, size
    while True:
        found = boundaries([text[pos : pos + room]])[0]
        if pos + room >= len(text):
            return np.concatenate([*out, found + pos])
        sure = found[found <= room - 4]  # the pattern looks ahead by two at most
        if len(sure) > 1:
            out.append(sure[:-1] + pos)
            pos, room = pos + int(sure[-1]), size
        else:
            room *= 2  # a slice longer than the stretch


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a slice: of all neighbouring pairs that have a rank, the lowest, leftmost one is joined, again and again.

    Parts are a linked list and pairs a heap, so a slice of n bytes takes n log n steps however long it is.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    get = ranks.get
    if n <= SHORT:  # the same on plain lists, which is faster as long as they are short
        parts = [piece[i : i + 1] for i in range(n)]
        pairs = [get(piece[i : i + 2], NO_RANK) for i in range(n - 1)]
        while pairs and (lowest := min(pairs)) != NO_RANK:
            i = pairs.index(lowest)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], NO_RANK)
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], NO_RANK)
        return [ranks[p] for p in parts]
    ends = list(range(1, n + 1))  # of the part that begins at i; the next part begins there
    before = list(range(-1, n - 1))
    now = [get(piece[i : i + 2], -1) for i in range(n - 1)] + [-1]  # rank of the pair whose left part begins at i, or -1
    heap = [(r, i) for i, r in enumerate(now) if r >= 0]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        if now[i] != rank:
            continue  # one of its parts has been joined since
        j = ends[i]
        end = ends[i] = ends[j]
        now[j] = -1
        if end < n:
            before[end] = i
            now[i] = get(piece[i : ends[end]], -1)
            if now[i] >= 0:
                heapq.heappush(heap, (now[i], i))
        else:
            now[i] = -1
        b = before[i]
        if b >= 0:
            now[b] = get(piece[b:end], -1)
            if now[b] >= 0:
                heapq.heappush(heap, (now[b], b))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return out


class Merged(dict):
    """Slice -> its ids as little-endian 32-bit integers. Bounded: what was used since the last time it was full is kept, the rest goes; slices over longest aren't kept."""

    def __init__(self, path: str, limit: int = 16_000_000, longest: int = 512):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.limit, self.longest, self.held = limit, longest, 0  # characters, and 32 for each slice
        self.older: dict[str, bytes] = {}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            found = merge(piece.encode(), self.ranks)
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(piece) <= self.longest:
            if self.held > self.limit:
                self.older, self.held = dict(self), 0
                self.clear()
            self[piece] = ids
            self.held += len(piece) + 32
        return ids


@functools.cache
def merged(path: str) -> Merged:
    return Merged(path)


def encode_texts(texts: list[str], path: str) -> Iterator[tuple[bytes, np.ndarray, list[bytes]]]:
    """Of each text: ids (packed), offsets of its slices, packed ids by slice."""
    table = merged(path)
    for a, b in steps(texts):
        part = texts[a:b]
        long = len(part) == 1 and len(part[0]) > STEP_CHARS
        for text, begins in zip(part, [long_boundaries(part[0])] if long else boundaries(part), strict=True):
            cuts = begins.tolist()
            pieces = [table[text[i:j]] for i, j in zip(cuts, [*cuts[1:], len(text)])]
            yield b"".join(pieces), begins, pieces


def decode_ids(ids: Iterable[int], path: str) -> bytes:
    return b"".join(map(merged(path).tokens.__getitem__, ids))


#: What encode() can return of each text, by name and type.
OUTPUTS = {
    "n_tokens": "bigint", "ids": "array<int>", "slice_starts": "array<int>", "slice_tokens": "array<int>",
    "ids_sha256": "string", "decoded_sha256": "string",
}


def encode(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", outputs: tuple[str, ...] = ("n_tokens", "ids", "slice_starts", "slice_tokens")) -> DataFrame:
    """Row by row: key and the outputs named.

    slice_starts and slice_tokens (code-point offset and number of ids of each slice) map ids back to
    the text. Other columns of df are not read. Null texts are empty; repeated rows are encoded each.
    """
    ship(df.sparkSession)
    wanted = [o for o in OUTPUTS if o in outputs]

    def some(keys: np.ndarray, texts: list[str]) -> pd.DataFrame:
        got: dict[str, list] = {o: [] for o in wanted}
        for packed, begins, pieces in encode_texts(texts, path):
            ids = np.frombuffer(packed, "<u4")
            if "n_tokens" in got:
                got["n_tokens"].append(len(ids))
            if "ids" in got:
                got["ids"].append(ids.astype(np.int32))
            if "slice_starts" in got:
                got["slice_starts"].append(begins.astype(np.int32))
            if "slice_tokens" in got:
                got["slice_tokens"].append(np.array([len(p) // 4 for p in pieces], np.int32))
            if "ids_sha256" in got:
                got["ids_sha256"].append(hashlib.sha256(packed).hexdigest())
            if "decoded_sha256" in got:
                got["decoded_sha256"].append(hashlib.sha256(decode_ids(ids.tolist(), path)).hexdigest())
        return pd.DataFrame({key: keys, **got})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            every = [t if isinstance(t, str) else "" for t in pdf.iloc[:, 1]]
            for a, b in steps(every):
                yield some(pdf.iloc[a:b, 0].to_numpy(), every[a:b])

    source = df.select(df[key], df[text])
    kind = source.schema[0].dataType.simpleString()
    return source.mapInPandas(run, ", ".join([f"`{key}` {kind}", *(f"{o} {OUTPUTS[o]}" for o in wanted)]))


def query(spark, sf_dir):
    """op7: ids and decoded bytes of every document, as digests."""
    import public_tokenizers

    from tidelog.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
