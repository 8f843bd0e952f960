"""SentencePiece encoding by forward filtering and backward sampling, and decoding."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import fields, map_rows

#: The model's file; a parameter of every function that needs it.
MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
#: What stands for a space in pieces.
SPACE = "▁"
#: Text bytes of one call: their lattices take some hundred times that.
CALL_BYTES = 1 << 19


def read_model(path: str) -> bytes:
    """The model file's content, read once on the driver (half a MB) and sent with the tasks."""
    with open(path, "rb") as file:
        return file.read()


class Vocabulary:
    """Pieces with their log weights, and the bytes that pieces stand for.

    The vocabulary ranks its pieces by merge order; a piece's weight is Zipf's,
    ``1 / (rank + offset)``, to the power ``sharpness``.  A character that no piece
    starts with falls back to its UTF-8 bytes, and so does a literal ``SPACE`` sign.
    """

    def __init__(self, model: bytes, sharpness: float = 1.0, offset: float = 10.0):
        sp = sentencepiece.SentencePieceProcessor()
        sp.LoadFromSerializedProto(model)
        self.raw: list[bytes] = []
        self.byte_ids = [0] * 256
        self.weight: dict[str, tuple[int, float]] = {}
        rank = 0
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.raw.append(b"")
            else:
                self.weight[piece] = (i, -sharpness * float(np.log(rank + offset)))
                self.raw.append(piece.replace(SPACE, " ").encode())
                rank += 1
        # white space inside pieces other than at their start would join chunks
        self.joins = any(SPACE in p.lstrip(SPACE) for p in self.weight)
        lines = any("\n" in p for p in self.weight)
        plain = r"[^▁]" if lines else r"[^▁\n]"
        self.chunks = re.compile(rf"▁*{plain}+|▁+" + ("" if lines else r"|\n"), re.S)

    def split(self, text: str) -> list[str]:
        """Chunks across whose borders no piece reaches."""
        return [text] if self.joins else self.chunks.findall(text)


class Trie:
    """All pieces as a tree of characters, followed for many places at once.

    Transitions are kept in an open-addressing table of (state, character) keys.
    """

    def __init__(self, weight: dict[str, tuple[int, float]]):
        states: dict[tuple[int, int], int] = {}
        final = {0: (-1, 0.0)}
        for piece, found in weight.items():
            at = 0
            for c in piece:
                at = states.setdefault((at, ord(c)), len(states) + 1)
            final[at] = found
        n = len(states) + 1
        self.piece = np.array([final.get(i, (-1, 0.0))[0] for i in range(n)], np.int32)
        self.weight = np.array([final.get(i, (-1, 0.0))[1] for i in range(n)], np.float32)
        self.mask = (1 << (4 * n).bit_length()) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.to = np.full(self.mask + 1, -1, np.int32)
        keys = np.array([s << 21 | c for s, c in states], np.int64)
        to = np.array(list(states.values()), np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            _, one = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            put = np.zeros(len(slot), bool)
            put[one] = True
            put &= free
            self.keys[slot[put]], self.to[slot[put]] = keys[put], to[put]
            keys, to, slot = keys[~put], to[~put], (slot[~put] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(40)).astype(np.int64) & self.mask

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The next states, -1 where there is none."""
        keys = state.astype(np.int64) << 21 | char
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.to[slot], -1)
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            held = self.keys[slot[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.to[slot[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return out


_END = 0x1FFFFF


class Lattices:
    """The lattices of distinct chunks side by side, with their forward filter.

    Chunks are ordered by falling length; node ``offset[p] + c`` is place p of chunk c, so
    the nodes of one place are neighbours and all chunks filter forward together.
    Edges are sorted by the node where they end.  ``ids`` is an edge's piece (or ``-1 -
    code point`` for a character in bytes), ``start`` the node where it starts, and
    ``cum`` the number of its end node plus the running probability among the edges that
    end there: ascending, so that one search finds a drawn edge.
    """

    def __init__(self, chunks: list[str], trie: Trie):
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        order = np.argsort(-sizes, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        longest = int(sizes[order[0]])
        per_place = np.cumsum(np.bincount(sizes, minlength=longest + 2)[::-1])[::-1]
        self.offset = offset = np.concatenate(([0], np.cumsum(per_place)))
        nodes = int(offset[longest + 1])
        text = "\n".join([*chunks, ""]).encode("utf-32-le", "surrogatepass")
        flat = np.frombuffer(text, np.uint32).astype(np.int64)
        base = np.cumsum(sizes + 1) - (sizes + 1)
        flat[base + sizes] = _END
        place = np.arange(nodes) - np.repeat(base, sizes + 1)
        node = offset[place] + np.repeat(rank, sizes + 1)
        chars = np.empty(nodes, np.int64)
        chars[node] = flat
        at = np.empty(nodes, np.int32)
        at[node] = place
        self.last = offset[sizes] + rank  # by the chunks' own order

        first = np.flatnonzero(chars != _END).astype(np.int32)
        offset = offset.astype(np.int32)
        begun = at[first]
        column = first - offset[begun]
        del text, flat, place, node
        state = np.zeros(len(first), np.int32)
        starts, ends, ids, weights = [], [], [], []
        here = first
        step = 0
        while len(first):
            step += 1
            state = trie.step(state, chars[here])
            piece = trie.piece[state]
            piece[state < 0] = -1
            here = offset[begun + step] + column
            got = piece >= 0
            starts.append(first[got]), ends.append(here[got])
            ids.append(piece[got]), weights.append(trie.weight[state[got]])
            if step == 1:  # characters that are no piece
                c = chars[first[~got]]
                size = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
                starts.append(first[~got]), ends.append(here[~got])
                ids.append((-1 - c).astype(np.int32))
                weights.append((-12.0 * size).astype(np.float32))
            live = (state >= 0) & (chars[here] != _END)
            first, begun, column, state, here = (
                x[live] for x in (first, begun, column, state, here)
            )
        ends = np.concatenate(ends)
        order = np.argsort(ends, kind="stable").astype(np.int32)
        ends = ends[order]
        self.start = np.concatenate(starts)[order]
        self.ids = np.concatenate(ids)[order]
        weight = np.concatenate(weights)[order]
        del starts, ids, weights, order
        per_node = np.bincount(ends, minlength=nodes)
        self.first = np.concatenate(([0], np.cumsum(per_node)))
        self.cum = np.empty(len(ends))
        alpha = np.zeros(nodes)
        for p in range(1, longest + 1):
            low, high = offset[p], offset[p + 1]
            e, f = self.first[low], self.first[high]
            seg = self.first[low:high] - e
            value = alpha[self.start[e:f]] + weight[e:f]
            column = ends[e:f] - low
            top = np.maximum.reduceat(value, seg)
            share = np.exp(value - top[column])
            run = np.cumsum(share)
            before = run[seg] - share[seg]
            total = np.add.reduceat(share, seg)
            alpha[low:high] = top + np.log(total)
            self.cum[e:f] = (run - before[column]) / total[column]
        self.cum[self.first[offset[1] + 1 :] - 1] = 1.0
        self.cum += ends


def _mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit words (three rounds of multiply and shift)."""
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class Sampler:
    """Draws segmentations of whole texts; the same seed gives the same one."""

    def __init__(self, model: bytes, **options: float):
        self.vocabulary = Vocabulary(model, **options)
        self.trie = Trie(self.vocabulary.weight)

    def __call__(self, texts: list[str | None], seeds: np.ndarray) -> list[np.ndarray]:
        """Piece ids of each text, drawn with its seed."""
        out: list = [_EMPTY] * len(texts)
        plain = [i for i, t in enumerate(texts) if t and SPACE not in t]
        for i, found in zip(plain, self._draw([texts[i] for i in plain], seeds[plain])):
            out[i] = found
        for i, t in enumerate(texts):
            if t and SPACE in t:  # the sign itself: coded in bytes, behind a free character
                used = set(t)
                free = next(c for c in map(chr, range(0xE000, 0x110000)) if c not in used)
                out[i] = self._draw([t.replace(SPACE, free)], seeds[[i]], free)[0]
        return out

    def _draw(self, texts: list[str], seeds: np.ndarray, literal: str = "") -> list[np.ndarray]:
        """The same for texts without ``SPACE`` signs, for which ``literal`` stands.

        A text gets a leading ``SPACE`` and its spaces become ``SPACE``.  The lattices of
        the distinct chunks are laid side by side; then all chunks of all texts step back
        together, one piece at a time.
        """
        split = self.vocabulary.split
        chunks: list[str] = []
        per_text = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            parts = split(SPACE + text.replace(" ", SPACE))
            per_text[i] = len(parts)
            chunks += parts
        if not chunks:
            return []
        coded = pa.array(chunks).dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        found = Lattices(coded.dictionary.to_pylist(), self.trie)
        owner = np.repeat(np.arange(len(texts)), per_text)
        offset = np.cumsum(per_text) - per_text
        place = np.arange(len(chunks)) - offset[owner]
        seed = _mix(seeds.astype(np.uint64)[owner] + place.astype(np.uint64) * _GOLDEN)
        at = found.last[which]
        begin = found.offset[1]  # nodes before are those of place 0
        live = np.arange(len(chunks))
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        while len(live):
            draw = _mix(seed) >> np.uint64(11)
            u = draw.astype(np.float64) / float(1 << 53)
            edge = np.searchsorted(found.cum, at + u, side="right")
            edge = np.clip(edge, found.first[at], found.first[at + 1] - 1)
            steps.append((live, found.ids[edge]))
            at = found.start[edge]
            more = at >= begin
            live, at, seed = live[more], at[more], seed[more] + _GOLDEN
        # steps ran backward: order by chunk, last step first
        where = np.concatenate([s[0] for s in steps])
        what = np.concatenate([s[1] for s in steps])
        order = np.argsort(where[::-1], kind="stable")
        what, where = what[::-1][order], where[::-1][order]
        if (what < 0).any():
            what, where = self._in_bytes(what, where, literal)
        counts = np.bincount(owner[where], minlength=len(texts))
        return np.split(what, np.cumsum(counts)[:-1])

    def _in_bytes(self, what: np.ndarray, where: np.ndarray, literal: str):
        """Replace each character without piece by the ids of its bytes."""
        table = self.vocabulary.byte_ids
        codes = {
            c: [table[b] for b in (SPACE if chr(-1 - c) == literal else chr(-1 - c)).encode()]
            for c in np.unique(what[what < 0]).tolist()
        }
        sizes = np.ones(len(what), np.int64)
        for c, found in codes.items():
            sizes[what == c] = len(found)
        out = np.repeat(what, sizes)
        start = np.cumsum(sizes) - sizes
        for c, found in codes.items():
            for k, piece in enumerate(found):
                out[start[what == c] + k] = piece
        return out, np.repeat(where, sizes)


_EMPTY = np.empty(0, np.int64)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def encode(
    df: DataFrame,
    key: str,
    text: str,
    model: str = MODEL,
    seed: int = 0,
    sharpness: float = 1.0,
    carry: tuple[str, ...] = (),
    check: bool = False,
) -> DataFrame:
    """``key, *carry, n_pieces, ids``: a sampled segmentation of each whole text.

    With ``check`` every text is decoded again in the same task, and ``lossless`` tells
    whether it came back (null and empty texts count as empty).

    The draw depends on the seed, the row's key and the text alone, so repeated rows and
    reruns agree.  Null and empty texts have no pieces; null keys share a seed.
    """
    content = read_model(model)

    def make():
        sampler = Sampler(content, sharpness=sharpness)
        raw = sampler.vocabulary.raw

        def run(keys, hashes, texts, *kept):
            found = sampler(texts, np.array(hashes, np.int64).view(np.uint64))
            sizes = np.array([len(f) for f in found])
            flat = np.concatenate(found or [_EMPTY]).astype(np.int32)
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            out = keys, *kept, sizes, pa.ListArray.from_arrays(offsets, flat)
            if not check:
                return out
            pairs = zip(texts, found, strict=True)
            return *out, [(t or "") == join_pieces(f.tolist(), raw) for t, f in pairs]

        return run

    schema = f"{fields(df, key, *carry)}, n_pieces bigint, ids array<int>"
    schema += ", lossless boolean" * check
    drawn = F.xxhash64(F.lit(seed), F.col(key)).alias("_seed")
    return map_rows(df, [key, drawn, text, *carry], schema, make, CALL_BYTES)


def decode(df: DataFrame, ids: str, text: str, model: str = MODEL) -> DataFrame:
    """``df`` with the column ``text`` decoded from ``ids``; exactly what was encoded.

    Null ids give a null text, none an empty one.
    """
    content = read_model(model)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        raw = Vocabulary(content).raw
        for batch in batches:
            yield batch.map(lambda x: None if x is None else join_pieces(x.tolist(), raw))

    return df.withColumn(text, run(F.col(ids)))


def join_pieces(ids, raw: list[bytes]) -> str:
    """The text of pieces: their bytes joined, without the leading space."""
    return b"".join([raw[i] for i in ids])[1:].decode("utf-8", "replace")
