"""SentencePiece encoding and decoding with a weighted finite-state transducer.

Three machines are compiled from a model file: the normaliser (rewrites of the file's character map, then spaces squeezed,
prefixed and escaped: the longest match is taken, so it has one output for an input), the pieces (numbered states with an arc a
character, and where a piece ends an arc with its id and weight back to the start), and the byte fallback (an arc over any
character outside the vocabulary, that puts out its bytes).  A normalised input is composed with the last two
lazily, state by state, and the tropical-semiring shortest path is its encoding.  Encodings of chunks are a cache on top.

* Unigram models: an arc for a piece costs its negative score; the cheapest path wins.
* BPE models: scores are merge ranks, which no sum of arc weights can order.  Their transducer remembers the
  last piece (one state per piece) and has an arc a -> b of weight 0 only where merging the characters of a+b by
  rank leaves just the pieces a, b; all other arcs weigh infinity.  Merges cross a boundary of a whole text only if they cross it
  for the two pieces beside it, so exactly one path is finite: the library's encoding.  It is searched depth first, the farthest arc first.

Row-local: no shuffle; the model file's bytes travel with the tasks (bounded: a vocabulary).
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import text_or_empty

SPACE = "▁"
#: Piece types and model types of the published file format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: What the unknown character costs above the worst piece (the library's constant).
UNKNOWN_PENALTY = 10.0
#: The start state, before any piece.
START = -1
#: Arcs over characters outside the vocabulary: this less their code point.
OUTSIDE = -2
#: Where a state of the piece machine keeps its arcs.
ARCS = ""
#: Below every rank.
NEVER = float("-inf")


def outside(c: str) -> int:
    return OUTSIDE - ord(c)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes):
    """(number, value) of every field of a protobuf message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        elif key & 7 == 2:
            size, at = _varint(data, at)
            value, at = data[at:at + size], at + size
        else:
            size = 4 if key & 7 == 5 else 8
            value, at = data[at:at + size], at + size
        yield key >> 3, value


def character_map(blob: bytes) -> dict[str, str]:
    """Rewrites of a compiled character map: a double-array trie of keys (the published layout), then the texts it points into."""
    size = int(np.frombuffer(blob, "<u4", 1)[0])
    units, texts = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64), blob[4 + size:]
    step = (units >> 10) << ((units & (1 << 9)) >> 6)
    labels, out = np.arange(1, 256), {}
    todo = [(0, b"")]
    while todo:
        at, key = todo.pop()
        base = at ^ int(step[at])
        if key and units[at] >> 8 & 1:
            begin = int(units[base]) & 0x7FFFFFFF
            out[key.decode()] = texts[begin:texts.index(b"\0", begin)].decode()
        near = base ^ labels
        inside = near < len(units)
        for c in labels[inside][units[near[inside]] & 0x800000FF == labels[inside]].tolist():
            todo.append((base ^ c, key + bytes([c])))
    return out


class Encodings(dict):
    """Little-endian 32-bit ids by chunk, memoised in two generations of ``bound`` chunks at most."""

    def __init__(self, fst: Transducer, bound: int):
        super().__init__()
        self.fst, self.bound, self.old = fst, bound, {}

    def __missing__(self, chunk: str) -> bytes:
        found = self.old.get(chunk)
        if found is None:
            ids = self.fst.ids(self.fst.shortest_path(chunk))
            found = struct.pack(f"<{len(ids)}i", *ids)
        if len(chunk) <= 64:
            if len(self) >= self.bound:
                self.old = dict(self)
                self.clear()
            self[chunk] = found
        return found


class Transducer:
    """The compiled model; ``shortest_path`` composes one chunk with it."""

    def __init__(self, model: bytes, cache: int = 200_000):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        kind, prefix, squeeze, escape, rewrites = UNIGRAM, True, True, True, {}
        for number, value in _fields(model):
            if number == 1:
                piece, score, type_ = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = float(np.frombuffer(v, "<f4")[0])
                    elif n == 3:
                        type_ = v
                self.pieces.append(piece)
                self.scores.append(score)
                self.types.append(type_)
            elif number == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
                rewrites = character_map(spec[2]) if spec.get(2) else {}
                prefix, squeeze, escape = spec.get(3, 1), spec.get(4, 1), spec.get(5, 1)
        if kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.kind, self.prefix, self.squeeze, self.escape = kind, bool(prefix), bool(squeeze), bool(escape)
        self.unknown = self.types.index(UNKNOWN) if UNKNOWN in self.types else 0
        self.byte_ids = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == BYTE}
        self.arcs = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t in (NORMAL, USER) and p}
        self.worst = min((self.scores[i] for i in self.arcs.values()), default=0.0) - UNKNOWN_PENALTY
        self.bytes_of = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else p.encode()
                         for p, t in zip(self.pieces, self.types)]
        self.bytes_of[self.unknown] = " ⁇ ".encode()
        self.rewrites, self.longest = rewrites, max(map(len, rewrites), default=0)
        self.rewritten = re.compile("[" + "".join(map(re.escape, sorted({k[0] for k in rewrites}))) + "]") if rewrites else None
        # States of the piece machine: by character the next state; under ARCS the (size, arc) of all pieces on the way there, the
        # shortest first.  The first character is always one: outside the vocabulary it goes to the byte fallback.
        self.start: dict = {}
        self.depth = max(map(len, self.arcs), default=0)
        for p in sorted(self.arcs):
            state = self.start
            for n, c in enumerate(p, 1):
                if c not in state:
                    arc = self.arcs.get(p[:n], outside(c) if n == 1 else None)
                    state[c] = {ARCS: state.get(ARCS, ()) + (((n, arc),) if arc is not None else ())}
                state = state[c]
        # Added for every character, the same for all paths over an input, so that no weight is below zero.
        self.lift = 0.0 if kind == BPE else max([0.0, *(self.scores[i] / len(p) for p, i in self.arcs.items())])
        self._linked: dict[int, dict[int, bool]] = {}
        self._links = 0
        self._sides: dict[int, tuple[list, list] | None] = {}
        self._cache, self._bound = Encodings(self, cache), cache
        # Exact places to cut an input: no arc spans them.  Controls that stand in no longer piece; a space mark, if it only
        # begins pieces; between a letter or digit and a punctuation mark that never follows it in a piece.
        inner = {c for p in self.arcs if len(p) > 1 for c in p}
        whole = all(SPACE not in p.lstrip(SPACE) for p in self.arcs)
        alone = "".join(re.escape(chr(c)) for c in range(32) if chr(c) not in inner)
        mark = re.escape(SPACE)
        before: dict[str, set[str]] = {chr(c): set() for c in range(33, 127) if not chr(c).isalnum()}
        for p in self.arcs:
            for x, y in zip(p, p[1:]):
                if x.isalnum() and y in before:
                    before[y].add(x)
        free = "".join(re.escape(c) for c, xs in before.items() if not xs)
        bound = "".join(f"|(?<![{re.escape(''.join(sorted(xs)))}]){re.escape(c)}" for c, xs in before.items() if xs)
        self.chunk = re.compile(f"[{alone}]|{mark}*[^\\W_]++(?=[{mark}{alone}{free}]|\\Z{bound})|{mark}+[^{mark}{alone}]*|[^{mark}{alone}]+"
                                if alone and whole else "(?s:.+)")

    def rewrite(self, text: str) -> str:
        """The text after the character map: the longest key at every place gives way to its text."""
        out, done = [], 0
        while hit := self.rewritten.search(text, done):
            at = hit.start()
            out.append(text[done:at])
            for size in range(min(self.longest, len(text) - at), 0, -1):
                new = self.rewrites.get(text[at:at + size])
                if new is not None:
                    break
            else:
                size, new = 1, text[at]
            out.append(new)
            done = at + size
        return "".join(out) + text[done:]

    def normalise(self, text: str) -> str:
        if self.rewritten:
            text = self.rewrite(text)
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        if self.prefix and text:
            text = " " + text
        return text.replace(" ", SPACE) if self.escape else text

    def next_merge(self, parts: list[str]) -> tuple[float, int]:
        """Rank and place of the next two parts to merge; place -1: none."""
        best, at = NEVER, -1
        for k in range(len(parts) - 1):
            i = self.arcs.get(parts[k] + parts[k + 1])
            if i is not None and (at < 0 or self.scores[i] > best):
                best, at = self.scores[i], k
        return best, at

    def merged(self, text: str) -> list[str]:
        """Pieces after merging characters by rank, leftmost first: the reference semantics of a BPE model."""
        parts = list(text)
        while (at := self.next_merge(parts)[1]) >= 0:
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def sides(self, arc: int) -> tuple[list, list] | None:
        """The first and the last part of a label while it is merged, from character to piece: (lowest rank merged since the part before, part).

        None: merging does not leave the label whole.
        """
        if arc in self._sides:
            return self._sides[arc]
        parts = list(self.label(arc))
        out = [(NEVER, parts[0])], [(NEVER, parts[-1])]
        low = [-NEVER, -NEVER]
        while len(parts) > 1:
            rank, at = self.next_merge(parts)
            if at < 0:
                out = None
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            low = [min(x, rank) for x in low]
            for side, place in ((0, 0), (1, len(parts) - 1)):
                if at == place:
                    out[side].append((low[side], parts[at]))
                    low[side] = -NEVER
        if arc >= 0:
            self._sides[arc] = out
        return out

    def label(self, arc: int) -> str:
        """Input label of an arc: a piece, or a character outside the vocabulary (kept as a negative number)."""
        return self.pieces[arc] if arc >= 0 else chr(OUTSIDE - arc)

    def linked(self, a: int, b: int) -> bool:
        """Is there an arc of weight 0 from the state of arc ``a`` (START: the start state) over ``b``?

        Merging both labels side by side, the higher rank moves first, the left one of equals; there is none if the parts beside the
        boundary merge.  A side changes its part there before the other one if the lowest rank on its way is the higher.
        """
        right = self.sides(b)
        if a == START or right is None:
            return right is not None
        left = self.sides(a)
        if left is None:
            return False
        (_, x), *lefts = left[1]
        (_, y), *rights = right[0]
        i = j = 0
        while True:
            low_x = lefts[i][0] if i < len(lefts) else NEVER
            low_y = rights[j][0] if j < len(rights) else NEVER
            across = self.arcs.get(x + y)
            if across is not None and (rank := self.scores[across]) > low_x and rank >= low_y:
                return False
            if i == len(lefts) and j == len(rights):
                return True
            if low_x >= low_y:
                x, i = lefts[i][1], i + 1
            else:
                y, j = rights[j][1], j + 1

    def arcs_from(self, chunk: str, start: int) -> tuple[tuple[int, int], ...]:
        """(size, arc) of every arc that the composition has over the input from ``start`` on, the shortest first."""
        state = self.start
        for c in chunk[start:start + self.depth]:
            after = state.get(c)
            if after is None:
                break
            state = after
        return state.get(ARCS) or ((1, outside(chunk[start])),)

    def allowed(self, last: int, arc: int) -> bool:
        """Is the weight of ``arc`` after the arc ``last`` of a BPE model (START: none) zero, not infinity?"""
        link = self._linked.setdefault(last, {}).get(arc)
        if link is None:
            if self._links >= 2 * self._bound:
                self._linked.clear()
                self._links = 0
            link = self._linked.setdefault(last, {})[arc] = self.linked(last, arc)
            self._links += 1
        return link

    def shortest_path(self, chunk: str) -> list[int]:
        """Arcs of the tropical shortest path through the composition of ``chunk`` with the machines.

        One entry a place is enough: unigram weights do not depend on the last arc, and for BPE a prefix has one path of finite
        weight at most.
        """
        return self.cheapest(chunk) if self.kind == UNIGRAM else self.finite(chunk)

    def cheapest(self, chunk: str) -> list[int]:
        """The path of a unigram model: best first, of equal costs the farthest."""
        n, lift = len(chunk), self.lift
        back: dict[int, tuple[int, int]] = {}
        heap = [(0.0, 0, 0, START)]
        while n not in back:
            total, place, before, arc = heapq.heappop(heap)
            place = -place
            if place in back:
                continue
            back[place] = before, arc
            for size, x in self.arcs_from(chunk, place) if place < n else ():
                cost = lift * size - (self.scores[x] if x >= 0 else self.worst)
                heapq.heappush(heap, (total + cost, -place - size, place, x))
        out, place = [], n
        while place > 0:
            place, arc = back[place]
            out.append(arc)
        return out[::-1]

    def finite(self, chunk: str) -> list[int]:
        """The path of a BPE model, where every finite one weighs 0: depth first, the farthest arc first; a weight is asked for when its arc's turn comes."""
        n, links, nothing = len(chunk), self._linked, {}
        taken = []  # (place, last arc, arcs from there, how many of them are untried, the arc taken)
        place, last = 0, START
        while place < n:
            arcs = self.arcs_from(chunk, place)
            left = len(arcs)
            while True:
                known = links.get(last, nothing)
                while left:
                    left -= 1
                    size, arc = arcs[left]
                    link = known.get(arc)
                    if link or link is None and self.allowed(last, arc):
                        break
                else:
                    place, last, arcs, left, _ = taken.pop()
                    continue
                break
            taken.append((place, last, arcs, left, arc))
            place, last = place + size, arc
        return [x[-1] for x in taken]

    def ids(self, arcs: list[int]) -> list[int]:
        """Piece ids; a character outside the vocabulary becomes its bytes (or the unknown piece without byte pieces)."""
        if min(arcs, default=0) >= 0:
            return arcs
        out: list[int] = []
        for x in arcs:
            if x >= 0:
                out.append(x)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in self.label(x).encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self._cache.__getitem__, self.chunk.findall(self.normalise(text)))), "<i4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of a sequence of ids: bytes joined, invalid ones replaced, space marks undone, dummy prefix dropped."""
        text = b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")
        if self.escape:
            text = text.replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def compiled(model: bytes) -> Transducer:
    """The machines of a model, once a worker process: its next tasks find them and the chunks met so far."""
    return Transducer(model)


def encode_documents(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, n_byte_tokens, round_trip, ids_sha256, ids.

    ``ids`` is the encoding of the whole text, ``ids_sha256`` the digest of its little-endian 32-bit values and
    ``round_trip`` whether decoding gives the text back.  Null counts as empty: no ids.  Texts that hold the space
    mark U+2581 itself decode to a space there (round_trip false).  Repeated rows give repeated results.
    """
    schema = "doc_id long, n_tokens long, n_byte_tokens long, round_trip boolean, ids_sha256 string, ids array<int>"

    def encode(batches):
        fst = compiled(model)
        is_byte = np.array([t == BYTE for t in fst.types])
        for batch in batches:
            docs_, texts = batch.column(0), batch.column(1).to_pylist()
            for at in range(0, len(texts), 500):
                part = texts[at:at + 500]
                ids = [fst.encode(t) for t in part]
                flat = np.concatenate([np.zeros(0, "<i4"), *ids])
                offsets = np.cumsum([0, *map(len, ids)])
                yield pa.RecordBatch.from_arrays(
                    [docs_.slice(at, len(part)), pa.array([len(x) for x in ids], pa.int64()),
                     pa.array([int(is_byte[x].sum()) for x in ids], pa.int64()),
                     pa.array([fst.decode(x) == t for x, t in zip(ids, part)]),
                     pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]),
                     pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))],
                    names=["doc_id", "n_tokens", "n_byte_tokens", "round_trip", "ids_sha256", "ids"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return src.mapInArrow(encode, schema)


def decode_documents(encoded: DataFrame, model: bytes) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids count as none."""
    def decode(batches):
        fst = compiled(model)
        for batch in batches:
            texts = [fst.decode(np.array(x or [], "<i4")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")
