"""SentencePiece encoding and decoding with N-best segmentation.

A text becomes a lattice of the model's pieces.  A forward Viterbi pass gives
the best score from the start to every place; a backward A-star search from the
end uses these scores as its heuristic.  The heuristic is exact, so the search
pops segmentations in order of their score and visits little else.

Pieces score by Zipf's law on the rank stored in the model, in whole
millionths of a nat, so sums are exact.  A character without a piece of its own
is spelt in byte pieces, each ten nats below the rarest piece.  A text
splits wherever two neighbouring characters stand side by side in no piece, at
word marks above all; the segmentations of a text are those of its parts put
together.  The distinct parts of a stretch of texts are searched in step: every
part has its own agenda, and one round pops the best entry of each.  The ``n``
best of a text differ in no other part than the ``n - 1`` whose second
segmentation loses least, as changing each of those alone is as good as changing
any further one.

As in the model, spaces are written as U+2581 after one leading mark, and
decoding gives the text back; a U+2581 in the text reads as a space.  Null and
empty texts have no pieces.  Repeated rows are encoded row by row; texts of
any length are encoded whole, stretch by stretch.  Only ``doc_id``
and ``text`` are read, so further columns, whatever their names, change nothing;
an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landmosaic.llm.textnum import PLACE, PLACES, lean, mix, text_parts

MARK = "▁"
UNIT = 1_000_000
#: Bytes of text whose distinct parts are searched together; longer texts are taken in stretches between parts.
PART_BYTES = 1 << 18
N_BEST = 2
#: The loss where there is no second segmentation.
ALONE = 1 << 62


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers ``first[i]`` to ``first[i] + size[i] - 1`` of every ``i``, in order."""
    return np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)


def sorted_by(*keys: np.ndarray) -> np.ndarray:
    """The order by several keys, none negative and the first one first; as one number where 63 bits hold them."""
    bits = [int(k.max(initial=0)).bit_length() for k in keys]
    if sum(bits) > 63:
        return np.lexsort(keys[::-1])
    one = keys[0]
    for key, width in zip(keys[1:], bits[1:], strict=True):
        one = one << width | key
    return np.argsort(one)


class Pieces:
    """The model's pieces, their scores and the lattice search."""

    def __init__(self, path: str | None = None, scores: dict[str, tuple[int, int]] | None = None, first_byte: int = 3):
        if path:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            usual = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
            scores = {model.id_to_piece(i): (i, -round(UNIT * math.log1p(-model.get_score(i)))) for i in usual}
            first_byte = model.piece_to_id("<0x00>")
        self.scores, self.first_byte = scores, first_byte
        self.byte_score = min((s for _, s in scores.values()), default=0) - 10 * UNIT
        self.longest = max(map(len, scores), default=1)
        self.text = {i: p for p, (i, _) in scores.items()}
        # the trie of all pieces, as sorted steps: node and character to node
        spaced = {p.replace(MARK, " "): v for p, v in scores.items()}
        node = {"": 0}
        for p in spaced:
            for k in range(1, len(p) + 1):
                node.setdefault(p[:k], len(node))
        steps = sorted((node[p[:-1]] << 21 | ord(p[-1]), i) for p, i in node.items() if p)
        self.steps, self.child = np.array(steps, np.int64).reshape(-1, 2).T.copy()
        self.piece, self.worth = (np.array([spaced.get(p, (-1, 0))[k] for p in node], np.int64) for k in (0, 1))
        # pairs of characters that stand side by side in a piece
        self.pairs = {p[k : k + 2] for p in spaced for k in range(len(p) - 1)}
        self.pair_keys = np.array(sorted(ord(a) << 21 | ord(b) for a, b in self.pairs), np.int64)
        self.pair_table = np.zeros(1 << 14, bool)
        self.pair_table[[ord(a) << 7 | ord(b) for a, b in self.pairs if a < "\x80" and b < "\x80"]] = True
        # the bytes of every id
        top = max([first_byte + 255, *self.text]) + 1
        raw = [b""] * top
        for i, p in self.text.items():
            raw[i] = p.replace(MARK, " ").encode()
        for b in range(256):
            raw[first_byte + b] = bytes([b])
        self.raw, self.raw_size = np.frombuffer(b"".join(raw), np.uint8), np.fromiter(map(len, raw), np.int64, top)
        self.raw_first = np.cumsum(self.raw_size) - self.raw_size

    # --- one text, step by step ---

    def edges(self, text: str) -> list[list[tuple[int, int, int, int]]]:
        """For each place, ``score so far, from, score, id`` of the pieces that end there.

        The score so far is the best from the start, by the forward Viterbi
        pass; the id is -1 where a character is spelt in bytes.
        """
        scores, size = self.scores, len(text)
        ends: list[list] = [[] for _ in range(size + 1)]
        ends[0].append((0, 0, 0, 0))
        for i, character in enumerate(text):
            top = max(ends[i])[0] if i else 0
            for j in range(i + 1, min(size, i + self.longest) + 1):
                if found := scores.get(text[i:j]):
                    ends[j].append((top + found[1], i, found[1], found[0]))
            if character not in scores:
                score = self.byte_score * len(character.encode("utf-8", "surrogatepass"))
                ends[i + 1].append((top + score, i, score, -1))
        return ends

    def n_best(self, text: str, n: int = N_BEST) -> list[tuple[int, tuple[int, ...]]]:
        """The best ``n`` segmentations of one part: score and ids, best first."""
        ends = self.edges(text)
        best = [max(e)[0] for e in ends]
        heap, found, made = [(-best[-1], 0, len(text), 0, None)], [], 0
        while heap and len(found) < n:
            _, _, at, score, path = heapq.heappop(heap)
            while at:  # go on along the best way in; the other ways wait in the heap
                ways = sorted(ends[at], reverse=True)
                for so_far, i, s, piece in ways[1:]:
                    made += 1
                    heapq.heappush(heap, (-(so_far + score), made, i, s + score, (piece, i, at, path)))
                _, i, s, piece = ways[0]
                score += s
                path = (piece, i, at, path)
                at = i
            ids: list[int] = []
            while path:
                piece, i, j, path = path
                ids.extend([piece] if piece >= 0 else (self.first_byte + b for b in text[i:j].encode("utf-8", "surrogatepass")))
            found.append((score, tuple(ids)))
        return found

    def split(self, text: str) -> list[str]:
        """The stretches of a text that pieces can hold together; marks are spaces or U+2581."""
        spaced = text.replace(MARK, " ")
        cuts = [k for k in range(1, len(text)) if spaced[k - 1 : k + 1] not in self.pairs]
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)] if text else []

    def segmentations(self, text: str, n: int = N_BEST) -> list[tuple[int, tuple[int, ...]]]:
        """The best ``n`` segmentations of a whole text, from those of its parts."""
        marked = MARK + text.replace(" ", MARK) if text else ""
        return self.joined([self.n_best(p, n) for p in self.split(marked)], n)

    @staticmethod
    def joined(parts: list[list[tuple[int, tuple[int, ...]]]], n: int) -> list[tuple[int, tuple[int, ...]]]:
        """The best ``n`` of the ways through all parts."""
        kept: list[tuple[int, tuple]] = [(0, ())]
        for options in parts:
            kept = heapq.nlargest(n, [(a + b, (x, y)) for a, x in kept for b, y in options], key=lambda r: r[0])
        out = []
        for score, path in kept:
            ids = []
            while path:
                path, last = path
                ids.append(last)
            out.append((score, tuple(chain.from_iterable(reversed(ids)))))
        return out

    # --- many parts in step ---

    def cuts(self, code: np.ndarray) -> np.ndarray:
        """Where a part begins: no piece holds this character and the one before it."""
        out = np.ones(len(code), bool)
        left, right = code[:-1], code[1:]
        plain = (left | right) < 128
        out[1:] = ~self.pair_table[np.where(plain, left << 7 | right, 0)]
        other = np.flatnonzero(~plain)
        if len(other):
            key = left[other].astype(np.int64) << 21 | right[other]
            k = np.minimum(np.searchsorted(self.pair_keys, key), max(0, len(self.pair_keys) - 1))
            out[1 + other] = self.pair_keys[k] != key if len(self.pair_keys) else True
        return out

    def lattice(self, code: np.ndarray, first: np.ndarray, size: np.ndarray) -> Lattice:
        """All pieces in the parts ``code[first:first + size]``, with the forward Viterbi scores."""
        owner = np.repeat(np.arange(len(size)), size)
        code = code[spread(first, size)].astype(np.int64)
        origin = np.cumsum(size) - size
        end = (origin + size)[owner]
        found = []
        at, node, depth = np.arange(len(code)), np.zeros(len(code), np.int64), 0
        while len(at):  # all starts go down the trie together
            key = node << 21 | code[at + depth]
            k = np.minimum(np.searchsorted(self.steps, key), len(self.steps) - 1)
            hit = self.steps[k] == key
            at, node, depth = at[hit], self.child[k[hit]], depth + 1
            piece = self.piece[node]
            full = piece >= 0
            found.append((at[full], at[full] + depth, piece[full], self.worth[node[full]]))
            more = at + depth < end[at]
            at, node = at[more], node[more]
        spelt = np.ones(len(code), bool)
        spelt[found[0][0]] = False
        spelt = np.flatnonzero(spelt)
        width = 1 + (code[spelt] >= 0x80) + (code[spelt] >= 0x800) + (code[spelt] >= 0x10000)
        found.append((spelt, spelt + 1, np.full(len(spelt), -1), self.byte_score * width))
        low, high, piece, worth = (np.concatenate(x) for x in zip(*found, strict=True))
        step = (high - origin[owner[low]]).astype(np.int32)
        u, v = low + owner[low], high + owner[low]  # a part has one place more than characters
        order = np.argsort(step.astype(np.uint16) if step.max(initial=0) < 1 << 16 else step, kind="stable")
        bounds = np.append(0, np.cumsum(np.bincount(step)))
        best = np.full(len(code) + len(size), -ALONE)
        best[origin + np.arange(len(size))] = 0
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):  # place by place
            e = order[a:b]
            np.maximum.at(best, v[e], best[u[e]] + worth[e])
        way = best[u] + worth
        order = sorted_by(v, best[v] - way, v - u)
        return Lattice(code, origin, size, best, *(x[order] for x in (u, v, way, piece, worth, low)))

    def n_best_of(self, lattice: Lattice, n: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Scores (``n`` by parts, ``-ALONE`` where there is none), and of each rank the ids of all parts with their numbers."""
        x, parts = lattice, len(lattice.size)
        start = x.origin + np.arange(parts)
        into = np.append(0, np.cumsum(np.bincount(x.v, minlength=len(x.best))))  # the ways into each place, best first
        score, last = np.full((n, parts), -ALONE), np.full((n, parts), -1)
        edges: list[np.ndarray] = []
        ups: list[np.ndarray] = []
        made = 0

        def take(edge: np.ndarray, up: np.ndarray) -> np.ndarray:
            nonlocal made
            edges.append(edge)
            ups.append(up)
            made += len(edge)
            return np.arange(made - len(edge), made)

        agenda = [np.zeros(0, np.int64)] * 5  # part, estimate, way, step it goes on from, score behind it
        who, at, behind, up = np.arange(parts), start + x.size, np.zeros(parts, np.int64), np.full(parts, -1)
        for rank in range(n):
            waiting = [agenda]
            while True:  # along the best ways in; the others wait in the agendas
                done = at == start[who]
                score[rank, who[done]], last[rank, who[done]] = behind[done], up[done]
                who, at, behind, up = (y[~done] for y in (who, at, behind, up))
                if not len(who):
                    break
                edge = into[at]
                if rank < n - 1:
                    more = into[at + 1] - edge - 1
                    other, of = spread(edge + 1, more), np.repeat(np.arange(len(who)), more)
                    waiting.append([who[of], x.way[other] + behind[of], other, up[of], behind[of]])
                up, behind, at = take(edge, up), behind + x.worth[edge], x.u[edge]
            if rank == n - 1:
                break
            agenda = [np.concatenate(y) for y in zip(*waiting, strict=True)]
            order = sorted_by(agenda[0], score[rank][agenda[0]] - agenda[1], np.arange(len(agenda[0])))
            agenda = [y[order] for y in agenda]
            top = np.diff(agenda[0], prepend=-1) != 0
            who, _, edge, up, behind = (y[top] for y in agenda)
            agenda = [y[~top] for y in agenda]
            up, behind, at = take(edge, up), behind + x.worth[edge], x.u[edge]
        edges_, ups_ = np.concatenate(edges or [np.zeros(0, np.int64)]), np.concatenate(ups or [np.zeros(0, np.int64)])
        return score, [self.ids_of(lattice, edges_, ups_, last[rank]) for rank in range(n)]

    def ids_of(self, x: Lattice, edges: np.ndarray, ups: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts end to end, and how many each has; a search's last step is a part's first piece."""
        whose, taken = [], []
        who = np.flatnonzero(last >= 0)
        step = last[who]
        while len(who):
            whose.append(who)
            taken.append(edges[step])
            step = ups[step]
            who, step = who[step >= 0], step[step >= 0]
        if not whose:
            return np.zeros(0, np.int32), np.zeros(len(last), np.int64)
        whose, taken = np.concatenate(whose), np.concatenate(taken)
        order = np.argsort(whose, kind="stable")
        whose, taken = whose[order], taken[order]
        piece, code = x.piece[taken], x.code[x.low[taken]]
        spelt = piece < 0
        width = np.where(spelt, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000), 1)
        ids = np.repeat(piece, width)
        ids[ids < 0] = self.first_byte + np.frombuffer("".join(map(chr, code[spelt].tolist())).encode("utf-8", "surrogatepass"), np.uint8)
        return ids.astype(np.int32), np.bincount(whose, width, len(last)).astype(np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray, n: int) -> list[list[tuple[int, np.ndarray]]]:
        """The best ``n`` segmentations of each text; texts are UTF-8 end to end, with their marks as spaces."""
        if not len(data):
            return [[(0, np.zeros(0, np.int32))] for _ in offsets[1:]]
        code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.int32)
        if len(code) != len(data):
            offsets = np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), offsets)
        cut = self.cuts(code)
        cut[offsets[:-1][offsets[:-1] < len(code)]] = True
        head = np.flatnonzero(cut)
        size = np.diff(np.append(head, len(code)))
        place = spread(np.zeros(len(head), np.int64), size)
        if len(place) > PLACES:
            place %= PLACES
        name = mix(np.add.reduceat((code + 1).astype(np.uint64) * PLACE[place], head) + size.astype(np.uint64))
        _, one, kind = np.unique(name, return_index=True, return_inverse=True)
        score, ways = self.n_best_of(self.lattice(code, head[one], size[one]), n)
        begin = [np.cumsum(count) - count for _, count in ways]
        first = np.searchsorted(head, offsets)  # parts of each text
        ids, count = ways[0]
        pieces = count[kind]
        flat = ids[spread(begin[0][kind], pieces)]
        at = np.append(0, np.cumsum(pieces))  # ids before each part
        total = np.append(0, np.cumsum(score[0][kind]))
        loss = (score[0] - score[1])[kind] if n > 1 else None
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            base = flat[at[a] : at[b]]
            top = int(total[b] - total[a])
            if n == 1 or a == b:
                out.append([(top, base)])
                continue
            places = range(b - a) if b - a < n else np.argpartition(loss[a:b], n - 2)[: n - 1].tolist()
            kept: list[tuple[int, tuple]] = [(top, ())]
            for k in sorted(places):
                which = kind[a + k]
                options = [(int(score[r, which] - score[0, which]), r) for r in range(n) if score[r, which] > -ALONE]
                kept = heapq.nlargest(n, [(s + d, (*path, (a + k, which, r)) if r else path) for s, path in kept for d, r in options], key=lambda w: w[0])
            found = []
            for s, path in kept:
                spliced, low = [], at[a]
                for k, which, r in path:
                    spliced += [flat[low : at[k]], ways[r][0][begin[r][which] : begin[r][which] + ways[r][1][which]]]
                    low = at[k + 1]
                found.append((s, np.concatenate([*spliced, flat[low : at[b]]]) if path else base))
            out.append(found)
        return out

    def encode_long(self, data: np.ndarray, n: int, most: int = PART_BYTES) -> list[tuple[int, np.ndarray]]:
        """The same of one long text, whose stretches end where a part does."""
        kept: list[tuple[int, list[np.ndarray]]] = [(0, [])]
        low, reach = 0, most
        while low < len(data):
            high = min(len(data), low + reach)
            if high < len(data):
                lead = np.flatnonzero((data[low:high] & 0xC0) != 0x80)[-max(2, most // 8) :]
                cut = np.flatnonzero(self.cuts(np.frombuffer(data[low + lead[0] : low + lead[-1]].tobytes().decode().encode("utf-32-le"), np.int32))[1:])
                if not len(cut):
                    reach *= 2
                    continue
                high, reach = low + int(lead[cut[-1] + 1]), most
            ways = self.encode(data[low:high], np.array([0, high - low]), n)[0]
            kept = heapq.nlargest(n, [(a + b, [*x, y]) for a, x in kept for b, y in ways], key=lambda w: w[0])
            low = high
        return [(score, np.concatenate(ids)) for score, ids in kept]

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """What the pieces spell, in UTF-8."""
        return self.raw[spread(self.raw_first[ids], self.raw_size[ids])]

    def decode(self, ids) -> str:
        return self.bytes_of(np.asarray(ids, np.int64)).tobytes().decode("utf-8", "replace")[1:]


class Lattice:
    """Pieces of many parts, those that end at a place together and best first."""

    def __init__(self, code, origin, size, best, u, v, way, piece, worth, low):
        self.code, self.origin, self.size, self.best = code, origin, size, best
        self.u, self.v, self.way, self.piece, self.worth, self.low = u, v, way, piece, worth, low


def id_lists(ids: list[np.ndarray]) -> pa.ListArray:
    offsets = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))


@cache
def pieces_of(path: str) -> Pieces:
    """This worker process's model, which outlives a task."""
    return Pieces(path)


def marked(text: Column) -> Column:
    """The text with its leading mark, marks as spaces; null and empty texts are empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(text == "", "").otherwise(F.concat(F.lit(" "), F.replace(text, F.lit(MARK), F.lit(" "))))


def encode_documents(docs: DataFrame, model_path: str, n: int = N_BEST) -> DataFrame:
    """``doc_id, ids, n_pieces, score, second_score, round_trip, best``; no shuffle.

    ``best`` holds score and ids of the ``n`` best segmentations of the whole
    text, or of all if they are fewer; ``ids`` and ``score`` are the first's,
    ``second_score`` is the second's (null where there is only one or ``n`` is
    1); ``round_trip`` tells whether the ids decode to the text.
    """
    if n < 1:
        raise ValueError("n must be at least 1")

    def encoded(pieces: Pieces, names: pa.Array, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        long_ = len(offsets) == 2 and len(data) > PART_BYTES
        best = [pieces.encode_long(data, n)] if long_ else pieces.encode(data, offsets, n)
        same = []
        for ways, low, high in zip(best, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            same.append(np.array_equal(pieces.bytes_of(ways[0][1]), data[low:high]))
        first = id_lists([ways[0][1] for ways in best])
        score = pa.array([ways[0][0] for ways in best], pa.int64())
        second = pa.array([ways[1][0] if len(ways) > 1 else None for ways in best], pa.int64())
        every = [way for ways in best for way in ways]
        ranked = pa.StructArray.from_arrays([pa.array([s for s, _ in every], pa.int64()), id_lists([x for _, x in every])], ["score", "ids"])
        ranked = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, best)]), pa.int32()), ranked)
        return pa.RecordBatch.from_arrays([names, first, first.value_lengths().cast(pa.int64()), score, second, pa.array(same), ranked], ["doc_id", "ids", "n_pieces", "score", "second_score", "round_trip", "best"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model_path)
        for batch in batches:
            for low, high, data, offsets in text_parts(batch.column(1), PART_BYTES):
                yield encoded(pieces, batch.column(0).slice(low, high - low), data, offsets)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), marked(F.col("text")).alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, ids array<int>, n_pieces long, score long, second_score long, round_trip boolean, best array<struct<score: long, ids: array<int>>>")


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, text`` of encoded documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pieces.decode(x or ()) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(lean(run), "doc_id long, text string")
