"""N-best segmentation into the pieces of a SentencePiece model, and decoding.

A text, with a space put before it, is cut between characters that stand side by side in no
piece, so that no piece crosses a cut. The pieces that fit into a segment form a lattice. Forward Viterbi scores give
for every place the best score of any path to it; a backward A* search from the end uses
them as exact heuristics, so complete paths leave its queue in order of their score. The
best segmentations of a text are the best sums over its segments, found the same way.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import packed

SPACE = "▁"
#: longer segments are not remembered
REMEMBERED = 64
#: characters of texts whose segments are looked up together
BLOCK = 1_000_000
#: characters of segments whose lattices are searched side by side
TOGETHER = 150_000
_OTHER = "<di"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass(frozen=True)
class Tree:
    """Pieces by their characters: sorted steps (node and kind) with the nodes they lead to, and the piece at each node."""

    steps: np.ndarray
    to: np.ndarray
    held: np.ndarray
    ids: np.ndarray
    scores: np.ndarray


@dataclass(frozen=True)
class Vocabulary:
    """Pieces, with spaces for the space marks.

    ``pieces`` maps every piece to its packed id and score. ``kinds`` numbers the characters of
    pieces, 0 for all others; ``links`` says which kinds stand side by side in a piece.
    ``byte`` are the ids of the 256 byte pieces.
    """

    pieces: dict[str, tuple[bytes, float]]
    kinds: np.ndarray
    links: np.ndarray
    byte: tuple[int, ...]
    unknown: float

    def spelled(self, character: str) -> tuple[bytes, float]:
        """A character as byte pieces."""
        raw = character.encode("utf-8", "surrogatepass")
        return packed_ids([self.byte[x] for x in raw]), self.unknown * len(raw)

    def tree(self) -> Tree:
        kinds = self.kinds
        children: dict[tuple[int, int], int] = {}
        held, ids, scores = [-1], [], []
        for piece, (packed_id, score) in self.pieces.items():
            node = 0
            for c in piece:
                node = children.setdefault((node, int(kinds[ord(c)])), len(children) + 1)
                if node == len(held):
                    held.append(-1)
            held[node] = len(ids)
            ids.append(np.frombuffer(packed_id, "<i4")[0])
            scores.append(score)
        steps = np.array([(n << 16) | k for n, k in children], np.int64)
        order = np.argsort(steps)
        return Tree(steps[order], np.array(list(children.values()))[order], np.array(held), np.array(ids, "<i4"), np.array(scores, float))

    def cuts(self, text: str, starts: np.ndarray) -> np.ndarray:
        """Where segments of texts that stand one after the other end; none crosses from one text to the next."""
        kinds = self.kinds[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
        cut = np.append(~self.links[kinds[:-1], kinds[1:]], True)
        cut[starts[1:] - 1] = True
        return np.flatnonzero(cut) + 1


def load_vocabulary(data: bytes, scores: str = "rank") -> Vocabulary:
    """From the bytes of a model file.

    ``scores`` "model" takes the model's own scores; "rank" takes -log(2 + rank of the piece by its
    score), which is near to a log-probability where the model only orders its pieces.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=data)
    byte, usable = [0] * 256, []
    for k in range(model.get_piece_size()):
        if model.is_byte(k):
            byte[int(model.id_to_piece(k)[3:5], 16)] = k
        elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
            # a mark in a text is no space: it has no piece and is written as bytes
            usable.append((model.id_to_piece(k).replace(SPACE, " "), k, model.get_score(k)))
    usable.sort(key=lambda p: (-p[2], p[1]))
    if scores == "rank":
        usable = [(p, k, -math.log(2 + r)) for r, (p, k, _) in enumerate(usable)]
    elif scores != "model":
        raise ValueError("scores must be 'rank' or 'model'")
    worst = min((s for *_, s in usable), default=0.0)
    pieces = {p: (packed_ids([k]), s) for p, k, s in usable}
    characters = sorted({c for p, *_ in usable for c in p})
    kinds = np.zeros(0x110000, np.uint16)
    kinds[[ord(c) for c in characters]] = np.arange(1, len(characters) + 1)
    links = np.zeros((len(characters) + 1, len(characters) + 1), bool)
    for p, *_ in usable:
        for x, y in zip(p, p[1:]):
            links[kinds[ord(x)], kinds[ord(y)]] = True
    return Vocabulary(pieces, kinds, links, tuple(byte), worst - 10.0)


def packed_ids(ids) -> bytes:
    return np.array(ids, "<i4").tobytes()


class Lattices:
    """Lattices of many segments with their forward scores.

    Every place between characters is a node; a segment of n characters has n + 1. The edges
    into node g are those numbered ``into[g]`` to ``into[g + 1]``.
    """

    def __init__(self, segments: list[str], words: Vocabulary, tree: Tree) -> None:
        text = "".join(segments)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        kinds = words.kinds[codes].astype(np.int64)
        lens = np.array([len(x) for x in segments], np.int64)
        upto = np.cumsum(lens)
        self.ends = upto + np.arange(len(segments))
        self.firsts = upto - lens + np.arange(len(segments))
        stop = np.repeat(upto, lens)
        node_of = np.arange(len(codes)) + np.repeat(np.arange(len(segments)), lens)
        start, node = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        alone = np.zeros(len(codes), bool)
        found = []
        depth = 0
        while len(start):
            keep = start + depth < stop[start]
            start, node = start[keep], node[keep]
            step = (node << 16) | kinds[start + depth]
            at = np.minimum(np.searchsorted(tree.steps, step), len(tree.steps) - 1)
            keep = tree.steps[at] == step
            start, node = start[keep], tree.to[at[keep]]
            depth += 1
            piece = tree.held[node]
            some = piece >= 0
            if depth == 1:
                alone[start[some]] = True
            found.append((node_of[start[some]], np.full(some.sum(), depth), piece[some]))
        # a character that no piece covers falls back to bytes
        rest = np.flatnonzero(~alone)
        odd, which = np.unique(codes[rest], return_inverse=True)
        spelled = [words.spelled(chr(c)) for c in odd.tolist()]
        self.ids = np.concatenate([tree.ids, *[np.frombuffer(i, "<i4") for i, _ in spelled]])
        self.n_ids = np.concatenate([np.ones(len(tree.ids), np.int64), np.array([len(i) // 4 for i, _ in spelled], np.int64)])
        found.append((node_of[rest], np.ones(len(rest), np.int64), which + len(tree.ids)))
        source, length, piece = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(source + length, kind="stable")
        source, piece = source[order], piece[order]
        target = source + length[order]
        score = np.concatenate([tree.scores, np.array([x for _, x in spelled], float)])[piece]
        nodes = len(codes) + len(segments)
        best = np.full(nodes, -np.inf)
        best[self.firsts] = 0.0
        # places of equal distance from the start of their segment are scored together
        place = target - np.repeat(self.firsts, lens + 1)[target]
        by_place = np.argsort(place, kind="stable")
        cuts = np.searchsorted(place[by_place], np.arange(1, (place.max() if len(place) else 0) + 2))
        for a, b in zip(cuts, cuts[1:]):
            now = by_place[a:b]
            np.maximum.at(best, target[now], best[source[now]] + score[now])
        top = np.flatnonzero(best[source] + score == best[target])[::-1]
        self.back = np.full(nodes, -1)
        self.back[target[top]] = top
        self.source, self.piece, self.score, self.best = source, piece, score, best
        self.into = np.searchsorted(target, np.arange(nodes + 1))

    def n_best(self, n: int) -> list[list[tuple[float, bytes]]]:
        """Of every segment up to n segmentations by falling score; of equal ones the first found.

        The searches of all segments go on side by side. The forward scores are exact, so a
        path taken from the queue keeps its estimate along the best edges to the start; only its
        alternatives are queued. As every entry is one whole path, a segment's queue keeps no more
        than are still wanted.
        """
        count, width = len(self.firsts), max(1, n - 1)
        queue = {
            "loss": np.full((count, width), np.inf), "rest": np.zeros((count, width)),
            "edge": np.zeros((count, width), np.int64), "path": np.zeros((count, width), np.int64),
        }
        # a path is its first edge and the number of the path behind it
        edges: list[np.ndarray] = []
        behind: list[np.ndarray] = []
        made = 0

        def longer(edge: np.ndarray, path: np.ndarray) -> np.ndarray:
            nonlocal made
            edges.append(edge)
            behind.append(path)
            made += len(edge)
            return np.arange(made - len(edge), made)

        segment, at = np.arange(count), self.ends
        after, path = np.zeros(count), np.full(count, -1)
        out: list[tuple[np.ndarray, ...]] = []
        for wanted in range(n - 1, -1, -1):
            while True:
                done = at == self.firsts[segment]
                if done.any():
                    out.append((segment[done], np.full(done.sum(), n - wanted), after[done], path[done]))
                    segment, at, after, path = (x[~done] for x in (segment, at, after, path))
                if not len(at):
                    break
                taken = self.back[at]
                if wanted:
                    self._queue(queue, segment, at, after, path, taken, wanted)
                after = after + self.score[taken]
                path = longer(taken, path)
                at = self.source[taken]
            segment = np.flatnonzero(queue["loss"][:, 0] < np.inf)
            if not wanted or not len(segment):
                break
            edge, after = queue["edge"][segment, 0], queue["rest"][segment, 0]
            path = longer(edge, queue["path"][segment, 0])
            at = self.source[edge]
            for name, held in queue.items():
                held[:, :-1] = held[:, 1:]
                held[:, -1] = np.inf if name == "loss" else 0
        return self._paths(out, np.concatenate(edges), np.concatenate(behind)) if made else [[] for _ in range(count)]

    def _queue(self, queue: dict, segment, at, after, path, taken, wanted: int) -> None:
        """Queues the edges into ``at`` beside those taken."""
        n = self.into[at + 1] - self.into[at]
        some = np.flatnonzero(n > 1)
        n = n[some]
        from_ = np.repeat(some, n)
        edge = np.arange(len(from_)) - np.repeat(np.cumsum(n) - n, n) + self.into[at][from_]
        other = edge != taken[from_]
        edge, from_ = edge[other], from_[other]
        rest = after[from_] + self.score[edge]
        loss = -(self.best[self.source[edge]] + rest)
        owner = segment[from_]
        near = np.flatnonzero(loss < queue["loss"][owner, wanted - 1])
        if not len(near):
            return
        owner, width = owner[near], queue["loss"].shape[1]
        touched = np.unique(owner)
        new = {"loss": loss[near], "rest": rest[near], "edge": edge[near], "path": path[from_[near]]}
        both = {k: np.concatenate([queue[k][touched].ravel(), new[k]]) for k in queue}
        owners = np.concatenate([np.repeat(touched, width), owner])
        # stable, so that of equal losses the earlier one stays in front
        order = np.lexsort((both["loss"], owners))
        owners = owners[order]
        sizes = np.diff(np.append(np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]])), len(owners)))
        rank = np.arange(len(owners)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        kept = rank < wanted
        queue["loss"][touched] = np.inf
        for k in queue:
            queue[k][owners[kept], rank[kept]] = both[k][order][kept]

    def _paths(self, out: list[tuple], edges: np.ndarray, behind: np.ndarray) -> list[list[tuple[float, bytes]]]:
        segment, turn, score, path = (np.concatenate(x) for x in zip(*out))
        order = np.lexsort((turn, segment))
        segment, score, path = segment[order], score[order], path[order]
        which, pieces, live = [], [], np.arange(len(path))
        while True:
            live = live[path[live] >= 0]
            if not len(live):
                break
            which.append(live)
            pieces.append(self.piece[edges[path[live]]])
            path[live] = behind[path[live]]
        which, piece = np.concatenate(which), np.concatenate(pieces)
        by = np.argsort(which, kind="stable")
        which, piece = which[by], piece[by]
        n = self.n_ids[piece]
        first = np.cumsum(self.n_ids) - self.n_ids
        flat = self.ids[np.repeat(first[piece] - (np.cumsum(n) - n), n) + np.arange(n.sum())].astype("<i4").tobytes()
        ends = 4 * np.cumsum(np.bincount(which, weights=n, minlength=len(score)).astype(np.int64))
        ends = [0, *ends.tolist()]
        listed = list(zip(score.tolist(), [flat[a:b] for a, b in zip(ends, ends[1:])]))
        cuts = np.searchsorted(segment, np.arange(len(self.firsts) + 1)).tolist()
        return [listed[a:b] for a, b in zip(cuts, cuts[1:])]


class _Pool:
    """Numbers that are added in pieces and looked up all at once."""

    def __init__(self, kind) -> None:
        self.held, self.n = np.zeros(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.held):
            self.held = np.concatenate([self.held[: self.n], np.zeros(max(len(values), self.n), self.held.dtype)])
        self.held[self.n : self.n + len(values)] = values
        self.n += len(values)


class Encoder:
    """Encodes texts; segments met before are looked up, up to ``remember`` of them."""

    def __init__(self, words: Vocabulary, n: int, remember: int = 400_000) -> None:
        self.words, self.tree, self.n, self.remember = words, words.tree(), n, remember
        self._forget()

    def _forget(self) -> None:
        # by number: score of the best, loss of the second, place of the best ids, all others packed
        self.known: dict[str, int] = {}
        self.scores, self.losses = _Pool(float), _Pool(float)
        self.ids, self.starts, self.sizes = _Pool("<i4"), _Pool(np.int64), _Pool(np.int64)
        self.others: list[bytes] = []

    def n_best(self, text: str) -> list[tuple[float, bytes]]:
        """The n best segmentations of a text as (score, packed ids), best first."""
        return next(self.all([text]))

    def all(self, texts: list[str]) -> Iterator[list[tuple[float, bytes]]]:
        """n_best of every text; the segments of texts are looked at in blocks."""
        block, size = [], 0
        for text in texts:
            block.append(text)
            size += len(text)
            if size >= BLOCK:
                yield from self._block(block)
                block, size = [], 0
        yield from self._block(block)

    def _learn(self, new: list[str]) -> None:
        at = 0
        while at < len(new):
            some, size = [], 0
            while at < len(new) and (not some or size + len(new[at]) <= TOGETHER):
                some.append(new[at])
                size += len(new[at])
                at += 1
            every = Lattices(some, self.words, self.tree).n_best(self.n)
            self.known.update(zip(some, range(len(self.others), len(self.others) + len(some))))
            best = [found[0] for found in every]
            sizes = np.array([len(i) // 4 for _, i in best], np.int64)
            self.starts.add(self.ids.n + np.cumsum(sizes) - sizes)
            self.sizes.add(sizes)
            self.ids.add(np.frombuffer(b"".join([i for _, i in best]), "<i4"))
            self.scores.add(np.array([s for s, _ in best]))
            self.losses.add(np.array([found[0][0] - found[1][0] if len(found) > 1 else math.inf for found in every]))
            self.others += [b"".join([struct.pack(_OTHER, s, len(i)) + i for s, i in found[1:]]) for found in every]

    def _found(self, k: int) -> list[tuple[float, bytes]]:
        """All segmentations of a known segment."""
        start, size = self.starts.held[k], self.sizes.held[k]
        out = [(float(self.scores.held[k]), self.ids.held[start : start + size].tobytes())]
        packed_others, at = self.others[k], 0
        while at < len(packed_others):
            score, n = struct.unpack_from(_OTHER, packed_others, at)
            at += struct.calcsize(_OTHER)
            out.append((score, packed_others[at : at + n]))
            at += n
        return out

    def _block(self, texts: list[str]) -> Iterator[list[tuple[float, bytes]]]:
        if len(self.known) > self.remember:
            self._forget()
        spaced = [" " + t for t in texts if t]
        if not spaced:
            yield from [[(0.0, b"")] for _ in texts]
            return
        lengths = np.array([len(t) for t in spaced])
        text, starts = "".join(spaced), np.cumsum(lengths) - lengths
        ends = self.words.cuts(text, starts)
        per_text = np.searchsorted(ends, starts + lengths, side="right").tolist()
        bounds = [0, *ends.tolist()]
        parts = [text[a:b] for a, b in zip(bounds, bounds[1:])]
        at = np.fromiter(map(self.known.get, parts, repeat(-1)), np.int64, len(parts))
        unknown = np.flatnonzero(at < 0).tolist()
        new = list({parts[k] for k in unknown})
        self._learn(new)
        at[unknown] = [self.known[parts[k]] for k in unknown]
        sizes = self.sizes.held[at]
        upto = np.cumsum(sizes)
        ids = self.ids.held[np.repeat(self.starts.held[at] - (upto - sizes), sizes) + np.arange(upto[-1])].tobytes()
        scores, losses, place = self.scores.held[at].tolist(), self.losses.held[at], [0, *(4 * upto).tolist()]
        spans = zip([0, *per_text], per_text)
        for t in texts:
            if not t:
                yield [(0.0, b"")]
                continue
            a, b = next(spans)
            out = []
            for score, changed in best_sums(math.fsum(scores[a:b]), losses[a:b], lambda j, a=a: self._found(int(at[a + j])), self.n):
                pieces, upto_now = [], place[a]
                for j in sorted(changed):
                    pieces += [ids[upto_now : place[a + j]], self._found(int(at[a + j]))[changed[j]][1]]
                    upto_now = place[a + j + 1]
                out.append((score, b"".join([*pieces, ids[upto_now : place[b]]])))
            yield out
        for p in new:
            if len(p) > REMEMBERED:
                self.others[self.known.pop(p)] = b""


class Decoder:
    def __init__(self, words: Vocabulary) -> None:
        self.pieces = {int(np.frombuffer(i, "<i4")[0]): p.encode() for p, (i, _) in words.pieces.items()}
        self.pieces |= {k: bytes([b]) for b, k in enumerate(words.byte)}

    def text(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        find = self.pieces.get
        raw = b"".join([find(k, b"") for k in ids])
        return raw[raw.startswith(b" ") :].decode("utf-8", "replace")


def best_sums(
    base: float, losses: np.ndarray, found: Callable[[int], list[tuple[float, bytes]]], n: int
) -> list[tuple[float, dict[int, int]]]:
    """The n best choices of one segmentation of every part, as their sum and {part: entry} where not the best.

    ``base`` is the sum of the best, ``losses`` (used up here) what each part's second loses,
    infinite where there is none, and ``found`` lists all of a part. The parts are sorted by
    their loss; a choice is followed by the one with the next entry in its last changed part, by
    the one that changes the next part too, and, where the last change is the first possible, by
    the one that changes the next part instead.
    """
    order = []
    # no more than n - 1 parts can change; as n is small, each is found by a pass of its own
    for _ in range(min(n - 1, len(losses))):
        k = int(losses.argmin())
        least = float(losses[k])
        if least == math.inf:
            break
        order.append((least, k))
        losses[k] = math.inf
    out: list[tuple[float, dict[int, int]]] = [(base, {})]
    queue = [(order[0][0], 0, 0, {order[0][1]: 1})] if order else []
    count = 0
    while queue and len(out) < n:
        loss, _, at, changed = heapq.heappop(queue)
        out.append((base - loss, changed))
        k = order[at][1]
        x, e = found(k), changed[k]
        following = []
        if e + 1 < len(x):
            following.append((loss + x[e][0] - x[e + 1][0], at, {**changed, k: e + 1}))
        if at + 1 < len(order):
            step, other = order[at + 1]
            following.append((loss + step, at + 1, {**changed, other: 1}))
            if e == 1:
                kept = {j: v for j, v in changed.items() if j != k}
                following.append((loss + step - order[at][0], at + 1, {**kept, other: 1}))
        for following_loss, place, choice in following:
            count += 1
            heapq.heappush(queue, (following_loss, count, place, choice))
    return out


def _vocabulary(docs: DataFrame, model: str | bytes, scores: str):
    if isinstance(model, str):
        with open(model, "rb") as f:
            model = f.read()
    # one model file, a few hundred kilobytes
    return docs.sparkSession.sparkContext.broadcast(load_vocabulary(model, scores))


def encode(
    docs: DataFrame, n: int = 3, id_col: str = "doc_id", text_col: str = "text", model: str | bytes = MODEL, scores: str = "rank",
) -> DataFrame:
    """(id, segmentations array<struct<score, ids>>): the n best segmentations of every text, best first.

    ``model`` is a file that the driver reads, or its bytes. Null and empty texts have one
    segmentation without ids. Texts with fewer segmentations give fewer. Equal scores come in
    the order of the search, which depends on the text alone.
    """
    rows, words = packed(docs, id_col, text_col), _vocabulary(docs, model, scores)

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = Encoder(words.value, n)
        kind = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int32()))]))
        for b in batches:
            out = [
                [{"score": s, "ids": np.frombuffer(i, "<i4")} for s, i in found]
                for found in encoder.all([t or "" for t in b.column(1).to_pylist()])
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], ["id", "segmentations"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", F.col("text").cast("string")).mapInArrow(
        read, f"id {kind}, segmentations array<struct<score:double,ids:array<int>>>"
    )


def encoded_digests(
    docs: DataFrame, n: int = 3, id_col: str = "doc_id", text_col: str = "text", model: str | bytes = MODEL, scores: str = "rank",
) -> DataFrame:
    """(id, n_pieces, scores, ids_sha256, restored): encode() without the ids, whose bytes are hashed.

    The hash of a segmentation is over its ids as little-endian 32-bit integers; ``restored``
    says whether decoding the best one gives back the text.
    """
    rows, words = packed(docs, id_col, text_col), _vocabulary(docs, model, scores)

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder, decoder = Encoder(words.value, n), Decoder(words.value)
        for b in batches:
            sizes, values, digests, same = [], [], [], []
            texts = [t or "" for t in b.column(1).to_pylist()]
            for t, found in zip(texts, encoder.all(texts)):
                best = found[0][1]
                sizes.append(len(best) // 4)
                values.append([round(s, 6) for s, _ in found])
                digests.append([hashlib.sha256(i).hexdigest() for _, i in found])
                same.append(decoder.text(np.frombuffer(best, "<i4").tolist()) == t)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(values, pa.list_(pa.float64())),
                 pa.array(digests, pa.list_(pa.string())), pa.array(same, pa.bool_())],
                ["id", "n_pieces", "scores", "ids_sha256", "restored"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", F.col("text").cast("string")).mapInArrow(
        read, f"id {kind}, n_pieces bigint, scores array<double>, ids_sha256 array<string>, restored boolean"
    )


def decode(encoded: DataFrame, id_col: str, ids_col: str, model: str | bytes = MODEL) -> DataFrame:
    """(id, text) of rows with ids; null ids give null, ids without a piece give nothing."""
    words = _vocabulary(encoded, model, "model")

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        decoder = Decoder(words.value)
        for b in batches:
            texts = [None if i is None else decoder.text(i) for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{ids_col}`").cast("array<int>")).mapInArrow(
        read, f"id {kind}, text string"
    )
