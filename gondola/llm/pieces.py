"""Sampled segmentations over the piece lattice of a SentencePiece model.

A text is cut where no piece of the vocabulary reaches across, so the lattice of a
text is the chain of the lattices of its units and sampling them one by one is
sampling the whole. For each distinct unit the forward sums over its lattice are
taken once (forward filtering); segmentations are then drawn from the end backwards,
an edge with the share its paths have in the forward sum (backward sampling). The
draws come from a counter-based hash of row key, unit and step: the same key and seed
give the same pieces, whatever the partitions.

Blanks are the mark U+2581 in pieces. A character without a piece, and a mark that
stands in the text itself, is spelled in byte pieces, so decoding gives the text
back exactly.

Piece weights: for a merge vocabulary (scores 0, -1, -2, ...) the weight of rank r is
that of a Zipf law, log(1 / (r + 2.7)); ``theta`` scales all weights, and large values
approach the single best segmentation.

Defined results: null and empty texts have no pieces; the row key of a null id is the
hash of its text; repeated rows get equal pieces; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.llm.staging import text_or_empty

MARK = "\u2581"
#: Stands for a mark of the text itself; no text read by Spark holds it.
OWN_MARK = "\udc80"
THETA = 1.0
#: Log weight of a character spelled in bytes; far below any piece.
BYTES_WEIGHT = -20.0
#: Lattice edges a worker keeps before it starts anew, and characters sampled at once.
CACHE_EDGES, PART_CHARS = 8_000_000, 2_000_000

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _step(state: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Hash of a spelling that is one character longer."""
    with np.errstate(over="ignore"):
        return _mix(state * _U(0xC2B2AE3D27D4EB4F) + points + _U(1))


class Lattices:
    """The vocabulary, and the filtered lattices of the units met so far.

    Edges into a node lie side by side; ``cdf`` holds node number plus their summed
    shares, so one search in the whole array draws an edge of any node.
    """

    def __init__(self, path: str, theta: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.theta = theta
        self.bytes = [b""] * size
        self.byte_ids = [0] * 256
        self.pieces: dict[str, tuple[int, float]] = {}
        scores = {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes[i], self.byte_ids[value] = bytes([value]), i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.bytes[i] = piece.replace(MARK, " ").encode()
                scores[i] = model.get_score(i)
        merges = all(float(s).is_integer() for s in scores.values())
        for i, score in scores.items():
            weight = -math.log(2.7 - score) if merges else score
            self.pieces[model.id_to_piece(i)] = (i, weight * theta)
        inside = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        self.inside = np.array(sorted(ord(a) << 32 | ord(b) for a, b in inside), np.int64)
        self.prefixes = self._prefixes()
        self.clear()

    def _prefixes(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By length: sorted hashes of all prefixes of pieces, with the piece of that spelling (or -1) and its weight."""
        levels: list[dict[int, tuple[int, float]]] = [{} for _ in range(max(map(len, self.pieces), default=0))]
        for piece, (i, weight) in self.pieces.items():
            state = np.zeros(1, _U)
            for k, c in enumerate(piece):
                state = _step(state, np.array([ord(c)], _U))
                levels[k].setdefault(int(state[0]), (-1, 0.0))
            levels[len(piece) - 1][int(state[0])] = (i, weight)
        made = []
        for level in levels:
            keys = np.array(sorted(level), _U)
            found = [level[int(k)] for k in keys]
            made.append((keys, np.array([i for i, _ in found], np.int64), np.array([w for _, w in found])))
        return made

    def clear(self) -> None:
        self.units: dict[str, int] = {}
        self.first, self.last = np.empty(0, np.int64), np.empty(0, np.int64)
        self.cdf = np.empty(CACHE_EDGES)
        self.origin, self.symbol = np.empty(CACHE_EDGES, np.int32), np.empty(CACHE_EDGES, np.int32)
        self.nodes = self.edges = 0

    def cut(self, text: str) -> list[str]:
        """Units of a text: cut between characters that stand side by side in no piece."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        pairs = points[:-1] << 32 | points[1:]
        at = np.minimum(np.searchsorted(self.inside, pairs), len(self.inside) - 1)
        ends = (np.flatnonzero(self.inside[at] != pairs) + 1).tolist()
        return [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)], strict=True)]

    def _paths(self, points: np.ndarray, stop: np.ndarray):
        """(begin, end, symbol, weight) of all edges; ``points`` are the units' characters, ``stop`` their unit's end."""
        at, state = np.arange(len(points)), np.zeros(len(points), _U)
        begins, ends, symbols, weights = [], [], [], []
        for k, (keys, ids, weight) in enumerate(self.prefixes):
            state = _step(state, points[at + k].astype(_U))
            where = np.minimum(np.searchsorted(keys, state), len(keys) - 1)
            known = keys[where] == state
            is_piece = known & (ids[where] >= 0)
            begins.append(at[is_piece])
            ends.append(at[is_piece] + k + 1)
            symbols.append(ids[where[is_piece]])
            weights.append(weight[where[is_piece]])
            if k == 0:
                spelled = np.flatnonzero(~is_piece)
                begins.append(spelled)
                ends.append(spelled + 1)
                symbols.append(-1 - points[spelled])
                weights.append(np.full(len(spelled), BYTES_WEIGHT * self.theta))
            going = known & (at + k + 1 < stop[at])
            at, state = at[going], state[going]
            if not len(at):
                break
        return tuple(map(np.concatenate, (begins, ends, symbols, weights)))

    def add(self, new: list[str]) -> None:
        """Forward filtering of all new units at once, position by position."""
        sizes = np.array([len(u) for u in new], np.int64)
        points = np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        unit = np.repeat(np.arange(len(new)), sizes)
        starts = np.cumsum(sizes) - sizes
        begin, end, symbol, weight = self._paths(points, (starts + sizes)[unit])
        # Nodes: one more than characters in each unit.
        own = unit[begin]
        origin, node = begin + own, end + own
        local = end - starts[own]
        order = np.lexsort((node, local))
        origin, node, symbol, weight, local = (x[order] for x in (origin, node, symbol, weight, local))
        total = np.zeros(len(points) + len(new))
        share = np.empty(len(node))
        cuts = np.flatnonzero(np.append(True, local[1:] != local[:-1]))
        for a, b in zip(cuts, np.append(cuts[1:], len(local)), strict=True):
            value = total[origin[a:b]] + weight[a:b]
            heads = np.flatnonzero(np.append(True, node[a + 1 : b] != node[a : b - 1]))
            widths = np.diff(np.append(heads, b - a))
            top = np.maximum.reduceat(value, heads)
            parts = np.exp(value - np.repeat(top, widths))
            sums = np.add.reduceat(parts, heads)
            total[node[a + heads]] = top + np.log(sums)
            running = np.cumsum(parts)
            running = (running - np.repeat(running[heads] - parts[heads], widths)) / np.repeat(sums, widths)
            running[np.append(heads[1:], b - a) - 1] = 1.0
            share[a:b] = np.clip(running, 0, 1)
        order = np.argsort(node, kind="stable")
        stop = self.edges + len(node)
        while stop > len(self.cdf):
            self.cdf, self.origin, self.symbol = (np.append(x, np.empty_like(x)) for x in (self.cdf, self.origin, self.symbol))
        self.cdf[self.edges : stop] = self.nodes + node[order] + share[order]
        self.origin[self.edges : stop] = self.nodes + origin[order]
        self.symbol[self.edges : stop] = symbol[order]
        first = self.nodes + starts + np.arange(len(new))
        self.units.update(zip(new, range(len(self.units), len(self.units) + len(new)), strict=True))
        self.first, self.last = np.append(self.first, first), np.append(self.last, first + sizes)
        self.nodes, self.edges = self.nodes + len(points) + len(new), stop

    def sample(self, units: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols in order, number of symbols per unit); ``keys`` seeds each unit's draws."""
        new = [u for u in dict.fromkeys(units) if u not in self.units]
        if new:
            self.add(new)
        cdf = self.cdf[: self.edges]
        at = np.fromiter(map(self.units.__getitem__, units), np.int64, len(units))
        first, node = self.first[at], self.last[at].copy()
        who = np.arange(len(units))
        drawn: list[tuple[np.ndarray, np.ndarray]] = []
        step = 0
        while len(who):
            share = (_mix(keys[who] + _U(step) * _U(0x9E3779B97F4A7C15)) >> _U(11)).astype(np.float64) * 2.0**-53
            edge = np.searchsorted(cdf, node[who] + share, side="right")
            drawn.append((who, self.symbol[edge]))
            node[who] = self.origin[edge]
            who = who[node[who] != first[who]]
            step += 1
        counts = np.zeros(len(units), np.int64)
        for who, _ in drawn:
            counts[who] += 1
        last = np.cumsum(counts) - 1
        out = np.empty(int(counts.sum()), np.int64)
        for step, (who, symbols) in enumerate(drawn):
            out[last[who] - step] = symbols
        return out, counts

    def ids(self, symbols: np.ndarray) -> np.ndarray:
        """Piece ids; spelled characters become their byte pieces."""
        odd = np.flatnonzero(symbols < 0)
        if not len(odd):
            return symbols.astype("<u4")
        parts, at = [], 0
        for k in odd.tolist():
            parts.append(symbols[at:k])
            raw = chr(-1 - int(symbols[k])).encode("utf-8", "surrogatepass")
            parts.append(np.array([self.byte_ids[b] for b in raw], np.int64))
            at = k + 1
        return np.concatenate([*parts, symbols[at:]]).astype("<u4")


_lattices: dict[tuple[str, float], Lattices] = {}


def lattices(path: str, theta: float = THETA) -> Lattices:
    if (path, theta) not in _lattices:
        _lattices[path, theta] = Lattices(path, theta)
    return _lattices[path, theta]


def _prepared(text: str) -> str:
    """Blanks as marks, with a leading one; marks of the text itself get a sign of their own."""
    return MARK + text.replace(MARK, OWN_MARK).replace(" ", MARK)


def encode_texts(texts: list[str], keys: list[int], path: str, theta: float = THETA, seed: int = 0) -> list[bytes]:
    """Sampled ids of each text, little-endian unsigned 32-bit."""
    model = lattices(path, theta)
    if model.edges > CACHE_EDGES // 2:
        model.clear()
    cut = [model.cut(_prepared(t)) if t else [] for t in texts]
    sizes = np.array([len(u) for u in cut], np.int64)
    with np.errstate(over="ignore"):
        rows = _mix(_mix(np.array([k & (2**64 - 1) for k in keys], _U)) + _U(seed) * _U(0x9E3779B97F4A7C15))
        place = (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(_U)
        draws = _mix(np.repeat(rows, sizes) + place * _U(0xD1B54A32D192ED03))
        symbols, counts = model.sample([u for units in cut for u in units], draws)
    symbols[symbols == -1 - ord(OWN_MARK)] = -1 - ord(MARK)
    ends = np.cumsum(np.append(0, counts))[np.cumsum(np.append(0, sizes))]
    return [model.ids(symbols[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def decode_ids(ids: list[bytes], path: str, theta: float = THETA) -> list[str]:
    """The texts that were encoded."""
    table = lattices(path, theta).bytes
    return [
        b"".join([table[i] for i in np.frombuffer(raw, "<u4").tolist()])[1:].decode("utf-8", "surrogatepass") for raw in ids
    ]


def _batched(sizes: list[int], most: int):
    """Index ranges whose sizes sum to about ``most``."""
    first = total = 0
    for i, size in enumerate(sizes):
        total += size
        if total > most or i == len(sizes) - 1:
            yield first, i + 1
            first, total = i + 1, 0


def encode(docs: DataFrame, path: str, theta: float = THETA, seed: int = 0) -> DataFrame:
    """(doc_id, ids): sampled piece ids of every text, little-endian unsigned 32-bit."""

    def kernel(batches):
        for batch in batches:
            texts, keys = batch.column("text").to_pylist(), batch.column("key").to_pylist()
            for a, b in _batched([len(t) for t in texts], PART_CHARS):
                ids = encode_texts(texts[a:b], keys[a:b], path, theta, seed)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(ids, pa.binary())], ["doc_id", "ids"]
                )

    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(
        doc_id.alias("doc_id"), F.coalesce(doc_id, F.xxhash64(text_or_empty())).alias("key"), text_or_empty().alias("text")
    )
    return rows.mapInArrow(kernel, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text): the text of every row of ids."""

    def kernel(batches):
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            for a, b in _batched([len(x) for x in ids], 4 * PART_CHARS):
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(a, b - a) for c in ("doc_id", "ids")), pa.array(decode_ids(ids[a:b], path), pa.string())],
                    ["doc_id", "ids", "text"],
                )

    return encoded.select("doc_id", "ids").mapInArrow(kernel, "doc_id long, ids binary, text string")
