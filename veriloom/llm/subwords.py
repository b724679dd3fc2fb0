"""Subword lattices over a public piece vocabulary: sampling without replacement, and decoding.

A text becomes what the piece model's normaliser makes of it (identity; white-space marks, one in
front) and is cut between characters that stand side by side in no piece, so that no piece crosses
a cut. Each chunk is a lattice whose edges are the vocabulary's pieces; a character outside the
vocabulary is one edge of byte pieces.
Piece scores are log probabilities by Zipf's law on the vocabulary's own ranks (the vocabulary
ships ranks and no probabilities; nothing is trained). Backward sums turn a lattice into a Markov
chain over its nodes, so a text's segmentations have exact probabilities.

The k samples are Gumbel top-k without replacement by perturbed A* search: the set of all
segmentations holds one Gumbel maximum, whose argument is an ordinary sample; taking it splits the
set by the first step at which a segmentation departs from it, each part gets a Gumbel truncated
at the parent's, and the part with the largest is opened next, by sampling within it. Every text
thus yields distinct segmentations in the order of their perturbed scores. The next unopened
value, kappa, gives inclusion scores: 1 - exp(-exp(log_prob - kappa)).

All randomness is a hash of (row key, sample, place in the text), so a row's samples depend on
neither partitioning nor neighbours, and a recomputed task gives the same rows.

Scale: a map over documents without a shuffle. Texts of a batch are sampled together, node by
node; chunk lattices are remembered per worker, up to REMEMBERED edges.

Defined results: null counts as empty; an empty text has no piece, one segmentation of probability
1 and inclusion 1; texts with fewer than k segmentations give all they have; repeated rows with
equal keys and texts give equal samples; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix64, whole
from .tokens import vocabulary

MODEL = "piece_bpe_32k.model"
SAMPLES = 2
MARK = "▁"
#: Zipf: a piece of rank r has weight 1 / (r + ZIPF_SHIFT); a byte piece counts as the last rank, squared.
ZIPF_SHIFT = 2.7
#: Scores are taken to this power, which flattens the distribution so that samples differ.
ALPHA = 0.3
#: Edges of lattices that a worker remembers, about 32 bytes each; the memory starts anew beyond that.
REMEMBERED = 6_000_000
#: Texts that are sampled together.
BATCH = 256
#: Siblings whose log mass lies further than this below the start cannot win in double precision.
FAR = 80.0


class Pieces:
    """The vocabulary: ids and log probabilities by piece, and bytes by id."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        rank = {i: r for r, i in enumerate(plain)}
        total = math.log(sum(1 / (r + ZIPF_SHIFT) for r in range(len(plain))))
        self.score = np.zeros(n)
        self.score[plain] = [ALPHA * (-math.log(rank[i] + ZIPF_SHIFT) - total) for i in plain]
        self._trie({names[i]: i for i in plain})
        self.byte_ids = {int(names[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.byte_score = ALPHA * 2 * (-math.log(len(plain) + ZIPF_SHIFT) - total)
        self.spelled: dict[int, bytes] = {i: names[i].replace(MARK, " ").encode() for i in plain} | {i: bytes([b]) for b, i in self.byte_ids.items()}


    def _pairs(self, names: list[str]) -> None:
        """A small number per character (0: in no piece), and which two stand side by side in a piece."""
        letters = sorted({c for name in names for c in name})
        self.letter = np.zeros(0x110000, np.int16)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.beside = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        joined = self.letter[np.frombuffer("".join(names).encode("utf-32-le"), "<u4")]
        inner = np.ones(len(joined) - 1, bool)
        inner[np.cumsum([len(name) for name in names])[:-1] - 1] = False
        self.beside[joined[:-1][inner], joined[1:][inner]] = True

    def _trie(self, ids: dict[str, int]) -> None:
        """The pieces' prefixes as states, with moves as sorted numbers (state and character)."""
        self._pairs(list(ids))
        states = {"": 0}
        for name in ids:
            for end in range(1, len(name) + 1):
                states.setdefault(name[:end], len(states))
        moves = sorted((states[x[:-1]] << 21 | ord(x[-1]), at) for x, at in states.items() if x)
        self.moves, self.moved = (np.array(x, np.int64) for x in zip(*moves, strict=True))
        self.piece_of = np.full(len(states), -1, np.int64)
        for name, i in ids.items():
            self.piece_of[states[name]] = i
        self.longest = max(map(len, ids))


class Lattices:
    """All lattices met so far, end to end.

    Nodes are numbered over all chunks, each chunk with a last node of its own that has no edge.
    By node: first and last edge (first is -1 for last nodes). By edge: the node it starts from and
    the one it leads to, its log probability given its start, the upper bound of its stretch of
    the unit interval above the start's number, and where its ids begin.
    """

    KINDS = {"first": np.int32, "last": np.int32, "owner": np.int32, "target": np.int32, "logp": np.float64, "upto": np.float64, "id_from": np.int32, "ids": np.int32}

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.base: dict[str, int] = {}  # chunk -> first node and, in the lower 32 bits, nodes
        self.store = {name: np.zeros(1 << 12, kind) for name, kind in self.KINDS.items()}
        self.used = dict.fromkeys(self.KINDS, 0)

    def _put(self, **more: np.ndarray) -> None:
        for name, values in more.items():
            n, held = self.used[name], self.store[name]
            if n + len(values) > len(held):
                self.store[name] = held = np.concatenate([held[:n], np.zeros(max(len(values), n // 2) + 1, held.dtype)])
            held[n : n + len(values)] = values
            self.used[name] = n + len(values)

    def _edges(self, codes: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First edge of every place, and (start, length, piece or -1) of every edge, by start and longest first."""
        pieces, found = self.pieces, []
        at, state, counts = np.arange(len(codes)), np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
        for length in range(1, pieces.longest + 1):
            key = state << 21 | codes[at + length - 1]
            place = np.minimum(np.searchsorted(pieces.moves, key), len(pieces.moves) - 1)
            hit = pieces.moves[place] == key
            state = np.where(hit, pieces.moved[place], 0)
            piece = np.where(hit, pieces.piece_of[state], -1)
            keep = np.flatnonzero(piece >= 0) if length > 1 else np.arange(len(at))  # else one edge of bytes
            found.append((at[keep], length, piece[keep]))
            counts[found[-1][0]] += 1
            going = np.flatnonzero(hit & (at + length < end[at]))
            at, state = at[going], state[going]
            if not len(at):
                break
        heads = np.cumsum(counts) - counts
        free, total = heads.copy(), int(counts.sum())
        lengths, piece = np.zeros(total, np.int64), np.zeros(total, np.int64)
        for where, length, of in reversed(found):
            to = free[where]
            lengths[to], piece[to] = length, of
            free[where] += 1
        return heads, np.repeat(np.arange(len(codes)), counts), lengths, piece

    def add(self, chunks: list[str]) -> None:
        """Build the lattices of new chunks, all at once."""
        if not chunks:
            return
        lengths = np.array([len(c) for c in chunks], np.int64)
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        end = np.repeat(np.cumsum(lengths), lengths)
        chunk = np.repeat(np.arange(len(chunks)), lengths)
        heads, start, length, piece = self._edges(codes, end)
        raw = np.flatnonzero(piece < 0)
        code = codes[start[raw]]
        n_bytes = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        score = self.pieces.score[piece]
        score[raw] = self.pieces.byte_score * n_bytes
        node = np.arange(len(codes)) + chunk  # every chunk has a last node of its own
        owner = node[start]
        target = owner + length
        # backward sums, by the distance to a chunk's end and for all chunks at once
        back = np.zeros(len(codes) + len(chunks))
        away = (end - np.arange(len(codes)))[start]
        order = np.argsort(away.astype(np.int16) if len(away) and away.max() < 1 << 15 else away, kind="stable")
        cuts = np.r_[0, np.cumsum(np.bincount(away))]
        value, by = score[order], (owner[order], target[order])
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo == hi:
                continue
            own = by[0][lo:hi]
            mass = value[lo:hi] + back[by[1][lo:hi]]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            top = np.maximum.reduceat(mass, first)
            mass -= np.repeat(top, np.diff(np.r_[first, hi - lo]))
            back[own[first]] = top + np.log(np.add.reduceat(np.exp(mass), first))
        logp = np.minimum(0.0, score + back[target] - back[owner])
        counts = np.diff(np.r_[heads, len(start)])
        upto = np.cumsum(np.exp(logp))
        upto -= np.repeat(np.r_[0.0, upto][heads], counts)
        node0, edge0, id0 = self.used["first"], self.used["target"], self.used["ids"]
        first, last = np.full(len(back), -1, np.int64), np.full(len(back), -2, np.int64)
        first[node], last[node] = edge0 + heads, edge0 + heads + counts - 1
        ids, id_from = piece, np.arange(len(piece))
        if len(raw):
            n_ids = np.ones(len(piece), np.int64)
            n_ids[raw] = n_bytes
            ids, id_from = np.repeat(piece, n_ids), np.cumsum(n_ids) - n_ids
            spelled: dict[int, list[int]] = {}
            for at, n, c in zip(id_from[raw].tolist(), n_bytes.tolist(), code.tolist(), strict=True):
                if c not in spelled:
                    spelled[c] = [self.pieces.byte_ids[b] for b in chr(c).encode("utf-8", "surrogatepass")]
                ids[at : at + n] = spelled[c]
        self._put(first=first, last=last, owner=node0 + owner, target=node0 + target, logp=logp, upto=node0 + owner + upto, id_from=id0 + id_from, ids=ids)
        starts = np.cumsum(lengths + 1) - lengths - 1 + node0
        self.base.update(zip(chunks, (starts << 32 | lengths + 1).tolist(), strict=True))

    def __getattr__(self, name: str) -> np.ndarray:
        if name in Lattices.KINDS:
            return self.store[name][: self.used[name]]
        raise AttributeError(name)

    def ids_of(self, path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all edges, one after the other, and how many each has."""
        start = self.id_from[path]
        known = path + 1 < len(self.id_from)
        count = np.where(known, self.id_from[np.where(known, path + 1, 0)], len(self.ids)) - start
        if not len(count) or count.max() == 1:
            return self.ids[start], count
        at = np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
        return self.ids[at], count


class Sampler:
    """Samples for batches of texts."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.lattices = Lattices(self.pieces)

    def chunks(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The chunks of all texts, one text after the other, and how many each has."""
        full = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        lengths = np.array([len(t) for t in full], np.int64)
        joined = "".join(full)
        if not joined:
            return [], np.zeros(len(texts), np.int64)
        letters = self.pieces.letter[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")]
        begins = np.empty(len(joined), bool)
        np.logical_not(self.pieces.beside[letters[:-1], letters[1:]], out=begins[1:])
        text_at = np.cumsum(lengths) - lengths
        begins[text_at[lengths > 0]] = True
        at = np.flatnonzero(begins)
        edges = at.tolist()
        counts = np.searchsorted(at, text_at + lengths) - np.searchsorted(at, text_at)
        return [joined[a:b] for a, b in zip(edges, [*edges[1:], len(joined)], strict=True)], counts

    def __call__(self, keys: list, texts: list[str], k: int = SAMPLES) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """Per text, in order: (ids, log_prob, perturbed score, inclusion)."""
        held = self.lattices
        if held.used["target"] > REMEMBERED:
            held.clear()
        chunks, counts = self.chunks(texts)
        known = held.base
        held.add(sorted(set(chunks).difference(known)))
        first, last_of, owner, target, logp, upto = held.first, held.last, held.owner, held.target, held.logp, held.upto
        total = len(chunks)
        where = np.fromiter(map(known.__getitem__, chunks), np.int64, total)
        start_of, nodes_of = where >> 32, where & 0xFFFFFFFF

        crcs = [str(x).encode() for x in keys]
        seeds = np.array([zlib.crc32(x) | zlib.crc32(b"#" + x) << 32 for x in crcs], np.uint64)
        token_doc = np.repeat(np.arange(len(texts)), counts)
        doc_base = np.concatenate([[0], np.cumsum(counts)])
        # a place in the text: nodes passed before this chunk, so that draws differ along the text
        place = np.cumsum(nodes_of) - nodes_of
        place -= place[np.minimum(doc_base[:-1], max(0, len(place) - 1))][token_doc] if len(place) else 0
        place -= start_of  # a node's place is its number plus this

        with np.errstate(over="ignore"):
            streams = [mix64(seeds + np.uint64(sample + 1) * np.uint64(0xD1B54A32D192ED03)) for sample in range(k)]

        def uniform(base: np.ndarray, at: np.ndarray) -> np.ndarray:
            """Numbers in (0, 1) by stream and place."""
            with np.errstate(over="ignore"):
                x = mix64(base + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            x >>= np.uint64(11)
            return np.maximum(x, np.uint64(1)) * (1 / (1 << 53))

        def walk(tokens: np.ndarray, start: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray]:
            """Edges of ancestral samples for tokens (sorted), each from its start node on, and where each text's begin."""
            alive = np.flatnonzero(first[start] >= 0)
            who, node = alive, start[alive]
            seed, shift = streams[sample][token_doc[tokens]][alive], place[tokens][alive]
            rows, edges, taken = [], [], np.zeros(len(tokens), np.int64)
            while len(who):
                aim = uniform(seed, shift + node)
                aim += node
                e = first[node]
                late = np.flatnonzero(aim >= upto[e])
                ends = last_of[node[late]]
                while len(late):
                    more = np.flatnonzero((e[late] < ends) & (aim[late] >= upto[e[late]]))
                    late, ends = late[more], ends[more]
                    e[late] += 1
                rows.append(who)
                edges.append(e)
                taken[who] += 1
                node = target[e]
                going = np.flatnonzero(first[node] >= 0)
                who, node, seed, shift = who[going], node[going], seed[going], shift[going]
            # a token's edges stand together, in the order of steps
            upto_here = np.concatenate([[0], np.cumsum(taken)])
            out = np.empty(int(upto_here[-1]), np.int64)
            for step, (who, e) in enumerate(zip(rows, edges, strict=True)):
                out[upto_here[who] + step] = e
            return out, upto_here[np.searchsorted(tokens, doc_base)]

        def parts(paths: list[np.ndarray], begin: list[int], excluded: list[set], before: np.ndarray, bound: np.ndarray, of: np.ndarray, sample: int) -> list[dict]:
            """Per path, truncated Gumbels of the sets that depart from it at each step from begin on.

            excluded: edges at begin that other samples have taken already; before: log mass of the
            steps before begin; of: the text of each path.
            """
            # what departs beyond FAR cannot win, so a long path is looked at as far as that only
            limit, reach = FAR - np.minimum(0.0, before), 64
            lengths = np.array([len(p) - b for p, b in zip(paths, begin, strict=True)], np.int64)
            while True:
                width = min(reach, int(lengths.max(initial=0)))
                shown = np.minimum(lengths, width)
                row, column = np.repeat(np.arange(len(paths)), shown), np.arange(int(shown.sum())) - np.repeat(np.cumsum(shown) - shown, shown)
                edge = np.concatenate([p[b : b + width] for p, b in zip(paths, begin, strict=True)]) if paths else row
                steps = np.zeros((len(paths), width))
                steps[row, column] = logp[edge]
                ahead = np.cumsum(steps, 1) - steps + before[:, None]
                if width < reach or (-ahead[:, -1] > limit)[lengths > width].all():
                    break
                reach *= 2
            near = (column == 0) | (-ahead[row, column] < limit[row])
            row, column, edge = row[near], column[near], edge[near]
            left = -np.expm1(np.minimum(steps[row, column], 0.0))
            node = owner[edge]
            left[first[node] == last_of[node]] = 0.0
            for at in np.flatnonzero(column == 0) if any(excluded) else ():
                if gone := excluded[row[at]]:
                    gone = gone | {int(edge[at])}
                    left[at] = sum(math.exp(logp[e]) for e in range(first[node[at]], last_of[node[at]] + 1) if e not in gone)
            value = np.full((len(paths), max(1, width)), -math.inf)
            alive = left > 1e-300
            row, column = row[alive], column[alive]
            phi = ahead[row, column] + np.log(left[alive])
            noise = -np.log(uniform(streams[sample][of[row]], np.array(begin, np.int64)[row] + column + (1 << 41)))
            value[row, column] = -np.logaddexp(-bound[row], np.log(noise) - phi)
            best, at = value.max(1).tolist(), value.argmax(1).tolist()
            return [{"value": value[i], "begin": begin[i], "best": best[i], "at": begin[i] + at[i], "excluded": excluded[i]} for i in range(len(paths))]

        edges, cuts = walk(np.arange(total), start_of, 0)
        every = np.arange(len(texts))
        tops = -np.log(-np.log(uniform(streams[0], np.full(len(texts), 1 << 40))))
        paths = [edges[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        found = [[(p, top)] for p, top in zip(paths, tops.tolist(), strict=True)]
        # per text: parts still to be opened, the first of them that of the first sample, and so on
        states = [[x] for x in parts(paths, [0] * len(texts), [set()] * len(texts), np.zeros(len(texts)), tops, every, 0)]
        for sample in range(1, k):
            tokens, starts, told = [], [], []
            picked = [max(range(len(x)), key=lambda i, x=x: x[i]["best"]) for x in states]
            live = [d for d, best in enumerate(picked) if states[d][best]["best"] > -math.inf]
            if not live:
                break
            ats = np.array([states[d][picked[d]]["at"] for d in live])
            luck = uniform(streams[sample][live], (1 << 42) + ats).tolist()
            for d, u in zip(live, luck, strict=True):
                part, path = states[d][picked[d]], found[d][picked[d]][0]
                at = part["at"]
                excluded = (part["excluded"] if at == part["begin"] else set()) | {int(path[at])}
                node = owner[path[at]]
                options = [e for e in range(first[node], last_of[node] + 1) if e not in excluded]
                mass = list(accumulate(math.exp(x) for x in logp[options].tolist()))
                branch = options[min(bisect_right(mass, u * mass[-1]), len(options) - 1)]
                chunk = int(doc_base[d] + np.count_nonzero(first[target[path[:at]]] < 0))
                tokens.append(np.arange(chunk, doc_base[d + 1]))
                starts.append(start_of[chunk : doc_base[d + 1]].copy())
                starts[-1][0] = target[branch]
                told.append((path[:at], branch, part["best"], excluded | {branch}))
                # the opened part shrinks: the new path's part takes over what is left at its place
                part["value"][at - part["begin"]] = -math.inf
                part["best"] = float(part["value"].max())
                part["at"] = part["begin"] + int(part["value"].argmax())
            tails, cuts = walk(np.concatenate(tokens), np.concatenate(starts), sample)
            paths = [np.concatenate([head, [branch], tails[cuts[d] : cuts[d + 1]]]) for d, (head, branch, _, _) in zip(live, told, strict=True)]
            values = np.array([x[2] for x in told])
            before = np.array([logp[head].sum() for head, *_ in told])
            new = parts(paths, [len(x[0]) for x in told], [x[3] - {x[1]} for x in told], before, values, np.array(live), sample)
            for d, path, value, part in zip(live, paths, values.tolist(), new, strict=True):
                found[d].append((path, value))
                states[d].append(part)
        flat = [path for samples in found for path, _ in samples]
        joined = np.concatenate(flat) if flat else np.zeros(0, np.int64)
        ends = np.cumsum([len(x) for x in flat]).astype(np.int64)
        ids, n_ids = held.ids_of(joined)
        id_ends = np.concatenate([[0], np.cumsum(n_ids)])[ends].tolist()
        sums = [float(x.sum()) for x in np.split(logp[joined], ends[:-1])] if flat else []
        out, i, begin = [], 0, 0
        for d, samples in enumerate(found):
            kappa = max(x["best"] for x in states[d])
            told = []
            for _, value in samples:
                lp = sums[i]
                told.append((ids[begin : id_ends[i]], lp, value, 1.0 if kappa == -math.inf else -math.expm1(-math.exp(min(700.0, lp - kappa)))))
                begin = id_ends[i]
                i += 1
            out.append(told)
        return out

    def decode(self, ids) -> str:
        return decoded(np.asarray(ids).tolist(), self.pieces)


def spelled(ids: list[int], pieces: Pieces) -> bytes:
    """The text of ids in UTF-8, without the mark in front."""
    return b"".join(map(pieces.spelled.__getitem__, ids))[1:]


def decoded(ids: list[int], pieces: Pieces) -> str:
    return spelled(ids, pieces).decode("utf-8", "replace")


@lru_cache(2)
def sampler(path: str) -> Sampler:
    return Sampler(path)


SAMPLED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("sample", T.IntegerType()), T.StructField("n_pieces", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("log_prob", T.DoubleType()), T.StructField("perturbed", T.DoubleType()), T.StructField("inclusion", T.DoubleType())])


def encode(docs: DataFrame, path: str | None = None, k: int = SAMPLES, text: str = "text", key: str = "doc_id", with_ids: bool = True, with_decoded: bool = False) -> DataFrame:
    """k distinct sampled segmentations per row, best perturbed score first.

    with_decoded: also the SHA-256 of the text that a segmentation's ids decode to.
    """
    path = path or vocabulary(MODEL)
    schema = T.StructType([*SAMPLED.fields, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []), *([T.StructField("decoded_sha256", T.StringType())] if with_decoded else [])])
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), *([pa.list_(pa.int32())] if with_ids else []), *([pa.string()] if with_decoded else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sampler(path)
        for big in batches:
            for at in range(0, big.num_rows, BATCH):
                batch = big.slice(at, BATCH)
                rows = []
                keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for doc, told in zip(keys, own(keys, texts, k), strict=True):
                    for i, (ids, lp, value, q) in enumerate(told):
                        rows.append((doc, i, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), lp, value, q, *([ids] if with_ids else []), *([hashlib.sha256(spelled(ids.tolist(), own.pieces)).hexdigest()] if with_decoded else [])))
                columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema.fields]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], schema.fieldNames())

    return docs.select(F.col(key).cast("long"), whole(text)).mapInArrow(run, schema)


def decode(rows: DataFrame, path: str | None = None, ids: str = "ids", to: str = "text") -> DataFrame:
    """rows with the text of their ids as column `to`, in place of one of that name; null ids give null."""
    path = path or vocabulary(MODEL)
    kept = [c for c in rows.columns if c != to]
    rows = rows.select(*kept, F.col(ids).alias(to + "_ids"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(to, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sampler(path).pieces
        for batch in batches:
            texts = [None if x is None else decoded(x, own) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], schema.fieldNames())

    return rows.mapInArrow(run, schema)


def op2_subword_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two samples of every text, and what each of them decodes to."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), with_ids=False, with_decoded=True)
