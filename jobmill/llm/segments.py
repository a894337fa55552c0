"""Distinct sampled segmentations of texts into the pieces of a vocabulary, and their decoding.

A text's segmentations are the paths of a lattice whose edges are pieces; a path's weight is the product of its pieces' weights
(``1 / (2 + rank)`` here, the vocabulary is ordered by frequency).  Backward sums make every edge's share known, so the
top ``k`` of Gumbel-perturbed log-probabilities, which is a sample of k paths without replacement, can be found by
an A* search from the start: a prefix carries the perturbed value of the best path through it, its extensions
draw theirs under that maximum, and the search always extends the best prefix.  The largest value left over is the threshold
from which each sample's inclusion score follows.

Beyond the point where a prefix's probability is below exp(-DEPTH), a path that leaves it cannot reach the sample any
more (its chance is of that size), so the rest of the path is drawn edge by edge, for all texts together.  No piece crosses the
beginning of a blank-led word, so the lattice of a word is built once per batch however often the word occurs.  All draws
come from the row's key and the place in the text, so they do not depend on batches or tasks.
"""

from __future__ import annotations

import heapq
import math
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmill.llm.common import GOLDEN, mix, picked, prefix_sums, slices, span_hash, utf8

SAMPLES, SEED = 2, 7
SLICE_BYTES = 3 << 20
DEPTH = 16.0
SCALE, LONG_WORD = 1.5, 64
PREFIXES = (2, 3, 4, 6, 8, 11)  # bytes after which places where no longer piece can begin are left out
FIRST_BYTE, FIRST_PIECE = 3, 259  # ids of byte 0 and of the first ordinary piece
BLANK = "▁"
_LEAD = np.array([1] * 0x80 + [0] * 0x40 + [2] * 0x20 + [3] * 0x10 + [4] * 0x08 + [1] * 0x08)
_vocabularies: dict[str, Vocabulary] = {}


class Vocabulary:
    """Pieces as bytes (a blank for the blank mark), their log-weights, and sorted hashes by length."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [b""] * model.get_piece_size()
        by_length: dict[int, list[tuple[int, bytes]]] = {}
        for i in range(model.get_piece_size()):
            if model.is_byte(i):
                self.pieces[i] = bytes([int(model.id_to_piece(i)[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.pieces[i] = model.id_to_piece(i).replace(BLANK, " ").encode()
                by_length.setdefault(len(self.pieces[i]), []).append((i, self.pieces[i]))
        self.weight = -np.log(2.0 + np.maximum(np.arange(len(self.pieces)) - FIRST_PIECE, 0))
        self.weight[:FIRST_PIECE] = -math.log(2.0 + len(self.pieces))
        self.tables = []
        for length, pairs in sorted(by_length.items()):
            data = np.frombuffer(b"".join(p for _, p in pairs), np.uint8)
            starts = np.arange(len(pairs)) * length
            hashes = span_hash(prefix_sums(data), starts, starts + length, short=True)
            order = np.argsort(hashes)
            self.tables.append((length, hashes[order], np.array([i for i, _ in pairs])[order]))
        self.prefixes = {}  # hashes of the first bytes that longer pieces begin with
        for length in PREFIXES:
            heads = sorted({p[:length] for n, pairs in by_length.items() if n > length for _, p in pairs})
            starts = np.arange(len(heads)) * length
            self.prefixes[length] = np.sort(span_hash(prefix_sums(np.frombuffer(b"".join(heads), np.uint8)), starts, starts + length, short=True))


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


class Lattices:
    """The lattices of distinct words: nodes are byte positions, one more per word for its end."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: Vocabulary):
        sizes = ends - starts
        first = np.cumsum(sizes) - sizes
        flat = data[np.repeat(starts - first, sizes) + np.arange(sizes.sum())]
        word = np.repeat(np.arange(len(sizes)), sizes)
        stop = (first + sizes)[word]
        sums, at = prefix_sums(flat), np.flatnonzero(_LEAD[flat])
        own = np.zeros(len(flat), bool)  # characters that are a piece
        src, length, piece = [], [], []
        known = lambda sorted_hashes, wanted: sorted_hashes[np.minimum(np.searchsorted(sorted_hashes, wanted), len(sorted_hashes) - 1)] == wanted
        checks = [p for p in PREFIXES if len(words.prefixes[p])]
        for n, hashes, ids in words.tables:
            at = at[at + n <= stop[at]]
            while checks and checks[0] < n:
                at = at[known(words.prefixes[checks[0]], span_hash(sums, at, at + checks.pop(0), short=True))]
            found = span_hash(sums, at, at + n, short=True)
            slot = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
            hit = hashes[slot] == found
            here = at[hit]
            own[here[_LEAD[flat[here]] == n]] = True
            src.append(here)
            length.append(np.full(len(here), n))
            piece.append(ids[slot[hit]])
        lead = np.maximum.accumulate(np.where(_LEAD[flat] > 0, np.arange(len(flat)), 0)) if len(flat) else np.empty(0, int)
        spelled = np.flatnonzero(~own[lead])
        src, length, piece = (np.concatenate([*x, y]) for x, y in ((src, spelled), (length, np.ones(len(spelled), int)), (piece, FIRST_BYTE + flat[spelled].astype(int))))
        self.begin = first + np.arange(len(sizes))  # node of each word's start
        self.final = self.begin + sizes
        left = stop[src] - src
        src = src + word[src]
        weight = words.weight[piece]
        order = np.argsort(left.astype(np.int16), kind="stable") if left.max(initial=0) < 1 << 15 else np.argsort(left, kind="stable")
        s, d, w, left = src[order], (src + length)[order], weight[order], left[order]
        behind = np.full(len(flat) + len(sizes), -np.inf)
        behind[self.final] = 0
        # Shares are summed as plain numbers, kept in range by a factor per byte; words too long for that by logarithms.
        factor = np.exp(w + SCALE * (d - s))
        sums_behind = np.zeros(len(behind))
        sums_behind[self.final] = 1.0
        bounds = np.append(np.flatnonzero(np.diff(left, prepend=-1)), len(left)).tolist()
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if left[lo] <= LONG_WORD:
                np.add.at(sums_behind, s[lo:hi], factor[lo:hi] * sums_behind[d[lo:hi]])
            else:
                if left[lo - 1] <= LONG_WORD:
                    _to_logs(behind, sums_behind, self.final, first, sizes, word)
                part = slice(lo, hi)
                np.logaddexp.at(behind, s[part], w[part] + behind[d[part]])
        if not len(left) or left[-1] <= LONG_WORD:
            _to_logs(behind, sums_behind, self.final, first, sizes, word)
        share = w_share(weight=words.weight[piece], behind=behind, src=src, dst=src + length)
        live = np.flatnonzero(np.isfinite(share))
        live = live[np.argsort(src[live] - np.exp(np.minimum(share[live], 0.0)) * 0.999, kind="stable")]  # a node's likeliest edge first
        self.dst, self.piece, self.logp, src = (src + length)[live], piece[live], share[live], src[live]
        self.start = np.searchsorted(src, np.arange(len(behind) + 1))
        total = np.concatenate([[0.0], np.cumsum(np.exp(self.logp))])
        self.reach = total[1:] - total[self.start[src]]  # share of a node's edges up to this one
        self.reach[self.start[1:][self.start[1:] > self.start[:-1]] - 1] = 2.0
        self.known: dict[int, tuple] = {}

    def word(self, number: int) -> tuple:
        """A word's first and last node, and for its nodes: first edges, targets, log-shares, shares."""
        if number not in self.known:
            a, b = int(self.begin[number]), int(self.final[number])
            starts = self.start[a:b + 1]
            edges = slice(starts[0], starts[-1])
            self.known[number] = (a, b, int(starts[0]), starts.tolist(), self.dst[edges].tolist(), self.logp[edges].tolist(), np.exp(self.logp[edges]).tolist())
        return self.known[number]


def _to_logs(behind: np.ndarray, sums: np.ndarray, final: np.ndarray, first: np.ndarray, sizes: np.ndarray, word: np.ndarray) -> None:
    """Logarithms of the scaled sums of all nodes."""
    left = np.zeros(len(behind))
    left[np.arange(len(word)) + word] = (first + sizes)[word] - np.arange(len(word))
    with np.errstate(divide="ignore"):
        np.subtract(np.log(sums), SCALE * left, out=behind)


def w_share(weight: np.ndarray, behind: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Log-share of each edge among the paths from its source; -inf where it leads nowhere."""
    ahead = behind[dst]
    return np.where(np.isfinite(ahead), weight + np.where(np.isfinite(ahead), ahead, 0.0) - np.where(np.isfinite(behind[src]), behind[src], 0.0), -np.inf)


def best_prefixes(lattices: Lattices, words: list[int], k: int, seed: int, depth: float = DEPTH) -> tuple[list[tuple], float]:
    """The k best (perturbed value, log-probability, words passed, edges), and the threshold below them.

    An entry of the queue is a set of paths: a prefix without some of its next edges.  Its value is that of its best
    path, whose edge falls by the shares; the other edges together are a new entry with a value drawn under this one.
    Entries are disjoint, so one that is below k + 1 others can be left out.
    """
    draw, log, exp, count = random.Random(seed).random, math.log, math.exp, len(words)
    root = -log(-log(draw() or 5e-324) or 5e-324)
    serial, done, best = 0, [], [root]
    queue = [(-root, 0, 0.0, 0, None, (), None)]
    while queue:
        value, _, logp, word, node, out, path = heapq.heappop(queue)
        value = -value
        if len(done) == k:
            return done, value
        if word < count:
            begin, end, base, starts, targets, logs, shares = lattices.word(words[word])
            node = begin if node is None else node
        while word < count:
            first, last = starts[node - begin] - base, starts[node - begin + 1] - base - 1
            if out:  # some edges are other entries' already
                left = [e for e in range(first, last + 1) if e not in out]
                u = draw() * sum([shares[e] for e in left])
                for pick in left:
                    u -= shares[pick]
                    if u < 0:
                        break
                rest = sum([shares[e] for e in left if e != pick])
            elif first == last:
                pick, rest = first, 0.0
            else:
                u, pick = draw(), first
                while u >= shares[pick] and pick < last:
                    u -= shares[pick]
                    pick += 1
                rest = 1.0 - shares[pick]
            if rest > 1e-15:
                mass = logp + log(rest)
                under = mass - log(exp(mass - value) - log(draw() or 5e-324))
                if len(best) <= k or under > best[0]:
                    serial += 1
                    heapq.heappush(queue, (-under, serial, logp, word, node, (*out, pick), path))
                    heapq.heappush(best, under)
                    if len(best) > k + 1:
                        heapq.heappop(best)
            out = ()
            logp, node, path = logp + logs[pick], targets[pick], (path, base + pick)
            if node == end:
                word += 1
                if word < count:
                    if logp < -depth:
                        break
                    begin, end, base, starts, targets, logs, shares = lattices.word(words[word])
                    node = begin
        edges = []
        while path is not None:
            path, edge = path
            edges.append(edge)
        done.append((value, logp, word, edges[::-1]))
    return done, -math.inf


def segment(column: pa.Array, keys: np.ndarray, words: Vocabulary, k: int, seed: int = SEED, depth: float = DEPTH) -> dict[str, list | np.ndarray]:
    """Up to ``k`` samples of each text: text, rank, perturbed, log_prob, log_inclusion, ids, bounds of the ids."""
    raw, offsets = utf8(column)
    if BLANK.encode() in raw.tobytes():
        return segment(pa.array([t and t.replace(BLANK, " ") for t in column.to_pylist()], pa.string()), keys, words, k, seed, depth)
    n = len(offsets) - 1
    filled = np.diff(offsets) > 0
    data = np.full(len(raw) + int(filled.sum()), 32, np.uint8)  # a blank before every text that is not empty
    moved = offsets + np.concatenate([[0], np.cumsum(filled)])
    data[np.arange(len(raw)) + np.repeat(np.cumsum(filled), np.diff(offsets))] = raw
    cut = data == 32
    cut[1:] &= data[:-1] != 32
    cut[moved[:-1][filled]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    _, at, index = np.unique(span_hash(prefix_sums(data), starts, ends), return_index=True, return_inverse=True)
    lattices = Lattices(data, starts[at], ends[at], words)
    before = np.searchsorted(starts, moved)
    seeds = mix(keys.astype(np.int64).view(np.uint64) * GOLDEN + np.uint64(seed))
    out = {c: [] for c in ("text", "rank", "perturbed", "log_prob", "log_inclusion")}
    heads, passed = [], []
    for i in range(n):
        own = index[before[i]:before[i + 1]]
        found, threshold = best_prefixes(lattices, own.tolist(), k, int(seeds[i]), depth)
        for rank, (value, logp, word, edges) in enumerate(found):
            out["text"].append(i)
            out["rank"].append(rank + 1)
            out["perturbed"].append(value)
            out["log_prob"].append(logp)
            out["log_inclusion"].append(threshold)
            heads.append(edges)
            passed.append(word)
    text, passed = np.array(out["text"], np.int64), np.array(passed, np.int64)
    left = np.diff(before)[text] - passed
    sample = np.repeat(np.arange(len(text)), left)
    number = passed[sample] + np.arange(len(sample)) - np.repeat(np.cumsum(left) - left, left)
    which = index[before[text[sample]] + number]
    node, final = lattices.begin[which], lattices.final[which]
    draws = mix(seeds[text[sample]] ^ mix(np.array(out["rank"], np.uint64)[sample] * GOLDEN + number.astype(np.uint64)))
    picks, who, live = [], [], np.arange(len(sample))
    while len(live):
        u = (mix(draws[live] ^ np.uint64(len(picks) << 40)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
        edge = lattices.start[node[live]]
        on = np.flatnonzero(u >= lattices.reach[edge])
        while len(on):
            edge[on] += 1
            on = on[u[on] >= lattices.reach[edge[on]]]
        picks.append(edge)
        who.append(live)
        node[live] = lattices.dst[edge]
        live = live[node[live] != final[live]]
    picks = np.concatenate(picks) if picks else np.empty(0, np.int64)
    steps = np.repeat(np.arange(len(who)), [len(w) for w in who]) if who else picks
    who = np.concatenate(who) if who else picks
    per_word = np.bincount(who, minlength=len(sample))
    head_size = np.array([len(h) for h in heads], np.int64)
    size = head_size + np.bincount(sample, per_word, len(text)).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(size)])
    tail_begin = np.cumsum(per_word) - per_word - np.concatenate([[0], np.cumsum(np.bincount(sample, per_word, len(text)))])[sample] + (bounds[:-1] + head_size)[sample]
    edges = np.empty(bounds[-1], np.int64)
    edges[tail_begin.astype(np.int64)[who] + steps] = picks
    edges[np.repeat(bounds[:-1], head_size) + np.arange(head_size.sum()) - np.repeat(np.cumsum(head_size) - head_size, head_size)] = np.array([e for h in heads for e in h], np.int64)
    log_prob = np.array(out["log_prob"]) + np.bincount(sample[who], lattices.logp[picks], len(text))
    with np.errstate(divide="ignore", over="ignore"):
        lead = log_prob - np.array(out["log_inclusion"], float)  # log(1 - exp(-exp(x))), which is x far below zero
        inclusion = np.where(lead < -30, lead, np.log(-np.expm1(-np.exp(lead))))
    return {"text": text, "rank": np.array(out["rank"], np.int32), "perturbed": np.array(out["perturbed"], float), "log_prob": log_prob,
            "log_inclusion": np.where(np.isneginf(np.array(out["log_inclusion"], float)), 0.0, inclusion), "ids": lattices.piece[edges].astype(np.int32), "bounds": bounds}


COLUMNS = "doc_id long, rank int, n_pieces long, ids_crc32 long, perturbed double, log_prob double, log_inclusion double"


def _encode(path: str, k: int, seed: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            for part in slices(batch, limit=SLICE_BYTES):
                keys = part.column("doc_id").fill_null(-1).to_numpy()
                got = segment(part.column("text"), keys, words, k, seed)
                bounds, ids = got["bounds"], np.ascontiguousarray(got["ids"].astype("<u4"))
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                arrays = [part.column("doc_id").take(pa.array(got["text"])), pa.array(got["rank"]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64()),
                          *(pa.array(got[c]) for c in ("perturbed", "log_prob", "log_inclusion"))]
                names = ["doc_id", "rank", "n_pieces", "ids_crc32", "perturbed", "log_prob", "log_inclusion"]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(got["ids"])))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)
    return run


def sample_segmentations(docs: DataFrame, path: str | None = None, k: int = SAMPLES, seed: int = SEED, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Up to ``k`` different segmentations of each text, best perturbed value first.

    A null or empty text has the empty segmentation alone, with inclusion score 0 (certain); a text with fewer segmentations gives
    all of them.  Equal ids with equal texts draw alike; a null id draws as -1; an empty table gives no rows.
    """
    import public_tokenizers

    path = path or public_tokenizers.path("piece_bpe_32k.model")
    rows = picked(docs, doc_id=docs[id_col].cast("long"), text=text_col)
    return rows.mapInArrow(_encode(path, k, seed, with_ids), COLUMNS + (", ids array<int>" if with_ids else ""))


def decoder(path: str | None = None):
    """A column function from ids to text: the pieces' bytes without the leading blank."""
    import public_tokenizers

    path = path or public_tokenizers.path("piece_bpe_32k.model")

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = vocabulary(path).pieces
        for column in batches:
            yield pa.array([None if ids is None else b"".join(map(pieces.__getitem__, ids)).removeprefix(b" ").decode(errors="replace") for ids in column.to_pylist()], pa.string())
    return decode


def op5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_segmentations(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
