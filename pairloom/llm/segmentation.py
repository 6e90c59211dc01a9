"""Distinct sampled segmentations of texts into the pieces of a SentencePiece model.

The pieces that fit a text form a lattice; a path is a segmentation. Paths are drawn
without replacement by the Gumbel top-k rule: every path's log-probability is perturbed
with a Gumbel variable and the k largest are the sample. The search is best first over
sets of paths. A set is a fixed prefix, a first step that avoids some pieces, and anything
after that; its largest perturbed value is drawn from its total mass, truncated at its
parent's. The set with the largest value is opened: a path is drawn from it, and what is
left falls apart into one set per step of that path.

Steps are conditionally independent given the lattice, so all texts of a block are drawn
at once with array operations. Uniform numbers are a hash of the row's key, the position
and the round: the same row gives the same sample in any batch, task or run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from pairloom.llm import scan

SPACE = "▁"
BLOCK_CHARS = 1 << 18
#: Ids that are spelled with one index array.
SPELLED = 1 << 16
FILTER_BITS = 20
#: Steps up to one more than this are told apart together, longer ones one by one.
SHORT = 3
#: A piece of rank r has weight 1 / (r + FLATTEN); the model's scores are minus the ranks.
FLATTEN = 10.0
BYTES_LEFT = -1
NO_PIECE, SEVERAL = 0, 1
#: A set of paths whose prefix is less likely than FAR_OFF has a value below TOO_LOW, as a drawn
#: Gumbel variable is 36.8 at most.
FAR_OFF, TOO_LOW, SLACK = -45.0, -8.0, 1e-3
#: The largest single-precision number below 1.
BELOW_ONE = np.nextafter(np.float32(1), np.float32(0))

SAMPLES = "array<struct<ids:array<int>,log_prob:double,gumbel:double,inclusion:double>>"
DECODED_SAMPLES = SAMPLES.replace("inclusion:double", "inclusion:double,decoded_sha256:string,round_trip:boolean")
_SPREAD, _STRIDE = 0xC2B2AE3D27D4EB4F, 0x9E3779B97F4A7C15
_BASE, _BACK = 0xA0761D6478BD642F, pow(0xA0761D6478BD642F, -1, 2**64)


def _prefix(codes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(scan.mix(codes.astype(np.uint64) + np.uint64(1)) * scan._power(_BASE, len(codes))[: len(codes)], out=out[1:])
    return out


def _slices(sums: np.ndarray, back: np.ndarray, at: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    return (sums[at + length] - sums[at]) * back[at] * np.uint64(_SPREAD)


class Vocabulary:
    """Pieces as sorted hashes with ids and log weights; small, so it can be broadcast."""

    def __init__(self, model_file: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        self.bytes = np.full(256, -1, np.int32)
        ids, pieces, scores = [], [], []
        for i in range(n):
            if model.is_byte(i):
                self.bytes[int(model.id_to_piece(i)[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                ids.append(i)
                pieces.append(model.id_to_piece(i))
                scores.append(model.get_score(i))
        self.unknown = model.unk_id()
        self.pieces = dict(zip(ids, pieces, strict=True))
        self.longest = max(map(len, pieces))
        hashes = np.array([self._hash(p) for p in pieces], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(ids, np.int32)[order]
        self.weights = -np.log(FLATTEN - np.array(scores))[order]
        self.byte_weight = float(self.weights.min()) - 1.0
        self.hash_of, self.weight_of = np.zeros(n, np.uint64), np.full(n + 1, -np.inf, np.float32)
        self.hash_of[self.ids], self.weight_of[self.ids] = self.hashes, self.weights
        # By the top bits of a hash: the piece, if there is one only, and, as the lowest bit, whether pieces go on.
        place = (self.hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
        alone = np.bincount(place, minlength=1 << FILTER_BITS)[place] == 1
        self.slot = np.full(1 << FILTER_BITS, NO_PIECE << 1, np.int32)
        self.slot[place] = np.where(alone, self.ids + SEVERAL + 1, SEVERAL) << 1
        longer = np.array([self._hash(p) for p in {p[:k] for p in pieces for k in range(1, len(p))}], np.uint64)
        self.slot[longer >> np.uint64(64 - FILTER_BITS)] |= 1

    @staticmethod
    def _hash(piece: str) -> int:
        codes = np.frombuffer(piece.encode("utf-32-le"), np.uint32)
        return int(_slices(_prefix(codes), scan._power(_BACK, len(codes)), np.zeros(1, np.int64), len(codes))[0])

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the hashes may be pieces, the ids of those pieces, -1 for what is none, and
        after which hashes longer pieces may go on."""
        slot = self.slot.take((h >> np.uint64(64 - FILTER_BITS)).view(np.int64))
        some = np.flatnonzero(slot > (NO_PIECE << 1 | 1))
        number, h = (slot.take(some) >> 1) - (SEVERAL + 1), h.take(some)
        unclear = np.flatnonzero(number < 0)
        number[unclear] = self.ids[np.minimum(np.searchsorted(self.hashes, h[unclear]), len(self.hashes) - 1)]
        number[self.hash_of.take(number) != h] = -1
        return some, number, np.flatnonzero((slot & 1).astype(bool))


class Lattice:
    """The lattices of the distinct words of a block: per node the pieces that start there,
    by length, and the probability of each given that a path reaches the node.

    Nodes are numbered by their distance from the end of the word, and words by falling
    length, so the nodes a step of a given length leads to are a slice.
    """

    def __init__(self, sums: np.ndarray, back: np.ndarray, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, vocabulary: Vocabulary):
        longest = int(lengths.max(initial=0))
        order = np.argsort((longest - lengths).astype(np.min_scalar_type(longest)), kind="stable")
        self.rank = np.empty(len(order), np.int32)
        self.rank[order] = np.arange(len(order))
        ends, lengths = (starts + lengths)[order], lengths[order]
        count = np.searchsorted(-lengths, -np.arange(longest + 1), side="right")
        self.level = np.concatenate([[0], np.cumsum(count)])
        n, level = int(self.level[-1]), self.level.tolist()
        distance = np.repeat(np.arange(longest + 1), count)
        self.place = ends[np.arange(n) - self.level[distance]] - distance

        live, at, fits = np.arange(level[1], n), self.place[level[1] :], []
        begin, scale = sums.take(at), back.take(at) * np.uint64(_SPREAD)
        for size in range(1, min(vocabulary.longest, longest) + 1):
            inside = int(np.searchsorted(live, level[size]))  # the others are too near the end
            live, at, begin, scale = live[inside:], at[inside:], begin[inside:], scale[inside:]
            some, number, on = vocabulary.find((sums.take(at + size) - begin) * scale)
            fits.append((live.take(some), number))
            live, at, begin, scale = live.take(on), at.take(on), begin.take(on), scale.take(on)
        width = max([1, *(size for size, (_, number) in enumerate(fits, 1) if (number >= 0).any())])
        self.ids = np.zeros((width, n), np.int32)
        weight = np.full((width, n), -np.inf, np.float32)
        for size, (where, number) in enumerate(fits[:width]):
            self.ids[size][where] = number
            weight[size][where] = vocabulary.weight_of.take(number)
        alone = level[1] + np.flatnonzero(np.isneginf(weight[0, level[1] :])) if longest else np.empty(0, np.int64)
        if len(alone):  # no piece for this character: its bytes, as one step
            c = codes[self.place[alone]]
            weight[0, alone] = vocabulary.byte_weight * (1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000))
            self.ids[0, alone] = BYTES_LEFT

        total = np.zeros(n)
        self.prob = np.zeros((width, n), np.float32)
        for d in range(1, longest + 1):
            a, b = level[d], level[d + 1]
            reach = min(width, d)
            after = total[level[d - 1] : level[d - 1] + b - a]  # finite: every character has a step
            value = weight[:reach, a:b].copy()
            for size in range(2, reach + 1):
                value[size - 1] += (total[level[d - size] : level[d - size] + b - a] - after).astype(np.float32)
            top = value.max(axis=0)
            np.exp(np.subtract(value, top, out=value), out=value)
            whole = value.sum(axis=0)
            total[a:b] = after + top + np.log(whole)
            np.divide(value, whole, out=self.prob[:reach, a:b])
        self.sums = self.prob.copy()
        for size in range(1, width):
            self.sums[size] += self.sums[size - 1]

    def others(self, size: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The probability of all steps from the nodes but the given ones."""
        out = np.zeros(len(node), np.float32)
        for longer in range(len(self.prob) - 1, 0, -1):
            out += np.where(size < longer, self.prob[longer].take(node), np.float32(0))
        return out + np.where(size > 0, self.sums[size - 1, node], np.float32(0))


def _uniform(place: np.ndarray, round_: int) -> np.ndarray:
    h = scan.mix(place + np.uint64((round_ * 0xD1342543DE82EF95) % 2**64))
    h >>= np.uint64(12)
    u = h.astype(np.float64)
    u += 0.5
    u *= 2.0**-52
    return u


class Block:
    """Some whole texts, as one stream of characters."""

    def __init__(self, texts: list[str], seeds: np.ndarray, vocabulary: Vocabulary):
        marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        self.n = len(texts)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in marked])]).astype(np.int64)
        codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
        self.size, self.codes = len(codes), codes
        space = codes == ord(SPACE)
        first = np.zeros(len(codes) + 1, bool)
        first[1:-1] = space[1:] & ~space[:-1]
        first[self.offsets] = True
        self.starts, self.inside = np.flatnonzero(first[:-1]), ~first
        self.ends = np.append(self.starts[1:], len(codes))[: len(self.starts)]
        lengths = self.ends - self.starts
        sums, back = _prefix(codes), scan._power(_BACK, len(codes))
        # Different words in the order of the text, so that what follows reads it in order.
        kind = pa.array(_slices(sums, back, self.starts, lengths)).dictionary_encode().indices.to_numpy()
        some = np.empty(int(kind.max(initial=-1)) + 1, np.int64)
        some[kind[::-1]] = np.arange(len(kind))[::-1]
        self.lattice = Lattice(sums, back, codes, self.starts[some], lengths[some], vocabulary)
        to_end = np.repeat(self.ends, lengths) - np.arange(self.size)
        self.node = self.lattice.level.astype(np.int32).take(to_end) + np.repeat(self.lattice.rank.take(kind), lengths)
        # Which uniform numbers belong to a position, and to a text as a whole.
        self.key = np.repeat(seeds - self.offsets[:-1].astype(np.uint64) * np.uint64(_STRIDE), np.diff(self.offsets))
        self.key += np.arange(self.size, dtype=np.uint64) * np.uint64(_STRIDE)
        self.text_key = seeds + np.uint64((_STRIDE << 40) % 2**64)

    def walk(self, at: np.ndarray, cut: np.ndarray, avoid: np.ndarray, round_: int, step: np.ndarray) -> None:
        """Draw steps from each position to the end of its word. ``avoid`` has for each text
        the steps that may not be taken at its cut."""
        lattice = self.lattice
        *partial, whole = lattice.sums
        for first in (True, False):
            while len(at):
                node = self.node.take(at).astype(np.int64)
                u = np.minimum(_uniform(self.key.take(at), 2 * round_).astype(np.float32), BELOW_ONE)
                drawn = u * whole.take(node)  # below the whole
                # How many partial sums lie at or below the drawn value; few steps are long.
                step_at, below = np.ones(len(at), np.uint8), np.zeros(len(at), bool)
                for sums in partial[:SHORT]:
                    below = sums.take(node) <= drawn
                    step_at += below
                longer = np.flatnonzero(below)
                for sums in partial[SHORT:]:
                    longer = longer[sums.take(node.take(longer)) <= drawn.take(longer)]
                    if not len(longer):
                        break
                    step_at[longer] += 1
                if first and avoid.any():
                    some = np.flatnonzero(avoid.any(axis=1))
                    i = np.searchsorted(at, cut[some])
                    sums = np.cumsum(np.where(avoid[some], 0, lattice.prob[:, node[i]].T), axis=1)
                    below = np.minimum(u[i] * sums[:, -1], np.nextafter(sums[:, -1], np.float32(0)))
                    step_at[i] = np.argmax(sums > below[:, None], axis=1) + 1
                step[at] = step_at
                at = at + step_at
                at = at[self.inside.take(at)]
                if first:
                    break

    def sample(self, k: int) -> list[tuple[np.ndarray, ...]]:
        """k rounds of (which texts have a path, log-probability, perturbed value, where steps
        begin, their places in the lattice's flat arrays, the first step per text), and one of
        which only the value of the next path holds."""
        width, n_nodes = self.lattice.prob.shape
        prob = self.lattice.prob.ravel()
        word_text = np.searchsorted(self.offsets, self.starts, side="right") - 1
        cut, avoid = self.offsets[:-1], np.zeros((self.n, width), bool)
        step = np.zeros(self.size, np.uint8)
        self.walk(self.starts, cut, avoid, 0, step)
        value = -np.log(-np.log(_uniform(self.text_key, 1)))
        alive = np.ones(self.n, bool)
        paths, left = [], []
        for round_ in range(k + 1):
            every = np.flatnonzero(step != 0)
            flat = (step.take(every).astype(np.int64) - 1) * n_nodes + self.node.take(every)
            log_p = np.log(prob.take(flat)).astype(np.float64)
            bounds = np.searchsorted(every, self.offsets)
            count = np.diff(bounds)
            owner = np.repeat(np.arange(self.n), count)
            total = np.bincount(owner, log_p, minlength=self.n)
            paths.append((alive, total, np.where(alive, value, -np.inf), every, flat, bounds))
            if round_ == k:
                break
            # What is left of the opened set: one set per step of the path from the cut on.
            before = np.cumsum(log_p) - log_p
            before -= np.repeat(np.append(before, 0)[bounds[:-1]], count)
            whole = np.zeros(self.n, bool)
            while True:
                near = np.flatnonzero((before > FAR_OFF) | whole.take(owner) if whole.any() else before > FAR_OFF)
                gumbel = -np.log(-np.log(_uniform(self.key.take(every.take(near)), 2 * round_ + 1)))
                likely = np.flatnonzero((gumbel + before.take(near) > TOO_LOW - SLACK) | whole.take(owner.take(near)))
                near, gumbel = near.take(likely), gumbel.take(likely)
                at, text = every.take(near), owner.take(near)
                firsts = np.flatnonzero(np.diff(text, prepend=-1))
                node = self.node.take(at)
                taken = step.take(at).astype(np.int64) - 1
                with np.errstate(divide="ignore"):
                    rest = np.log(self.lattice.others(taken, node).astype(np.float64))
                    i = np.flatnonzero((at == cut[text]) & avoid.any(axis=1)[text])
                    row = np.where(avoid[text[i]], np.float32(0), self.lattice.prob[:, node[i]].T)
                    row[np.arange(len(i)), taken[i]] = 0
                    rest[i] = np.log(np.ascontiguousarray(row).sum(axis=1))
                    mass = before.take(near) + rest
                    drawn = mass - np.logaddexp(mass - value[text], -gumbel)
                drawn[np.isneginf(mass) | (at < cut[text]) | ~alive[text]] = -np.inf
                # The sets that were left out count where so few others are likely that one could be opened.
                few = np.bincount(text, drawn > TOO_LOW, minlength=self.n) < k - round_
                few &= np.bincount(text, minlength=self.n) < count
                if not few.any():
                    break
                whole |= few
            left.append((at, text, firsts, drawn, step, cut, avoid, every, bounds))
            # Open the best set of each text over all rounds so far.
            best, which, where = np.full(self.n, -np.inf), np.zeros(self.n, int), np.zeros(self.n, np.int64)
            for r, (_, text_r, firsts_r, drawn_r, *_) in enumerate(left):
                if not len(firsts_r):
                    continue
                top = np.full(self.n, -np.inf)
                top[text_r[firsts_r]] = np.maximum.reduceat(drawn_r, firsts_r)
                hit = np.flatnonzero((drawn_r == top[text_r]) & (drawn_r > best[text_r]))
                mine, i = np.unique(text_r[hit], return_index=True)
                best[mine], which[mine], where[mine] = top[mine], r, hit[i]
            alive, value = best > -np.inf, best
            if round_ == k - 1:  # of what follows the sample only the value counts, as its threshold
                paths.append((alive, total, np.where(alive, value, -np.inf)))
                break
            new_avoid, new_cut = np.zeros_like(avoid), cut.copy()
            step = np.zeros(self.size, np.uint8)
            for r, (at_r, _, _, drawn_r, step_r, cut_r, avoid_r, every_r, bounds_r) in enumerate(left):
                mine = np.flatnonzero(alive & (which == r))
                drawn_r[where[mine]] = -np.inf
                q = at_r[where[mine]]
                new_cut[mine] = q
                new_avoid[mine] = avoid_r[mine] & (q == cut_r[mine])[:, None]
                new_avoid[mine, step_r[q].astype(np.int64) - 1] = True
                # The steps before the cut stay.
                begin = bounds_r[mine]
                stay = np.searchsorted(every_r, q) - begin
                same = every_r[np.arange(stay.sum()) + np.repeat(begin - np.cumsum(stay) + stay, stay)]
                step[same] = step_r[same]
            cut, avoid = new_cut, new_avoid
            q = cut[word_text]
            fresh = np.flatnonzero(alive[word_text] & (self.ends > q))
            self.walk(np.maximum(self.starts[fresh], q[fresh]), cut, avoid, round_ + 1, step)
        return paths

    def ids(self, at: np.ndarray, flat: np.ndarray, firsts: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        """All ids of one round's paths, and where each text's ids start."""
        ids = self.lattice.ids.ravel().take(flat)
        odd = np.flatnonzero(ids == BYTES_LEFT)
        if len(odd):
            letters, which = np.unique(self.codes[at[odd]], return_inverse=True)
            spelling = [vocabulary.bytes[list(chr(c).encode())] for c in letters.tolist()]
            spelled = [spelling[i] for i in which.tolist()]
            times = np.ones(len(ids), np.int64)
            times[odd] = [len(s) for s in spelled]
            starts = np.concatenate([[0], np.cumsum(times)])
            ids = np.repeat(ids, times)
            ids[ids == BYTES_LEFT] = np.concatenate(spelled)
            firsts = starts[firsts]
        return ids, firsts


def sample_block(texts: list[str | None], seeds: np.ndarray, k: int, vocabulary: Vocabulary) -> pa.Array:
    block = Block([t or "" for t in texts], seeds, vocabulary)
    paths = block.sample(k)
    drawn = [block.ids(*p[3:], vocabulary) for p in paths[:k]]
    threshold = paths[k][2]
    flat, sizes, numbers, counts = [], [], [], []
    for t, text in enumerate(texts):
        have = [r for r in range(k) if paths[r][0][t]] if text is not None else []
        for r in have:
            ids, firsts = drawn[r]
            part = ids[firsts[t] : firsts[t + 1]]
            flat.append(part)
            sizes.append(len(part))
            log_p = float(paths[r][1][t])
            inclusion = float(-np.expm1(-np.exp(min(700.0, log_p - threshold[t])))) if threshold[t] > -np.inf else 1.0
            numbers.append((log_p, float(paths[r][2][t]), inclusion))
        counts.append(len(have))
    ids = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)),
        pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32), pa.int32()),
    )
    columns = [pa.array([x[c] for x in numbers], pa.float64()) for c in range(3)]
    rows = pa.StructArray.from_arrays([ids, *columns], names=["ids", "log_prob", "gumbel", "inclusion"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), rows)


class Speller:
    """Bytes of lists of ids, gathered from one flat table of all pieces."""

    def __init__(self, vocabulary: Vocabulary):
        spelled = {i: p.replace(SPACE, " ").encode() for i, p in vocabulary.pieces.items()}
        spelled.update({int(i): bytes([b]) for b, i in enumerate(vocabulary.bytes) if i >= 0})
        n = max(spelled, default=-1) + 1
        pieces = [spelled.get(i, b"") for i in range(n)]
        self.known = np.array([i in spelled for i in range(n)], bool)
        self.size = np.array([len(p) for p in pieces], np.int32)
        self.start = (np.cumsum(self.size) - self.size).astype(np.int32)
        self.table = np.frombuffer(b"".join(pieces), np.uint8)

    def spell(self, ids: np.ndarray, ends: np.ndarray) -> tuple[bytes, list[int]]:
        """The bytes of all lists, one after the other, and where each ends."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size) or not self.known[ids].all()):
            raise KeyError("an id that is no piece")
        size = self.size[ids]
        upto = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        out = np.empty(int(upto[-1]), np.uint8)
        for lo in range(0, len(ids), SPELLED):  # in pieces that stay in cache
            hi = min(lo + SPELLED, len(ids))
            begin = (self.start[ids[lo:hi]] - (upto[lo:hi] - upto[lo])).astype(np.int32)
            place = np.repeat(begin, size[lo:hi])
            place += np.arange(len(place), dtype=np.int32)
            np.take(self.table, place, out=out[upto[lo] : upto[hi]], mode="clip")
        return out.tobytes(), upto[ends].tolist()


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all lists, and where each list ends; null is empty."""
    flat = column.flatten().to_numpy(zero_copy_only=False)  # null lists have no part in it
    return flat, np.cumsum(pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False))


def _spell(column: pa.Array, speller: Speller) -> list[str | None]:
    """The text of each list of ids, without the blank that was put before it; null for a null list."""
    texts, begin = [], 0
    whole, ends = speller.spell(*_lists(column))
    for known, end in zip(column.is_valid().to_pylist(), ends, strict=True):
        text = whole[begin:end].decode(errors="replace") if known else None
        texts.append(text[1:] if text else text)
        begin = end
    return texts


def _with_decoded(samples: pa.ListArray, texts: list[str | None], speller: Speller) -> pa.Array:
    """The samples of a block, each with the SHA-256 of what its ids decode to and whether that is the text."""
    rows = samples.values
    whole, ends = speller.spell(*_lists(rows.field("ids")))
    owner = np.repeat(np.arange(len(texts)), np.diff(samples.offsets.to_numpy())).tolist()
    sha, same, begin, now, own, own_sha = [], [], 0, None, b"", ""
    for t, end in zip(owner, ends, strict=True):
        if t != now:  # the digest of a text is made once, for all samples that decode to it
            now, own = t, texts[t].encode()
            own_sha = hashlib.sha256(own).hexdigest()
        text = whole[begin:end]
        # Without the blank that was put before it, or what a model without one spells instead.
        text, begin = text[1:] if text[:1] == b" " else text.decode(errors="replace")[1:].encode(), end
        same.append(text == own)
        sha.append(own_sha if same[-1] else hashlib.sha256(text.decode(errors="replace").encode()).hexdigest())
    rows = pa.StructArray.from_arrays([*rows.flatten(), pa.array(sha, pa.string()), pa.array(same, pa.bool_())], names=[*(f.name for f in rows.type), "decoded_sha256", "round_trip"])
    return pa.ListArray.from_arrays(samples.offsets, rows)


def sample_segmentations(
    docs: DataFrame, model_file: str, k: int = 3, key_col: str = "doc_id", text_col: str = "text", seed: int = 0, decoded: bool = False
) -> DataFrame:
    """All columns of ``docs`` in a struct ``row`` (so any names may occur) and ``samples``:
    up to ``k`` distinct segmentations in the order drawn, each with its piece ids, its
    log-probability, its perturbed log-probability and the probability that it lies above
    the sample's threshold, the inclusion score.

    A text with fewer than ``k`` segmentations gives all of them, with inclusion 1 for
    each. Null text gives none; empty text gives one without pieces. Rows with the same key
    and text give the same sample; a null key is a key. The vocabulary is sent to the
    executors, which need not have the model file.

    With ``decoded`` every sample's ids are decoded where they are drawn, block by block, and
    the sample also has ``decoded_sha256`` and ``round_trip``, whether that is the text. It
    is not for a text that holds the mark U+2581 itself, which stands for a blank.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(model_file))

    def draw(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        speller = Speller(vocabulary.value) if decoded else None
        for texts, keys in columns:
            seeds = keys.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
            _, offsets = scan.utf8(texts)
            for i, j in scan.blocks(offsets, BLOCK_CHARS):
                part = texts.slice(i, j - i).to_pylist()
                samples = sample_block(part, scan.mix(seeds[i:j].copy()), k, vocabulary.value)
                yield _with_decoded(samples, part, speller) if decoded else samples

    row = F.col("row")
    draw_udf = F.arrow_udf(draw, DECODED_SAMPLES if decoded else SAMPLES).asNondeterministic()
    key = F.xxhash64(F.lit(seed), row.getField(key_col))
    return docs.select(F.struct("*").alias("row")).withColumn("samples", draw_udf(row.getField(text_col), key))


def decode(docs: DataFrame, model_file: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Text of piece ids. Null ids give null."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(model_file))

    def spell(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        speller = Speller(vocabulary.value)
        for column in columns:
            yield pa.array(_spell(column, speller), pa.string())

    return docs.withColumn(out, F.arrow_udf(spell, "string").asNondeterministic()(F.col(ids_col)))
