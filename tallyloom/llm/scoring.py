"""Scores of texts by a causal self-attention model over subword ids (10).

Words are told apart by blocks of texts, once, and each block's distinct words go in buckets of words of like hashes:
a row is a block's share of a bucket. Each word's training count and subword ids come back to the blocks that hold it. The model
reads subword ids; it predicts classes of them (the most frequent ids are classes by themselves, the others share
some by their neighbours) and then the id within its class, both from the context. Ids that no
training text holds are one symbol a class, and share its probability equally. A text is a start, its ids, and an end;
its score is the log10 probability of the ids and the end.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, tokens
from .common import id_text, per_block, written

CLASSES, SINGLES, DIM, HIDDEN = 128, 95, 16, 32
#: Inputs of a window, and how far the next one begins: a token that isn't in a text's first window has at least CONTEXT - STRIDE ids before it.
CONTEXT, STRIDE = 64, 32
#: Every training document trains the model, all of its windows; trainers work on their parts of a round side by side. A trainer has about PART ids, so larger corpora have more trainers.
TRAINERS, ROUNDS, BATCH, PART = 6, 4, 48, 8 << 20
#: Texts are kept as ids in pieces of whole texts, of about this many ids.
PIECE = 1 << 15
#: A trainer passes over its part again until it has made so many steps in a round, but no more than PASSES times.
STEPS, PASSES = 150, 8
FOLDS, HELD = 7, 2
LOG10 = np.log(10.0)


# --- the model -------------------------------------------------------------------------

SHAPES = {"E": (CLASSES, DIM), "P": (CONTEXT, DIM), "QKV": (DIM, 3 * DIM), "O": (DIM, DIM), "W1": (DIM, HIDDEN), "b1": (HIDDEN,), "W2": (HIDDEN, DIM), "U": (DIM, CLASSES), "b": (CLASSES,)}
SCALE = np.float32(DIM**-0.5)
TOP = np.float32(80)
#: The largest exponents of attention, so that sums of them times values stay finite: none to later positions.
CAP = np.where(np.triu(np.ones((CONTEXT, CONTEXT), bool), 1), np.float32(-1e9), np.float32(64))
#: Queries that look back are taken so many at a time, against no more keys than they may see.
SPAN = 32


def bounded(h: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> bool:
    """Whether no row of h @ weights + bias can come near TOP in size, so that its exponentials need no care."""
    long = lambda x, axis: math.sqrt(float(np.einsum("ij,ij->j" if axis else "ij,ij->i", x, x).max(initial=0)))
    return long(h, 0) * long(weights, 1) + float(np.abs(bias).max(initial=0)) < 0.9 * float(TOP)


def with_ones(h: np.ndarray) -> np.ndarray:
    """h and a column of ones, for products that add a bias or a sum as they go."""
    out = np.empty((len(h), h.shape[1] + 1), h.dtype)
    out[:, :-1] = h
    out[:, -1] = 1
    return out


def in_spans(a: np.ndarray) -> np.ndarray:
    """The rows of a in spans of CONTEXT, if that comes out even, else in one: BLAS is quicker at short narrow products than at long ones."""
    return a.reshape(-1, CONTEXT, a.shape[1]) if len(a) and len(a) % CONTEXT == 0 else a[None]


def gram(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b."""
    return (in_spans(a).transpose(0, 2, 1) @ in_spans(b)).sum(axis=0)


def order_of(y: np.ndarray) -> np.ndarray:
    """The stable order of numbers from 0 on; that of narrow numbers takes no comparisons."""
    return np.argsort(y.astype(np.uint16) if not len(y) or y.max() < 1 << 16 else y, kind="stable")


class Model(dict):
    """Weights by name. One layer: attention to earlier positions, then two dense ones, both added to what came in."""

    @staticmethod
    def fresh(share: np.ndarray, seed: int = 1) -> "Model":
        """Untrained, it predicts each class by its share."""
        rng = np.random.default_rng(seed)
        model = Model({k: (rng.normal(size=s) * 0.15).astype(np.float32) for k, s in SHAPES.items()})
        model["b1"][:] = 0
        for k in ("U", "P", "O", "W2"):
            model[k] *= 0.1
        model["b"] = np.log(np.maximum(share, 1e-9)).astype(np.float32)
        return model

    def with_symbols(self, share: np.ndarray) -> "Model":
        """Adds what tells the symbols of shared classes apart: to the class's input D, and V and c for the choice within the class. They start from the log shares."""
        self["D"], self["V"] = (np.zeros((len(share), DIM), np.float32) for _ in range(2))
        self["c"] = share.astype(np.float32)
        return self

    def inputs(self, cuts: np.ndarray | None) -> np.ndarray:
        """The vector of each class; with cuts, of each symbol: the single classes, then those of shared classes in order."""
        if cuts is None:
            return self["E"]
        out = self["E"].take(kinds(cuts), axis=0)
        out[SINGLES + 1 :] += self["D"]
        return out

    def start_from_pairs(self, pairs: np.ndarray, share: np.ndarray, doubt: float = 20.0) -> "Model":
        """Sets the way from an input straight to the prediction to the best approximation of rank DIM of log p(next | class) - log p(next)."""
        p = np.maximum(share, 1e-9)
        given = (pairs + doubt * p) / (pairs.sum(axis=1, keepdims=True) + doubt)
        left, right = np.sqrt(p)[:, None], np.sqrt(p)[None, :]
        u, size, v = np.linalg.svd(left * (np.log(given) - np.log(p)) * right)
        root = np.sqrt(size[:DIM])
        self["E"] = (u[:, :DIM] * root / left).astype(np.float32)
        self["U"] = (root[:, None] * v[:DIM] / right).astype(np.float32)
        return self

    @staticmethod
    def unpack(raw: bytes) -> "Model":
        flat, out, at = np.frombuffer(raw, np.float32), Model(), 0
        for k, s in SHAPES.items():
            n = int(np.prod(s))
            out[k] = flat[at : at + n].reshape(s).copy()
            at += n
        rest = (len(flat) - at) // (2 * DIM + 1)
        if rest:
            out["D"], out["V"] = (flat[at + k * rest * DIM : at + (k + 1) * rest * DIM].reshape(rest, DIM).copy() for k in range(2))
            out["c"] = flat[at + 2 * rest * DIM :].copy()
        return out

    def pack(self) -> bytes:
        return b"".join(np.ascontiguousarray(self[k], np.float32).tobytes() for k in [*SHAPES, *("D", "V", "c")] if k in self)

    def body(self, x: np.ndarray, keep: dict | None = None, table: np.ndarray | None = None, start: int = 0) -> np.ndarray:
        """What the predictions are made from, for each place of the windows from start on. table: the inputs' vectors."""
        n, own = x.shape[0], CONTEXT - start
        h0 = (self["E"] if table is None else table).take(x, axis=0)
        h0 += self["P"]
        weights = self["QKV"].copy()
        weights[:, :DIM] *= SCALE
        # keys, values and a one beside each value: what a row of exponentials gives has their sum at its end
        if start:
            z = np.empty((n, CONTEXT, 2 * DIM + 1), h0.dtype)
            np.matmul(h0.reshape(-1, DIM), weights[:, DIM:], out=z.reshape(-1, 2 * DIM + 1)[:, :-1])
            h0 = np.ascontiguousarray(h0[:, start:])
            q = (h0.reshape(-1, DIM) @ weights[:, :DIM]).reshape(n, own, DIM)
        else:
            z = np.empty((n, CONTEXT, 3 * DIM + 1), h0.dtype)
            np.matmul(h0.reshape(-1, DIM), weights, out=z.reshape(-1, 3 * DIM + 1)[:, :-1])
            q = z[:, :, :DIM]
        z[:, :, -1] = 1
        k, v, o, parts = z[:, :, -2 * DIM - 1 : -DIM - 1], z[:, :, -DIM - 1 :], np.empty((n, own, DIM + 1), h0.dtype), []
        for first in range(start, CONTEXT, SPAN):
            last = min(first + SPAN, CONTEXT)
            a = q[:, first - start : last - start] @ k[:, :last].transpose(0, 2, 1)
            np.minimum(a, CAP[first:last, :last], out=a)
            np.exp(a, out=a)
            np.matmul(a, v[:, :last], out=o[:, first - start : last - start])
            if keep is not None:
                parts.append((first, last, a))
        o = o.reshape(-1, DIM + 1)
        share = 1 / (o[:, DIM:] + np.float32(1e-30))
        o = o[:, :DIM] * share
        h1 = o @ self["O"]
        h1 += h0.reshape(-1, DIM)
        m = h1 @ self["W1"]
        m += self["b1"]
        np.maximum(m, 0, out=m)
        h2 = m @ self["W2"]
        h2 += h1
        if keep is not None:
            keep |= {"h0": h0, "q": q, "k": k, "v": v, "parts": parts, "o": o, "share": share, "h1": h1, "m": m, "weights": weights}
        return h2

    def within(self, h: np.ndarray, y: np.ndarray, cuts: np.ndarray, back: dict | None = None, scale: float = 1.0) -> np.ndarray:
        """Natural log of the probability of symbol y within its class at each row; 0 for a single class. back: takes the gradients of V and c and adds that of h."""
        out = np.zeros(len(y), h.dtype)
        places = np.flatnonzero(y > SINGLES)
        if not len(places):
            return out
        row = y[places] - (SINGLES + 1)
        order = order_of(row)
        places, row = places[order], row[order]
        own, both, summed = with_ones(h.take(places, axis=0)), np.concatenate([self["V"], self["c"][:, None]], axis=1), with_ones(self["V"])
        turned = np.ascontiguousarray(both.T)
        edges = np.searchsorted(row, cuts).tolist()
        spans = [(a, b, first, last) for a, b, first, last in zip(edges, edges[1:], cuts[:-1].tolist(), cuts[1:].tolist()) if a < b]
        own_z, less = np.einsum("ij,ij->i", own, both.take(row, axis=0)), np.zeros(len(row), h.dtype)
        given, g = np.empty_like(own), None if back is None else np.zeros_like(both)
        for careful in (False, True):
            # rows whose sums leave the range of the numbers are rare: all is done again, less the largest of each row
            with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                for a, b, first, last in spans:
                    z = own[a:b] @ turned[:, first:last]
                    if careful:
                        less[a:b] = z.max(axis=1)
                        z -= less[a:b, None]
                    np.exp(z, out=z)
                    if g is None:
                        np.matmul(z, summed[first:last, DIM], out=given[a:b, DIM])
                    else:
                        np.matmul(z, summed[first:last], out=given[a:b])
                        np.matmul(z.T, own[a:b] / given[a:b, DIM:], out=g[first:last])
            total = given[:, DIM]
            if total.min() > 1e-20 and total.max() < 1e30:
                break
        out[places] = own_z - less - np.log(total)
        if g is not None:
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            g[row[first]] -= np.add.reduceat(own, first, axis=0)
            g *= scale
            back["V"][:], back["c"][:] = g[:, :DIM], g[:, DIM]
            back["h"][places] += (given[:, :DIM] / total[:, None] - self["V"].take(row, axis=0)) * h.dtype.type(scale)
        return out

    def class_exponentials(self, h: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The exponentials of the rows' logits, their sums, where those of y are in the flat array, and the logits of y."""
        z = (in_spans(with_ones(h)) @ np.concatenate([self["U"], self["b"][None, :]])).reshape(-1, CLASSES)
        if not bounded(h, self["U"], self["b"]):
            np.minimum(z, TOP, out=z)
        at = np.arange(0, z.size, CLASSES) + y
        own = z.reshape(-1).take(at)
        np.exp(z, out=z)
        return z, z @ np.ones(CLASSES, z.dtype) + np.float32(1e-30), at, own

    def log_p(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log of the probability of class y at each row."""
        _, size, _, own = self.class_exponentials(h, y)
        return own - np.log(size)

    def gradient(self, x: np.ndarray, y: np.ndarray, real: np.ndarray, cuts: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over the real targets, and its gradient. x and y are classes; with cuts, symbols."""
        s: dict = {}
        table = self.inputs(cuts)
        h2 = self.body(x, s, table)
        n, flat = max(1, int(real.sum())), real.ravel()
        target = classes_of(y.ravel(), cuts)
        z, size, own, own_z = self.class_exponentials(h2, target)
        loss = -float(np.maximum(own_z - np.log(size), np.log(1e-30))[flat].sum()) / n
        weight = (flat / (size * n)).astype(z.dtype)
        z.reshape(-1)[own] -= size
        g = {"U": gram(h2 * weight[:, None], z), "b": weight @ z}
        dh2 = z @ self["U"].T
        dh2 *= weight[:, None]
        if cuts is not None:
            at = np.flatnonzero(flat & (target > SINGLES))
            g |= {"V": np.zeros_like(self["V"]), "c": np.zeros_like(self["c"])}
            more = g | {"h": np.zeros((len(at), DIM), dh2.dtype)}
            loss -= float(self.within(h2.take(at, axis=0), y.ravel()[at], cuts, more, 1 / n).sum()) / n
            dh2[at] += more["h"]
        g["W2"] = gram(s["m"], dh2)
        dm = dh2 @ self["W2"].T
        dm *= s["m"] > 0
        g["W1"], g["b1"] = gram(s["h1"], dm), np.ones(len(dm), dm.dtype) @ dm
        dh1 = dm @ self["W1"].T
        dh1 += dh2
        g["O"] = s["o"].T @ dh1
        # under a row of exponentials, da is do times the values less do times what the row gave, and all over their sum
        do = np.empty((len(dh1), DIM + 1), dh1.dtype)
        np.multiply(dh1 @ self["O"].T, s["share"], out=do[:, :DIM])
        do[:, DIM] = -np.einsum("ij,ij->i", do[:, :DIM], s["o"])
        shape = (*x.shape, DIM)
        do, q, k, v, dz = do.reshape(*x.shape, DIM + 1), s["q"], s["k"], s["v"], np.empty((*x.shape, 3 * DIM), dh1.dtype)
        for first, last, a in reversed(s["parts"]):
            ds = do[:, first:last] @ v[:, :last].transpose(0, 2, 1)
            ds *= a
            np.matmul(ds, k[:, :last], out=dz[:, first:last, :DIM])
            if last == CONTEXT:
                np.matmul(ds.transpose(0, 2, 1), q[:, first:last], out=dz[:, :, DIM : 2 * DIM])
                np.matmul(a.transpose(0, 2, 1), do[:, first:last, :DIM], out=dz[:, :, 2 * DIM :])
            else:
                dz[:, :last, DIM : 2 * DIM] += ds.transpose(0, 2, 1) @ q[:, first:last]
                dz[:, :last, 2 * DIM :] += a.transpose(0, 2, 1) @ do[:, first:last, :DIM]
        dz = dz.reshape(-1, 3 * DIM)
        g["QKV"] = gram(s["h0"].reshape(-1, DIM), dz)
        g["QKV"][:, :DIM] *= SCALE
        dh0 = dz @ s["weights"].T
        dh0 += dh1
        g["P"] = dh0.reshape(shape).sum(axis=0)
        order = order_of(x.ravel())
        used = x.ravel()[order]
        first = np.flatnonzero(np.append(True, used[1:] != used[:-1]))
        given = np.zeros_like(table)
        given[used[first]] = np.add.reduceat(dh0.take(order, axis=0), first, axis=0)
        g["E"] = given
        if cuts is not None:
            g["D"] = given[SINGLES + 1 :]
            g["E"] = np.concatenate([given[: SINGLES + 1], np.add.reduceat(g["D"], cuts[:-1], axis=0)])
        return loss, g


@lru_cache(maxsize=4)
def kinds_of(raw: bytes) -> np.ndarray:
    out = np.append(np.arange(SINGLES + 1), np.repeat(np.arange(SINGLES + 1, CLASSES), np.diff(np.frombuffer(raw, np.int64))))
    out.flags.writeable = False
    return out


def kinds(cuts: np.ndarray) -> np.ndarray:
    """The class of each symbol; cuts: where those of each shared class, none of which is empty, begin and end."""
    return kinds_of(cuts.astype(np.int64).tobytes())


def classes_of(y: np.ndarray, cuts: np.ndarray | None) -> np.ndarray:
    """The classes of symbols."""
    return y if cuts is None else kinds(cuts).take(y)


def windows(seq: np.ndarray, ends: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets, which targets a window scores, and its text. Text i is seq[ends[i]:ends[i+1]],
    its start and end included; every other place of it is the target of exactly one window."""
    size = np.diff(ends)
    count = 1 + np.maximum(0, -(-(size - 1 - CONTEXT) // stride))
    text = np.repeat(np.arange(len(size)), count)
    turn = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    at = (ends[:-1][text] + turn * stride)[:, None] + np.arange(CONTEXT + 1)
    last = ends[1:][text, None] - 1
    real = at[:, 1:] <= last
    at = np.minimum(at, last)
    real[turn > 0, : CONTEXT - stride] = False
    return seq[at[:, :-1]], seq[at[:, 1:]], real, text


def sequence_log_p(model: Model, seq: np.ndarray, ends: np.ndarray, chunk: int = 128, cuts: np.ndarray | None = None) -> np.ndarray:
    """Natural log probability of each text's classes (with cuts: symbols) after its start."""
    out = np.zeros(len(ends) - 1)
    table = model.inputs(cuts)
    # windows of bounded numbers of texts, so that a long block's index arrays stay small
    first = 0
    while first < len(out):
        stop = max(first + 1, int(np.searchsorted(ends, ends[first] + (1 << 19), "right")) - 1)
        x, y, real, text = windows(seq, ends[first : stop + 1])
        later = np.append(False, text[1:] == text[:-1])
        each: list[tuple] = []
        # of a later window, the first places are only looked back at
        for which, start in ((np.flatnonzero(~later), 0), (np.flatnonzero(later), CONTEXT - STRIDE)):
            for k in range(0, len(which), chunk):
                at = which[k : k + chunk]
                r, target = real[at, start:].ravel(), y[at, start:].ravel()
                h = model.body(x[at], None, table, start)
                lp, own = model.log_p(h, classes_of(target, cuts)), text[at].repeat(CONTEXT - start)
                shared = np.flatnonzero(r & (target > SINGLES)) if cuts is not None else np.zeros(0, np.int64)
                out[first:stop] += np.bincount(own, np.where(r, lp, 0), minlength=stop - first)
                each.append((h.take(shared, axis=0), target[shared], own[shared]))
        # the classes' own ids, for the windows of all chunks together
        h, target, own = (np.concatenate(c) for c in zip(*each))
        if len(target):
            out[first:stop] += np.bincount(own, model.within(h, target, cuts), minlength=stop - first)
        first = stop
    return out


def train_local(model: Model, seq: np.ndarray, ends: np.ndarray, rate: float, seed: int, moments: dict | None = None, cuts: np.ndarray | None = None) -> Model:
    """One pass over the windows in shuffled batches (Adam)."""
    x, y, real, _ = windows(seq, ends, CONTEXT)
    order = np.random.default_rng(seed).permutation(len(x))
    m = moments if moments is not None else {}
    # all weights lie in one vector, so that a step is a few passes over it
    names, ends = list(model), np.cumsum([w.size for w in model.values()])
    flat = np.concatenate([w.ravel() for w in model.values()])
    for name, w, part in zip(names, list(model.values()), np.split(flat, ends[:-1])):
        model[name] = part.reshape(w.shape)
    if "sums" not in m:
        m["sums"] = np.zeros_like(flat), np.zeros_like(flat)
    (a, b), d, t = m["sums"], np.empty_like(flat), np.empty_like(flat)
    for k in range(0, len(order), BATCH):
        at = order[k : k + BATCH]
        _, g = model.gradient(x[at], y[at], real[at], cuts)
        np.concatenate([g[name].ravel() for name in names], out=d)
        m["step"] = m.get("step", 0) + 1
        # a and b are the usual moments times 10 and 100
        a *= 0.9
        a += d
        d *= d
        b *= 0.99
        b += d
        np.sqrt(b, out=t)
        root = math.sqrt(1 - 0.99 ** m["step"])
        t += 1e-7 * root
        np.divide(a, t, out=t)
        t *= rate * root / (1 - 0.9 ** m["step"])
        flat -= t
    return model


# --- classes of ids --------------------------------------------------------------------


class Ids:
    """Of each subword id its class and the log of its share of the class, from counts of ids in training texts. Class 0 is start and end.

    neighbours: for each id, counts of the single classes (and one for all others) before and after it in
    the sampled texts; ids that aren't classes by themselves are grouped by these, words' beginnings apart.
    """

    def __init__(self, counts: np.ndarray, texts: int, begins: np.ndarray, neighbours: np.ndarray | None = None):
        self.singles = np.argsort(-counts, kind="stable")[:SINGLES]
        self.classes = np.full(len(counts), -1, np.int32)
        self.classes[self.singles] = 1 + np.arange(len(self.singles))
        groups = (CLASSES - 1 - SINGLES) // 2
        for side, which in enumerate((begins, ~begins)):
            rest = np.flatnonzero((self.classes < 0) & which)
            if neighbours is None or not len(rest):
                label = np.zeros(len(rest), np.int32)
            else:
                label = alike(neighbours[rest], counts[rest], groups)
            self.classes[rest] = 1 + SINGLES + side * groups + label
        total = np.bincount(self.classes, counts + 1.0, minlength=CLASSES)
        self.log_share = np.log((counts + 1.0) / total[self.classes])
        total[0] = texts + 1.0
        self.share = total / total.sum()
        # symbols: single classes as they are; then the ids of each shared class that occur, and one for those that don't
        seen = np.flatnonzero((self.classes > SINGLES) & (counts > 0))
        seen = seen[np.argsort(self.classes[seen], kind="stable")]
        of = np.append(self.classes[seen], np.arange(SINGLES + 1, CLASSES))
        order = np.argsort(of, kind="stable")
        place = np.empty(len(of), np.int64)
        place[order] = np.arange(len(of))
        self.cuts = np.searchsorted(of[order], np.arange(SINGLES + 1, CLASSES + 1))
        unseen = (self.classes > SINGLES) & (counts == 0)
        many = np.bincount(self.classes[unseen], minlength=CLASSES)
        self.symbols = self.classes.astype(np.int64)
        self.symbols[seen] = SINGLES + 1 + place[: len(seen)]
        self.symbols[unseen] = SINGLES + 1 + place[len(seen) :][self.classes[unseen] - SINGLES - 1]
        self.log_part = np.where(unseen, -np.log(np.maximum(many[self.classes], 1)), 0.0)
        weight = np.append(counts[seen] + 1.0, np.maximum(many[SINGLES + 1 :], 1e-9))
        self.symbol_share = np.log(weight / np.maximum(total[of], 1e-9))[order]

    def single(self) -> np.ndarray:
        """Of each id its class if that is its own, else one number for all others."""
        return np.where(self.classes <= SINGLES, self.classes, SINGLES + 1)


def alike(table: np.ndarray, counts: np.ndarray, k: int, turns: int = 12) -> np.ndarray:
    """k groups of rows of like shares (weighted k-means on square roots, from a fixed start)."""
    x = np.sqrt((table + 0.01) / (table + 0.01).sum(axis=1, keepdims=True))
    weight = counts + 1e-3
    centres = [x[np.argmax(weight)]]
    far = np.full(len(x), np.inf)
    for _ in range(min(k, len(x)) - 1):
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(axis=1))
        centres.append(x[np.argmax(far * weight)])
    centres = np.array(centres)
    for _ in range(turns):
        label = np.argmin((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T, axis=1)
        for c in range(len(centres)):
            if (label == c).any():
                centres[c] = np.average(x[label == c], axis=0, weights=weight[label == c])
    return label.astype(np.int32)


def sequences(ids: np.ndarray, ends: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts' classes with a start and an end."""
    out_ends = ends + 2 * np.arange(len(ends))
    out = np.zeros(int(out_ends[-1]), np.int32)
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    out[np.arange(len(ids)) + 2 * text + 1] = classes[ids]
    return out, out_ends


# --- over the corpus --------------------------------------------------------------------


def held_out(ids: pa.Array) -> np.ndarray:
    """Whether crc32 of the id as text is 2 modulo 7; a null id is trained on."""
    return np.fromiter((i is not None and zlib.crc32(str(i).encode()) % FOLDS == HELD for i in ids.to_pylist()), bool, len(ids))


def _words(texts: blocks.Texts) -> blocks.Words:
    return blocks.words(texts, lowered=True)


#: Of a word's bytes so many choose its bucket, each with a factor of its own.
HASHED = 64
FACTORS = np.random.default_rng(42).integers(0, 1 << 63, HASHED, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def buckets_of(data: np.ndarray, ends: np.ndarray, many: int) -> np.ndarray:
    """The bucket of each word, by its bytes alone. Word i is data[ends[i]:ends[i+1]], and isn't empty."""
    if len(ends) < 2:
        return np.zeros(0, np.int64)
    size = np.minimum(np.diff(ends), HASHED)
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    h = np.add.reduceat((data[place + np.repeat(ends[:-1], size)] + np.uint64(1)) * FACTORS[place], first)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(32)) % np.uint64(many)).astype(np.int64)


def in_buckets(many: int):
    """For mapInArrow over rows (block, words, word_ends, n): for each bucket of a block, its words and their sizes, slots and counts."""

    def binary(values: np.ndarray, at: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * values.itemsize).astype(np.int32)), pa.py_buffer(values)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw, ends, n in zip(*(c.to_pylist() for c in batch.columns)):
                data, ends, n = np.frombuffer(raw, np.uint8), np.frombuffer(ends, "<i8"), np.frombuffer(n, "<i8")
                if not len(n):
                    continue
                bucket = buckets_of(data, ends, many)
                slots = order_of(bucket)
                at, data = blocks.parts(pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(data)]).take(pa.array(slots)))
                bucket = bucket[slots]
                edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
                columns = [pa.array(bucket[edges[:-1]]), pa.array(np.full(len(edges) - 1, block)), binary(data, at[edges])]
                columns += [binary(x, edges) for x in (np.diff(at).astype("<i4"), slots.astype("<i4"), n[slots])]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "block", "words", "sizes", "slots", "n"])

    return run


def encode_counted(path: str, pattern: str):
    """For mapInArrow over rows (bucket, block, words, sizes, slots, n) in order of buckets: answers by block with ids and
    counts, and rows without a block: how often each id occurs in training texts, training tokens, and distinct ones."""

    def answer(held: list[tuple]) -> pa.RecordBatch:
        encoding, table = tokens.rank_encoding(path, pattern)
        slot, n = (np.frombuffer(b"".join(r[k] for r in held), kind) for k, kind in ((3, "<i4"), (4, "<i8")))
        block = np.repeat([r[0] for r in held], [len(r[3]) // 4 for r in held])
        at = np.append(0, np.cumsum(np.frombuffer(b"".join(r[2] for r in held), "<i4"), dtype=np.int64))
        coded = pa.Array.from_buffers(pa.large_binary(), len(slot), [None, pa.py_buffer(at), pa.py_buffer(b"".join(r[1] for r in held))]).dictionary_encode()
        ids = [encoding.encode_ordinary(" " + w.decode("utf-8", "surrogatepass")) for w in coded.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum()))
        offsets = np.append(0, np.cumsum(sizes)).astype(np.int64)
        code = coded.indices.to_numpy(zero_copy_only=False)
        c = np.bincount(code, n, minlength=len(ids)).astype(np.int64)
        used_n = np.bincount(flat, np.repeat(c, sizes), minlength=len(table)).astype(np.int64)
        used = np.flatnonzero(used_n)
        order = np.argsort(block, kind="stable")
        block, slot, code = block[order], slot[order], code[order]
        values, ends = blocks.ragged(flat, offsets, code)
        cuts = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block))
        spans, each = list(zip(cuts[:-1], cuts[1:])), c[code]
        long = pa.list_(pa.int64())
        columns = [
            pa.array([*block[cuts[:-1]].tolist(), None], pa.int64()),
            pa.array([*(slot[a:b].tobytes() for a, b in spans), None], pa.binary()),
            pa.array([*(np.diff(ends[a : b + 1]).astype("<i4").tobytes() for a, b in spans), None], pa.binary()),
            pa.array([*(values[ends[a] : ends[b]].astype("<u4").tobytes() for a, b in spans), None], pa.binary()),
            pa.array([*(each[a:b].astype("<i8").tobytes() for a, b in spans), None], pa.binary()),
            pa.array([*(None for _ in spans), used.tolist()], long),
            pa.array([*(None for _ in spans), used_n[used].tolist()], long),
            pa.array([0] * len(spans) + [int(n.sum())], pa.int64()),
            pa.array([0] * len(spans) + [int((c > 0).sum())], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["block", "slots", "sizes", "ids", "counts", "id", "id_n", "tokens", "kinds"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, last = [], 0, None
        for batch in batches:
            for bucket, *row in zip(*(c.to_pylist() for c in batch.columns)):
                # only whole buckets are answered, so that all rows of a word are counted together
                if n >= tokens.ENCODE_ROWS and bucket != last:
                    yield answer(held)
                    held, n = [], 0
                held.append(tuple(row))
                n, last = n + len(row[3]) // 4, bucket
        if n:
            yield answer(held)

    return run


def pieces(values: np.ndarray, ends: np.ndarray, which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The chosen texts in pieces: their numbers, ids, and ends. Text i is values[ends[i]:ends[i+1]]."""
    ids, at = blocks.ragged(values, ends, which)
    first = 0
    while first < len(which):
        stop = max(first + 1, int(np.searchsorted(at, at[first] + PIECE, "right")) - 1)
        yield which[first:stop], ids[at[first] : at[stop]], at[first : stop + 1] - at[first]
        first = stop


def unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and ends of each piece; its last two columns are these."""
    for ids, ends in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)):
        yield tokens.unpack_codes(ids.as_py()).astype(np.int64), np.frombuffer(ends.as_py(), "<i8")


def pair_counts(texts: DataFrame, *sides: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """For each (left, right), how often left[id] comes right before right[next id] in the pieces (ids, ends); 0 stands for a text's start and end."""
    shapes = [(int(left.max()) + 1, int(right.max()) + 1) for left, right in sides]
    begins = np.append(0, np.cumsum([a * b for a, b in shapes]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(begins[-1], np.int64)
        for batch in batches:
            for values, ends in unpacked(batch):
                for (left, right), (_, width), begin in zip(sides, shapes, begins):
                    a, at = sequences(values, ends, left)
                    b = a if right is left else sequences(values, ends, right)[0]
                    keys = a[:-1].astype(np.int64)
                    keys *= width
                    keys += b[1:]
                    keys += begin
                    # the last of a text and the first of the next are no pair
                    inner = np.ones(len(keys), bool)
                    inner[at[1:-1] - 1] = False
                    np.add.at(total, keys[inner], 1)
        keys = np.flatnonzero(total)
        for k in range(0, len(keys), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 10_000]), pa.array(total[keys[k : k + 10_000]])], ["pair", "n"])

    out = np.zeros(begins[-1])
    found = texts.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out[found["pair"].to_numpy()] = found["n"].to_numpy()
    return [out[begin : begin + a * b].reshape(a, b) for begin, (a, b) in zip(begins, shapes)]


def train(coded: DataFrame, counts: np.ndarray, texts: int, path: str, pattern: str) -> tuple[Model, Ids]:
    """Classes of ids, and rounds of training side by side: each trainer passes over its part of the round's texts, then the weights are averaged.

    coded: draw, n, ids and ends of pieces of all training texts; each piece is in one trainer's
    part of one round. The driver reads the trainers' weights one by one, and before that counts of pairs of classes.
    """
    total = coded.agg(F.sum("n")).first()[0] or 0
    trainers = max(TRAINERS, -(-total // (ROUNDS * PART)))
    few = coded.select("ids", "ends")
    table = tokens.rank_encoding(path, pattern)[1]
    begins = np.array([t.startswith(b" ") for t in table])
    every, single = np.arange(1, len(counts) + 1), Ids(counts, texts, begins).single()
    after, before = pair_counts(few, (every, single), (single, every))
    near = np.zeros((len(counts), 2 * (SINGLES + 2)))
    near[: len(after) - 1, : after.shape[1]] = after[1:]
    near[: before.shape[1] - 1, SINGLES + 2 : SINGLES + 2 + len(before)] = before[:, 1:].T
    ids = Ids(counts, texts, begins, near)
    pairs = np.zeros((CLASSES, CLASSES))
    (found,) = pair_counts(few, (ids.classes, ids.classes))
    pairs[: found.shape[0], : found.shape[1]] = found
    model = Model.fresh(ids.share).start_from_pairs(pairs, ids.share).with_symbols(ids.symbol_share)
    for turn in range(ROUNDS):
        raw, rate = model.pack(), 0.005 * 0.5**turn

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine, moments, n, kept, part = Model.unpack(raw), {}, 0, [], 0
            for batch in batches:
                part = batch.column(0)[0].as_py() if batch.num_rows else part
                for values, ends in unpacked(batch):
                    seq, at = sequences(values, ends, ids.symbols)
                    mine = train_local(mine, seq, at, rate, turn, moments, ids.cuts)
                    n += len(seq)
                    if moments.get("step", 0) < STEPS:
                        kept.append((seq, at))
            again = 1
            while kept and moments.get("step", 0) < STEPS and again < PASSES:
                for seq, at in kept:
                    mine = train_local(mine, seq, at, rate, turn + 1000 * again, moments, ids.cuts)
                again += 1
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([mine.pack()]), pa.array([n])], ["part", "weights", "n"])

        parts = coded.where(F.col("draw") % ROUNDS == turn).withColumn("part", (F.floor(F.col("draw") / ROUNDS) % trainers).cast("int"))
        rows = written(parts.repartitionById(trainers, F.col("part")).sortWithinPartitions("draw").select("part", "ids", "ends").mapInArrow(learn, "part int, weights binary, n long"))
        seen, mean = 0, 0.0
        for r in rows.orderBy("part").toLocalIterator():
            seen, mean = seen + r.n, mean + np.frombuffer(bytes(r.weights), np.float32) * np.float64(r.n)
        if seen:
            model = Model.unpack((mean / seen).astype(np.float32).tobytes())
    return model, ids


def score_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    Tokens are the lower-cased words and one end. Counts are of all documents that aren't
    held out. A null or empty text is its end alone; repeated rows count, and are scored, one by one; a null id isn't
    held out. Without training documents nothing is known and all classes are equally likely.
    """
    source = id_text(docs)

    def coded_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        block = tokens.Block(batch, _words)
        rows = block.text_rows(batch.column(0))
        learned = ~held_out(batch.column(0))
        known = np.repeat(learned, np.diff(block.docs))
        n = np.bincount(block.codes[known], minlength=len(block.words))
        ends, data = blocks.parts(block.words)
        # a block's first row has its words and how many there are, and its training texts
        for name, values in (("words", data), ("word_ends", ends.astype("<i8")), ("n", n.astype("<i8"))):
            rows = rows.append_column(name, pa.array([values.tobytes(), *[None] * (rows.num_rows - 1)], pa.binary()))
        for name, value in (("distinct", len(n)), ("texts", int(learned.sum()))):
            rows = rows.append_column(name, pa.array([value, *[0] * (rows.num_rows - 1)], pa.int64()))
        return rows

    source_coded = written(source.mapInArrow(per_block(coded_rows, tokens.DICTIONARY_BYTES), "block long, doc_ids array<long>, sizes binary, codes binary, words binary, word_ends binary, n binary, distinct long, texts long"))
    distinct, texts = (x or 0 for x in source_coded.agg(F.sum("distinct"), F.sum("texts")).first())
    # a bucket has a fourth of what an encoding task holds
    many = 1 + 4 * distinct // tokens.ENCODE_ROWS
    words = source_coded.where("words IS NOT NULL").select("block", "words", "word_ends", "n").mapInArrow(in_buckets(many), "bucket long, block long, words binary, sizes binary, slots binary, n binary")
    counted = words.repartition("bucket").sortWithinPartitions("bucket")
    answers = written(counted.mapInArrow(encode_counted(path, pattern), "block long, slots binary, sizes binary, ids binary, counts binary, id array<long>, id_n array<long>, tokens long, kinds long"))

    n, v = (x or 0 for x in answers.agg(F.sum("tokens"), F.sum("kinds")).first())
    n, v = n + texts, v + (texts > 0)
    counts = np.zeros(len(tokens.rank_encoding(path, pattern)[1]))
    for r in answers.where("block IS NULL").select(F.explode(F.arrays_zip("id", "id_n")).alias("z")).groupBy("z.id").agg(F.sum("z.id_n").alias("n")).collect():
        counts[r.id] = r.n
    unit = np.log10(n + v + 1)

    def put_together(texts_table: pa.Table, rows: pa.Table) -> pa.Table:
        values, offsets, found = tokens.by_block(rows)
        c = np.frombuffer(b"".join(rows["counts"].to_pylist()), "<i8")[found["where"]]
        log_c, known = np.log10(c + 1.0), c > 0
        out: list[tuple] = []
        for row in texts_table.to_pylist():
            codes = tokens.unpack_codes(row["codes"])
            if len(codes) and int(codes.max()) >= len(c):
                raise ValueError("a block's words are incomplete")
            at = np.append(0, np.cumsum(np.frombuffer(row["sizes"], "<i4"))).astype(np.int64)
            flat, ends = blocks.ragged(values, offsets, codes)
            size = np.diff(at) + 1
            base = blocks.row_sums(log_c[codes], at) + np.log10(texts + 1.0) - size * unit
            sure = blocks.row_sums(known[codes], at).astype(np.int64) + (texts > 0)
            doc_ids = row["doc_ids"]
            held = held_out(pa.array(doc_ids, pa.int64()))
            for which in (False, True):
                for own, piece, piece_ends in pieces(flat, ends[at], np.flatnonzero(held == which)):
                    packed = tokens.pack_codes(piece)
                    out.append(([doc_ids[i] for i in own], which, size[own], sure[own], base[own], zlib.crc32(packed), len(piece) + len(own), packed, piece_ends.astype("<i8").tobytes()))
        return pa.table([pa.array(column, f.type) for column, f in zip(zip(*out), shape)], shape)

    long = pa.list_(pa.int64())
    shape = pa.schema([("doc_ids", long), ("held_out", pa.bool_()), ("sizes", long), ("sure", long), ("base", pa.list_(pa.float64())), ("draw", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("ends", pa.binary())])
    texts_coded = source_coded.select("block", "doc_ids", "sizes", "codes")
    per = answers.where("block IS NOT NULL").select("block", "slots", "sizes", "ids", "counts")
    # small row groups, so that a file can be read by several tasks
    coded = written(texts_coded.groupBy("block").cogroup(per.groupBy("block")).applyInArrow(put_together, "doc_ids array<long>, held_out boolean, sizes array<long>, sure array<long>, base array<double>, draw long, n long, ids binary, ends binary"), **{"parquet.block.size": str(4 << 20)})
    model, ids = train(coded.where("NOT held_out").select("draw", "n", "ids", "ends"), counts, texts, path, pattern)
    weights = model.pack()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.unpack(weights)
        for batch in batches:
            for k, (values, ends) in enumerate(unpacked(batch)):
                seq, bounds = sequences(values, ends, ids.symbols)
                scores = (sequence_log_p(model, seq, bounds, cuts=ids.cuts) + blocks.row_sums(ids.log_part[values], ends)) / LOG10
                doc_ids, held, size, sure, base = (batch.column(c)[k].as_py() for c in range(5))
                m = len(doc_ids)
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(np.full(m, held)), pa.array(size, pa.int64()), pa.array(sure, pa.int64()), pa.array(np.full(m, n)), pa.array(base, pa.float64()), pa.array(scores)], names)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return coded.select("doc_ids", "held_out", "sizes", "sure", "base", "ids", "ends").mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
