"""A small causal self-attention model over subword ids, in numpy.

One attention layer reads a window of ids. Its softmax runs over the ids seen so
far and a sentinel (Merity et al. 2016): the weight of a place is the probability
that the id which followed there comes next again; the sentinel's weight goes to
a mixture of three count models (id, id after one, id after two), whose shares a
gate on the attended state decides. All of it is one distribution over ids:

    P(next) = s * sum_k w_k P_k(next) + sum_j a_j [next = id after place j]

Count models are discounted and back off to each other; the shortest one gives
every id of the vocabulary a share, so probabilities are positive and sum to one.
A text that was counted leaves its own occurrence out of the counts it is scored
by (leave one out), in training and in scoring: counted and new texts are on one
scale.

Windows overlap: CONTEXT ids give context only, STEP ids are scored, so each id
is scored once, with at least CONTEXT ids before it where the text has them.
"""

from __future__ import annotations

import numpy as np

CONTEXT, STEP, DIM = 16, 32, 16
WIDTH = CONTEXT + STEP
DISCOUNT = 0.75
#: Buckets of how often a context was seen, by powers of two.
BUCKETS = 16
_SHARED = ("Q", "K", "V", "S", "R", "N", "G", "B", "C")
f32 = np.float32


def _by(m: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``m @ w`` of windows by a matrix, in one product."""
    return (m.reshape(-1, m.shape[2]) @ w).reshape(*m.shape[:2], -1)


class Table:
    """Places of keys by their hash: keys of a bucket stand together, a bucket holds about one."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = np.uint64(64 - max(4, int(len(keys)).bit_length()))
        h = self._hash(keys)
        order = np.argsort(h, kind="stable")
        self.keys, self.place = np.append(keys[order], -1), np.append(order, len(keys)).astype(np.int32)
        n = np.bincount(h, minlength=1 << (64 - int(self.bits)))
        self.first = np.append(0, np.cumsum(n)).astype(np.int32)
        self.longest = int(n.max(initial=0))

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.bits).astype(np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Places of ``x`` among the keys; their number where there is none."""
        h = self._hash(x)
        at, end = self.first[h], self.first[h + 1]
        out = np.full(len(x), len(self.keys) - 1, np.int32)
        todo = np.flatnonzero(at < end)
        at, end, x = at[todo], end[todo], x[todo]
        while len(todo):
            hit = self.keys[at] == x
            out[todo[hit]] = self.place[at[hit]]
            at = at + 1
            on = ~hit & (at < end)
            todo, at, end, x = todo[on], at[on], end[on], x[on]
        return out


class Counts:
    """Count models: ids, pairs and triples. Pairs and triples that are left out keep their mass, which backs off."""

    def __init__(self, vocab: int, ones: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], triples: tuple[np.ndarray, np.ndarray]) -> None:
        """``ones``: counts of ids; ``pairs``: sorted keys a * vocab + b, counts; ``triples``: sorted keys (a * vocab + b) * vocab + c, counts."""
        self.vocab, self.ones = vocab, ones.astype(f32)
        self.total = float(ones.sum(dtype=np.float64))
        k2, self.c2 = pairs[0], np.append(pairs[1], 0).astype(f32)
        self.t2 = Table(k2)
        at = self.t2.find(triples[0] // vocab).astype(np.int64)
        good = at < len(k2)
        at = at[good]
        # a triple's key is its pair's place, so that it is found from there
        self.t3, self.c3 = Table(at * vocab + triples[0][good] % vocab), np.append(triples[1][good], 0).astype(f32)
        n = len(k2) + 1
        self.d3 = np.bincount(at, minlength=n).astype(f32)  # kinds that follow, and mass that backs off for kinds left out
        self.l3 = np.maximum(self.c2 - np.bincount(at, self.c3[:-1], minlength=n).astype(f32), 0)
        a = k2 // vocab
        self.d2 = np.bincount(a, minlength=vocab).astype(f32)
        self.l2 = np.maximum(self.ones - np.bincount(a, self.c2[:-1], minlength=vocab).astype(f32), 0)
        self.bucket = np.minimum(BUCKETS - 1, np.ceil(np.log2(self.c2 + 1))).astype(np.int8)

    def shares(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """P of ``c`` after ``b`` and, before that, ``a`` (-1: none) by each model, and the context's bucket. ``own``: 1 where the place was counted.

        The arrays run along texts: where there is an ``a``, it and ``b`` are ``b`` and ``c`` of the place before."""
        own = own.astype(f32)
        p1 = (np.maximum(self.ones[c] - own, 0) + f32(0.01)) / (np.maximum(f32(self.total) - own, 0) + f32(0.01 * self.vocab))
        here = self.t2.find(b * self.vocab + c)
        p2 = self._back(self.c2[here], self.ones[b], self.l2[b], self.d2[b], own, p1)
        none = np.int32(len(self.c2) - 1)
        at = np.where(a >= 0, np.concatenate(([none], here[:-1])), none)  # the pair before was looked up there
        p3 = self._back(self.c3[self.t3.find(at.astype(np.int64) * self.vocab + c)], self.c2[at], self.l3[at], self.d3[at], own, p2)
        return p1, p2, p3, self.bucket[at]

    @staticmethod
    def _back(c: np.ndarray, n: np.ndarray, left: np.ndarray, kinds: np.ndarray, own: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Absolute discounting: (c - D) / n and the rest of the mass, that of kinds left out included, to ``lower``."""
        left = np.maximum(left - own * (c == 0), 0)
        kinds = kinds - own * (c == 1)
        c = np.maximum(c - own, 0)
        n = n - own
        good = n > 0
        n = np.maximum(n, 1)
        share = np.maximum(c - f32(DISCOUNT), 0)
        share += (left + f32(DISCOUNT) * kinds) * lower
        share /= n
        return np.where(good, share, lower)


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts laid end to end, ``lengths`` inputs each: per window the inputs' places (-1: none), and which places are scored."""
    n = -(-lengths // STEP)
    start = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    text = np.repeat(np.arange(len(lengths)), n)
    block = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = (start[text] + block * STEP)[:, None] - CONTEXT + np.arange(WIDTH)
    ok = (at >= start[text][:, None]) & (at < (start + lengths)[text][:, None])
    return np.where(ok, at, -1), ok[:, CONTEXT:]


class Batch:
    """Windows of texts: inputs, what comes next, which are scored, and the count models' shares."""

    def __init__(self, counts: Counts, end: int, texts: list[np.ndarray], own: np.ndarray) -> None:
        """``own``: 1 for each text that was counted."""
        lengths = np.array([len(t) + 1 for t in texts])
        ends = np.array([end])
        last = np.concatenate([x for t in texts for x in (ends, t)]).astype(np.int64)
        self.target = np.concatenate([x for t in texts for x in (t, ends)]).astype(np.int64)
        before = np.concatenate(([-1], last[:-1]))
        before[np.concatenate(([0], np.cumsum(lengths)[:-1]))] = -1
        *self.p, self.bucket = counts.shares(before, last, self.target, np.repeat(own, lengths))
        self.at, self.ok = windows(lengths)
        self.last, self.lengths = last, lengths

    def pick(self, rows: np.ndarray | slice) -> tuple[np.ndarray, ...]:
        at, ok = self.at[rows], self.ok[rows]
        place = np.maximum(at, 0)
        here = place[:, CONTEXT:]
        return np.where(at >= 0, self.last[place], -1), self.target[here], ok, [p[here] for p in self.p], self.bucket[here]


class Model:
    def __init__(self, vocab: int, end: int, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.vocab, self.end = vocab, end
        eye = np.eye(DIM, dtype=f32)
        self.p = {"E": rng.normal(0, 0.5, (vocab, DIM)).astype(f32), "Q": 1.6 * eye, "K": 1.6 * eye, "V": rng.normal(0, 0.2, (DIM, DIM)).astype(f32), "S": 0.5 * eye,
                  "R": np.zeros((STEP, WIDTH), f32), "N": np.zeros((1, DIM), f32), "G": np.zeros((3, DIM), f32),
                  "B": np.tile(np.r_[-2.0, 0.0, 2.0, np.zeros(DIM - 3)].astype(f32), (BUCKETS, 1)), "C": np.full((BUCKETS, DIM), 7.5 / DIM, f32)}
        # a place may point only where what followed it has been seen
        self.blind = np.where(np.arange(WIDTH)[None, :] < CONTEXT + np.arange(STEP)[:, None], 0, -1e4).astype(f32)

    def _forward(self, ids: np.ndarray, target: np.ndarray, p: list[np.ndarray], bucket: np.ndarray) -> dict:
        """``ids``: windows x WIDTH, -1 where there is none; ``target``, ``bucket`` and each of ``p``: windows x STEP."""
        w = self.p
        x = np.take(w["E"], np.maximum(ids, 0), 0)
        missing = ids < 0
        gaps = missing[:, 0].any() or missing[:, -1].any()  # texts begin late or end early
        if gaps:
            x[missing] = 0
        u = x.copy()
        u[:, 1:] += _by(x, w["S"])[:, :-1]
        uq = np.ascontiguousarray(u[:, CONTEXT:])
        q, k, v = _by(uq, w["Q"] * f32(DIM**-0.5)), _by(u, w["K"]), _by(u, w["V"])
        a = q @ k.transpose(0, 2, 1)
        a += w["R"] + self.blind
        if gaps:
            rows = missing.any(1)
            a[rows] += np.where(missing[rows], f32(-1e4), f32(0))[:, None, :]
        np.minimum(a, f32(30), out=a)
        np.exp(a, out=a)
        null = np.exp(np.minimum(_by(uq, w["N"].T)[:, :, 0] + w["C"].sum(1)[bucket], f32(30)))
        total = (a @ np.ones((WIDTH, 1), f32))[:, :, 0] + null
        h = np.tanh(uq + (a @ v) / total[:, :, None])
        z = _by(h, w["G"].T)
        z = [np.exp(np.minimum(z[:, :, e] + w["B"][:, e][bucket], f32(30))) for e in range(3)]
        scale = 1 / (z[0] + z[1] + z[2])
        z = [e * scale for e in z]
        mixed = z[0] * p[0] + z[1] * p[1] + z[2] * p[2]
        follows = np.concatenate([ids[:, 1:], np.full((len(ids), 1), -2)], 1).astype(np.int32)
        same = follows[:, None, :] == target.astype(np.int32)[:, :, None]  # places to come have no weight
        pointed = np.einsum("wsk,wsk->ws", a, same)
        return {"x": x, "u": u, "uq": uq, "q": q, "k": k, "v": v, "a": a, "null": null, "total": total, "h": h, "z": z, "mixed": mixed, "same": same, "out": (null * mixed + pointed) / total}

    def _gradients(self, ids: np.ndarray, target: np.ndarray, ok: np.ndarray, p: list[np.ndarray], bucket: np.ndarray) -> tuple[dict, np.ndarray, float]:
        """Of the mean loss: by all parameters but the embeddings, by each input, and the loss."""
        w, s = self.p, self._forward(ids, target, p, bucket)
        flat = lambda m: m.reshape(-1, m.shape[2])
        n, b = max(1, int(ok.sum())), bucket.ravel()
        up = -(ok / np.maximum(s["out"], f32(1e-30)) / n).astype(f32)  # loss by P
        a, uq, over = s["a"], s["uq"], 1 / s["total"]
        a *= over[:, :, None]
        null = s["null"] * over
        dw = up * null
        dz = np.stack([dw * z * (q - s["mixed"]) for z, q in zip(s["z"], p, strict=True)], 2)
        g = {"G": flat(dz).T @ flat(s["h"]), "B": np.zeros_like(w["B"])}
        for e in range(3):
            g["B"][:, e] = np.bincount(b, dz[:, :, e].ravel(), BUCKETS)
        dh = _by(dz, w["G"]) * (1 - s["h"] ** 2)
        dl = dh @ s["v"].transpose(0, 2, 1)
        dl += up[:, :, None] * s["same"]
        dnull = up * s["mixed"]
        mean = np.einsum("wsk,wsk->ws", dl, a) + dnull * null
        dl -= mean[:, :, None]
        dl *= a
        dn = null * (dnull - mean)
        g["R"] = dl.sum(0)
        g["C"] = np.repeat(np.bincount(b, dn.ravel(), BUCKETS).astype(f32)[:, None], DIM, 1)
        g["N"] = (dn.reshape(1, -1) @ flat(uq)).astype(f32)
        dv = a.transpose(0, 2, 1) @ dh
        dq, dk = (dl @ s["k"]) * f32(DIM**-0.5), dl.transpose(0, 2, 1) @ s["q"]  # q holds the scale already
        g["Q"], g["K"], g["V"] = (flat(l).T @ flat(r) for l, r in ((uq, dq), (s["u"], dk), (s["u"], dv)))
        du = _by(dk, w["K"].T)
        du += _by(dv, w["V"].T)
        du[:, CONTEXT:] += _by(dq, w["Q"].T) + dh + dn[:, :, None].astype(f32) * w["N"][0]
        g["S"] = flat(s["x"][:, :-1]).T @ flat(du[:, 1:])
        dx = du.copy()
        dx[:, :-1] += _by(du, w["S"].T)[:, 1:]
        return g, dx, float(-(np.log(np.maximum(s["out"], f32(1e-30))) * ok).sum() / n)

    def learner(self) -> None:
        """Gets ready to ``learn``."""
        self.p = {k: v.copy() for k, v in self.p.items()}
        self.t, self.seen = 0, np.zeros(self.vocab, np.int64)
        self.m1, self.m2 = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))

    def learn(self, batch: Batch, rate: float, size: int = 128, seed: int = 5) -> float:
        """One pass of Adam over a batch's windows, which starts slowly; embeddings move where their ids occur. The mean loss on the way."""
        order, lost = np.random.default_rng(seed).permutation(len(batch.at)), 0.0
        for at in range(0, len(order), size):
            rows = order[at : at + size]
            ids, *rest = batch.pick(rows)
            g, dx, loss = self._gradients(ids, *rest)
            lost += loss * len(rows)
            real = np.flatnonzero(ids >= 0)
            here = ids.ravel()[real].astype(np.uint16 if self.vocab <= 1 << 16 else np.int64)
            by = np.argsort(here, kind="stable")
            here = here[by]
            first = np.flatnonzero(np.append(True, here[1:] != here[:-1]))
            ids_ = here[first].astype(np.int64)
            self.seen[ids_] += np.diff(np.append(first, len(here)))
            g["E"] = np.add.reduceat(np.take(dx.reshape(-1, DIM), real[by], 0), first)
            self.t += 1
            for name, grad in g.items():
                of = ids_ if name == "E" else slice(None)
                m1, m2 = 0.9 * self.m1[name][of] + 0.1 * grad, 0.99 * self.m2[name][of] + 0.01 * grad**2
                self.m1[name][of], self.m2[name][of] = m1, m2
                self.p[name][of] -= (rate * min(1.0, self.t / 50) * m1 / (1 - 0.9**self.t) / (np.sqrt(m2 / (1 - 0.99**self.t)) + 1e-8)).astype(f32)
        return lost / max(1, len(order))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What was learned, as (key, weight, DIM values): embeddings of ids seen, then all else, DIM values a row."""
        ids = np.flatnonzero(self.seen)
        rest = np.concatenate([self.p[k].ravel() for k in _SHARED]).reshape(-1, DIM)
        return np.r_[ids, self.vocab + np.arange(len(rest))], np.r_[self.seen[ids], np.full(len(rest), self.seen.sum())].astype(np.float64), np.vstack([self.p["E"][ids], rest])

    def take(self, key: np.ndarray, values: np.ndarray) -> None:
        """Sets parameters from (averaged) ``rows``."""
        own = key < self.vocab
        self.p["E"][key[own]] = values[own]
        rest = np.concatenate([self.p[k].ravel() for k in _SHARED]).reshape(-1, DIM)
        rest[key[~own] - self.vocab] = values[~own]
        for k, v in zip(_SHARED, np.split(rest.ravel(), np.cumsum([self.p[k].size for k in _SHARED])[:-1]), strict=True):
            self.p[k] = v.reshape(self.p[k].shape).copy()

    def logs(self, batch: Batch, size: int = 128) -> np.ndarray:
        """log10 probability of each id of a batch's texts, and of their ends, in order."""
        out = np.zeros(len(batch.target))
        for at in range(0, len(batch.at), size):
            rows = slice(at, at + size)
            ids, target, ok, p, bucket = batch.pick(rows)
            got = self._forward(ids, target, p, bucket)["out"]
            out[batch.at[rows][:, CONTEXT:][ok]] = np.log10(np.maximum(got[ok].astype(np.float64), 1e-30))
        return out
