"""The numpy part of operator 11: a causal self-attention model of subword ids, its training and its scoring.

Ids are ranked by their count in the training documents. The ``HEAD`` most
frequent ones have vectors of their own, all others share one. A place attends
to itself and to what stands before it in its own block of ``BLOCK`` ids and in
the block before: windows of two blocks overlap by one, and each id is scored
once, in the window in which it stands in the second block. Weights of attention are
queries by keys and a bias by distance; what comes out passes a layer of
``HIDDEN`` units with the id itself. The next id is told in two steps, its class
and its place in it: classes hold frequent ids of about the same share of all
text each, and the last one all ids outside the head, by their smoothed shares.
So every id has a chance, and the chances of all ids sum to one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLOCK = 8
HEAD = 1024
CLASSES = 32
KEY, VALUE, HIDDEN = 8, 8, 24
#: Entries of keys and queries are held to this, so that exponentials stay finite.
MOST = 3.0
F32 = np.float32


@dataclass
class Vocabulary:
    """Ranks, classes and shares of ids, from their counts in the training documents."""

    rank: np.ndarray  # of each id: its place in the head, HEAD if it stands outside
    log_share: np.ndarray  # of each id: the logarithm of its share of its rank, 0 in the head
    bounds: np.ndarray  # first ranks of the classes of the head, and HEAD
    unit: np.ndarray  # logarithms of the shares of the ranks, HEAD included

    @property
    def classes(self) -> int:
        """Those of the head, and the one of all other ids."""
        return len(self.bounds)

    @property
    def pad(self) -> int:
        return len(self.unit)


def vocabulary(counts: np.ndarray, end: int, head: int = HEAD, classes: int = CLASSES) -> Vocabulary:
    """``counts`` has the number of each id; the id ``end`` is always in the head. Ties go to the smaller id."""
    head = min(head, len(counts) - 1)
    share = (counts + 0.5) / (counts + 0.5).sum()
    order = np.argsort(-share, kind="stable")
    order = np.concatenate([[end], order[order != end]])
    order[:head] = order[:head][np.argsort(-share[order[:head]], kind="stable")]
    rank = np.full(len(counts), head, np.int32)
    rank[order[:head]] = np.arange(head)
    rest = share[order[head:]].sum()
    log_share = np.zeros(len(counts))
    log_share[order[head:]] = np.log(share[order[head:]] / rest)
    own = share[order[:head]]
    number = np.minimum((np.cumsum(own) - own) / own.sum() * (classes - 1), classes - 2).astype(int)
    bounds = np.append(np.flatnonzero(np.append(True, np.diff(number) > 0)), head)
    return Vocabulary(rank, log_share, bounds, np.log(np.append(own, rest)))


#: Parameters by name: shapes follow from the vocabulary.
def shapes(v: Vocabulary) -> dict[str, tuple[int, ...]]:
    n = v.pad
    return {
        "query": (n, KEY),
        "key": (n, KEY),
        "value": (n, VALUE),
        "own": (n, HIDDEN),
        "near": (2 * BLOCK,),
        "mixing": (VALUE, HIDDEN),
        "lift": (HIDDEN,),
        "to_class": (HIDDEN, v.classes),
        "class_bias": (v.classes,),
        "to_id": (HIDDEN, v.pad - 1),
        "id_bias": (v.pad - 1,),
    }


def started(v: Vocabulary, seed: int = 11) -> np.ndarray:
    """Parameters that give each id its share, whatever the context, with small random vectors to begin with."""
    rng = np.random.default_rng(seed)
    p = {k: rng.normal(0, 0.3, s).astype(F32) for k, s in shapes(v).items()}
    p["near"][:] = -0.1 * np.arange(2 * BLOCK)
    p["lift"][:] = 0
    p["to_class"] *= 0.1
    p["to_id"] *= 0.1
    p["id_bias"][:] = v.unit[:-1]
    whole = np.logaddexp.reduceat(v.unit[:-1], v.bounds[:-1])
    p["class_bias"][:] = np.append(whole, v.unit[-1])
    return np.concatenate([x.ravel() for x in p.values()])


def named(flat: np.ndarray, v: Vocabulary) -> dict[str, np.ndarray]:
    """The parameters as views of one array."""
    out, at = {}, 0
    for k, s in shapes(v).items():
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s)
        at += n
    return out


def _distance() -> tuple[np.ndarray, np.ndarray]:
    """How far each of a window's keys stands before each place of its second block, and where that is in the future."""
    back = (np.arange(BLOCK)[:, None] + BLOCK) - np.arange(2 * BLOCK)[None, :]
    return np.maximum(back, 0), back < 0


_BACK, _FUTURE = _distance()


def _exponentials(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sums of the exponentials of each row, which take the logits' place, and what was taken off a row's logits before."""
    n = len(logits)
    if not n:
        return np.zeros(0, F32), np.zeros(0, F32)
    off, ones = np.zeros(n, F32), np.ones(logits.shape[1], F32)
    # most rows need nothing taken off; where the largest one might overflow, or all of them vanish, the row's largest is
    if logits.max() > 80 or logits.min() < -80:
        off = logits.max(1)
        logits -= off[:, None]
    np.exp(logits, out=logits)
    return logits @ ones, off


class Model:
    """Parameters made ready for scoring and training."""

    def __init__(self, flat: np.ndarray, v: Vocabulary) -> None:
        self.v, self.flat, self.room = v, flat, np.empty(0, F32)
        self.refresh()

    def refresh(self) -> None:
        v, p = self.v, named(self.flat, self.v)
        self.p, n = p, v.pad
        np.clip(p["query"], -MOST, MOST, out=p["query"])
        np.clip(p["key"], -MOST, MOST, out=p["key"])
        np.clip(p["near"], -MOST * 4, MOST, out=p["near"])
        if not hasattr(self, "query"):
            # one dimension more: what stands in for a missing id gets no weight
            self.query = np.ones((n + 1, KEY + 1), F32)
            self.key = np.zeros((n + 1, KEY + 1), F32)
            self.key[n, KEY] = -1e4
            # a last entry of one, so that the weights' sum comes with what they bring
            self.value = np.ones((n + 1, VALUE + 1), F32)
            self.own = np.zeros((n + 1, HIDDEN), F32)
            # class of each rank, and one after all of them for a missing id
            self.of = np.repeat(np.arange(v.classes + 1, dtype=np.uint8), np.diff(np.append(v.bounds, [n, n + 1])))
        np.divide(p["query"], np.sqrt(F32(KEY)), out=self.query[:n, :KEY])
        self.query[n] = self.query[n - 1]
        self.key[:n, :KEY] = p["key"]
        self.value[:n, :VALUE] = p["value"]
        self.value[n] = self.value[n - 1]
        np.add(p["own"], p["lift"], out=self.own[:n])
        # weights with their biases as a last row, which meets a last entry of one of the hidden units
        self.to_class = np.concatenate([p["to_class"], p["class_bias"][None]])
        to_id = np.concatenate([p["to_id"], p["id_bias"][None]])
        self.to_id = [np.ascontiguousarray(to_id[:, a:b]) for a, b in zip(v.bounds, v.bounds[1:])]
        self.near = np.where(_FUTURE, F32(-1e4), p["near"][_BACK])

    def attend(self, query: np.ndarray, keys: np.ndarray, values: np.ndarray, none: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """Weights (not yet summing to one) of what stands before and in the block, their sums, and what they bring.

        ``keys`` and ``values`` are those of the block before and of the block itself; blocks ``none`` have none before.
        """
        weight = query @ keys.transpose(0, 2, 1)
        weight += self.near
        np.exp(weight, out=weight)
        if none is not None:
            weight[none, :, :BLOCK] = 0
        met = weight @ values
        total = met[:, :, VALUE:] + F32(1e-30)
        return weight, total, met[:, :, :VALUE] / total

    def hidden(self, own: np.ndarray, none: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
        """Of blocks (n + 1, BLOCK) that follow each other, all but the first; ``none``: which of them begin a row."""
        # each block's keys and values follow those of the block before
        k, v = (_pairs(table.take(own, axis=0)) for table in (self.key, self.value))
        met = self.attend(self.query.take(own[1:], axis=0), k, v, none)[-1]
        h = np.matmul(met.reshape(-1, VALUE), self.p["mixing"], out=out)
        h += self.own.take(own[1:].ravel(), axis=0)
        return np.maximum(h, 0, out=h)

    def sorted_by_class(self, following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places that something follows, by its class, and where the classes begin and end."""
        of = self.of.take(following)
        cuts = np.zeros(self.v.classes + 1, np.int64)
        np.cumsum(np.bincount(of, minlength=self.v.classes + 1)[:-1], out=cuts[1:])
        return np.argsort(of, kind="stable")[: cuts[-1]], cuts

    def log_chance(self, h: np.ndarray, following: np.ndarray) -> np.ndarray:
        """Logarithm of the chance of each rank that follows, 0 where none does; rows are gone through class by class."""
        bounds, out = self.v.bounds, np.zeros(len(h), F32)
        order, cuts = self.sorted_by_class(following)
        n, following = len(order), following.take(order)
        held = np.ones((n, HIDDEN + 1), F32)
        held[:, :HIDDEN] = h.take(order, axis=0)
        widest = max(int((np.diff(cuts)[:-1] * np.diff(bounds)).max()), n * len(bounds))
        if len(self.room) < widest:
            self.room = np.empty(widest, F32)
        logits = np.matmul(held, self.to_class, out=self.room[: n * len(bounds)].reshape(n, -1))
        found = np.concatenate([logits[x:y, c] for c, (x, y) in enumerate(zip(cuts, cuts[1:]))])
        sums, off = _exponentials(logits)
        found -= off
        inner_sums = np.ones(n, F32)
        for c in range(len(bounds) - 1):
            a, b, x, y = bounds[c], bounds[c + 1], cuts[c], cuts[c + 1]
            if b - a > 1 and x < y:
                inner = np.matmul(held[x:y], self.to_id[c], out=self.room[: (y - x) * (b - a)].reshape(y - x, -1))
                found[x:y] += inner[np.arange(y - x), following[x:y] - a]
                inner_sums[x:y], off = _exponentials(inner)
                found[x:y] -= off
        out[order] = found - np.log(sums) - np.log(inner_sums)
        return out

    def gradient(self, windows: np.ndarray) -> tuple[np.ndarray, float]:
        """Of the mean loss over the places of windows (n, 3, BLOCK) that something follows, and that loss."""
        p, v, flat = self.p, self.v, np.zeros_like(self.flat)
        g = named(flat, v)
        ranks, own, following = windows[:, :2].reshape(len(windows), 2 * BLOCK), windows[:, 1], windows[:, 2].ravel()
        query, keys, values = (table.take(x, axis=0) for table, x in ((self.query, own), (self.key, ranks), (self.value, ranks)))
        weight, total, met = self.attend(query, keys, values)
        at, cuts = self.sorted_by_class(following)
        to = following.take(at)
        m2, o, n = met.reshape(-1, VALUE).take(at, axis=0), own.ravel().take(at), max(1, len(at))
        held, ones, each = np.ones((len(at), HIDDEN + 1), F32), np.ones(len(at), F32), F32(1 / n)
        h = m2 @ p["mixing"]
        h += self.own.take(o, axis=0)
        np.maximum(h, 0, out=h)
        held[:, :HIDDEN] = h
        chance = held @ self.to_class
        sums, _ = _exponentials(chance)
        lost = np.ones(len(at), F32)
        for c, (x, y) in enumerate(zip(cuts, cuts[1:])):
            lost[x:y] = chance[x:y, c]
        lost /= sums
        chance *= (each / sums)[:, None]
        for c, (x, y) in enumerate(zip(cuts, cuts[1:])):
            chance[x:y, c] -= each
        whole = held.T @ chance
        g["to_class"][:], g["class_bias"][:] = whole[:-1], whole[-1]
        dh = chance @ p["to_class"].T
        loss = -float(np.log(lost + F32(1e-30)).sum())
        lost[:] = 1
        for c in range(len(v.bounds) - 1):
            a, b, x, y = v.bounds[c], v.bounds[c + 1], cuts[c], cuts[c + 1]
            if b - a < 2 or x == y:
                continue
            inner = held[x:y] @ self.to_id[c]
            sums, _ = _exponentials(inner)
            place = np.arange(y - x), to[x:y] - a
            lost[x:y] = inner[place] / sums
            inner *= (each / sums)[:, None]
            inner[place] -= each
            whole = held[x:y].T @ inner
            g["to_id"][:, a:b], g["id_bias"][a:b] = whole[:-1], whole[-1]
            dh[x:y] += inner @ self.to_id[c][:-1].T
        loss -= float(np.log(lost + F32(1e-30)).sum())
        dh *= h > 0
        g["mixing"][:] = m2.T @ dh
        g["lift"][:] = ones @ dh
        of_own = np.zeros((own.size, HIDDEN + KEY), F32)
        of_own[at, :HIDDEN] = dh
        back = np.zeros((own.size, VALUE), F32)
        back[at] = dh @ p["mixing"].T
        back = back.reshape(met.shape)
        weight /= total
        change = back @ values[:, :, :VALUE].transpose(0, 2, 1)
        change -= np.einsum("bqd,bqd->bq", back, met)[:, :, None]
        change *= weight
        near = (np.ones(len(windows), F32) @ change.reshape(len(windows), -1)).reshape(_BACK.shape)
        np.add.at(g["near"], _BACK.ravel(), np.where(_FUTURE, 0, near).ravel())
        of_own[:, HIDDEN:] = (change @ keys[:, :, :KEY]).reshape(-1, KEY)
        summed = _summed(own.ravel(), of_own, v.pad)
        g["own"][:], g["query"][:] = summed[:, :HIDDEN], summed[:, HIDDEN:] / np.sqrt(F32(KEY))
        of_all = np.concatenate([change.transpose(0, 2, 1) @ query[:, :, :KEY], weight.transpose(0, 2, 1) @ back], 2)
        summed = _summed(ranks.ravel(), of_all.reshape(-1, KEY + VALUE), v.pad)
        g["key"][:], g["value"][:] = summed[:, :KEY], summed[:, KEY:]
        return flat, loss / n


def _pairs(rows: np.ndarray) -> np.ndarray:
    """(n, 2 * BLOCK, width) of blocks (n + 1, BLOCK, width) that follow each other: each with the one before, as a view."""
    n, _, width = rows.shape
    return np.lib.stride_tricks.as_strided(rows, (n - 1, 2 * BLOCK, width), rows.strides, writeable=False)


def _summed(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The sums of the values of each of ``n`` rows; rows beyond them are missing ids."""
    out = np.zeros((n, values.shape[1]), F32)
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    sorted_rows = rows.take(order)
    first = np.flatnonzero(np.append(True, sorted_rows[1:] != sorted_rows[:-1])) if len(rows) else np.zeros(0, int)
    if len(first):
        sums, at = np.add.reduceat(values.take(order, axis=0), first, axis=0), sorted_rows[first]
        out[at[at < n]] = sums[at < n]
    return out


def train(flat: np.ndarray, v: Vocabulary, windows: np.ndarray, steps: int, batch: int, rate: float) -> np.ndarray:
    """``steps`` steps of Adam over windows (n, 3, BLOCK) of ranks (before, own, following), in turn and from the start again."""
    model = Model(flat.astype(F32), v)
    first, second, move, root = (np.zeros_like(model.flat) for _ in range(4))
    n = len(windows)
    for step in range(steps):
        at = np.arange(step * batch, (step + 1) * batch) % n if n > batch else np.arange(n)
        g, _ = model.gradient(windows[at])
        first *= F32(0.9)
        np.multiply(g, F32(0.1), out=move)
        first += move
        second *= F32(0.99)
        np.multiply(g, g, out=root)
        root *= F32(0.01)
        second += root
        slow = rate * min(1.0, (step + 1) / 8) * (1 - 0.9 * step / steps)
        np.multiply(second, F32(1 / (1 - 0.99 ** (step + 1))), out=root)
        np.sqrt(root, out=root)
        root += F32(1e-8)
        np.multiply(first, F32(slow / (1 - 0.9 ** (step + 1))), out=move)
        move /= root
        model.flat -= move
        model.refresh()
    return model.flat


def blocks(ranks: np.ndarray, counts: np.ndarray, end: int, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows' ids in blocks: (own, following) of each block, and each row's first block.

    A row is led by ``end``, as what stands before its first id, and closed by it.
    """
    pieces = counts // BLOCK + 1
    starts = np.cumsum(pieces) - pieces
    total = int(pieces.sum())
    own, following = np.full(total * BLOCK, pad, ranks.dtype), np.full(total * BLOCK, pad, ranks.dtype)
    at = np.repeat(starts * BLOCK - (np.cumsum(counts) - counts), counts) + np.arange(len(ranks))
    following[at] = ranks
    own[at + 1] = ranks  # the place of a row's last id has room for its end
    own[starts * BLOCK] = end
    following[starts * BLOCK + counts] = end
    return own.reshape(-1, BLOCK), following.reshape(-1, BLOCK), starts


def windows(own: np.ndarray, following: np.ndarray, starts: np.ndarray, pad: int) -> np.ndarray:
    """(n, 3, BLOCK): the block before each block, the block, and what follows its places."""
    before = np.full_like(own, pad)
    before[1:] = own[:-1]
    before[starts] = pad
    return np.stack([before, own, following], 1)


def _chances(model: Model, own: np.ndarray, following: np.ndarray, none: np.ndarray, at_once: int, together: int) -> np.ndarray:
    """Natural logarithm of the chance of what follows in each block (n, BLOCK), summed; ``own`` has one block more, before the first."""
    out = np.zeros(len(following))
    room = np.empty((min(at_once * together, len(following)) * BLOCK, HIDDEN), F32)
    for x in range(0, len(following), at_once * together):
        y = min(x + at_once * together, len(following))
        for a in range(x, y, at_once):
            b = min(a + at_once, y)
            model.hidden(own[a : b + 1], none[a:b], room[(a - x) * BLOCK : (b - x) * BLOCK])
        out[x:y] = model.log_chance(room[: (y - x) * BLOCK], following[x:y].ravel()).reshape(-1, BLOCK).sum(1, dtype=float)
    return out


def score(model: Model, ranks: np.ndarray, counts: np.ndarray, end: int, at_once: int = 512, together: int = 4) -> np.ndarray:
    """Natural logarithm of the chance of each row's ranks and its end; ``at_once`` blocks attend together."""
    own, following, starts = blocks(ranks, counts, end, model.v.pad)
    none = np.zeros(len(own), bool)
    none[starts] = True
    own = np.concatenate([np.full((1, BLOCK), model.v.pad, own.dtype), own])
    sums = np.concatenate([[0.0], np.cumsum(_chances(model, own, following, none, at_once, together))])
    return sums[np.append(starts[1:], len(following))] - sums[starts]


def score_lines(model: Model, counts: np.ndarray, ranks: np.ndarray, at_once: int = 512, together: int = 4) -> np.ndarray:
    """Natural logarithm of the chance of what follows in each line: a block before it, the rank before its first, and ``counts`` blocks."""
    size = (counts + 1) * BLOCK + 1
    upto = np.cumsum(size)
    inner = np.ones(len(ranks), bool)
    inner[upto - 1] = False
    own = ranks[inner].reshape(-1, BLOCK)
    inner[upto - 1] = True
    inner[upto - size] = False
    following = ranks[inner].reshape(-1, BLOCK)
    starts = np.cumsum(counts + 1) - (counts + 1)
    following[starts] = model.v.pad  # what stands before a line has been scored where it belongs
    none = np.zeros(len(own), bool)
    none[starts] = True
    own = np.concatenate([np.full((1, BLOCK), model.v.pad, own.dtype), own])
    got = _chances(model, own, following, none, at_once, together)
    return np.add.reduceat(got, starts) if len(starts) else got
