"""Toxicity by a string-subsequence kernel machine.

The kernel between two strings sums over all character subsequences of length 4 that both hold, each weighted by
DECAY to the power of the span it takes in either, so gapped and inserted-character spellings still share most of
their weight; marks between letters are left out, neighbouring short words are read as one as well, and so are every
second letters of a word. The square of the normalised kernel keeps chance likenesses small. A sentence's kernel with a
landmark adds up its words'. Landmarks are strings mined from labelled
sentences; Nyström's map over them gives features, and a linear support vector machine on these is trained on
sentences: of a toxic document, those that score highest. A document scores as its worst sentence.

A likeness is that of the best window with room for a letter between all of the landmark's, and one under LEAST of the
landmark's own counts as 0. Only windows whose letters prove that are passed over.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, STEP_BYTES, U64, Words, column, power_tables, text_steps

# DECAY, LEAST and CROWD were chosen by tuning.py, from labelled rows that are not held out.
#: Length of subsequences, decay a character of span, and longest piece of a word that one kernel evaluation takes.
LENGTH, DECAY, SPAN = 4, 0.8, 32
#: Letters of two neighbouring words that are read as one.
JOINED = 12
#: Power of the normalised kernel, and the least value of it that counts.
POWER, LEAST = 2, 0.4
#: Fitting is bounded: labelled documents of each label, characters of each, and landmarks.
SAMPLE, LONGEST, LANDMARKS = 1_000, 6_000, 64
#: Bytes of text that are scored at once: a worker's memory goes with this, some 150 bytes each.
SCORED_BYTES = STEP_BYTES // 2
#: Texts of one doc_id that the fit may take.
ROWS = 4
#: Pieces like no landmark that a worker remembers (8 bytes each).
REMEMBERED = 1_000_000
REGULAR, EPOCHS, ROUNDS = 1e-4, 60, 3
#: Likenesses in clean sentences, for each toxic one that holds a landmark, past which its disguises are not learnt.
CROWD = 4
#: Score of a text on the machine's border.
EDGE = 0.7

# characters that spell: letters in lower case, digits and bytes from 128 on; others may stand between them
_CODE = np.zeros(256, np.uint8)
_CODE[97:123] = np.arange(97, 123)
_CODE[65:91] = np.arange(97, 123)
_CODE[48:58] = np.arange(48, 58)
_CODE[128:] = np.arange(128, 256)


def _bits(letters: np.ndarray) -> np.ndarray:
    """One of 64 bits for each letter: its own for a to z and digits, shared ones for bytes from 128 on."""
    return U64(1) << np.where(letters >= 128, 36 + letters.astype(U64) % U64(28), np.where(letters >= 97, letters - U64(97), (letters - U64(48)) + U64(26)) & U64(63)).astype(U64)


def kernel(words: np.ndarray, landmark: np.ndarray) -> np.ndarray:
    """Gap-weighted subsequence kernel of LENGTH between each row of words (0-padded bytes) and landmark (bytes).

    Dynamic programming over both strings, all words at once. Zero bytes match nothing but count as gaps.
    """
    rows, width = words.shape
    size = len(landmark)
    near, close = np.float32(DECAY), np.float32(DECAY * DECAY)
    same = (np.ascontiguousarray(words.T)[:, None, :] == landmark[None, :, None]).astype(np.float32) * close
    table = np.ones((width + 1, size + 1, rows), np.float32)
    for level in range(1, LENGTH):
        then = np.zeros_like(table)
        for i in range(level, width + 1):
            line = np.zeros(rows, np.float32)
            for j in range(level, size + 1):
                line = near * line + same[i - 1, j - 1] * table[i - 1, j - 1]
                then[i, j] = near * then[i - 1, j] + line
        table = then
    return (same * table[:-1, :-1]).sum(axis=(0, 1), dtype=np.float64)


def _runs(short: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of short words whose `inside` is the same."""
    held = np.concatenate([[False], short, [False]])
    cut = np.concatenate([[True], inside[1:] != inside[:-1], [True]]) if len(inside) else np.ones(1, bool)
    return np.flatnonzero(short & (~held[:-2] | cut[:-1])), np.flatnonzero(short & (~held[2:] | cut[1:]))


class Spelled:
    """Pieces of the words of several texts: letters only, at most SPAN of them, with the first and last word of each.

    A longer word gives overlapping pieces of its whole. A run of one-letter words is a word as well, and in a sentence
    so are a run of words under LENGTH letters and two neighbours of at most JOINED. Every second letters are pieces too.
    """

    def __init__(self, words: Words):
        codes = _CODE[words.data]
        kept = codes > 0
        place = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(kept, out=place[1:])
        self.letters = codes[kept]
        start, end = place[words.start], place[words.end]
        owner = np.arange(len(start))
        size = end - start
        text = np.searchsorted(words.first, owner, side="right")
        sentence = _numbers(words)[words.start]
        first, last = [owner], [owner]
        for short, inside in ((size == 1, text), (size < LENGTH, sentence)):
            a, b = _runs(short, inside)
            first.append(a[b > a])
            last.append(b[b > a])
        two = np.flatnonzero((size[:-1] > 0) & (size[1:] > 0) & (size[:-1] + size[1:] <= JOINED) & (sentence[:-1] == sentence[1:]))
        spelled_out = len(first[1])
        first, last = np.concatenate([*first, two]), np.concatenate([*last, two + 1])
        start, end = start[first], end[last]
        # of these, other than words and spelled-out ones, letters next to each other only
        close = np.arange(len(start)) >= len(owner) + spelled_out
        long = end - start >= LENGTH
        start, end, first, last, close = start[long], end[long], first[long], last[long], close[long]
        # every second letter of single words, from the first and from the second on
        thin = np.flatnonzero((first == last) & (end - start >= 2 * LENGTH - 1))
        many = np.stack([end[thin] - start[thin] + 1, end[thin] - start[thin]], axis=1).ravel() // 2
        ahead = np.cumsum(many) - many
        begin = np.stack([start[thin], start[thin] + 1], axis=1).ravel()
        below = len(self.letters) + ahead
        self.letters = np.concatenate([self.letters, self.letters[np.repeat(begin - 2 * ahead, many) + 2 * np.arange(many.sum())]])
        long = many >= LENGTH
        start, end = np.concatenate([start, below[long]]), np.concatenate([end, (below + many)[long]])
        twice = np.repeat(thin, 2)[long]
        first, last = np.concatenate([first, first[twice]]), np.concatenate([last, last[twice]])
        close = np.concatenate([close, np.ones(len(twice), bool)])
        half = SPAN // 2
        many = np.where(end - start > SPAN, -(-(end - start) // half) - 1, 1)
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        self.start = np.repeat(start, many) + nth * half
        self.end = np.minimum(np.repeat(end, many), self.start + SPAN)
        self.owner, self.last, self.close = np.repeat(first, many), np.repeat(last, many), np.repeat(close, many)
        n = len(self.letters)
        powers, inverse = power_tables(n + 1)
        sums = np.zeros(n + 1, U64)
        np.cumsum((self.letters.astype(U64) + U64(1)) * powers[:n], out=sums[1:])
        self.name = (sums[self.end] - sums[self.start]) * inverse[self.start]
        # which letters each piece has
        self.bits = np.append(_bits(self.letters), U64(0))
        bounds = np.stack([self.start, self.end], axis=1).ravel()
        self.held = np.bitwise_or.reduceat(self.bits, bounds)[::2] if len(bounds) else np.zeros(0, U64)


def _best(first: np.ndarray, last: np.ndarray, got: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, value) of likenesses of words first to last. Joined words count if that beats each of them, and once."""
    single = first == last
    own = np.zeros(words + 1)
    np.maximum.at(own, first[single], got[single])
    a, b, v = first[~single], last[~single], got[~single]
    if len(a):
        more = v > np.maximum.reduceat(own, np.stack([a, b + 1], axis=1).ravel())[::2]
        a, b, v = a[more], b[more], v[more]
    alone = np.flatnonzero(own)
    if not len(a):
        return alone, own[alone]
    a, b, v = np.concatenate([alone, a]), np.concatenate([alone, b]), np.concatenate([own[alone], v])
    order = np.argsort(a, kind="stable")
    a, b, v = a[order], b[order], v[order]
    # those that share words are one likeness
    group = np.cumsum(np.append(0, a[1:] > np.maximum.accumulate(b)[:-1]))
    order = np.lexsort((-v, group))
    pick = order[np.unique(group[order], return_index=True)[1]]
    return a[pick], v[pick]


def _most(landmark: np.ndarray, norm: float) -> np.ndarray:
    """The most that the kernel of a string with so many of the landmark's kinds of letters can be, over the landmark's own.

    A subsequence weighs at most DECAY to the LENGTH in the string and comes at most once if no letter repeats. Each
    letter of the landmark that the string has beyond one of its kind at most doubles how often it comes.
    """
    weight: Counter[tuple[int, ...]] = Counter()
    for at in combinations(range(len(landmark)), LENGTH):
        weight[tuple(landmark[list(at)].tolist())] += DECAY ** (at[-1] - at[0] + 1)
    kinds = {c: _bits(np.array([c], np.uint8))[0].item() for c in set(landmark.tolist())}
    names = sorted(set(kinds.values()))
    out = np.zeros(65)
    for size in range(len(names) + 1):
        for held in combinations(names, size):
            whole = sum(w for u, w in weight.items() if all(kinds[c] in held for c in u))
            out[size] = max(out[size], whole * DECAY**LENGTH / norm)
    return out


@dataclass
class Model:
    landmarks: list[bytes]
    weights: np.ndarray  # of each landmark's normalised kernel, after the Nyström map
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def __post_init__(self):
        self.unlike = np.zeros(0, U64)
        self.codes = [_CODE[np.frombuffer(z, np.uint8)] for z in self.landmarks]
        self.norms = [float(kernel(z[None, :], z)[0]) for z in self.codes]
        self.masks = [np.bitwise_or.reduce(_bits(z)) for z in self.codes]
        # what shares a subsequence has the letters of one; a landmark that repeats letters has short sets of them
        self.needs = [min(np.bitwise_or.reduce(_bits(np.array(s))).item().bit_count() for s in combinations(z, LENGTH)) for z in self.codes]
        self.holds = [np.bitwise_and(_bits(np.arange(256, dtype=np.uint8)), m) > 0 for m in self.masks]
        self.most = [_most(z, norm) for z, norm in zip(self.codes, self.norms)]

    def word_features(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, landmark, value) of kernels that are not 0, each over the landmark's own and to the POWER."""
        at, which, value = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        spelled = Spelled(words)
        # equal pieces are computed once, and those like no landmark are remembered from step to step
        names, piece, alike = np.unique(spelled.name ^ spelled.close.astype(U64), return_index=True, return_inverse=True)
        unlike = self.unlike[np.minimum(np.searchsorted(self.unlike, names), max(0, len(self.unlike) - 1))] == names if len(self.unlike) else np.zeros(len(names), bool)
        held, open_, like = spelled.held[piece], ~unlike, np.zeros(len(names), bool)
        each_name = np.argsort(alike, kind="stable")
        bounds = np.searchsorted(alike[each_name], np.arange(len(names) + 1))
        for k, (mask, need) in enumerate(zip(self.masks, self.needs)):
            some = np.flatnonzero(open_ & (np.bitwise_count(held & mask) >= need))
            if not len(some):
                continue
            some = some[np.argsort(spelled.start[piece[some]], kind="stable")]  # reduceat also reads what lies between
            rows = piece[some]
            # the best window of the piece, with room for a letter between all
            size = len(self.codes[k])
            width = np.where(spelled.close[rows], size, 2 * size - 1)
            many = np.maximum(spelled.end[rows] - spelled.start[rows] - width, 0) + 1
            ahead = np.cumsum(many) - many
            start = np.repeat(spelled.start[rows] - ahead, many) + np.arange(many.sum())
            end = np.minimum(start + np.repeat(width, many), np.repeat(spelled.end[rows], many))
            # windows whose letters keep their kernel under LEAST are 0
            inside = np.zeros(len(spelled.letters) + 1, np.int32)
            np.cumsum(self.holds[k][spelled.letters], out=inside[1:])
            kinds = np.bitwise_count(np.bitwise_or.reduceat(spelled.bits, np.stack([start, end], axis=1).ravel())[::2] & mask)
            over = np.clip(inside[end] - inside[start] - kinds, 0, 12)
            each = np.zeros(len(start))
            may = np.flatnonzero(self.most[k][kinds] * (1 << over) >= LEAST)
            by_size = may[np.argsort((end - start)[may], kind="stable")]
            for low in range(0, len(may), 4096):
                pick = by_size[low : low + 4096]
                place = start[pick, None] + np.arange(end[pick[-1]] - start[pick[-1]])
                letters = np.where(place < end[pick, None], spelled.letters[np.minimum(place, len(spelled.letters) - 1)], 0)
                each[pick] = kernel(letters, self.codes[k])
            got = np.minimum(np.maximum.reduceat(each, ahead) / self.norms[k], 1.0)
            some, got = some[got >= LEAST], got[got >= LEAST]
            if not len(some):
                continue
            like[some] = True
            # all pieces of these names
            many = bounds[some + 1] - bounds[some]
            hit = each_name[np.repeat(bounds[some] - np.cumsum(many) + many, many) + np.arange(many.sum())]
            got = np.repeat(got, many)
            word, best = _best(spelled.owner[hit], spelled.last[hit], got, len(words.start))
            at.append(word)
            which.append(np.full(len(word), k))
            value.append(best**POWER)
        fresh = names[open_ & ~like]
        self.unlike = np.sort(np.concatenate([self.unlike, fresh])) if len(self.unlike) < REMEMBERED else fresh
        return np.concatenate(at), np.concatenate(which), np.concatenate(value)

    def decision(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Highest decision value of any sentence of each text."""
        words = Words(data, offsets)
        best = np.full(len(offsets) - 1, self.bias)
        at, which, value = self.word_features(words)
        if len(at):
            sentence = _numbers(words)[words.start[at]]
            _, first, back = np.unique(sentence, return_index=True, return_inverse=True)
            total = np.bincount(back, self.weights[which] * value) + self.bias
            text = np.searchsorted(words.first, at[first], side="right") - 1
            np.maximum.at(best, text, total)
        return best

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.decision(data, offsets) + self.shift, -30, 30)))


def _ends(data: np.ndarray) -> np.ndarray:
    """Bytes that end a sentence: line feeds, and . ! ? before white space or the end."""
    mark = (data == 46) | (data == 33) | (data == 63)
    return (data == 10) | mark & np.append(SPACES[data[1:]], True) if len(data) else np.zeros(0, bool)


def _numbers(words: Words) -> np.ndarray:
    """Number of the sentence that each byte is in: sentence ends, line breaks and texts' borders before it."""
    border = np.zeros(len(words.data) + 1, bool)
    border[1:] = _ends(words.data)
    border[words.offsets] = True
    return np.cumsum(border)


def sentences(text: str) -> list[bytes]:
    raw = text.encode()
    cuts = [0, *(np.flatnonzero(_ends(np.frombuffer(raw, np.uint8))) + 1).tolist(), len(raw)]
    return [s for a, b in zip(cuts, cuts[1:]) if (s := raw[a:b]).strip()]


def _distinct(texts: list[str]) -> list[str]:
    """Texts of which at least half of the sentences were not in those before: near copies would count as proof."""
    seen: set[bytes] = set()
    out = []
    for t in sorted(set(texts)):
        own = set(sentences(t))
        if len(own & seen) <= len(own) / 2:
            out.append(t)
        seen |= own
    return out


def _mine(toxic: list[str], clean: list[str], limit: int) -> list[bytes]:
    """Substrings of words that tell toxic texts apart, taken greedily by how many toxic texts' words they explain.

    A substring counts if the texts that hold it are toxic beyond chance, given how many substrings are tried.
    A word of a text is explained by the first substring taken from it.
    """

    def pieces(word: str) -> set[bytes]:
        raw = word.encode()
        whole = [c & 0xC0 != 0x80 for c in raw] + [True]  # places where a character begins
        return {raw[i : i + n] for n in (4, 5, 6, 7) for i in range(len(raw) - n + 1) if whole[i] and whole[i + n]}

    def fresh(texts: list[str]) -> list[set[str]]:
        """Words of each text, but for those that stand between the same two words in an earlier text: copies prove nothing."""
        seen: set[tuple[str, ...]] = set()
        out = []
        for text in texts:
            own = ["", *re.findall(r"[^\W_]+", text.lower()), ""]
            around = set(zip(own, own[1:], own[2:]))
            out.append({w for _, w, _ in around - seen})
            seen |= around
        return out

    against = Counter(p for ws in fresh(clean) for p in {p for w in ws for p in pieces(w)})
    texts = fresh(toxic)
    held = Counter(p for ws in texts for p in {p for w in ws for p in pieces(w)})
    share = len(toxic) / (len(toxic) + len(clean))
    tried = np.log(20 * len(held) + 1)

    def telling(p: bytes, t: int) -> bool:
        c = against[p]
        if t / (t + c) <= share:
            return False
        gain = t * np.log(t / (t + c) / share) + (c * np.log(c / (t + c) / (1 - share)) if c else 0)
        return gain > tried and c * len(toxic) * 20 < t * len(clean)

    good = {p for p, n in held.items() if n > 1 and telling(p, n)}
    where: dict[bytes, set[tuple[int, str]]] = {}
    for i, ws in enumerate(texts):
        for w in ws:
            for p in pieces(w) & good:
                where.setdefault(p, set()).add((i, w))
    chosen: list[bytes] = []
    while where and len(chosen) < limit:
        best = max(where, key=lambda p: (len(where[p]) * (held[p] / (held[p] + against[p])) ** 4, p))
        # a longer string around it that explains most of the same words is safer
        longer = [p for p in where if best in p and len(where[p]) >= 0.7 * len(where[best])]
        best = max(longer, key=lambda p: (len(p), len(where[p]), p))
        gone = set(where[best])
        chosen.append(best)
        rests = {p: s - gone if s & gone else s for p, s in where.items()}
        where = {p: s for p, s in rests.items() if s and telling(p, len({i for i, _ in s}))}
    return chosen


def _disguised(word: bytes) -> list[bytes]:
    """Spellings with a mark between all characters, a space at each place, a letter at each place and at any two, and a
    letter between all."""
    letters, places = [word[i : i + 1] for i in range(len(word))], range(1, len(word))
    once = [word[:i] + b"x" + word[i:] for i in places]
    twice = [word[:i] + b"x" + word[i:j] + b"x" + word[j:] for i in places for j in range(i, len(word))]
    return [b"-".join(letters)] + [word[:i] + b" " + word[i:] for i in places] + once + twice + [b"x".join(letters)]


def fit(toxic: list[str], clean: list[str], landmarks: int = LANDMARKS) -> Model:
    """Fits on whole sample texts. Without toxic or without clean texts, or without any telling string: a constant."""
    prior = (len(toxic) + 1) / (len(toxic) + len(clean) + 2)
    toxic, clean = _distinct(toxic), _distinct(sorted(set(clean) - set(toxic)))
    found = _mine(toxic, clean, landmarks) if toxic and clean else []
    if not found:
        return Model([], np.zeros(0), 0.0, 1.0, float(np.log(min(prior, 0.5) / (1 - min(prior, 0.5)))))
    model = Model(found, np.ones(len(found)), 0.0)
    gram = np.array([[kernel(z[None, :], y)[0] for y in model.codes] for z in model.codes])
    values, vectors = np.linalg.eigh((gram / np.sqrt(np.outer(model.norms, model.norms))) ** POWER)
    keep = values > 1e-6
    root = vectors[:, keep] / np.sqrt(values[keep])

    def features(parts: list[bytes]) -> np.ndarray:
        offsets = np.cumsum([0, *map(len, parts)])
        words = Words(np.frombuffer(b"".join(parts), np.uint8), offsets)
        at, which, value = model.word_features(words)
        out = np.zeros((len(parts), len(found)))
        text = np.searchsorted(words.first, at, side="right") - 1
        np.add.at(out, (text, which), value)
        return out

    bags = [sentences(t) for t in toxic]
    owner = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    raw = features([s for b in bags for s in b])
    plain = features([s for t in clean for s in sentences(t)])
    informative = plain[plain.sum(axis=1) > 0]
    # a landmark's spellings weigh as much as two sentences, however many there are; those of one that clean text comes
    # near to more often than toxic text holds it are left out
    crowded = (plain > 0).sum(axis=0) > CROWD * (raw > 0.9).sum(axis=0)
    forms = [_disguised(z) for z, full in zip(found, crowded) if not full]
    odd = features([d for f in forms for d in f])
    heavy = np.concatenate([np.zeros(0), *(np.full(len(f), 2 / len(f)) for f in forms)])
    # toxic documents' sentences without any landmark teach nothing about them
    negative = np.concatenate([informative, np.zeros((max(1, len(informative) // 4), len(found)))])
    weights, bias = np.ones(len(found)), 0.0
    for _ in range(ROUNDS):
        # of each toxic document, its highest sentence
        order = np.argsort(raw @ weights, kind="stable")
        top = np.zeros(len(bags), np.int64) - 1
        top[owner[order]] = order
        positive = np.concatenate([x for x in (raw[top[top >= 0]], odd)])
        counts = np.concatenate([np.ones((top >= 0).sum()), heavy])[positive.max(axis=1) > 0]
        positive = positive[positive.max(axis=1) > 0]
        x = np.concatenate([positive, negative]) @ root
        y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
        total = counts.sum() + len(negative)
        balance = np.concatenate([counts * total / (2 * max(1, counts.sum())), np.full(len(negative), total / (2 * len(negative)))])
        inner, bias = _svm(x, y, balance)
        weights = root @ inner
    margin = x @ inner + bias
    # a logistic curve as steep as the margins suggest; the machine's own border scores EDGE
    slope = _logistic(margin, y, balance)[0]
    return Model(found, weights, float(bias), slope, float(np.log(EDGE / (1 - EDGE))))


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared-hinge support vector machine by Newton steps on the rows inside the margin."""
    ones = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(ones.shape[1])
    penalty = REGULAR * len(x) * np.eye(len(w))
    penalty[-1, -1] = 1e-8
    for _ in range(EPOCHS):
        inside = y * (ones @ w) < 1
        part, c = ones[inside], cost[inside][:, None]
        then = np.linalg.solve(part.T @ (part * c) + penalty, part.T @ (y[inside][:, None] * c)[:, 0])
        if np.abs(then - w).max() < 1e-9:
            break
        w = w + 0.7 * (then - w)
    return w[:-1], float(w[-1])


def _logistic(margin: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[float, float]:
    a, b, target = 1.0, 0.0, (y + 1) / 2
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = cost * (p - target)
        h = cost * p * (1 - p) + 1e-9
        grad = np.array([(g * margin).sum() + 1e-2 * a, g.sum()])
        hess = np.array([[(h * margin * margin).sum() + 1e-2, (h * margin).sum()], [(h * margin).sum(), h.sum()]])
        step = np.linalg.solve(hess + 1e-9 * np.eye(2), grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(np.clip(a, 0.1, 20)), float(np.clip(b, -20, 20))


def remainder(parts: int) -> Column:
    """crc32 of the doc_id's text modulo parts; -1 without a doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts, F.lit(-1))


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list:
    """Rows (doc_id, text, toxic): a bounded sample that crc32(doc_id) mod 3 allows, about `sample` ids of each label.

    docs has doc_id and text, labels doc_id and toxic; other columns are ignored. Rows without an id, a label or a text
    and texts over LONGEST characters are left out. Of repeated labels the highest counts. Rows that repeat a doc_id are
    texts of their own, of which at most ROWS are taken, by a hash of the text.
    """
    allowed = labels.where((remainder(3) != 1) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    allowed = allowed.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("key", F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)))
    counts = {r.toxic: r.n for r in allowed.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for toxic, n in sorted(counts.items()):
        share = F.when(F.col("toxic") == toxic, F.lit(min(1.0, sample / n))).otherwise(share)
    picked = allowed.where(F.col("key") < share * 1_000_003).select("doc_id", "toxic")
    texts = docs.where(F.col("text").isNotNull() & (F.length("text") <= LONGEST)).select("doc_id", "text")
    # ids of about two samples, whatever the corpus
    rows = texts.join(F.broadcast(picked), "doc_id")
    nth = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    return rows.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= ROWS).select("doc_id", "text", "toxic").collect()


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on what `labelled` gives; equal texts count once. With empty tables, or one label only, the model is a constant."""
    rows = labelled(docs, labels, sample)
    return fit([r.text for r in rows if r.toxic == 1], [r.text for r in rows if r.toxic != 1])


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted: Model = model.value
        for batch in batches:
            ids = column(batch, "doc_id")
            for i, j, data, offsets in text_steps(column(batch, "text"), SCORED_BYTES):
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(fitted.scores(data, offsets))], names=["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score: one row for each row of docs (doc_id long, text string); higher is likelier toxic.

    Whole texts are scored. Null and empty texts score as a sentence without any telling word. Repeated rows score
    alike. Other columns are ignored. Empty tables give empty ones.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # LANDMARKS short strings
    return source.mapInArrow(_score(sent), "doc_id long, score double")


def score_of(text: Column, model: Model, spark) -> Column:
    """The score of a text column, for filters that keep all other columns out of Python; null and empty texts as in toxicity."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts))
        for i, j, data, offsets in text_steps(texts, SCORED_BYTES):
            out[i:j] = sent.value.scores(data, offsets)
        return pa.array(out)

    return scored(text)
