"""Toxicity: a subsequence string-kernel support vector machine with Nystroem landmarks, trained on labelled sentences.

The kernel of two words counts their common gapped subsequences of three symbols, a subsequence weighing ``decay`` to the
power of the span it takes (at most ``SPAN``), word ends being symbols too. So a word with characters put in or left out
stays near itself. It is normalised by each word's weight for its length.

Training takes a bounded sample: at most ``per_class`` labelled rows of each label, by hash of doc_id, none held out.
1. A sentence is the bag of its words and carries its document's label; one that a clean document has is clean. The toxic
   sentences of a document are one bag (copies of a text are one document): some word of it is toxic, which one isn't told.
   All words of clean sentences are clean.
2. A word's features are its kernel values to the landmarks, whitened (Nystroem). Landmarks are chosen by pivoted Cholesky
   steps among words of toxic sentences, and among clean ones.
3. A squared-hinge SVM is fitted by Newton steps, at first with all words of a toxic bag, which share its weight; then with
   the bag's witnesses: words that score above 0 by a model of other bags, and the bag's highest. Landmarks are then chosen
   anew, among witnesses and the clean words that score highest, and the SVM is fitted again; witnesses of several bags are
   examples with characters put in, too.
4. A second squared-hinge SVM is fitted on the sentences in stretches of at most ``STRETCH`` words. Its kernel counts common
   subsequences of one or two words, at most ``REACH`` words apart, so insults made of usual words are learned. Its features
   are explicit (hashed to ``2**BITS`` places), so it needs no landmarks. Witnesses are chosen in the same way.
5. A document's score pools its words' (the two highest, and how many of how many are in the first SVM's positive half) and
   its highest stretch, through a logistic curve fitted on all rows of the sample, their stretches scored by models of other
   documents, and on toxic texts whose witnesses have characters put in.

The decision is a weighted sum of kernels to landmarks, and the kernel a dot product of subsequence counts, so the landmarks
collapse into one weight for each of 64**3 subsequences: a table of 1 MB, broadcast with another 1 MB of the second SVM.
Every character and word of every text is scored with them in numpy, a segment of a text at a time, without a shuffle. Runs
of single characters between spaces are read as a word as well.

Cases: null text counts as empty; a text without words scores lowest. Null ids are never trained on. Without labels of both
kinds every score is 0. Repeated rows are scored each. An empty table gives no rows. Extra columns are never read.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, text_of
from tessera.llm.hashing import SEGMENT, U, span_hashes
from tessera.llm.quality import held_out, mixed, sample

SPAN, DECAY, SYMBOLS = 5, 0.7, 64
EDGE, SKIP, OTHER = 0, 1, 63
#: Letters with a symbol of their own; digits, then other letters, share the last ones.
LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßéèêëçàâîïôûùñáíóúæœåøãõ¿ž"
GAPS = [(i, j) for i in range(1, SPAN) for j in range(i + 1, SPAN)]
SPACED = re.compile(r"(?<!\S)(?:[^\W\d_][ \t]){2,}[^\W\d_](?!\S)")
SENTENCE = re.compile(r"[.!?]+(?=\s)|\n+")
BITS, REACH, STRETCH = 18, 3, 32
#: Where a long text is cut: after a sentence, else after a word that is no part of a run of single characters.
CUTS = re.compile(r"[.!?]\s|\n"), re.compile(r"\S\S\s")
WORD = re.compile(r"\S+")
#: Of the first SVM; and what a toxic text with characters put in counts for in the curve.
RIDGE, HIDDEN = 10.0, 0.05
STRIP = ".,;:!?\"'()[]{}<>|*$%&#"


def _code_table() -> np.ndarray:
    codes = np.full(0x250, SKIP, np.uint32)
    for c in range(0x250):
        if chr(c).isspace() or c < 32:
            codes[c] = EDGE
        elif chr(c).isdigit():
            codes[c] = OTHER - 1
        elif chr(c).isalpha():
            low = chr(c).lower()
            codes[c] = 2 + LETTERS.index(low) if low in LETTERS else OTHER
    return codes


CODES = _code_table()


def encode(text: str) -> np.ndarray:
    """Symbols of a text, with an edge before and after."""
    points = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), "<u4")
    if len(points) and points.max() >= len(CODES):
        wide = points >= len(CODES)
        codes = CODES[np.where(wide, 0, points)]
        kinds = {c: EDGE if chr(c).isspace() else OTHER if chr(c).isalpha() else SKIP for c in np.unique(points[wide]).tolist() if not 0xD800 <= c < 0xE000}
        codes[wide] = [kinds.get(c, SKIP) for c in points[wide].tolist()]
        return codes
    return CODES[points]


def norms(n: np.ndarray) -> np.ndarray:
    """The norm of words of n symbols, ends included: the root of the sum of squared weights, were all subsequences apart."""
    return np.sqrt(np.maximum(sum(np.maximum(n - j, 0) * DECAY ** (2 * (j + 1)) for _, j in GAPS), 1e-9))


def word_scores(codes: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Normalised sum of subsequence weights for each word of an encoded text."""
    edge = codes == EDGE
    at = np.cumsum(edge) - 1  # an edge opens the word after it
    n = int(at[-1])
    if n <= 0:
        return np.zeros(0)
    total = np.zeros(len(codes), np.float32)
    size = len(codes)
    ending = at - edge  # and closes the one before it
    high, mid = codes * np.uint32(SYMBOLS * SYMBOLS), codes * np.uint32(SYMBOLS)
    for i, j in GAPS:
        m = size - j
        if m <= 0:
            continue
        got = v[high[:m] + mid[i : i + m] + codes[j:]]
        got *= DECAY ** (j + 1)
        got *= (at[:m] == at[i : i + m]) & (at[:m] == ending[j:])
        total[:m] += got
    starts = np.flatnonzero(edge)
    length = np.diff(starts) + 1
    return np.add.reduceat(total, starts)[:n] / norms(length)


def parts(text: str) -> Iterator[str]:
    """Pieces of a long text, each about SEGMENT characters unless no cut is found; joined they are the text."""
    at = 0
    while len(text) - at > SEGMENT:
        found = CUTS[0].search(text, at + SEGMENT, at + 2 * SEGMENT) or CUTS[1].search(text, at + SEGMENT)
        if found is None:
            break
        yield text[at : found.end()]
        at = found.end()
    yield text[at:] if at else text


def document_features(text: str, v: np.ndarray, bias: float) -> np.ndarray:
    """The two highest word scores, and logarithms of the words in the SVM's positive half and of all words."""
    top, positive, n, read = [-3.0, -3.0], 0, 0, 0
    for part in parts(text):
        read += len(part)
        low = unicodedata.normalize("NFC", part if read == len(text) else part[:-1])  # a cut is one white space
        spaced = [m[0].replace(" ", "").replace("\t", "") for m in SPACED.finditer(low)]
        scores = word_scores(encode(" ".join([low, *spaced]) if spaced else low), v) + bias
        high = np.partition(scores, -2)[-2:] if len(scores) > 1 else scores
        top = sorted([*(top if n else top[: max(0, 2 - len(high))]), *high.tolist()])[-2:]
        positive, n = positive + int((scores > 0).sum()), n + len(scores)
    return np.array([top[1], top[0], np.log1p(positive), np.log1p(n)])


WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def stretches(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of word subsequences, their normalised weights and the stretch of each, stretches ascending from 0.

    A sentence's pairs of words belong to the stretch of the first word.
    """
    b = np.frombuffer(f"{text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)
    word = WORD_BYTE[b]
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, U), np.zeros(0), np.zeros(0, np.int64)
    words = mixed(span_hashes(b, starts, ends))
    stop = (b == 10) | (((b == 46) | (b == 33) | (b == 63)) & np.r_[b[1:] <= 32, True])
    sentence = np.cumsum(stop)[starts]
    first = np.r_[True, sentence[1:] != sentence[:-1]]
    here = np.arange(len(words))
    inside = here - np.maximum.accumulate(np.where(first, here, 0))
    of = np.cumsum(inside % STRETCH == 0) - 1
    keys, weights, owner = [words], [np.ones(len(words))], [of]
    for gap in range(1, REACH + 1):
        same = sentence[:-gap] == sentence[gap:]
        keys.append((words[:-gap] * U(31) + words[gap:] * U(37) + U(7))[same])
        weights.append(np.full(int(same.sum()), DECAY ** (gap - 1)))
        owner.append(of[:-gap][same])
    key, x, at = np.concatenate(keys), np.concatenate(weights), np.concatenate(owner)
    order = np.argsort(at, kind="stable")
    key, x, at = key[order], x[order], at[order]
    return mixed(key), x / np.sqrt(np.bincount(at, x * x))[at], at


def highest_stretch(text: str, u: np.ndarray) -> float:
    """The sentence SVM's score of a text's most toxic stretch; that of a text without words is the intercept's."""
    best = None
    for part in parts(text):
        key, x, at = stretches(part)
        if len(at):
            high = float(np.bincount(at, x * u[(key >> U(64 - BITS)).astype(np.int64)]).max())
            best = high if best is None else max(best, high)
    return float(u[-1] + (best or 0.0))


# --- training, in one task over the sample ---


class Sentences:
    """Stretches of the sample, each text's once, and the SVM over them."""

    def __init__(self, rows: list[tuple[int, str]]):
        keys, xs, units, self.doc, signs = [], [], [], [], []
        n = 0
        for i, part in ((i, p) for i, (_, t) in enumerate(rows) for p in parts(t)):
            key, x, at = stretches(part)
            if len(at):
                m = int(at[-1]) + 1
                signs.append(np.add.reduceat(key, np.flatnonzero(np.r_[True, at[1:] != at[:-1]])))
                keys.append((key >> U(64 - BITS)).astype(np.int32))
                xs.append(x.astype(np.float32))
                units.append(at + n)
                self.doc.append(np.full(m, i))
                n += m
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.key, self.x, unit, self.doc, sign = join(keys, np.int32), join(xs, np.float32), join(units, np.int64), join(self.doc, np.int64), join(signs, U)
        self.ends = np.r_[0, np.cumsum(np.bincount(unit, minlength=n))].astype(np.int64)
        self.y = np.array([y for y, _ in rows])[self.doc] if n else np.zeros(0, np.int64)
        self.usable = (self.y == 0) | ~np.isin(sign, sign[self.y == 0])

    def picked(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the units' entries, and the entries' unit in ``units``."""
        n = self.ends[units + 1] - self.ends[units]
        of = np.repeat(np.arange(len(units)), n)
        return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.ends[units][of], of

    def scores(self, u: np.ndarray) -> np.ndarray:
        return np.add.reduceat(u[self.key] * self.x, self.ends[:-1]) + u[-1] if len(self.doc) else np.zeros(0)

    def learn(self, units: np.ndarray, weight: np.ndarray, epochs: int = 3, batch: int = 512, alpha: float = 1.0, l1: float = 0.5, l2: float = 0.01) -> np.ndarray:
        """Weights by proximal steps with a rate for each place, the intercept last; squared hinge, mean weight one."""
        z, n, rng = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1), np.random.default_rng(3)
        limit = np.r_[np.full(1 << BITS, l1), 0.0]
        weights = lambda at: np.where(np.abs(z[at]) <= limit[at], 0.0, -(z[at] - np.sign(z[at]) * limit[at]) / ((0.1 + np.sqrt(n[at])) / alpha + l2))
        if not len(units):
            return np.zeros((1 << BITS) + 1)
        weight, target = weight / weight.mean(), np.where(self.y[units] == 1, 1.0, -1.0)
        for _ in range(epochs):
            order = rng.permutation(len(units))
            for lo in range(0, len(units), batch):
                some = order[lo : lo + batch]
                entry, of = self.picked(units[some])
                at, place = np.unique(np.r_[self.key[entry], 1 << BITS], return_inverse=True)
                w, x = weights(at), self.x[entry]
                lack = np.maximum(0, 1 - target[some] * (np.bincount(of, w[place[:-1]] * x, minlength=len(some)) + w[-1]))
                pull = -weight[some] * target[some] * lack
                g = np.bincount(place, np.r_[pull[of] * x, pull.sum()], minlength=len(at))
                z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
                n[at] += g * g
        return weights(np.arange(len(z)))

    def fit(self, folds: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """Weights of all documents' sentences, and each stretch's score by a model of other documents."""
        fold = self.doc % folds
        toxic = np.flatnonzero((self.y == 1) & self.usable)
        clean = np.flatnonzero(self.y == 0)
        weight = np.ones(len(self.doc))
        if len(toxic):
            weight[toxic] = 1 / np.bincount(self.doc[toxic])[self.doc[toxic]]  # documents weigh alike
        model, others = np.zeros((1 << BITS) + 1), np.zeros(len(self.doc))
        for again in (False, True):
            taken = toxic
            if again and len(toxic):
                best = np.full(int(self.doc.max()) + 1, -np.inf)
                np.maximum.at(best, self.doc[toxic], others[toxic])
                taken = toxic[(others[toxic] > 0) | (others[toxic] >= best[self.doc[toxic]])]
                weight[taken] = 1 / np.bincount(self.doc[taken])[self.doc[taken]]
            scale = len(clean) / weight[taken].sum() / 4 if len(taken) else 1.0
            full = np.r_[taken, clean]
            w = np.r_[weight[taken] * scale, np.ones(len(clean))]
            for f in range(folds):
                mine = fold[full] != f
                others[fold == f] = self.scores(self.learn(full[mine], w[mine]))[fold == f]
            if again:
                model = self.learn(full, w)
        return model, others


def entries(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Subsequences of words (none with white space within): the word of each, its place in the table, its normalised weight; by word."""
    codes = encode(" ".join(words)).astype(np.int64)
    edge = codes == EDGE
    at = np.cumsum(edge) - 1
    ending, norm = at - edge, 1 / norms(np.diff(np.flatnonzero(edge)) + 1)
    of, keys, values = [], [], []
    for i, j in GAPS:
        m = max(len(codes) - j, 0)
        a, b, c = codes[:m], codes[i : i + m], codes[j:]
        some = np.flatnonzero((at[:m] == at[i : i + m]) & (at[:m] == ending[j:]) & (a != SKIP) & (b != SKIP) & (c != SKIP) & (b != EDGE))
        of.append(at[some])
        keys.append(a[some] * SYMBOLS * SYMBOLS + b[some] * SYMBOLS + c[some])
        values.append(DECAY ** (j + 1) * norm[at[some]])
    of, keys, values = np.concatenate(of), np.concatenate(keys), np.concatenate(values)
    order = np.argsort(of, kind="stable")
    return of[order], keys[order], values[order]


def kernel(words: list[str], landmarks: list[str], white: np.ndarray | None = None, chunk: int = 512) -> np.ndarray:
    """Kernel values, words by landmarks (times ``white``, Nystroem features), a chunk of words at a time."""
    of, keys, values = entries(landmarks)
    known, place = np.unique(keys, return_inverse=True)
    dense = np.zeros((len(known), len(landmarks)))
    np.add.at(dense, (place, of), values)
    dense = (dense if white is None else dense @ white).astype(np.float32)
    out = np.zeros((len(words), dense.shape[1]), np.float32)
    for lo in range(0, len(words), chunk):
        of, keys, values = entries(words[lo : lo + chunk])
        place = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
        mine = np.flatnonzero(known[place] == keys) if len(known) else place[:0]
        if len(mine):
            of = of[mine]
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            out[lo + of[first]] = np.add.reduceat(dense[place[mine]] * values[mine, None].astype(np.float32), first)
    return out


def collapsed(landmarks: list[str], beta: np.ndarray) -> np.ndarray:
    """The table whose subsequence weights give the sum of kernels to ``landmarks`` times ``beta``."""
    of, keys, values = entries(landmarks)
    return np.bincount(keys, values * beta[of], SYMBOLS**3).astype(np.float32)


def squared_hinge(x: np.ndarray, toxic: np.ndarray, clean: np.ndarray, w: np.ndarray | None = None, ridge: float = RIDGE, steps: int = 12, chunk: int = 8192) -> np.ndarray:
    """SVM weights (the last is the intercept) by Newton steps, from ``w`` on; every row counts ``toxic`` times for one side and ``clean`` times for the other."""
    n, sides = x.shape[1], (toxic > 0, clean > 0)
    penalty = np.diag(np.r_[np.full(n, ridge), 1e-6])
    for step in range(steps + 1):
        if step or w is not None:
            f = x @ w[:-1].astype(np.float32) + w[-1]
            now = ((toxic > 0) & (f < 1), (clean > 0) & (f > -1))
            if step and all((a == b).all() for a, b in zip(now, sides, strict=True)):
                break
            sides = now
        up, down = toxic * sides[0], clean * sides[1]
        left, right = penalty.copy(), np.zeros(n + 1)
        active = np.flatnonzero(up + down)
        for lo in range(0, len(active), chunk):
            some = active[lo : lo + chunk]
            z = np.c_[x[some], np.ones(len(some), np.float32)]
            left += z.T @ (z * (up + down)[some, None].astype(np.float32))
            right += z.T @ (up - down)[some].astype(np.float32)
        w = np.linalg.solve(left, right)
    return w


def pivots(k: np.ndarray, weight: np.ndarray, most: int) -> list[int]:
    """Rows of a kernel matrix by pivoted Cholesky steps: each the one that those before it span least, times its weight."""
    rest, rows, found = np.diag(k) * weight, np.zeros((len(k), most)), []
    while len(found) < most and len(k):
        i, p = len(found), int(np.argmax(rest))
        if rest[p] <= 1e-6:
            break
        row = k[:, p] - rows[:, :i] @ rows[p, :i]
        rows[:, i] = row / math.sqrt(max(row[p], 1e-9))
        found.append(p)
        rest = np.maximum(np.diag(k) - (rows[:, : i + 1] ** 2).sum(1), 0) * weight
        rest[found] = 0
    return found


def originals(texts: list[str]) -> list[int]:
    """For each text the place of the first one it copies, or its own: a copy has more than half its runs of three words in an earlier text."""
    first: dict[tuple, list[int]] = defaultdict(list)
    found = []
    for i, t in enumerate(texts):
        words = [w.strip(STRIP).lower() for w in WORD.findall(t)]
        runs = {*zip(words, words[1:], words[2:], strict=False)} or {tuple(words)}
        shared: dict[int, int] = defaultdict(int)
        for r in runs:
            for j in first.get(r, ()):
                shared[j] += 1
        j = max(shared, key=lambda j: (shared[j], -j), default=i)
        if 2 * shared.get(j, 0) > len(runs):
            found.append(j)
            continue
        found.append(i)
        for r in runs:
            if len(first[r]) < 64:  # a run in more texts tells none of them from the others
                first[r].append(i)
    return found


def disguised(word: str, rng: np.random.Generator) -> str:
    """The word with one to three characters put in."""
    s = list(word)
    for _ in range(int(rng.integers(1, 4))):
        s.insert(int(rng.integers(1, len(s))) if len(s) > 1 else 1, "._-*x"[int(rng.integers(0, 5))])
    return "".join(s)


def words_of(text: str) -> set[str]:
    return {w for w in (w.strip(STRIP).lower() for w in WORD.findall(text)) if w}


class Bags:
    """Labelled sentences as bags of words: those of a toxic document that no clean one has are one bag, and of copies of a text only one counts."""

    def __init__(self, toxic: list[str], clean: list[str], most_clean: int):
        usual = {s for t in clean for s in SENTENCE.split(t)}
        found: dict[int, set] = defaultdict(set)
        for i, t in zip(originals(toxic), toxic, strict=True):
            for s in {*SENTENCE.split(t)} - usual:
                found[i] |= words_of(s)
        bags = [sorted(b) for b in found.values() if b]
        seen: dict[str, int] = defaultdict(int)
        for t in clean:
            for w in words_of(t):
                seen[w] += 1
        own = sorted({w for b in bags for w in b})
        rest = sorted(seen.keys() - {*own}, key=lambda w: (zlib.crc32(w.encode("utf-8", "surrogatepass")), w))[:most_clean]
        self.words, self.n = own + rest, len(bags)
        place = {w: i for i, w in enumerate(self.words)}
        self.bag = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
        self.word = np.array([place[w] for b in bags for w in b], np.int64)
        self.toxic = np.bincount(self.word, minlength=len(self.words)).astype(float)  # bags that have the word
        self.clean = np.array([seen.get(w, 0) for w in self.words], float)  # clean documents that have it

    def positive(self, chosen: np.ndarray, share: float) -> np.ndarray:
        """Weights of the words as toxic examples: a bag's chosen words share a weight of one; ``share`` is the sum's part of the clean side's."""
        each = np.bincount(self.bag[chosen], minlength=self.n)
        total = np.bincount(self.word[chosen], 1 / each[self.bag[chosen]], len(self.words))
        return total * (share * self.clean.sum() / max(total.sum(), 1e-9))

    def witnesses(self, f: np.ndarray) -> np.ndarray:
        """Places in the bags whose words score above 0, and each bag's highest."""
        best = np.full(self.n, -np.inf)
        np.maximum.at(best, self.bag, f)
        return np.flatnonzero((f > 0) | (f >= best[self.bag]))


def nystroem(landmarks: list[str]) -> np.ndarray:
    """Whitening of kernel values to ``landmarks``."""
    k = kernel(landmarks, landmarks).astype(float)
    s, u = np.linalg.eigh((k + k.T) / 2)
    keep = s > 1e-4 * s[-1]
    return u[:, keep] / np.sqrt(s[keep])


def fit_words(toxic: list[str], clean: list[str], landmarks: int = 160, most_clean: int = 30_000, pool: int = 3000, share: float = 0.25, folds: int = 2) -> tuple[np.ndarray, float, set[str]]:
    """Subsequence weights and intercept of the SVM over labelled sentences as bags of words, and its witnesses of several bags.

    ``landmarks`` is the number of each kind, ``most_clean`` of words of clean texts alone (by hash), ``pool`` of words that
    landmarks are chosen from: bounds of the sample, whatever the table's size.
    """
    bags = Bags(toxic, clean, most_clean)
    if not bags.n or not bags.clean.any():
        return np.zeros(SYMBOLS**3, np.float32), -1.0, set()
    lettered = np.array([any(c.isalpha() for c in w) for w in bags.words])
    fold = np.arange(bags.n) % folds

    def chosen_from(some: np.ndarray, weight: np.ndarray) -> list[str]:
        some = some[lettered[some]]
        some = some[np.argsort(-weight[some], kind="stable")[:pool]]
        names = [bags.words[i] for i in some]
        return [names[i] for i in pivots(kernel(names, names).astype(float), np.log1p(weight[some]), landmarks)]

    usual = np.where(bags.clean > 0, bags.clean, 0.1)
    land = chosen_from(np.flatnonzero(bags.toxic > 0), bags.toxic) + chosen_from(np.flatnonzero(bags.toxic == 0), usual)
    chosen = np.flatnonzero(bags.toxic[bags.word] + bags.clean[bags.word] > 1)  # at first all words of a bag but those no other text has
    for again in (False, True):
        land = list(dict.fromkeys(land))
        white = nystroem(land)
        x = kernel(bags.words, land, white)
        f, high = np.zeros(len(bags.bag)), np.zeros(len(x))
        for k in range(folds):  # scores by a model of other bags
            w = squared_hinge(x, bags.positive(chosen[fold[bags.bag[chosen]] != k], share), bags.clean, None if k == 0 else w)
            scores = x @ w[:-1].astype(np.float32) + w[-1]
            mine = fold[bags.bag] == k
            f[mine] = scores[bags.word[mine]]
            high += scores / folds
        chosen = bags.witnesses(f)
        told = np.bincount(bags.word[chosen], minlength=len(bags.words)).astype(float)
        if not again:  # landmarks anew: witnesses, and the clean words that score highest
            hard = np.argsort(-np.where(bags.clean > 0, high, -np.inf), kind="stable")[:pool]
            land = chosen_from(np.flatnonzero(told), told) + chosen_from(hard[bags.clean[hard] > 0], np.exp(np.clip(high, -5, 5)))
    # Virtual examples: words that are witnesses of several bags, with characters put in.
    rng, weight = np.random.default_rng(7), bags.positive(chosen, share)
    virtual = [(disguised(bags.words[i], rng), weight[i] / 3) for i in np.flatnonzero(told > 1) for _ in range(3)]
    made = kernel([v for v, _ in virtual], land, white) if virtual else x[:0]
    w = squared_hinge(np.r_[x, made], np.r_[weight, [v for _, v in virtual]], np.r_[bags.clean, np.zeros(len(virtual))], w)
    sure = {bags.words[i] for i in np.flatnonzero(told > 1) if x[i] @ w[:-1] + w[-1] > 0}
    return collapsed(land, white @ w[:-1]), float(w[-1]), sure


def fit(rows: list[tuple[int, str]], **bounds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Subsequence weights, the SVM's intercept before the logistic curve's weights, and the word-subsequence SVM's weights, from labelled texts."""
    flat, none, zero = np.zeros(SYMBOLS**3, np.float32), np.array([0.0, 0, 0, 0, 0, 0, -50]), np.zeros((1 << BITS) + 1, np.float32)
    toxic, clean = ([t for y, t in rows if y == k] for k in (1, 0))
    if not toxic or not clean:
        return flat, none, zero
    v, bias, sure = fit_words(toxic, clean, **bounds)
    held = Sentences(rows)
    u, others = held.fit()
    top = np.full(len(rows), u[-1], float)
    if len(held.doc):
        best = np.full(len(rows), -np.inf)
        np.maximum.at(best, held.doc, others)
        top = np.where(np.isfinite(best), best, top)
    x = np.c_[[document_features(t, v, bias) for _, t in rows], top]
    # Virtual examples again: toxic texts with characters put in their witnesses.
    rng = np.random.default_rng(11)
    hidden = [WORD.sub(lambda m: disguised(m[0], rng) if m[0].strip(STRIP).lower() in sure else m[0], t) for t in toxic]
    hidden = [t for t, old in zip(hidden, toxic, strict=True) if t != old]
    more = [np.r_[document_features(t, v, bias), highest_stretch(t, u)] for t in hidden]
    y = np.array([y for y, _ in rows] + [1] * len(more), float)
    weight = np.r_[np.ones(len(rows)), np.full(len(more), HIDDEN)]
    return v, np.r_[bias, logistic(np.array([*x, *more]), y, weight)], u.astype(np.float32)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, steps: int = 40, ridge: float = 2e-3) -> np.ndarray:
    """Weights and intercept by Newton steps, classes weighing alike, with targets drawn in and a ridge."""
    weight = np.ones(len(y)) if weight is None else weight
    middle, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.c_[(x - middle) / scale, np.ones(len(x))]
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    if not n.all():
        return np.r_[np.zeros(x.shape[1]), -50.0]
    total = np.bincount(y.astype(int), weight)
    target, weight, w = np.where(y == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2)), weight / total[y.astype(int)], np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        gradient = z.T @ (weight * (p - target)) + ridge * w
        w = w - np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), gradient)
    return np.r_[w[:-1] / scale, w[-1] - (w[:-1] * middle / scale).sum()]


def logit(text: str, v: np.ndarray, curve: np.ndarray, u: np.ndarray) -> float:
    return float(document_features(text, v, curve[0]) @ curve[1:-2] + highest_stretch(text, u) * curve[-2] + curve[-1])


def train(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, curve, u = fit([x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)])
        yield pa.RecordBatch.from_arrays([*(pa.array([w.astype("<f4").tobytes()], pa.binary()) for w in (v, u)), pa.array([curve.tolist()])], names=["v", "u", "curve"])

    one = rows.repartition(1).sortWithinPartitions("doc_id", "text").select("y", "text")
    got = one.mapInArrow(run, "v binary, u binary, curve array<double>").collect()
    return (np.frombuffer(got[0]["v"], "<f4"), np.array(got[0]["curve"]), np.frombuffer(got[0]["u"], "<f4")) if got else fit([])


def score_toxicity(docs: DataFrame, labels: DataFrame, least: float = 0.5, per_class: int = 2500) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(train(sample(docs, labels, "toxic", per_class)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, curve, u = model.value
        for b in batches:
            scores = 1 / (1 + np.exp(-np.clip([logit(t.as_py(), v, curve, u) for t in b.column(2)], -50, 50)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64()), pa.array((scores >= least).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
