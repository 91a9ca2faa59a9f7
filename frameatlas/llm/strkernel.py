"""Gap-weighted subsequence string kernel with Nyström landmarks, and a linear SVM on top.

Two texts are alike as far as they share subsequences of ``p`` letters; each
occurrence counts ``DECAY`` to the power of the letters it skips, and spans at most
``window`` letters.  Inserted or left-out letters therefore cost weight, not the
match.  Values are divided by the norms of both texts' occurrence weights.

``Machine`` maps texts to their kernel values with the landmarks, whitened by the
landmarks' own kernel matrix, and trains a squared-hinge SVM there.  As the decision
is linear in the hashed subsequence space, it folds into one weight table of
``2**BITS`` floats (half a MB), which is all that executors need.

Letters of every script count: a letter is its code point, letters that look like
Latin ones are read as those, and marks belong to their letters.
"""

from __future__ import annotations

import html
import itertools
import re
import unicodedata

import numpy as np
import regex

from frameatlas.runtime import single_blas_thread

BITS, DECAY = 17, 0.6
SHAPES = ((3, 4), (4, 5), (5, 6))  # (letters, window)
PAD = 8
CHUNK = 1 << 14  # letters scored at a time, so that the arrays stay in the cache
_SPACED = re.compile(r"(?<!\S)(?:[^\W\d_] ){2,}[^\W\d_](?!\S)")
_STARRED = re.compile(r"(?:[^\W\d_]\*){2,}[^\W\d_]")
_STRETCH = re.compile(r"([^\W\d_])\1{2,}")
_MIXED = re.compile(r"[a-z0-9@$]*(?:[0-9@$][a-z]|[a-z][0-9@$])[a-z0-9@$]*")
_LEET = str.maketrans("013457@$", "oieastas")
# the look-behind stands after the first digit: a pattern that starts with digits is found faster
_NUMBER = re.compile(r"[0-9](?<![\w@$][0-9])[0-9]*(?![\w@$])")
# a full stop after a single letter ends no sentence: spelled-out words stay whole
_END = re.compile(r"[.!?;:…](?<![\s.]\w\.)\s+|[。！？\n]+")
_TAG = re.compile(r"<[^<>]{1,80}>")
_BLANKED = {i: " " for i in range(128) if not (chr(i).isalnum() or chr(i) == "*")}
_BLANKED_BUT_0 = {i: " " for i in _BLANKED if i}
_REST = regex.compile(r"[^\p{L}\p{M}\p{N}*]+")
_DIGITS = re.compile(r"[0-9]+")
_NO_DIGITS = {ord(c): "0" for c in "123456789"}
_FOREIGN = re.compile("[^\x00-\x7f]")
# fixed values: letters that don't show
_HIDDEN = frozenset(map(chr, [0xAD, *range(0x200B, 0x2010), *range(0x2060, 0x2065), 0xFEFF, 0x34F]))
_REST = regex.compile(r"[^\p{L}\p{M}\p{N}*]+")
_DIGITS = re.compile(r"[0-9]+")
_NO_DIGITS = {ord(c): "0" for c in "123456789"}
# hidden letters and accents to drop; fixed values: ranges of combining marks
_ODD = dict.fromkeys(map(ord, "­​‌‍‎‏⁠⁡⁢⁣⁤﻿͏"), None) | {ord("ß"): "ss", 0: "\0"}
_MARKS = dict.fromkeys([*range(0x300, 0x370), *range(0x1AB0, 0x1B00), *range(0x20D0, 0x2100), *range(0xFE20, 0xFE30)], None)
# fixed values: letters of other scripts that are drawn like Latin ones
_ALIKE = str.maketrans("авекмнорстухіјѕԁһӏԛԝαεικνορτυχ", "abekmhopctyxijsdhlqwaeiknoptux")


class _Fold(dict):
    """What a letter outside ASCII is read as: lower case, without accent, as the Latin letter it looks like; hidden ones as nothing."""

    def __missing__(self, c: str) -> str:
        t = unicodedata.normalize("NFKD", c.lower()).lower().replace("ß", "ss")
        self[c] = t = "".join(x for x in t if not unicodedata.combining(x) and x not in _HIDDEN).translate(_ALIKE)
        return t


_FOLD = _Fold()


def _folded(t: str) -> str:
    t = t.lower()
    return t if t.isascii() else _FOREIGN.sub(lambda m: _FOLD[m.group()], t)


def _undone(t: str) -> str:
    """A folded sentence without spacing out, stretching or digits for letters; letters, digits as 0, stars and blanks only."""
    t = _MIXED.sub(lambda m: m.group().translate(_LEET), t)
    t = " ".join((t.translate(_BLANKED) if t.isascii() else _REST.sub(" ", t)).split())
    t = _SPACED.sub(lambda m: m.group().replace(" ", ""), t)
    t = _STARRED.sub(lambda m: m.group().replace("*", ""), t)
    return _DIGITS.sub("0", _STRETCH.sub(r"\1", t))


# classes of ASCII letters: 1 letter, 2 digit or sign read as a letter, 4 star, 8 blank
_CLASS = np.full(128, 8, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 1
for _c in "0123456789@$":
    _CLASS[ord(_c)] = 2
_CLASS[ord("*")] = 4


def normal_all(sentences: list[str]) -> list[str]:
    """All sentences normalised; those with nothing to undo (found in one sweep over all of them) take a short way."""
    if not sentences:
        return []
    flat = [s.replace("\0", " ") if "\0" in s else s for s in sentences]
    other = [i for i, s in enumerate(flat) if not s.isascii()]
    for i, s in zip(other, _folded("\0".join(flat[i] for i in other)).split("\0")):
        flat[i] = s
    easy = [i for i, s in enumerate(flat) if s.isascii()]
    out = ["" if s.isascii() else _undone(s) for s in flat]
    if not easy:
        return out
    low = "\0\0\0".join(flat[i] for i in easy).lower() + "\0\0\0"
    code = np.frombuffer(low.encode("ascii"), np.uint8)
    cls = _CLASS[code]
    one, two = cls[:-1], cls[1:]
    odd = np.zeros(len(code), bool)
    odd[:-1] = ((one | two) == 3) | (one == 4)  # a digit beside a letter, a star
    odd[:-2] |= (code[:-2] == code[1:-1]) & (code[1:-1] == code[2:]) & (cls[:-2] == 1)  # stretched
    lone = np.zeros(len(code) + 3, bool)
    lone[:-3] = cls == 1
    lone[1:-3] &= cls[:-1] != 1
    lone[:-4] &= cls[1:] != 1
    pair = lone[:-3] & (lone[2:-1] | lone[3:])
    odd[:-3] |= pair[:-3] & (pair[2:-1] | pair[3:])  # spaced out: three lone letters in a row
    starts = np.concatenate([[0], np.cumsum(np.array([len(flat[i]) + 3 for i in easy]))[:-1]])
    hard = np.logical_or.reduceat(odd, starts)
    blanked = low.translate(_BLANKED_BUT_0).split("\0\0\0")
    for i, h, t in zip(easy, hard.tolist(), blanked):
        out[i] = _undone(flat[i].lower()) if h else " ".join(t.split())
    return "\n".join(out).translate(_NO_DIGITS).split("\n")


def raw_sentences(text: str) -> list[str]:
    """The sentences of a text as written, without markup and with free-standing numbers as 0."""
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", html.unescape(text))
    text = _NUMBER.sub("0", text)
    out, at = [], 0
    for m in _END.finditer(text):
        out.append(text[at : m.start() + 1])
        at = m.end()
    out.append(text[at:])
    return out


def windows(s: str, longest: int = 160, overlap: int = 60) -> list[str]:
    """A normalised sentence; a longer one in overlapping windows cut at spaces."""
    out = []
    while len(s) > longest:
        cut = s.rfind(" ", overlap + 1, longest)
        cut = longest if cut < 0 else cut
        out.append(s[:cut])
        back = s.find(" ", cut - overlap)
        s = s[back + 1 if 0 <= back < cut else cut :].strip()
    if s:
        out.append(s)
    return out


def sentences(text: str) -> list[str]:
    """Normalised sentences of a text, long ones in windows."""
    return [w for s in normal_all(raw_sentences(text)) for w in windows(s)]


# fixed multipliers of the letters of a subsequence (odd, 32 bits)
_FACTORS = [np.uint32((pow(0x9E3779B97F4A7C15, j + 3, 1 << 61) >> 17) & 0xFFFFFFFF | 1) for j in range(8)]
# subsequence shapes by (letters, last offset): weight and middle offsets
_GROUPS = [(p, last, np.float32(DECAY ** (last + 1 - p)), list(itertools.combinations(range(1, last), p - 2))) for p, w in SHAPES for last in range(p - 1, w)]


def _codes(texts: list[str]):
    """Code points of the joined texts, padded so that no subsequence spans two texts; starts of the texts."""
    joined = ("\0" * PAD).join(f" {t} " for t in texts) + "\0" * PAD
    code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    lengths = np.array([len(t) + 2 + PAD for t in texts])
    return code, len(code) - PAD, np.concatenate([[0], np.cumsum(lengths)[:-1]])


def _sweeps(code: np.ndarray, n: int):
    """``(hashed ids, validity, weight)`` of every group of shapes with equal letters and span."""
    full = code != 0
    scaled: list[np.ndarray] = []
    for p, last, weight, middles in _GROUPS:
        while len(scaled) < p:
            scaled.append(code * _FACTORS[len(scaled)])
        ends = scaled[0][:n] + scaled[p - 1][last : last + n]
        ids = []
        for mid in middles:
            h = ends
            for j, o in enumerate(mid, 1):
                h = h + scaled[j][o : o + n]
            ids.append((h >> np.uint32(32 - BITS)).astype(np.intp))
        # both ends inside a text: the padding is wider than any span
        yield ids, full[:n] & full[last : last + n], weight


def _chunks(texts: list[str], size: int):
    lo, have = 0, 0
    for i, t in enumerate(texts):
        have += len(t) + PAD + 2
        if have >= size or i + 1 == len(texts):
            yield lo, i + 1
            lo, have = i + 1, 0


def sparse(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed ids and normalised weights of every subsequence of every text."""
    out = []
    for lo, hi in _chunks(texts, 1 << 17):
        code, n, starts = _codes(texts[lo:hi])
        ids, ok, w = [], [], []
        for group, valid, weight in _sweeps(code, n):
            ids.extend(group)
            ok.extend([valid] * len(group))
            w.extend([weight] * len(group))
        ids, ok, w = np.array(ids, np.int32), np.array(ok), np.array(w, np.float32)[:, None]
        for a, t in zip(starts, texts[lo:hi]):
            own = slice(a, a + len(t) + 2)
            use = ok[:, own]
            v = np.broadcast_to(w, use.shape)[use]
            out.append((ids[:, own][use], v / max(1e-9, float(np.sqrt(v @ v)))))
    return out


def score(texts: list[str], table: np.ndarray, rarity: np.ndarray, bias: float) -> np.ndarray:
    """Decision values of all texts, swept in chunks that fit the cache."""
    out = np.zeros(len(texts))
    both = np.empty(1 << BITS, np.complex64)  # weight and squared rarity in one look-up
    both.real, both.imag = table, rarity * rarity
    for lo, hi in _chunks(texts, CHUNK):
        code, n, starts = _codes(texts[lo:hi])
        top, norm = np.zeros(n, np.float32), np.zeros(n, np.float32)
        for ids, ok, weight in _sweeps(code, n):
            a = both.take(ids[0], mode="clip")
            for j in ids[1:]:
                a += both.take(j, mode="clip")
            use = ok * weight
            top += a.real * use
            norm += a.imag * (use * weight)
        out[lo:hi] = np.add.reduceat(top, starts) / np.sqrt(np.maximum(np.add.reduceat(norm, starts), 1e-9)) + bias
    return out


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float, start: np.ndarray | None = None) -> np.ndarray:
    """Primal Newton for the squared hinge; the last weight is the (unpenalised) bias."""
    a = np.c_[z, np.ones(len(z), z.dtype)]
    w = np.zeros(a.shape[1]) if start is None else start.copy()
    reg = np.ones(a.shape[1])
    reg[-1] = 1e-6
    for _ in range(12):
        slack = 1 - y * (a @ w)
        on = slack > 0
        ao, wo = a[on], weight[on].astype(a.dtype)
        grad = reg * w - 2 * c * (ao.T @ (wo * y[on] * slack[on]))
        hess = np.diag(reg) + 2 * c * ((ao.T * wo) @ ao).astype(np.float64)
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-2 * max(1.0, np.abs(w).max()):
            break
    return w


class Machine:
    """Kernel values of texts with fixed landmarks, whitened; texts may be added.

    Every hashed subsequence is weighed by its rarity among the first texts.
    """

    def __init__(self, texts: list[str], landmarks: list[int], block: int = 100):
        single_blas_thread()
        raw = sparse(texts)
        self.rarity = rarities([ids for ids, _ in raw])
        feats = [self._weigh(f) for f in raw]
        self.marks, self.block = [feats[i] for i in landmarks], block
        k = self._kernel(feats)
        own = k[landmarks].astype(np.float64)
        val, vec = np.linalg.eigh((own + own.T) / 2)
        keep = val > 1e-4 * val.max()
        self.white = (vec[:, keep] / np.sqrt(val[keep])).astype(np.float32)
        self.z = k @ self.white

    def add(self, texts: list[str]) -> None:
        self.z = np.concatenate([self.z, self._kernel([self._weigh(f) for f in sparse(texts)]) @ self.white])

    def _kernel(self, feats) -> np.ndarray:
        k = np.zeros((len(feats), len(self.marks)), np.float32)
        room = np.empty((max((len(ids) for ids, _ in feats), default=0), self.block), np.float32)
        for lo in range(0, len(self.marks), self.block):
            part = self.marks[lo : lo + self.block]
            base = np.zeros((1 << BITS, self.block), np.float32)
            for j, (ids, w) in enumerate(part):
                np.add.at(base[:, j], ids, w)
            for i, (ids, w) in enumerate(feats):
                near = np.take(base, ids, axis=0, out=room[: len(ids)], mode="clip")
                k[i, lo : lo + len(part)] = (w @ near)[: len(part)]
        return k

    def _weigh(self, f):
        ids, w = f
        w = w * self.rarity[ids]
        return ids, (w / max(1e-9, float(np.sqrt(w @ w)))).astype(np.float32)

    def fit(self, rows: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float, start: np.ndarray | None = None) -> np.ndarray:
        return _svm(self.z[rows], y, weight, c, start)

    def values(self, w: np.ndarray, rows: np.ndarray | slice) -> np.ndarray:
        return self.z[rows] @ w[:-1] + w[-1]

    def table(self, w: np.ndarray) -> np.ndarray:
        """The decision as one weight per hashed subsequence (the bias apart)."""
        out = np.zeros(1 << BITS, np.float64)
        for a, (ids, v) in zip(self.white @ w[:-1], self.marks):
            np.add.at(out, ids, a * v)
        return (out * self.rarity).astype(np.float32)


def rarities(lists: list[np.ndarray]) -> np.ndarray:
    """Inverse frequency of every hashed subsequence among the texts, between 0.15 and 1."""
    seen = np.zeros(1 << BITS)
    for ids in lists:
        seen[ids] += 1
    return np.clip(np.log((1 + len(lists)) / (1 + seen)) / np.log(1 + len(lists)), 0.15, 1.0).astype(np.float32)
