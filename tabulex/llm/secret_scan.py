"""Secret scanning by a linear-chain conditional random field, beside fixed patterns.

Tokens are runs of the characters that secrets are made of. Each token is
tagged secret-begin, secret-inside or outside; a line's tokens are one chain.
Features are the token's shape, its neighbours and the text around it. The field
is fitted on a bounded sample that the patterns label, and on secrets and
harmless tokens made up at random in the same texts; half of the time it doesn't
see the neighbours, so that it also knows secrets that nothing announces.

Tokens and features of many texts are made by array operations on their bytes.
Viterbi is exact but short: a token whose outside score leads by more than any
transitions could make up is outside on every best path, and the chain falls
into independent parts there.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import find, numbered, parallelism, pick, reach, slices, spread, tidy
from .shingles import mix

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are taken whole, so shorter ones never stand in a longer one's way
#: An assignment has one of these; most texts have none.
HINTS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex")

#: Texts with a token of so many bytes that has a digit are sampled for the fit, and the stretch around it.
LEAST = 12
DIM = 1 << 14  # features by hash; row DIM of the weights is that of no feature
BEGIN, INSIDE, OUTSIDE = 0, 1, 2
#: Bytes whose tokens are made together, and of texts that are decoded together.
BLOCK = 1 << 20


def patterns(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches, in order of start, then kind."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)



#: Kinds of bytes: none of a token's, a-z, A-Z, 0-9, signs.
KIND = np.zeros(256, np.uint8)
KIND[ord("a") : ord("z") + 1], KIND[ord("A") : ord("Z") + 1], KIND[ord("0") : ord("9") + 1] = 1, 2, 3
KIND[list(b"+/_.=-")] = 4
HEXES, NUMBERS = np.zeros(256, bool), np.zeros(256, bool)
HEXES[list(b"0123456789abcdef")] = NUMBERS[list(b"0123456789.-+")] = True
#: Signs that tell something before a token.
SIGN = np.zeros(256, np.int64)
SIGN[list(b"=:\"'@$ ")] = range(1, 8)
with np.errstate(over="ignore"):
    POWERS = np.cumprod(np.full(1024, 0x9E3779B97F4A7C15 | 1, np.uint64))

OWN = ("bias", "length", "shape", "set", "digits", "upper", "signs", "distinct", "varied", "switches", "hex", "start", "number")
AROUND = ("left", "left but one", "right", "sign", "after", "file signs", "file length")
FEATURES = {name: i for i, name in enumerate(OWN + AROUND)}


def spot(feature: str, value: np.ndarray) -> np.ndarray:
    """The weights' rows of a feature's values."""
    return (mix(np.asarray(value).astype(np.uint64) ^ np.uint64(FEATURES[feature] << 56)) % np.uint64(DIM)).astype(np.int64)


def run_hashes(data: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash of each run of bytes; the runs lie in ``data`` one after another."""
    if not len(length):
        return np.zeros(0, np.uint64)
    first = np.cumsum(length) - length
    at = (np.arange(len(data)) - np.repeat(first, length)) & 1023
    return mix(np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * POWERS[at], first) + length.astype(np.uint64))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(mask.view(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


def own_features(data: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Of the shapes of tokens, whose bytes lie in ``data`` one after another: a row for each, a column for each of OWN."""
    n, kind = len(length), KIND[data]
    first = np.cumsum(length) - length
    who = np.repeat(np.arange(n), length)
    at = np.arange(len(data)) - first[who]
    count = {k: np.bincount(who[kind == k], minlength=n) for k in (1, 2, 3, 4)}
    low = np.bitwise_or.reduceat(np.where(data < 64, np.uint64(1) << (data & 63).astype(np.uint64), np.uint64(0)), first)
    high = np.bitwise_or.reduceat(np.where(data >= 64, np.uint64(1) << (data & 63).astype(np.uint64), np.uint64(0)), first)
    distinct = np.bitwise_count(low).astype(np.int64) + np.bitwise_count(high)
    change = np.r_[False, kind[1:] != kind[:-1]] & (at > 0)
    step = np.cumsum(change)
    rank = step - step[first][who]
    shown = (change | (at == 0)) & (rank < 6)
    shape = np.bincount(who[shown], kind[shown] * 5.0 ** rank[shown], n).astype(np.int64)
    starts = at < 4
    kinds = np.bincount(who[starts], kind[starts] * 8.0 ** at[starts], n).astype(np.int64)
    letters = np.bincount(who[starts], data[starts] * 256.0 ** at[starts], n).astype(np.int64) + (1 << 40)
    half = length // 2
    values = {
        "bias": np.zeros(n),
        "length": np.minimum(12, length // 4),
        "shape": shape,
        "set": sum((count[k] > 0) << k for k in count),
        "digits": (5 * count[3] + half) // length,
        "upper": (5 * count[2] + half) // length,
        "signs": np.minimum(4, count[4]),
        "distinct": np.minimum(31, distinct),
        "varied": 8 * distinct // length,
        "switches": (8 * np.bincount(who[change], minlength=n) + half) // length,
        "hex": 2 * np.logical_and.reduceat(HEXES[data], first) + (length >= 32),
        "start": np.where(count[2] > 0, letters, kinds),
        "number": 2 * np.logical_and.reduceat(NUMBERS[data], first) + (count[3] == length),
    }
    return np.stack([spot(f, values[f]) for f in OWN], axis=1)


@dataclass
class Tokens:
    """Tokens of some texts, in order."""

    start: np.ndarray  # in the text, in bytes
    end: np.ndarray
    text: np.ndarray
    line: np.ndarray
    kind: np.ndarray  # the row of ``own`` that the token has
    own: np.ndarray  # features of different tokens
    around: np.ndarray  # features of each token, DIM for none


def tokens_of(texts: list[bytes]) -> Tokens:
    """The tokens of whole texts with their features.

    Neighbouring words are the last two runs of letters that end up to 40 bytes
    before a token and the first that begins under 20 after it, in its text;
    signs are those of the four bytes before it.
    """
    buf = np.frombuffer(b"\n".join(texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(size + 1) - size - 1
    token = KIND[buf] > 0
    starts, ends, names, owns, word_start, word_end, word_hash = [], [], [], [], [], [], []
    lo = made = 0
    while lo < len(buf):
        hi = min(lo + BLOCK, len(buf))
        if hi < len(buf):  # no token is cut
            gap = np.flatnonzero(~token[lo:hi])
            hi = lo + int(gap[-1]) + 1 if len(gap) else hi + int(np.argmax(~token[hi:])) if not token[hi:].all() else len(buf)
        s, e = runs(token[lo:hi])
        if len(s):
            part, inside = buf[lo:hi], token[lo:hi]
            data, length = part[inside], e - s
            _, first, kind = np.unique(run_hashes(data, length), return_index=True, return_inverse=True)
            one = np.zeros(len(s), bool)
            one[first] = True
            order = np.argsort(first)  # own_features goes through the tokens in order
            place = np.empty(len(first), np.int64)
            place[order] = np.arange(len(first))
            owns.append(own_features(data[np.repeat(one, length)], length[one]))
            names.append(place[kind] + made)
            made += len(first)
            low = data | np.uint8(32)
            letter = KIND[part]
            letter = (letter == 1) | (letter == 2)
            ws, we = runs(letter)
            word_start.append(ws + lo)
            word_end.append(we + lo)
            word_hash.append(run_hashes(low[letter[inside]], we - ws))
            starts.append(s + lo)
            ends.append(e + lo)
        lo = hi
    if not starts:
        none = np.zeros(0, np.int64)
        return Tokens(none, none, none, none, none, np.zeros((0, len(OWN)), np.int64), np.zeros((0, len(AROUND)), np.int64))
    s, e = np.concatenate(starts), np.concatenate(ends)
    ws, we, wh = np.concatenate(word_start), np.concatenate(word_end), np.concatenate(word_hash)
    text = np.searchsorted(begin, s, side="right") - 1
    first, last = begin[text], begin[text] + size[text]
    around = np.full((len(s), len(AROUND)), DIM, np.int64)
    if len(ws):
        before = np.searchsorted(we, s, side="right") - 1
        for column, j in (("left", before), ("left but one", before - 1)):
            k = np.maximum(j, 0)
            ok = (j >= 0) & (ws[k] >= first) & (s - we[k] <= 40)
            around[ok, AROUND.index(column)] = spot(column, wh[k[ok]])
        j = np.searchsorted(ws, e, side="left")
        k = np.minimum(j, len(ws) - 1)
        ok = (j < len(ws)) & (ws[k] < last) & (ws[k] - e < 20)
        around[ok, AROUND.index("right")] = spot("right", wh[k[ok]])
    signs = np.zeros(len(s), np.int64)
    for back in (4, 3, 2, 1):
        here = np.where(s - back >= first, SIGN[buf[np.maximum(s - back, 0)]], 0)
        signs = np.where(here > 0, signs * 8 + here, signs)
    around[:, AROUND.index("sign")] = spot("sign", signs)
    after = np.where(e < last, np.minimum(buf[np.minimum(e, len(buf) - 1)], 128), 129)
    around[:, AROUND.index("after")] = spot("after", after)
    marks = np.array([t.count(b"=") + t.count(b"{") for t in texts], np.int64)
    around[:, AROUND.index("file signs")] = spot("file signs", np.minimum(5, 200 * marks // np.maximum(1, size)))[text]
    around[:, AROUND.index("file length")] = spot("file length", np.minimum(8, np.log2(np.maximum(1, size)).astype(np.int64) // 2))[text]
    line = np.searchsorted(np.flatnonzero(buf == 10), s)
    return Tokens(s - first, e - first, text, line, np.concatenate(names), np.concatenate(owns), around)


class Field:
    """Weights of features and transitions; OUTSIDE stands before and after each chain."""

    def __init__(self) -> None:
        self.w = np.zeros((DIM + 1, 3))
        self.w[spot("bias", np.zeros(1)), OUTSIDE] = 1  # without any training nothing is a secret
        self.t = np.zeros((3, 3))
        self.t[OUTSIDE, INSIDE] = -1e4  # an inside needs a begin

    def viterbi(self, s: np.ndarray) -> list[int]:
        """The best tags of one chain of scored tokens."""
        best, back = self.t[OUTSIDE] + s[0], []
        for i in range(1, len(s)):
            m = best[:, None] + self.t
            back.append(m.argmax(axis=0))
            best = m.max(axis=0) + s[i]
        tag = int((best + self.t[:, OUTSIDE]).argmax())
        tags = [tag]
        for b in reversed(back):
            tag = int(b[tag])
            tags.append(tag)
        return tags[::-1]

    def sure(self, s: np.ndarray) -> np.ndarray:
        """Tokens that are outside on every best path, by their own scores and the next token's.

        Take a path with another tag there. If the next tag is no inside,
        outside instead of it gains the lead less what transitions can cost; if
        it is one, a begin takes its place, and the next token's scores count too.
        """
        t, two = self.t, (BEGIN, INSIDE)
        into = np.array([max(t[p, x] - t[p, OUTSIDE] for p in range(3)) for x in two])
        plain = max(into[x] + t[x, n] - t[OUTSIDE, n] for x in two for n in (BEGIN, OUTSIDE))
        follow = max(t[INSIDE, f] - t[BEGIN, f] for f in range(3))
        inside = max(into[x] + t[x, INSIDE] - t[OUTSIDE, BEGIN] for x in two) + follow
        lead = s[:, OUTSIDE] - np.maximum(s[:, BEGIN], s[:, INSIDE])
        step = np.r_[s[1:, BEGIN] - s[1:, INSIDE], 0.0]
        return (lead > plain + 1e-9) & (lead + step > inside + 1e-9)

    def best(self, score: np.ndarray, line: np.ndarray) -> np.ndarray:
        """Viterbi of each line; all parts between sure tokens go a step at once."""
        n, t = len(score), self.t
        out = np.full(n, OUTSIDE, np.int8)
        at = np.flatnonzero(~self.sure(score))
        if not len(at):
            return out
        s = score[at]
        first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (line[at[1:]] != line[at[:-1]])])
        size = np.diff(np.r_[first, len(at)])
        by = np.argsort(-size, kind="stable")
        first, size = first[by], size[by]
        active = np.searchsorted(-size, -np.arange(size[0]), side="left")  # parts longer than each step
        best = t[OUTSIDE] + s[first]
        back = np.zeros((len(at), 3), np.int8)
        for k in range(1, size[0]):
            a = active[k]
            m = best[:a, :, None] + t
            i = first[:a] + k
            back[i] = m.argmax(axis=1)
            best[:a] = m.max(axis=1) + s[i]
        tags = np.full(len(at), OUTSIDE, np.int8)
        tags[first + size - 1] = (best + t[:, OUTSIDE]).argmax(axis=1)
        for k in range(size[0] - 1, 0, -1):
            i = first[: active[k]] + k
            tags[i - 1] = back[i, tags[i]]
        out[at] = tags
        return out

    def decode(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """(start, end, tag) in bytes of the tokens of each text that are not outside."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        x = tokens_of(texts)
        if not len(x.start):
            return out
        score = self.w[x.own].sum(axis=1)[x.kind]
        for column in x.around.T:
            score += self.w[column]
        tags = self.best(score, x.line)
        for i in np.flatnonzero(tags != OUTSIDE).tolist():
            out[x.text[i]].append((int(x.start[i]), int(x.end[i]), int(tags[i])))
        return out

    def gradient(self, s: np.ndarray, tags: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected less seen counts of chains side by side: of each token's tags, and of all transitions.

        s: scores (chains, tokens, tags); tags: (chains, tokens); ``size`` tokens of each chain count.
        """
        n, most = s.shape[:2]
        at, rows = np.arange(most), np.arange(n)
        inside = at < size[:, None]

        def added(m: np.ndarray, axis: int) -> np.ndarray:
            top = m.max(axis=axis, keepdims=True)
            return (np.log(np.exp(m - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)

        fore, aft = np.zeros_like(s), np.zeros_like(s)
        fore[:, 0] = self.t[OUTSIDE] + s[:, 0]
        for i in range(1, most):
            fore[:, i] = added(fore[:, i - 1, :, None] + self.t, 1) + s[:, i]
        for i in range(most - 1, -1, -1):
            last = (size - 1 == i)[:, None]
            more = added(self.t + (s[:, i + 1] + aft[:, i + 1])[:, None, :], 2) if i + 1 < most else np.zeros((n, 3))
            aft[:, i] = np.where(last, self.t[:, OUTSIDE], more)
        z = added(fore[rows, size - 1] + self.t[:, OUTSIDE], 1)
        own = np.where(inside[:, :, None], np.exp(np.where(inside[:, :, None], fore + aft - z[:, None, None], 0.0)), 0.0)
        steps = inside[:, 1:]
        m = fore[:, :-1, :, None] + self.t + (s[:, 1:] + aft[:, 1:])[:, :, None, :] - z[:, None, None, None]
        pair = np.exp(m[steps]).sum(axis=0)
        pair[OUTSIDE] += own[:, 0].sum(axis=0)
        pair[:, OUTSIDE] += own[rows, size - 1].sum(axis=0)
        c, i = np.nonzero(inside)
        own[c, i, tags[c, i]] -= 1
        before = np.where(i > 0, tags[c, np.maximum(i - 1, 0)], OUTSIDE)
        np.subtract.at(pair, (before, tags[c, i]), 1)
        np.subtract.at(pair, (tags[rows, size - 1], OUTSIDE), 1)
        return own, pair

    def fit(self, data: list[tuple[np.ndarray, np.ndarray, np.ndarray]], epochs: int = 5, rate: float = 0.3, l2: float = 1e-3, seed: int = 23, together: int = 16) -> None:
        """data: each chain's own features, features around, tags. AdaGrad on the log likelihood, ``together`` chains a step."""
        rng = np.random.default_rng(seed)
        gw, gt = np.full((DIM + 1, 3), 1e-8), np.full((3, 3), 1e-8)
        width = len(OWN) + len(AROUND)
        for _ in range(epochs):
            order = rng.permutation(len(data))
            for lo in range(0, len(order), together):
                chains = [data[i] for i in order[lo : lo + together]]
                size = np.array([len(t) for _, _, t in chains])
                features = np.full((len(chains), size.max(), width), DIM, np.int64)
                tags = np.full((len(chains), size.max()), OUTSIDE, np.int64)
                for k, (own, around, t) in enumerate(chains):
                    features[k, : len(t), : len(OWN)], tags[k, : len(t)] = own, t
                    if rng.random() < 0.5:
                        features[k, : len(t), len(OWN) :] = around
                g, pair = self.gradient(self.w[features].sum(axis=2), tags, size)
                used = features != DIM
                rows = features[used]
                d = np.repeat(g.reshape(-1, 3), used.reshape(-1, width).sum(axis=1), axis=0) + l2 * self.w[rows]
                np.add.at(gw, rows, d * d)
                np.subtract.at(self.w, rows, rate * d / np.sqrt(gw[rows]))
                pair[OUTSIDE, INSIDE] = 0
                gt += pair * pair
                self.t -= rate * pair / np.sqrt(gt)


def byte_places(text: str) -> np.ndarray:
    """Where each code point begins in the text's UTF-8 bytes, and where it ends."""
    raw = np.frombuffer(text.encode(), np.uint8)
    return np.r_[np.flatnonzero((raw & 0xC0) != 0x80), len(raw)]


#: Texts that the field is fitted on, at most about, and of others; chains taken of each; tokens of a training chain on either side of one that makes it; places where something made up stands.
SAMPLE, OTHERS, CHAINS, NEAR, MADE_UP = 4000, 1000, 8, 6, 3


LOWER, UPPER, DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def made_up(r: random.Random, words: list[str]) -> tuple[str, str, bool]:
    """(what stands before, a token or two, whether it is a secret), put together at random.

    Secrets are random characters of several alphabets, some behind a short
    prefix, and, behind a sign, short ones and words run together. The others
    are what clean texts hold: numbers, dates, addresses, words joined by signs.
    """

    def some(letters: str, n: int) -> str:
        return "".join(r.choice(letters) for _ in range(n))

    def word() -> str:
        return r.choice(words)

    sign = r.choice(["", "", " = ", ": ", "=", ' = "', ":"])
    before = word() + sign if sign else ""
    if r.random() < 0.5:
        letters = r.choice([LOWER[:6] + DIGIT, LOWER + UPPER + DIGIT, LOWER + UPPER + DIGIT, LOWER + DIGIT, UPPER + DIGIT, LOWER + UPPER + DIGIT + "+/", LOWER + UPPER])
        body = some(letters, r.randint(9 if sign else 20, 44))
        kind = r.random()
        if kind < 0.3:
            body = some(LOWER, r.randint(2, 5)) + r.choice(["_", "-", "_live_", "-test-"]) + body
        elif kind < 0.4:
            body += ":" + some(letters, r.randint(12, 30))
        elif kind < 0.5 and sign:
            body = "".join(word().capitalize() for _ in range(3)) + (some(DIGIT, 2) if r.random() < 0.5 else "")
        return before, body, True
    year = f"{r.randint(1950, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}"
    return before, r.choice([
        some(DIGIT, r.randint(3, 18)), year, f"{year}T{r.randint(0, 23):02}", ".".join(some(DIGIT, r.randint(1, 3)) for _ in range(4)), f"{word()}.{word()}", f"{word()}-{word()}-{word()}", f"{word()}_{word()}",
        f"www.{word()}.com/{word()}/{word()}-{word()}", f"{word()}{some(DIGIT, 2)}", word().capitalize() + word().capitalize(), word().upper() + "-" + some(DIGIT, 4), word(), word(), f"{some(DIGIT, 3)}-{some(DIGIT, 4)}", "=" * r.randint(3, 30), "-" * r.randint(3, 40),
    ]), False


def labelled(text: str) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches of a text's chains with their tags, for the fit.

    Those around secrets by the patterns (of an assignment its value is the
    secret) and around long tokens with a digit; the start of a plain line; and,
    in the same text, places where something made up stands.
    """
    low = text.lower()
    spans = [m.span(2) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8] if any(h in low for h in HINTS) else []
    out = stretches(text, spans + [(s, e) for s, k, e in patterns(text) if k])
    r = random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    words, gaps = re.findall("[A-Za-z]{3,12}", text), [m.start() for m in re.finditer(" ", text)]
    for _ in range(MADE_UP if words and gaps else 0):
        at = r.choice(gaps)
        before, body, secret = made_up(r, words)
        start = at + 1 + len(before)
        changed = f"{text[:at]} {before}{body}{text[at:]}"
        # only what lies near it, so that what the text has itself isn't repeated
        lo, hi = max(changed.rfind("\n", 0, at) + 1, start - 200), start + len(body) + 200
        out += stretches(changed[lo:hi].split("\n")[0], [(start - lo, start - lo + len(body))], secret)
    return out


def stretches(text: str, spans: list[tuple[int, int]], secret: bool | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches of chains with tags by spans; with ``secret`` the only one is that around the span, which is one or is none."""
    raw = text.encode()
    x = tokens_of([raw])
    n = len(x.start)
    if not n:
        return []
    tags = np.full(n, OUTSIDE, np.int64)
    inside = np.zeros(n, bool)
    if spans:
        place = byte_places(text)
        for s, e in sorted(spans):
            i, j = np.searchsorted(x.end, place[s], side="right"), np.searchsorted(x.start, place[e], side="left")
            inside[i:j] = True
            if secret is not False:
                tags[i:j] = INSIDE
                tags[i : i + 1] = BEGIN
    data = np.frombuffer(raw, np.uint8)
    digits = np.r_[0, np.cumsum(KIND[data] == 3)]
    hot = inside if secret is not None else inside | ((x.end - x.start >= LEAST) & (digits[x.end] > digits[x.start]))
    bounds = np.r_[np.flatnonzero(np.r_[True, x.line[1:] != x.line[:-1]]), n]
    plain = [(int(lo), int(min(hi, lo + 2 * NEAR))) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True) if not hot[lo:hi].any()][: secret is None]
    parts: list[list[int]] = []
    for i in np.flatnonzero(hot).tolist():
        line = np.searchsorted(bounds, i, side="right") - 1
        lo, hi = max(int(bounds[line]), i - NEAR), min(int(bounds[line + 1]), i + NEAR + 1)
        if parts and lo <= parts[-1][1] and x.line[lo] == x.line[parts[-1][0]]:
            parts[-1][1] = hi
        else:
            parts.append([lo, hi])
    parts.sort(key=lambda p: bool((tags[p[0] : p[1]] == OUTSIDE).all()))
    return [(x.own[x.kind[lo:hi]], x.around[lo:hi], tags[lo:hi]) for lo, hi in [*parts[:CHAINS], *plain]]


def learn(docs: DataFrame) -> Field:
    """A field fitted on a sample of ``text``, chosen by hash: about SAMPLE different texts with a long token or a keyword and OTHERS without.

    Of each, CHAINS chains at most and MADE_UP made-up ones. Without any text
    nothing is learned, and nothing will be tagged.
    """
    reach(docs.sparkSession)
    hot = (F.col("text").rlike(r"[A-Za-z0-9+/_.=-]{%d}" % LEAST) & F.col("text").rlike("[0-9]")) | F.col("text").rlike("(?i)" + "|".join(HINTS))
    texts = docs.where(F.col("text").isNotNull()).select("text", F.xxhash64(F.lit(19), "text").alias("h"), hot.alias("hot"))
    some, others = texts.agg(F.approx_count_distinct(F.when(F.col("hot"), F.col("h"))), F.approx_count_distinct(F.when(~F.col("hot"), F.col("h")))).first()
    share = F.when(F.col("hot"), min(1.0, SAMPLE / max(1, some))).otherwise(min(1.0, OTHERS / max(1, others)))
    # copies become one text before they count; few bytes, but work for all cores
    chosen = texts.where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30)).groupBy("h").agg(F.first("text").alias("text")).repartition(2 * parallelism(docs.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(h, i, *(a.astype("<u2").tobytes() for a in c)) for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, c in enumerate(labelled(t))]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.int32()] + [pa.binary()] * 3, strict=True)], names=["h", "i", "own", "around", "tags"])

    field = Field()
    rows = sorted(map(tuple, chosen.mapInArrow(tidy(run), "h long, i int, own binary, around binary, tags binary").collect()))

    def array(x: bytes) -> np.ndarray:
        return np.frombuffer(x, "<u2").astype(np.int64)

    field.fit([(array(o).reshape(-1, len(OWN)), array(a).reshape(-1, len(AROUND)), array(t)) for _, _, o, a, t in rows])
    return field


def scan(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """``docs`` with the secrets of every whole text.

    Appends n_assign, n_access, n_hex (pattern matches), base_sha256 (of those
    spans) and spans: ``kind:start:end`` in code points, end exclusive, ordered
    by start, then kind (assign, access, hex, crf), comma-joined. The field adds
    a span (kind crf) for each run of tokens that it tags as one secret; tokens
    that touch a pattern's span are left out of it. A null text is empty and has
    none. Extra columns stay, whatever their names; an empty table gives an
    empty result; repeated rows have the same spans; very long texts are scanned
    whole.
    """
    reach(docs.sparkSession)
    n = numbered(docs)
    at = find(docs, text)
    known = docs.sparkSession.sparkContext.broadcast(field)  # DIM * 3 weights

    def added(t: str, tagged: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Spans of the tagged tokens that no base span touches; an inside token joins the one before it if that stayed."""
        place = byte_places(t)
        more: list[list[int]] = []
        last = None
        for i, (s, e, tag) in enumerate(tagged):
            s, e = (int(x) for x in np.searchsorted(place, (s, e)))
            if any(a < e and s < z for a, _, z in base):
                continue
            if tag == INSIDE and last == i - 1:
                more[-1][2] = e
            else:
                more.append([s, 3, e])
            last = i
        return [(s, k, e) for s, k, e in more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, field = (*KINDS, "crf"), known.value
        for b in slices(batches, 512):
            counts, digests, spans = ([], [], []), [], []
            texts = [t or "" for t in b.column(at).to_pylist()]
            for lo, hi in grouped([len(t) for t in texts]):
                for t, tagged in zip(texts[lo:hi], field.decode([t.encode() for t in texts[lo:hi]]), strict=True):
                    base = patterns(t)
                    more = added(t, tagged, base) if tagged else []
                    for k in range(3):
                        counts[k].append(sum(x[1] == k for x in base))
                    digests.append(hashlib.sha256(",".join(f"{names[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest())
                    spans.append(",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(base + more)))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=[*b.schema.names, *OUT])

    kinds = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in n.schema.fields)
    return n.mapInArrow(tidy(run), f"{kinds}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string").toDF(*docs.columns, *OUT)


def grouped(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Bounds of texts that go together: about BLOCK characters, one text at least."""
    lo = size = 0
    for i, n in enumerate(sizes):
        if size and size + n > BLOCK:
            yield lo, i
            lo, size = i, 0
        size += n + 1
    if lo < len(sizes):
        yield lo, len(sizes)


OUT = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of all documents, one row for each row of the table.

    A null text is empty. Repeated rows have equal results, a null doc_id stays
    null, other columns are left out, an empty table gives no rows.
    """
    docs = pick(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), doc_id="doc_id", text="text")
    return scan(docs, learn(docs)).drop("text")
