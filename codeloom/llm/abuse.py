"""Abusive, hateful or sexual content: a subword-bag classifier over sentences.

A sentence is the average of the vectors of its words, their character n-grams, its word
pairs and, in scripts without blanks, its character pairs and triples (all hashed into a
fixed number of rows), followed by a linear softmax over the kinds of verdict; vectors and
softmax are trained jointly in numpy. Misspelt and masked words share n-grams with the
plain ones; look-alike letters, digits for letters and spaced-out words are folded first.

Reviews judge whole documents, err, and abuse sits in single sentences. So first the error
rates of the raters and from them the probability that each reviewed document is abusive
are estimated by expectation maximisation over the counts of verdicts. Training then
alternates: sentences of clean documents are negative; of an abusive document the
sentences that a model trained without this document scores highest are positive. The
threshold is the one that is best on documents scored by models that did not see them; it
is shifted into the bias, so that from :data:`ABUSIVE` on a document counts as abusive.

What is fitted is bounded, by documented parameters of :func:`score_documents`; every
document of the corpus is scored, over its whole text, by its worst sentence.

Defined results: null, empty and letterless texts score 0. Documents without a usable
verdict do not train. Where the reviews do not make up a model (fewer than
``min_abusive`` probably abusive documents, none clean, or no sentence told apart in
documents held out) the score is null for every document.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import small

#: Score from which a document counts as abusive.
ABUSIVE = 0.5
#: Kinds of verdict; the first is the clean one.
KINDS = ("none", "insult", "threat", "hate", "sexual")

# --- Fixed values: letters of other scripts that look like Latin ones, and digits used as letters ---
LOOKALIKES = dict(zip("аеорсухіјѕԁһклмнтвгпибαεορτυνικηβ", "aeopcyxijsdhklmhtbrnubaeoptuvikhb"))
LEET = dict(zip("013457@$+!8", "oieastastib"))

_LOOK = {ord(a): b for a, b in LOOKALIKES.items()}
_LEET = {ord(a): b for a, b in LEET.items()}
_MIXED = regex.compile(r"(?<![\d.,])[\p{Latin}0134578@$+!]*\p{Latin}[\p{Latin}0134578@$+!]*")
_PLAIN = regex.compile(r"\p{L}+[!+]*|\d+\p{L}{1,2}|\p{L}{1,2}\d+")
_SPACED = regex.compile(r"(?<!\p{L})\p{L}([ .\-_·．•])(?:\p{L}\1){2,}\p{L}{1,2}(?!\p{L})")
_SPACED_HAN = regex.compile(r"(?<=[\p{Han}\p{Kana}\p{Hira}])[ .\-_*·．•]+(?=[\p{Han}\p{Kana}\p{Hira}])")
_INVISIBLE = regex.compile(r"[\p{Cf}\p{Mn}--[̀-ͯऀ-෿฀-໿؀-ۿ]]", regex.V1)
_STARS = regex.compile(r"(\p{L})[*＊#]{2,}(\p{L}{0,3})")
#: Texts without any of these need no unmasking.
_ODD = re.compile(r"[*#＊@$_·．•]|[013457+!8][^\W\d_]|[^\W\d_][01345780+!][^\W_]|[^\W\d_][.\-][^\W\d_][.\-]|\b[^\W\d_] [^\W\d_] [^\W\d_]\b")
_CYR = regex.compile(r"[\p{Cyrillic}\p{Greek}]")
_LATIN = regex.compile(r"\p{Latin}")
_RUN = r"\p{Han}\p{Hira}\p{Kana}ー\p{Thai}"
_LABEL = re.compile(r"\s*(?:[\[【(（][^\]】)）\n]{1,30}[\]】)）]|[^:：\s.,]{1,16}(?:\s\d+)?[:：]|(?:The )?[A-ZÀ-ÖØ-Þ ]{4,30}\.)\s*")
_ASCII_TOKEN = re.compile(r"[a-z][a-z'*]*|\d+|\n")
_TOKEN = regex.compile(rf"[{_RUN}]|[\p{{L}}--[{_RUN}]][\p{{L}}\p{{M}}'’*--[{_RUN}]]*|\d+|\n", regex.V1)
_SINGLE = regex.compile(rf"[{_RUN}]")
#: Longer pieces are scored part by part.
LONGEST_PIECE = 2_000
_PAIR, _TRIPLE = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)


def fold(text: str) -> str:
    """Text in the spelling the classifier sees."""
    if text.isascii():
        t = text.lower()
    else:
        t = unicodedata.normalize("NFKC", text).casefold()
        t = _INVISIBLE.sub("", t)
        if _CYR.search(t) and _LATIN.search(t):
            t = t.translate(_LOOK)
        t = _SPACED_HAN.sub("", t)
    if _ODD.search(t):
        t = _SPACED.sub(lambda m: regex.sub(r"[ .\-_·．•]", "", m.group()), t)
        t = _STARS.sub(r"\1**\2", t)
        t = _MIXED.sub(lambda m: m.group() if _PLAIN.fullmatch(m.group()) else m.group().translate(_LEET), t)
    return t.replace("\n", " ")


def pieces(text: str | None, labelled: bool = False) -> Iterator[str]:
    """Pieces of a text at stops and line ends, without speaker labels; ``labelled`` gives those with a label as they are written, too."""
    if not text:
        return
    for stop in ". ", "! ", "? ", "… ":
        text = text.replace(stop, stop[0] + "\n")
    for stop in "。！？":
        text = text.replace(stop, stop + "\n")
    for line in text.replace("　", "\n").replace("\r", "\n").split("\n"):
        if not line:
            continue
        m = _LABEL.match(line)
        piece = line[m.end() :] if m else line
        if len(line) > LONGEST_PIECE:
            for at in range(0, len(piece), LONGEST_PIECE // 2):
                yield piece[at : at + LONGEST_PIECE]
            continue
        if piece and not piece.isspace():
            yield piece
        if labelled and m:
            yield line


class Words:
    """Words met so far: their hash rows, whether they are single characters, and their token hash."""

    def __init__(self, buckets: int, low: int = 3, high: int = 5, most: int = 400_000) -> None:
        self.buckets, self.low, self.high, self.most = buckets, low, high, most
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {"\n": 0}
        self.rows: list[np.ndarray] = [np.empty(0, np.int32)]
        self.hashes, self.single = [0], [False]

    def add(self, w: str) -> int:
        """Number of a word that is not known yet."""
        known = w
        if w[0].isdigit():
            w = "0"
        at = self.index.get(w)
        if at is None:
            h = crc32(w.encode())
            one = bool(_SINGLE.match(w))
            ids = [h % self.buckets]
            if not one and w != "0":
                s = f"<{w}>"
                ids += [crc32(s[i : i + n].encode()) % self.buckets for n in range(self.low, self.high + 1) for i in range(len(s) - n + 1)]
            at = self.index[w] = len(self.rows)
            self.rows.append(np.array(ids, np.int32))
            self.hashes.append(h)
            self.single.append(one)
        self.index[known] = at
        return at

    def tokens(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers, line of each) of folded lines."""
        if len(self.rows) > self.most:
            self.clear()
        ids, where = [], []
        for ascii_only, pattern in ((True, _ASCII_TOKEN), (False, _TOKEN)):
            mine = [i for i, s in enumerate(lines) if s.isascii() == ascii_only]
            if not mine:
                continue
            found, index = pattern.findall("\n".join([lines[i] for i in mine])), self.index
            for w in set(found).difference(index):
                self.add(w)
            got = np.fromiter(map(index.__getitem__, found), np.int32, len(found))
            line = np.cumsum(got == 0)
            ids.append(got[got > 0])
            where.append(np.array(mine, np.int64)[line[got > 0]])
        return np.concatenate(ids or [np.empty(0, np.int32)]), np.concatenate(where or [np.empty(0, np.int64)])

    def sequences(self, ids: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, line) of pairs of words in sequence, and of triples of single characters."""
        h, one = np.array(self.hashes, np.uint32)[ids], np.array(self.single)[ids]
        same = where[1:] == where[:-1]
        pair = ((h[:-1] * _PAIR + h[1:]) % np.uint32(self.buckets))[same]
        three = same[1:] & same[:-1] & one[2:] & one[1:-1] & one[:-2]
        triple = ((h[:-2] * _TRIPLE + h[1:-1] * _PAIR + h[2:] + np.uint32(1)) % np.uint32(self.buckets))[three]
        return np.concatenate([pair, triple]).astype(np.int64), np.concatenate([where[1:][same], where[2:][three]])

    def bags(self, lines: list[str]) -> list[np.ndarray]:
        """All rows of each folded line."""
        ids, where = self.tokens(lines)
        rows, line = self.sequences(ids, where)
        per = [self.rows[i] for i in ids]
        flat = np.concatenate([*per, rows.astype(np.int32)]) if len(ids) else np.empty(0, np.int32)
        of = np.concatenate([np.repeat(where, [len(p) for p in per]), line]) if len(ids) else np.empty(0, np.int64)
        order = np.argsort(of, kind="stable")
        return np.split(flat[order], np.searchsorted(of[order], np.arange(1, len(lines)))) if lines else []


@dataclass
class Model:
    """Logits per row: ``logits`` (buckets x kinds, relative to the clean kind) and ``bias``.

    The softmax is linear in the average of a sentence's vectors, so vectors and softmax
    fold into one number per row and kind; no other state is needed to score.
    """

    logits: np.ndarray
    bias: np.ndarray
    words: Words = field(default=None, repr=False)
    _values: np.ndarray = field(default=None, repr=False)
    _counts: np.ndarray = field(default=None, repr=False)

    def __post_init__(self) -> None:
        self.words = self.words or Words(len(self.logits))

    def score_lines(self, lines: list[str]) -> np.ndarray:
        """Probability that each folded line is abusive; 0 for lines without words."""
        w = self.words
        ids, where = w.tokens(lines)
        if self._values is None or len(self._values) > len(w.rows):
            self._values, self._counts = np.zeros((0, self.logits.shape[1]), np.float32), np.zeros(0, np.float32)
        new = w.rows[len(self._values) :]
        if new:
            sums = np.array([self.logits[r].sum(0) if len(r) else np.zeros(self.logits.shape[1]) for r in new], np.float32)
            self._values, self._counts = np.concatenate([self._values, sums]), np.concatenate([self._counts, [len(r) for r in new]])
        rows, line = w.sequences(ids, where)
        n = np.bincount(where, self._counts[ids], len(lines)) + np.bincount(line, minlength=len(lines))
        z = np.empty((len(lines), self.logits.shape[1]))
        for k in range(self.logits.shape[1]):
            z[:, k] = np.bincount(where, self._values[ids, k], len(lines)) + np.bincount(line, self.logits[rows, k], len(lines))
        e = np.exp(np.clip(z / np.maximum(n, 1)[:, None] + self.bias, -30, 30)).sum(1)
        letters = np.bincount(where, ids != w.index.get("0", -1), len(lines))
        return np.where(letters > 0, e / (1 + e), 0.0)

    def score_texts(self, texts: list[str | None], chars: int = 2_000_000) -> np.ndarray:
        """Score of each document: its worst piece, with or without what looks like its label."""
        worst = np.zeros(len(texts))
        line_of: dict[str, int] = {}
        docs: list[int] = []
        which: list[int] = []
        held = 0

        def flush() -> None:
            if which:
                got = self.score_lines([fold(s) for s in line_of])
                np.maximum.at(worst, docs, got[which])
            line_of.clear(), docs.clear(), which.clear()

        for d, text in enumerate(texts):
            for piece in pieces(text, labelled=True):
                at = line_of.setdefault(piece, len(line_of))
                if at == len(line_of) - 1:
                    held += len(piece)
                docs.append(d)
                which.append(at)
                if held > chars:
                    flush()
                    held = 0
        flush()
        return worst


def combine(models: list[Model]) -> Model:
    """One model with the mean of the models' logits; they are linear in a sentence's rows, so this is exact."""
    return Model(np.mean([m.logits for m in models], axis=0), np.mean([m.bias for m in models], axis=0), models[0].words)


def _fit(bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray, words: Words, kinds: int, dim: int, epochs: int, rate: float, seed: int) -> Model:
    """Joint stochastic gradient training of vectors and softmax, every row as often as it occurs."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (words.buckets, dim)).astype(np.float32)
    W, b = np.zeros((dim, kinds), np.float32), np.zeros(kinds, np.float32)
    size, done = 32, 0
    lens = np.array([len(x) for x in bags])
    ends = np.cumsum(lens)
    everything = np.concatenate(bags)
    steps = max(1, epochs * ((len(bags) + size - 1) // size))
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), size):
            pick = order[at : at + size]
            n = lens[pick]
            flat = everything[np.repeat(ends[pick] - n - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            rows, at_row = np.unique(flat, return_inverse=True)
            # How often each row occurs in each sentence of the step.
            times = np.bincount(at_row * len(pick) + np.repeat(np.arange(len(pick)), n), minlength=len(rows) * len(pick)).reshape(len(rows), -1).astype(np.float32)
            share = times / n.astype(np.float32)
            h = share.T @ vectors[rows]
            z = h @ W + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1.0
            g = (p * weight[pick][:, None]).astype(np.float32)
            lr = rate * (1 - done / steps)
            change = g @ W.T
            W -= lr * (h.T @ g)
            b -= lr * g.sum(0) * 0.1
            vectors[rows] -= lr * (share @ change)
            done += 1
    logits = vectors @ W
    return Model((logits[:, 1:] - logits[:, :1]).astype(np.float32), (b[1:] - b[0]).astype(np.float64), words)


def probabilities(counts: dict[tuple[int, int], int], rounds: int = 50) -> dict[tuple[int, int], float]:
    """Probability that a document of which k of m raters said abusive is so, for every (k, m) with its number of documents.

    Expectation maximisation over the share of abusive documents and the raters' two error
    rates, with the weight of some imaginary documents so that few reviews do not run away.
    """
    share, false, missed = 0.15, 0.08, 0.1
    out: dict[tuple[int, int], float] = {}
    for _ in range(rounds):
        for k, m in counts:
            bad = share * (1 - missed) ** k * missed ** (m - k)
            good = (1 - share) * false**k * (1 - false) ** (m - k)
            out[k, m] = bad / (bad + good)
        n = sum(counts.values())
        bad = sum(c * out[x] for x, c in counts.items())
        votes = sum(c * out[k, m] * m for (k, m), c in counts.items())
        yes = sum(c * out[k, m] * k for (k, m), c in counts.items())
        every, all_yes = sum(c * m for (_, m), c in counts.items()), sum(c * k for (k, _), c in counts.items())
        share, missed, false = (bad + 1.5) / (n + 10), (votes - yes + 2) / (votes + 20), (all_yes - yes + 4) / (every - votes + 50)
    return out


@dataclass
class _Doc:
    """A document of the fit: its pieces by key, probability of being abusive, and kind."""

    pieces: dict[str, str]
    p: float
    kind: int
    part: int


def train(
    docs: list[tuple[str, float, str]], buckets: int = 1 << 17, dim: int = 10, epochs: int = 4, rounds: int = 2, rate: float = 0.8, seed: int = 7,
    max_clean: int = 12_000, min_abusive: int = 8, clean_weight: float = 3.0, seeds: int = 3,
) -> Model | None:
    """Model from (text, probability of being abusive, kind of verdict); null if the reviews do not make one up.

    Documents of at most 0.1 are clean, from 0.4 on abusive; the rest is not used. A fit
    takes at most ``max_clean`` different clean sentences, half of them those that the last
    model found most abusive, then the commonest and a seeded sample. The documents are in two
    parts, each judged by the model of the other one, so a mistaken verdict does not confirm itself.
    ``clean_weight``: how much commoner clean documents are in the corpus than among those
    reviewed, for the choice of the threshold.
    """
    rng, words = np.random.default_rng(seed), Words(buckets)
    clean, bad = [], []
    for text, p, kind in docs:
        folded = list(dict.fromkeys(fold(s) for s in pieces(text)))
        ids, where = words.tokens(folded)
        order = np.argsort(where, kind="stable")
        keys = [x.tobytes() for x in np.split(ids[order], np.searchsorted(where[order], np.arange(1, len(folded))))] if folded else []
        own = {k: s for k, s in zip(keys, folded) if k}
        if own and p <= 0.1:
            clean.append(_Doc(own, p, 0, int(rng.integers(2))))
        elif own and p >= 0.4:
            bad.append(_Doc(own, p, KINDS.index(kind) if kind in KINDS[1:] else 1, int(rng.integers(2))))
    if sum(d.p for d in bad) < min_abusive or not clean:
        return None
    number: dict[str, int] = {}
    texts: list[str] = []
    for d in (*bad, *clean):
        for k, s in d.pieces.items():
            if k not in number:
                number[k] = len(texts)
                texts.append(s)
    bags = [b if len(b) else np.zeros(1, np.int32) for b in words.bags(texts)]
    of = lambda d: np.array([number[k] for k in d.pieces])
    clean_of, bad_of = [of(d) for d in clean], [of(d) for d in bad]
    in_clean = np.zeros((3, len(texts)), np.float32)
    for d, x in zip(clean, clean_of):
        in_clean[d.part, x] += 1
        in_clean[2, x] += 1
    in_bad = np.zeros(len(texts), np.float32)
    for d, x in zip(bad, bad_of):
        in_bad[x] += d.p
    # A sentence that clean documents hold too is evidence only if it is clearly commoner in abusive ones.
    pure = in_bad - 2 * np.sqrt(in_bad) > 2 * in_clean[2] * len(bad) / len(clean)
    pure |= in_clean[2] == 0
    row_clean, row_bad = np.zeros(buckets, np.float32), np.zeros(buckets, np.float32)
    for x in clean_of:
        row_clean[np.unique(np.concatenate([bags[i] for i in x]))] += 1
    for d, x in zip(bad, bad_of):
        row_bad[np.unique(np.concatenate([bags[i] for i in x]))] += d.p
    odds = np.log((row_bad + 0.2) / len(bad)) - np.log((row_clean + 0.5) / len(clean))
    guess = [np.array([odds[bags[i]].mean() if pure[i] else -9.0 for i in x]) for x in bad_of]
    chosen = [x[[int(g.argmax())]] if g.max() > -9 else x[:0] for x, g in zip(bad_of, guess)]
    suspicion = np.zeros(len(texts), np.float32)

    def fit(part: int, seed: int) -> Model | None:
        """Model of the documents of the other part (part 2: of all documents)."""
        count = in_clean[2] - (in_clean[part] if part < 2 else 0)
        able = np.flatnonzero(count > 0)
        if len(able) > max_clean:
            hard = able[np.argsort(-suspicion[able], kind="stable")][: max_clean // 2]
            rest = np.setdiff1d(able, hard)
            common = rest[np.argsort(-count[rest], kind="stable")][: max_clean // 4]
            able = np.r_[hard, common, rng.permutation(np.setdiff1d(rest, common))[: max_clean - len(hard) - len(common)]]
        weight, kind = np.zeros(len(texts), np.float32), np.zeros(len(texts), np.int64)
        for d, x in zip(bad, chosen):
            if d.part != part:
                weight[x] += d.p
                kind[x] = d.kind
        pos = np.flatnonzero(weight)
        if not len(pos) or not len(able):
            return None
        up = min(6.0, max(1.0, (len(able) / len(pos)) ** 0.5))
        w = np.r_[1 + np.log(count[able]), np.minimum(3.0, weight[pos]) * up]
        take = np.r_[able, pos]
        return _fit([bags[i] for i in take], np.r_[np.zeros(len(able), np.int64), kind[pos]], np.minimum(w, 8.0), words, len(KINDS), dim, epochs, rate, seed)

    def threshold(held: list[np.ndarray]) -> tuple[float, float]:
        """(logit, weighted F1) of the cut that is best on the documents held out."""
        top = np.array([held[d.part][x].max() for d, x in (*zip(bad, bad_of), *zip(clean, clean_of))])
        p = np.array([d.p for d in (*bad, *clean)])
        w = np.r_[np.ones(len(bad)), np.full(len(clean), clean_weight)]
        order = np.argsort(-top, kind="stable")
        top = top[order]
        f1 = 2 * np.cumsum((p * w)[order]) / (np.cumsum(w[order]) + (p * w).sum())
        last = np.flatnonzero(np.r_[top[1:] != top[:-1], True])
        # The middle one of the cuts that are about as good as the best one.
        good = last[f1[last] >= f1[last].max() - 0.003]
        at = good[len(good) // 2]
        both = np.clip([top[at], top[at + 1] if at + 1 < len(top) else 0.0], 0.02, 1 - 1e-9)
        return float(np.log(both / (1 - both)).mean()), float(f1[at])

    cut, f1 = 0.0, 0.0
    for r in range(rounds):
        parts = [fit(0, 2 * r), fit(1, 2 * r + 1)]
        if None in parts:
            return None
        held = [m.score_lines(texts) for m in parts]
        cut, f1 = threshold(held)
        clear = 1 / (1 + np.exp(-cut))
        for i, (d, x) in enumerate(zip(bad, bad_of)):
            g = np.where(pure[x], held[d.part][x], 0.0)
            # Clear cases, and the worst sentence where several people agree that there is one;
            # after the first round the other documents are left out.
            best = g == g.max()
            chosen[i] = x[(g >= clear) | (best & (g > 0) & ((d.p > 0.9) | (r == 0) & (g >= 0.1)))]
        suspicion = np.maximum(*held)
    final = [m for m in (fit(2, 2 * rounds + i) for i in range(seeds)) if m]
    if not final or f1 <= 0:
        return None
    model = combine(final)
    model.bias = model.bias - cut
    return model


def reviewed_documents(documents: DataFrame, reviews: DataFrame, max_documents: int, max_chars: int) -> list[tuple[str, float, str]]:
    """(text, probability of being abusive, commonest kind) of at most ``max_documents`` documents and ``max_chars`` characters, half of them abusive at most, by hash.

    Error rates are estimated from all reviews. Of several verdicts of a rater on a document the latest counts.
    """
    verdict = F.lower(F.trim("verdict"))
    votes = (
        reviews.filter(F.col("verdict").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id", F.lower(F.trim("rater")).alias("rater")).agg(F.max_by(verdict, F.struct("reviewed_at", "review_id")).alias("v"))
        .groupBy("doc_id").agg(F.count_if(F.col("v") != "none").cast("int").alias("k"), F.count("*").cast("int").alias("m"), F.mode(F.when(F.col("v") != "none", F.col("v")), True).alias("kind"))
    )
    p = probabilities({(r.k, r.m): r["count"] for r in votes.groupBy("k", "m").count().collect()})
    if not p:
        return []
    rows = documents.sparkSession.createDataFrame([(k, m, v) for (k, m), v in p.items()], "k int, m int, p double")
    known = votes.join(F.broadcast(rows), ["k", "m"])
    half, order = max_documents // 2, F.xxhash64("doc_id")
    picked = known.filter("p >= 0.4").orderBy(order).limit(half).unionByName(known.filter("p <= 0.1").orderBy(order).limit(half))
    texts = documents.select("doc_id", "text").filter(F.col("text").isNotNull()).join(small(picked, max_documents), "doc_id").orderBy(order)
    out, left = [], max_chars
    for r in texts.toLocalIterator():
        if len(r.text) <= left:
            out.append((r.text, r.p, r.kind))
            left -= len(r.text)
    return out


def score_documents(documents: DataFrame, reviews: DataFrame, max_documents: int = 6_000, max_chars: int = 30_000_000, **options: object) -> DataFrame:
    """``documents`` (doc_id, text and whatever else) with ``abuse_score`` in [0, 1].

    The fit takes at most ``max_documents`` reviewed documents with together ``max_chars``
    characters, and ``max_clean`` different clean sentences (see :func:`train`).
    """
    spark = documents.sparkSession
    model = train(reviewed_documents(documents, reviews, max_documents, max_chars), **options)
    if model is None:
        return documents.withColumn("abuse_score", F.lit(None).cast("double"))
    # The model is four numbers per bucket (2 MB), whatever the corpus.
    shared = spark.sparkContext.broadcast((model.logits.astype(np.float32), model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            scores = own.score_texts(batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "abuse_score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields)
    return documents.mapInArrow(run, f"{schema}, abuse_score double")
