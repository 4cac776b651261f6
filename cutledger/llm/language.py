"""Language identification by unigrams over a public vocabulary, summed over all segmentations."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutledger.llm.common import stored, text_of, words
from cutledger.llm.tokens import runs

#: The vocabulary file's place is a parameter; this is its usual name.
VOCABULARY = "piece_bpe_32k.model"
#: Labelled documents learned from, per language (chosen by a hash of the id), and rounds of learning.
SAMPLE, ROUNDS = 1500, 3
#: Longest piece of the usual vocabulary (of any other its own longest piece counts), and characters
#: of a step: a longer run without white space is summed in such steps, which hand on their sums.
LONGEST, WORD = 16, 64
#: A word begins with this sign, as in the vocabulary.
BEGIN = "▁"
#: Probability of a character that the vocabulary or the language lacks; added count of each piece.
UNKNOWN, ADDED = 1e-5, 0.05
#: Every character is weighted so that the sums of a step stay within a double's range.
LIFT = 50.0
#: Characters of long runs that go through the steps side by side.
TOGETHER = 100_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def pieces(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the pieces in ascending order, and their lengths; a piece is its place."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    texts = [x for x in texts if x]
    hashes = np.array([_prefix_sums(_codes([x], len(x)))[0, -1] for x in texts], np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.array([len(x) for x in texts])[order]


def _codes(texts: list[str], n: int) -> np.ndarray:
    return np.array(texts, f"<U{n}").view(np.uint32).reshape(len(texts), n).astype(np.uint64) + np.uint64(1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, base))), dtype=np.uint64)


def _prefix_sums(codes: np.ndarray) -> np.ndarray:
    sums = np.cumsum(codes * _powers(_STEP, codes.shape[1] - 1), axis=1, dtype=np.uint64)
    return np.concatenate((np.zeros((len(codes), 1), np.uint64), sums), axis=1)


def _places(hashes: np.ndarray, longest: int, texts: list[str], n: int) -> dict[tuple[int, int], np.ndarray]:
    """For words of length n: (from, to) -> each word's piece there, -1 where there is none."""
    sums, back = _prefix_sums(_codes(texts, n)), _powers(_BACK, n)
    found = {}
    for i in range(n):
        for j in range(i + 1, min(n, i + longest) + 1):
            want = (sums[:, j] - sums[:, i]) * back[i]
            at = np.minimum(np.searchsorted(hashes, want), len(hashes) - 1)
            at = np.where(hashes[at] == want, at, -1)
            if j == i + 1 or (at >= 0).any():
                found[i, j] = at
    return found


def _lifted(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Weights of the pieces, with a last row for what is no piece; single characters have a floor."""
    p = np.where((lengths == 1)[:, None], np.maximum(p, UNKNOWN), p)
    return np.concatenate((p * LIFT ** lengths[:, None], np.zeros((1, p.shape[1]))))


def by_length(texts: Iterable[str]) -> dict[int, list[int]]:
    groups: dict[int, list[int]] = {}
    for i, x in enumerate(texts):
        groups.setdefault(len(x), []).append(i)
    return groups


def forward(found: dict, n: int, size: int, weights: np.ndarray) -> np.ndarray:
    """Sums over all segmentations of each word's first t characters, t from 0 to n."""
    sums = np.zeros((n + 1, size, weights.shape[1]))
    sums[0] = 1
    for (i, j), at in sorted(found.items(), key=lambda x: x[0][1]):
        w = weights[at]
        if j == i + 1:
            w = np.where((at < 0)[:, None], UNKNOWN * LIFT, w)
        sums[j] += sums[i] * w
    return sums


class Runs:
    """Runs of more than WORD characters, longest first, in steps of WORD characters side by side."""

    def __init__(self, hashes: np.ndarray, longest: int, texts: list[str], weights: np.ndarray):
        self.hashes, self.longest, self.weights = hashes, longest, weights
        self.lengths = np.array([len(x) for x in texts])
        self.sums, self.back = _prefix_sums(_codes(texts, len(texts[0]))), _powers(_BACK, len(texts[0]))

    def step(self, t0: int) -> tuple[int, np.ndarray, np.ndarray]:
        """Runs that go beyond t0; the pieces that end at each of the step's places, by their length from
        the longest down to one character (-1: none); the pieces' weights."""
        m, t1 = int((self.lengths > t0).sum()), min(int(self.lengths[0]), t0 + WORD)
        at = np.full((t1 - t0, self.longest, m), -1)
        for d in range(1, min(self.longest, t1) + 1):
            a = max(t0 + 1, d)
            want = (self.sums[:m, a : t1 + 1] - self.sums[:m, a - d : t1 + 1 - d]) * self.back[a - d : t1 + 1 - d]
            i = np.minimum(np.searchsorted(self.hashes, want), len(self.hashes) - 1)
            at[a - t0 - 1 :, self.longest - d] = np.where(self.hashes[i] == want, i, -1).T
        w = self.weights[at]
        w[:, -1][at[:, -1] < 0] = UNKNOWN * LIFT
        return m, at, w

    def ahead(self) -> Iterator[tuple[int, np.ndarray]]:
        """For each step its start, and logs of the sums over all segmentations up to each of its places."""
        carry = np.zeros((self.longest, len(self.lengths), self.weights.shape[1]))
        carry[-1] = 1
        logs = np.zeros(carry.shape[1:])
        for t0 in range(0, int(self.lengths[0]), WORD):
            m, _, w = self.step(t0)
            sums = np.concatenate((carry[:, :m], np.empty((len(w), m, carry.shape[2]))))
            for k in range(len(w)):
                sums[self.longest + k] = (sums[k : k + self.longest] * w[k]).sum(axis=0)
            yield t0, np.log(sums[self.longest :]) + logs[:m]
            carry = sums[-self.longest :]
            top = carry.max(axis=0)
            carry, logs = carry / top, logs[:m] + np.log(top)

    def totals(self) -> np.ndarray:
        out = np.empty((len(self.lengths), self.weights.shape[1]))
        for t0, logs in self.ahead():
            ends = np.flatnonzero((self.lengths > t0) & (self.lengths <= t0 + WORD))
            out[ends] = logs[self.lengths[ends] - t0 - 1, ends]
        return out

    def add_expected(self, total: np.ndarray, counts: np.ndarray) -> None:
        """Add each piece's expected uses under weights of one language to `total`."""
        far, n = self.longest, int(self.lengths[0])
        ahead = np.full((far + n, len(self.lengths)), -np.inf)  # of place t in row far - 1 + t
        ahead[far - 1] = 0
        for t0, logs in self.ahead():
            ahead[far + t0 : far + t0 + len(logs), : logs.shape[1]] = logs[:, :, 0]
        whole = ahead[far - 1 + self.lengths, np.arange(len(self.lengths))]
        carry, logs = np.zeros((far, 0)), np.zeros(0)
        for t0 in reversed(range(0, n, WORD)):
            m, at, w = self.step(t0)
            w, new = w[..., 0], m - carry.shape[1]
            behind = np.zeros((far + len(w), m))
            behind[len(w) :, : m - new] = carry
            ends = np.arange(m - new, m)
            behind[far - 1 + self.lengths[ends] - t0, ends] = 1
            logs = np.concatenate((logs, np.zeros(new)))
            for k in reversed(range(len(w))):
                behind[k : k + far] += w[k] * behind[far + k]
            with np.errstate(divide="ignore"):
                for k in range(len(w)):
                    share = ahead[t0 + k : t0 + k + far] + np.log(w[k]) + np.log(behind[far + k]) + logs - whole[:m]
                    np.add.at(total, at[k], np.exp(share) * counts[:m])
            carry = behind[:far]
            top = carry.max(axis=0)
            carry, logs = carry / top, logs + np.log(top)


def _long_runs(texts: list[str]) -> Iterator[list[int]]:
    """Places of the runs of more than WORD characters, longest first, in parts of about TOGETHER characters."""
    which = sorted((i for i, x in enumerate(texts) if len(x) > WORD), key=lambda i: -len(texts[i]))
    while which:
        n = max(1, TOGETHER // len(texts[which[0]]))
        yield which[:n]
        which = which[n:]


def log_likelihoods(path: str, texts: list[str], p: np.ndarray) -> np.ndarray:
    """Log of each word's probability, summed over its segmentations, per language."""
    hashes, lengths = pieces(path)
    weights, out = _lifted(p, lengths), np.empty((len(texts), p.shape[1]))
    longest = int(lengths.max())
    for n, which in by_length(texts).items():
        if n > WORD:
            continue
        for k in range(0, len(which), 20_000):
            part = which[k : k + 20_000]
            found = _places(hashes, longest, [texts[i] for i in part], n)
            out[part] = np.log(forward(found, n, len(part), weights)[n]) - n * np.log(LIFT)
    for part in _long_runs(texts):
        some = Runs(hashes, longest, [texts[i] for i in part], weights)
        out[part] = some.totals() - some.lengths[:, None] * np.log(LIFT)
    return out


def expected(path: str, texts: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected number of times each piece is used in the words, over all their segmentations."""
    hashes, lengths = pieces(path)
    weights, total = _lifted(p[:, None], lengths), np.zeros(len(lengths) + 1)
    longest = int(lengths.max())
    for part in _long_runs(texts):
        Runs(hashes, longest, [texts[i] for i in part], weights).add_expected(total, counts[part])
    for n, which in by_length(texts).items():
        if n > WORD:
            continue
        found = _places(hashes, longest, [texts[i] for i in which], n)
        ahead = forward(found, n, len(which), weights)[:, :, 0]
        behind = np.zeros_like(ahead)
        behind[n] = 1
        for (i, j), at in sorted(found.items(), key=lambda x: -x[0][0]):
            w = weights[at, 0]
            if j == i + 1:
                w = np.where(at < 0, UNKNOWN * LIFT, w)
            behind[i] += w * behind[j]
        for (i, j), at in found.items():
            share = ahead[i] * weights[at, 0] * behind[j] / ahead[n] * counts[which]
            np.add.at(total, at, share)
    return total[:-1]


def signed_words(text: str) -> list[str]:
    """The text's words in lower case, with their sign."""
    return [BEGIN + w for w in text.lower().split()]


def _expect(path: str, now: dict[str, np.ndarray] | None, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = len(pieces(path)[0])
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_numpy()
        for lang in sorted(set(langs)):
            tally: Counter = Counter()
            for l, w, c in zip(langs, texts, counts.tolist(), strict=True):
                if l == lang:
                    for x in signed_words(w):
                        tally[x] += c
            p = np.full(n, 1 / n) if now is None else now[lang]
            total[lang] = total.get(lang, 0) + expected(path, list(tally), np.array(list(tally.values()), float), p)
    for lang, t in total.items():
        used = np.flatnonzero(t)
        yield pa.RecordBatch.from_pydict({"lang": [lang] * len(used), "piece": used, "n": t[used]})


def learn(labelled: DataFrame, path: str, sample: int = SAMPLE, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages, and the probability of each piece in each, from rows of id, text and lang.

    Words of about `sample` documents per language are counted on the cluster; each round sums
    the pieces' expected counts there and brings back one number per piece and language.
    """
    n = len(pieces(path)[0])
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return [], np.zeros((n, 0))
    share = F.create_map(*(F.lit(x) for lang, c in sizes.items() for x in (lang, min(1.0, sample / c))))
    chosen = labelled.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < 1_000_000 * F.element_at(share, F.col("lang")))
    counted = stored(chosen.select("lang", F.explode(words(text_of("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n")), "words")
    now = None
    for _ in range(rounds):
        got = counted.mapInArrow(partial(_expect, path, now), "lang string, piece bigint, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
        now = {lang: np.full(n, ADDED) for lang in sizes}
        for r in got:
            now[r["lang"]][r["piece"]] += r["n"]
        now = {lang: v / v.sum() for lang, v in now.items()}
    langs = sorted(sizes)
    return langs, np.stack([now[lang] for lang in langs], axis=1)


class Scorer:
    """Scores texts, with a bounded memory of words; runs of more than WORD characters are not remembered."""

    def __init__(self, path: str, p: np.ndarray, most: int = 250_000):
        self.path, self.p, self.most = path, p, most
        self.known: dict[str, int] = {}
        self.scores = np.empty((most, p.shape[1]))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        tallies = [Counter(signed_words(x)) for x in texts]
        new = list(set().union(*tallies).difference(self.known))
        if len(self.known) + len(new) > self.most:
            self.known.clear()
            new = list(set().union(*tallies))
            if len(new) > self.most:  # one long text of many words: its words pass by in parts
                return [sum(np.array([t[w] for w in part]) @ log_likelihoods(self.path, part, self.p) for part in _parts(list(t), self.most)) for t in tallies]
        long = [w for w in new if len(w) > WORD]
        far = dict(zip(long, log_likelihoods(self.path, long, self.p), strict=True))
        new = [w for w in new if w not in far] if far else new
        if new:
            self.scores[len(self.known) : len(self.known) + len(new)] = log_likelihoods(self.path, new, self.p)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        return [self._total(t, far) for t in tallies]

    def _total(self, tally: Counter, far: dict[str, np.ndarray]) -> np.ndarray:
        total = np.zeros(self.p.shape[1])
        if far:
            total = sum((c * far[w] for w, c in tally.items() if w in far), total)
            tally = {w: c for w, c in tally.items() if w not in far}
        return total + np.array(list(tally.values())) @ self.scores[[self.known[w] for w in tally]] if tally else total


def _parts(items: list[str], n: int) -> Iterator[list[str]]:
    for i in range(0, len(items), n):
        yield items[i : i + n]


def _predict(path: str, langs: list[str], p: np.ndarray, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(path, p)
    for batch in batches:
        texts = batch.column(1).to_pylist()
        names, scores = [], []
        for a, b in runs([len(x) for x in texts]):
            for text, total in zip(texts[a:b], scorer(texts[a:b]), strict=True):
                if langs and any(map(str.isalpha, text)):
                    best = int(total.argmax())
                    names.append(langs[best])
                    scores.append(float(1 / np.exp(total - total[best]).sum()))
                else:
                    names.append("und")
                    scores.append(0.0)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])


def identify(docs: DataFrame, langs: list[str], p: np.ndarray, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, lang_pred, score for every row: the likeliest language of the whole text and its share
    of the languages' likelihoods. A text without letters (null, empty) is `und` with score 0, and so
    is every text where nothing was learned. The model travels with the tasks: its size is that of
    the vocabulary times the number of languages."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(partial(_predict, path or vocabulary_path(), langs, p), "doc_id bigint, lang_pred string, score double")


def query(docs: DataFrame) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    labelled = docs.where(~held_out & F.col("lang").isNotNull()).select(F.col("doc_id").alias("id"), "text", "lang")
    found = identify(docs, *learn(labelled, vocabulary_path()))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
