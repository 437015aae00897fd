"""Toxicity with noisy-channel deobfuscation.

Words written with look-alike characters, with characters spread by spaces or dots, or with repeated letters are
restored first: a word's possible readings form a lattice (each character stands for itself, for the letters it
resembles, or for nothing), and the Viterbi path under a character trigram model and the channel's costs is its
restored form. The language model counts the trigrams of the whole corpus. Plain words have one reading and stay.

The restored text is scored by the toxic evidence of its words and of their beginnings: log odds learned from
labelled rows, kept only where far from chance. The score is the probability given the strongest evidence, so one
insult in a very long text counts as much as in a short one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmere.llm.common import bounded_sample, held_out, in_batches, table
from voxmere.llm.quality import with_score
from voxmere.llm.textvec import LOWER, SPACE, U64, grams, mix, run_hashes, runs, slices
from voxmere.llm.textvec import words as split_words

#: Bound of the labelled rows that are learned from.
TRAIN_ROWS = 10000
#: The letters that a character is used for.
READINGS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
#: Log probabilities of the channel: a character read as another, a separator inserted, a look-alike inserted, a letter repeated in a long run or doubled.
AS_OTHER, SEPARATED, INSERTED, REPEATED, DOUBLED = -1.0, -0.7, -7.0, -0.4, -4.0
#: A word is taken as evidence if it explains at least this share of the toxic texts, and three of them.
LEAST_SHARE = 0.006
#: A word is evidence on its own if it is so many times as frequent in toxic texts as in others.
SURE = 12
#: Least hashes of word runs by which near copies are told.
LIKENESSES = 4
SYMBOLS = 28  # boundary, a to z, any other letter
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LEADING = np.zeros(256, bool)
_LEADING[[ord(c) for c in "0123456789@$!|+("]] = True
_LOOK = np.zeros(256, bool)
_LOOK[[ord(c) for c in READINGS if c < "\x80"]] = True
_PUNCTUATION = b"\"'()[]{}<>.,;:?!-*_"  # what may stand around a word; "(" and "!" are look-alikes as well
_SOFT = bytes(c for c in _PUNCTUATION if not _LOOK[c])
_AROUND = np.zeros(256, bool)
_AROUND[list(_PUNCTUATION)] = True
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[97:123] = _SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[192:] = 27
_PREFIXES = (4, 5, 6)
_INNER = range(4, 13)  # lengths of words looked for in letters that were spread out


def trigram_counts(data: np.ndarray) -> np.ndarray:
    """Counts of the symbols' trigrams; bytes that continue a character are left out, all that is no letter is a boundary."""
    s = _SYMBOL[data[(data < 128) | (data >= 192)]]
    if len(s) < 3:
        return np.zeros(SYMBOLS**3, np.int64)
    return np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)


@dataclass
class CharModel:
    """log of how much likelier a symbol is after two others than evenly drawn."""

    gain: np.ndarray

    @classmethod
    def fit(cls, texts: DataFrame) -> CharModel:
        """From the counts over all texts (one column); the driver gets at most SYMBOLS**3 sums."""

        def count(batches):
            total = np.zeros(SYMBOLS**3, np.int64)
            for batch in batches:
                for _, _, data, _ in slices(batch.column(0)):
                    total += trigram_counts(data)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["gram", "n"])

        n = np.zeros(SYMBOLS**3)
        for r in texts.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
            n[r["gram"]] = r["n"]
        n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
        two, one = n.sum(axis=0), n.sum(axis=(0, 1))
        p1 = (one + 1) / (one.sum() + SYMBOLS)
        p2 = (two + 20 * p1) / (two.sum(axis=1, keepdims=True) + 20)
        p3 = (n + 20 * p2[None]) / (n.sum(axis=2, keepdims=True) + 20)
        return cls(np.log(p3 * SYMBOLS))


def _symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27


def restore(word: str, gain) -> str:
    """The likeliest letters behind a word; gain is CharModel.gain as nested lists.

    Paths are joined where their last two letters agree, and the best of each state is kept: an exact Viterbi search,
    whose work and memory are in proportion to the word's length. Of equal paths the first read stays.
    """
    word = word.lower()
    paths: dict[tuple, tuple] = {("", 0, 0): (0.0, None)}  # (last letter, symbols of the last two) -> score, chain of letters
    for i, c in enumerate(word):
        if c.isalpha():
            run = 1 + (i > 0 and word[i - 1] == c) + (i + 1 < len(word) and word[i + 1] == c) + (i > 1 and word[i - 2] == c == word[i - 1]) + (i + 2 < len(word) and word[i + 1] == c == word[i + 2])
            options = [(c, 0.0)]
            drop = (REPEATED if run >= 3 else DOUBLED) if i and word[i - 1] == c else None
        else:
            options = [(x, AS_OTHER) for x in READINGS.get(c, "")]
            drop = INSERTED if options else SEPARATED
        after: dict[tuple, tuple] = {}
        for key, (score, chain) in paths.items():
            if drop is not None and (key not in after or after[key][0] < score + drop):
                after[key] = (score + drop, chain)
            _, a, b = key
            for x, cost in options:
                s = _symbol(x)
                to, total = (x, b, s), score + cost + gain[a][b][s]
                if to not in after or after[to][0] < total:
                    after[to] = (total, (chain, x))
        paths = after
    _, chain = max(((score + gain[a][b][0], chain) for (_, a, b), (score, chain) in paths.items()), key=lambda x: x[0], default=(0, None))
    letters = []
    while chain:
        chain, x = chain
        letters.append(x)
    return "".join(reversed(letters))


class Restorer:
    """Restores the words of a slice; words seen before are looked up. The store is emptied when it is full."""

    def __init__(self, model: CharModel, most: int = 200_000):
        self.gain, self.seen, self.most = model.gain.tolist(), {}, most

    def __call__(self, word: bytes) -> bytes:
        found = self.seen.get(word)
        if found is None:
            if len(self.seen) >= self.most:
                self.seen.clear()
            found = self.seen[word] = restore(word.decode("utf-8", "ignore"), self.gain).encode()
        return found


def look_alikes(low: np.ndarray) -> np.ndarray:
    """True for the bytes of characters that are used for letters."""
    look = _LOOK[low]
    for c in READINGS:
        if c >= "\x80":
            own = np.frombuffer(c.encode(), np.uint8)
            here = np.ones(max(0, len(low) - len(own) + 1), bool)
            for k, byte in enumerate(own):
                here &= low[k : k + len(here)] == byte
            at = np.flatnonzero(here)
            for k in range(len(own)):
                look[at + k] = True
    return look


def plain_and_restored(data: np.ndarray, offs: np.ndarray, restorer: Restorer) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, start, end, row) of the letters of plain words, and of the restored forms of the others.

    A word is plain if nothing but letters stands between its first and last letter, no letter is there three
    times in a row, no look-alike leads it, and it is not one of three or more single letters or look-alikes in a
    row. A word that holds a look-alike anywhere is also restored as a whole, with and without the punctuation around
    it, and one that holds a letter twice in a row is restored besides being plain.
    """
    low = LOWER[data]
    start, end, row = runs(~SPACE[low], offs)
    if not len(start):
        return []
    look = look_alikes(low)
    letter = _LETTER[low] & ~look
    sums = lambda x: np.concatenate([[0], np.cumsum(x)])
    before = sums(letter)
    count, looks = before[end] - before[start], sums(look)
    looks = looks[end] - looks[start]
    some = (count > 0) | (looks > 0)
    start, end, row, count, looks = start[some], end[some], row[some], count[some], looks[some]
    if not len(start):
        return []
    # the first and the last letter of each word that has one
    places = np.append(np.flatnonzero(letter), 0)
    lettered = count > 0
    first = np.where(lettered, places[before[start]], start)
    last = np.where(lettered, places[before[end] - 1] + 1, end)
    noisy = lettered & ((last - first) != count)
    lead = np.maximum(first - 1, 0)
    noisy |= (first - start == 1) & _LEADING[low[lead]] & (count >= 2)
    trail = np.minimum(last, len(low) - 1)
    noisy |= (end - last == 1) & np.isin(low[trail], (36, 64)) & (count >= 2)
    double, triple = np.zeros(len(low) + 1, np.int64), np.zeros(len(low) + 1, np.int64)
    if len(low) > 2:
        double[2:] = np.cumsum((low[1:] == low[:-1]) & letter[1:])
        triple[3:] = np.cumsum((low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & letter[2:])
    noisy |= lettered & (triple[last] - triple[np.minimum(first + 2, last)] > 0)
    doubled = lettered & (double[last] - double[np.minimum(first + 1, last)] > 0)
    firm, around = sums(letter | look & ~_AROUND[low]), sums(_AROUND[low])
    bare = (firm[end] - firm[start] == 1) & (around[end] - around[start] == end - start - 1)
    single = bare | ((end - start == 1) & (looks == 1))
    in_run = np.zeros(len(start), bool)
    if single.any():
        edge = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
        for a, b in zip(edge[::2], edge[1::2]):
            for r in np.unique(row[a:b]):
                mine = np.flatnonzero(row[a:b] == r) + a
                if len(mine) >= 3:
                    in_run[mine] = True
    plain = lettered & ~noisy & ~in_run
    out = [(low, first[plain], last[plain], row[plain])]
    forms: list[tuple[bytes, np.ndarray]] = []  # and the rows they are in
    view = low.tobytes()
    # the trimmed form of noisy and doubled words, and all of a word with look-alikes; each distinct one is restored once
    trimmed = np.flatnonzero(lettered & (noisy | doubled) & ~in_run)
    whole = np.flatnonzero((looks > 0) & ~in_run)
    a = np.concatenate([first[trimmed] - (first[trimmed] - start[trimmed] == 1), start[whole]])
    b = np.concatenate([last[trimmed] + ((end[trimmed] - last[trimmed] == 1) & np.isin(low[trail[trimmed]], (36, 64))), end[whole]])
    if len(a):
        row_of = np.concatenate([row[trimmed], row[whole]])
        _, one, which = np.unique(run_hashes(low, a, b), return_index=True, return_inverse=True)
        order = np.argsort(which, kind="stable")
        for i, own in zip(one, np.split(row_of[order], np.cumsum(np.bincount(which))[:-1])):
            word = view[a[i] : b[i]]
            found = {restorer(w) for w in {word, word.strip(_SOFT), word.strip(_PUNCTUATION)}}
            for form in found - {b""}:
                forms.append((form, own))
    spaced = np.flatnonzero(in_run)
    if len(spaced):
        for part in np.split(spaced, np.flatnonzero((np.diff(spaced) != 1) | (np.diff(row[spaced]) != 0)) + 1):
            joined = b".".join(view[start[i] : end[i]] if end[i] - start[i] == 1 else view[start[i] : end[i]].strip(_PUNCTUATION) for i in part)
            if len(set(joined)) > 2:  # not one letter again and again
                read = restorer(joined)
                inner = {read[i : i + n] for n in _INNER for i in range(len(read) - n + 1)}  # neighbours such as "a" may run into it
                own = row[part[:1]]
                forms += [(form, own) for form in {read, *inner} - {b""}]
    if forms:
        ends = np.cumsum([len(f) for f, _ in forms])
        begins = np.concatenate([[0], ends[:-1]])
        times = np.array([len(own) for _, own in forms])
        out.append((np.frombuffer(b"".join(f for f, _ in forms), np.uint8), np.repeat(begins, times), np.repeat(ends, times), np.concatenate([own for _, own in forms])))
    return out


def evidence(data: np.ndarray, offs: np.ndarray, restorer: Restorer) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each restored word and of its beginnings."""
    rows, hashes = [np.zeros(0, np.int64)], [np.zeros(0, U64)]
    for low, start, end, row in plain_and_restored(data, offs, restorer):
        rows.append(row)
        hashes.append(run_hashes(low, start, end))
        for k in _PREFIXES:
            longer = end - start > k
            rows.append(row[longer])
            hashes.append(mix(run_hashes(low, start[longer], start[longer] + k) + U64(k)))
    return np.concatenate(rows), np.concatenate(hashes)


@dataclass
class Toxicity:
    characters: CharModel
    hashes: np.ndarray  # sorted
    odds: np.ndarray
    base: float

    def score(self, column: pa.Array) -> np.ndarray:
        restorer = self.__dict__.setdefault("_restorer", Restorer(self.characters))
        if "_filter" not in self.__dict__:
            self._filter = np.zeros(1 << 16, bool)
            self._filter[(self.hashes & U64(0xFFFF)).astype(np.int64)] = True
        out = np.full(len(column), self.base)
        for first, last, data, offs in slices(column):
            row, h = evidence(data, offs, restorer)
            near = self._filter[(h & U64(0xFFFF)).astype(np.int64)] if len(h) else np.zeros(0, bool)
            row, h = row[near], h[near]
            at = np.minimum(np.searchsorted(self.hashes, h), max(0, len(self.hashes) - 1))
            hit = self.hashes[at] == h if len(self.hashes) else np.zeros(0, bool)
            np.maximum.at(out[first:last], row[hit], self.odds[at[hit]])
        return 1 / (1 + np.exp(-out))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}


def fit(labelled: DataFrame, corpus: DataFrame, text: str = "text", label: str = "label", key: str = "doc_id", rows: int = TRAIN_ROWS) -> Toxicity:
    """Learns the channel's language model from all texts of `corpus` and the evidence from about `rows` labelled rows.

    A word counts once per text. It is kept as evidence if the log likelihood ratio of its counts in toxic and
    other texts is beyond what chance gives among as many words, and it is commoner in toxic ones. With no
    labelled rows all scores are 0.5; with none that are toxic, low. Null and empty texts have no evidence; rows that
    repeat an id are sampled together, and toxic texts that are equal explain once.
    """
    characters = CharModel.fit(in_batches(corpus.select(text)))
    known = labelled.where(F.col(label).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).cast("int").alias("label"))
    sample = bounded_sample(known, "key", rows)
    shared = labelled.sparkSession.sparkContext.broadcast(characters)

    def count(batches):
        restorer = Restorer(shared.value)
        texts = [0, 0]
        for batch in batches:
            label_of = batch["label"].to_numpy()
            texts = [texts[0] + int((label_of == 0).sum()), texts[1] + int((label_of != 0).sum())]
            for first, last, data, offs in slices(batch["text"]):
                row, h = evidence(data, offs, restorer)
                order = np.lexsort((row, h))
                row, h = row[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                row, h = row[new], h[new]
                word, at = np.unique(h, return_inverse=True)
                toxic = np.bincount(at, weights=label_of[first:last][row] != 0, minlength=len(word)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(toxic), pa.array(np.bincount(at, minlength=len(word)).astype(np.int64) - toxic)], names=["word", "toxic", "other"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([texts[1]], pa.int64()), pa.array([texts[0]], pa.int64())], names=["word", "toxic", "other"])

    sums = sample.select("label", "text").mapInArrow(count, "word long, toxic long, other long").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum("other").alias("c"))
    found = sums.where("word is null or (t >= 3 and t >= 5 * c)").collect()  # far fewer than the sample's words
    n_toxic, n_other = next(((r["t"], r["c"]) for r in found if r["word"] is None), (0, 0))
    if not n_toxic + n_other:
        return Toxicity(characters, np.zeros(0, U64), np.zeros(0), 0.0)
    words = np.array([r["word"] for r in found if r["word"] is not None], np.int64).view(U64)
    t, c = (np.array([r[k] for r in found if r["word"] is not None], float) for k in "tc")
    share = n_toxic / max(1, n_toxic + n_other)
    ratio = likelihood_ratio(t, c, share)
    odds = np.log((t + 0.5) / (c + 0.5))
    order = np.argsort(words)
    order = order[(ratio > beyond_chance(len(words)))[order]]
    words, odds = words[order], odds[order]
    chosen = explaining(sample, words, odds, c[order], share, shared)
    base = np.log((0.1 * n_toxic + 0.5) / (n_other + 1))
    return Toxicity(characters, words[chosen], odds[chosen], float(min(base, -0.5)))


def likelihood_ratio(t: np.ndarray, c: np.ndarray, share: float) -> np.ndarray:
    """Twice the log likelihood ratio of counts in toxic and other texts against the share of toxic texts."""
    some = lambda n, expected: np.where(n > 0, n * np.log(np.maximum(n, 1) / np.maximum(expected, 1e-9)), 0)
    return 2 * (some(t, (t + c) * share) + some(c, (t + c) * (1 - share)))


def beyond_chance(words: int) -> float:
    """A likelihood ratio that none of so many words reaches by chance."""
    return 2 * np.log(max(10, words) * 20) + 4


def likenesses(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows x LIKENESSES: the least hashes of each row's runs of five words (of three, of one in shorter rows); near copies share most of them."""
    tokens = split_words(LOWER[data], offs)
    out = np.full((len(offs) - 1, LIKENESSES), np.iinfo(np.int64).max)
    for size in (1, 3, 5):
        row, h = grams(tokens, size)
        if not len(row):
            continue
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        for k in range(LIKENESSES):
            out[row[first], k] = np.minimum.reduceat(mix(h + U64(k)), first).view(np.int64)
    return out


def explaining(sample: DataFrame, words: np.ndarray, odds: np.ndarray, others: np.ndarray, share: float, characters) -> np.ndarray:
    """Which of the (sorted) words are evidence themselves and not just neighbours of such words.

    Words that merely stand beside toxic ones, as in copies of one text, would be evidence too. A word is taken if
    its count is beyond chance even when near copies count once (texts that share a likeness; the least number of
    different ones is taken), or if it explains toxic texts that stronger words leave unexplained: the one found in
    most texts not yet explained first, until none adds enough. The driver gets the candidates of the sample's
    toxic texts, each distinct text once.
    """
    if not len(words):
        return np.zeros(0, np.int64)
    model = sample.sparkSession.sparkContext.broadcast(words)

    def candidates(batches):
        restorer = Restorer(characters.value)
        for batch in batches:
            for first, last, data, offs in slices(batch["text"]):
                row, h = evidence(data, offs, restorer)
                at = np.minimum(np.searchsorted(model.value, h), len(model.value) - 1)
                hit = model.value[at] == h
                row, at = row[hit], at[hit]
                yield pa.RecordBatch.from_arrays([pa.array([np.unique(at[row == r]).tolist() for r in range(last - first)], pa.list_(pa.int32())), pa.array(likenesses(data, offs).tolist(), pa.list_(pa.int64()))], names=["words", "likenesses"])

    texts = sample.where("label <> 0").select("text", F.xxhash64("text").alias("h")).dropDuplicates(["h"]).select("text")
    toxic = [r for r in texts.mapInArrow(candidates, "words array<int>, likenesses array<long>").collect() if r["words"]]
    kinds: list[list[set]] = [[set() for _ in range(LIKENESSES)] for _ in words]
    for r in toxic:
        for w in r["words"]:
            for seen, x in zip(kinds[w], r["likenesses"]):
                seen.add(x)
    apart = np.array([min(map(len, x)) for x in kinds], float)
    chosen = set(np.flatnonzero((likelihood_ratio(apart, others, share) > beyond_chance(len(words))) & (apart + 0.5 >= SURE * (others + 0.5))).tolist())
    open_texts = [set(r["words"]) for r in toxic if not chosen.intersection(r["words"])]
    least = max(3, LEAST_SHARE * len(toxic))
    while open_texts:
        n = np.zeros(len(words))
        for w in open_texts:
            n[list(w)] += 1
        best = int(np.argmax(n * (1 + 1e-3 * odds)))
        if n[best] < least:
            break
        chosen.add(best)
        open_texts = [w for w in open_texts if best not in w]
    return np.array(sorted(chosen), np.int64)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(spark, docs, sf_dir)
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def score_documents(spark: SparkSession, docs: DataFrame, sf_dir: str, out: str = "score") -> DataFrame:
    """docs with the toxicity of each text as the column `out`, learned from the labels that are not held out."""
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0)).select("doc_id", F.col("toxic").alias("label")).where("label is not null")
    chosen = bounded_sample(labels, "doc_id", TRAIN_ROWS)
    model = fit(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), docs)  # at most about TRAIN_ROWS small rows
    return with_score(docs, model, out=out)
