"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of one word and the space behind it, forwards and
backwards; its state starts anew at each word.  Every position gets
probabilities of all languages, and a document's are the mean over all its
positions.  As a word's probabilities depend on its bytes alone, a task computes
each distinct word once.

The network is trained on the driver in numpy by backpropagation through time,
on words of a bounded sample of labelled documents: of each language that any
label names as many as ``SAMPLE_DOCS`` has room for, ``DOCS_PER_LANGUAGE`` at
most, one at least; of a longer document a passage of ``PASSAGE_CHARS``
characters.  ``WORDS`` words are drawn from them.  Prediction covers every whole
text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from siftrank.llm.common import bound_batches, named, release, string_groups, whole_text, without, worker_state
from siftrank.operators.ranking import full_rank
from siftrank.scratch import materialize

SAMPLE_DOCS = 19_200      # training documents of all languages together
DOCS_PER_LANGUAGE = 300
PASSAGE_CHARS = 1 << 12   # 16 KB at most
WORDS = 40_000     # words of the sample that are read, in each pass
PASSES = 2
BATCH = 128
RATE = 0.02
HIDDEN = 16
RUN_BYTES = 48      # a longer word is read in runs of so many bytes
CACHE_WORDS = 400_000
KEPT_SHARE = 0.99   # of the rightly predicted documents, ``kept_documents`` keeps so many in each language
SPARE_SHARE = 0.2   # of a language's labelled documents are not trained on there, at least
UNKNOWN = "und"


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Network:
    """Weights of both directions: input table (257 rows, the last for padding), recurrence, and the output layer."""
    languages: list[str]
    weights: dict[str, np.ndarray]

    @staticmethod
    def new(languages: list[str], hidden: int = HIDDEN, seed: int = 0) -> Network:
        chance = np.random.default_rng(seed)
        weights = {}
        for way in "fb":
            weights[f"x{way}"] = chance.normal(0, 0.3, (257, 3 * hidden)).astype(np.float32)
            weights[f"u{way}"] = chance.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)
        weights["out"] = chance.normal(0, 0.2, (2 * hidden, len(languages))).astype(np.float32)
        weights["bias"] = np.zeros(len(languages), dtype=np.float32)
        return Network(languages, weights)

    def run(self, way: str, data: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (time, batch, hidden) of one direction; ``keep`` gathers what the way back needs."""
        x, u = self.weights[f"x{way}"], self.weights[f"u{way}"]
        hidden = u.shape[0]
        state = np.zeros((data.shape[0], hidden), dtype=np.float32)
        states = np.empty((data.shape[1], data.shape[0], hidden), dtype=np.float32)
        for t in range(data.shape[1]):
            given, own = x[data[:, t]], state @ u
            gates = sigmoid(given[:, :2 * hidden] + own[:, :2 * hidden])
            z, r = gates[:, :hidden], gates[:, hidden:]
            new = np.tanh(given[:, 2 * hidden:] + r * own[:, 2 * hidden:])
            if keep is not None:
                keep.append((state, z, r, new, own[:, 2 * hidden:]))
            state = new + z * (state - new)
            states[t] = state
        return states

    def forward(self, data: np.ndarray, length: np.ndarray, keep: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities (batch, time, language) of padded runs, and the mask of their positions."""
        steps = np.arange(data.shape[1])
        mask = steps[None, :] < length[:, None]
        back = np.where(mask, length[:, None] - 1 - steps[None, :], steps[None, :])
        turned = np.take_along_axis(data, back, axis=1)
        ahead = self.run("f", data, None if keep is None else keep.setdefault("f", []))
        behind = self.run("b", turned, None if keep is None else keep.setdefault("b", []))
        lines = np.arange(len(data))[:, None]
        both = np.concatenate([ahead.transpose(1, 0, 2), behind.transpose(1, 0, 2)[lines, back]], axis=2)
        logits = both @ self.weights["out"] + self.weights["bias"]
        logits -= logits.max(axis=2, keepdims=True)
        chance = np.exp(logits)
        chance /= chance.sum(axis=2, keepdims=True)
        if keep is not None:
            keep.update(both=both, turned=turned, back=back)
        return chance, mask

    def gradients(self, data: np.ndarray, length: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions, and its derivatives."""
        keep: dict = {}
        chance, mask = self.forward(data, length, keep)
        lines = np.arange(len(data))
        n = mask.sum()
        loss = -float((np.log(chance[lines, :, label] + 1e-12) * mask).sum() / n)
        error = chance.copy()
        error[lines, :, label] -= 1
        error *= (mask / n)[:, :, None].astype(np.float32)
        hidden = self.weights["uf"].shape[0]
        found = {"out": np.einsum("bth,btc->hc", keep["both"], error), "bias": error.sum(axis=(0, 1))}
        both = error @ self.weights["out"].T
        for way, read, into in (("f", data, both[:, :, :hidden]),
                                ("b", keep["turned"], both[:, :, hidden:][lines[:, None], keep["back"]])):
            u = self.weights[f"u{way}"]
            dx, du = np.zeros_like(self.weights[f"x{way}"]), np.zeros_like(u)
            slopes = np.empty((data.shape[1], len(data), 3 * hidden), dtype=dx.dtype)
            carry = np.zeros((len(data), hidden), dtype=np.float32)
            for t in range(data.shape[1] - 1, -1, -1):
                state, z, r, new, own = keep[way][t]
                carry = carry + into[:, t]
                d_new = carry * (1 - z) * (1 - new * new)
                d_z = carry * (state - new) * z * (1 - z)
                d_r = d_new * own * r * (1 - r)
                slopes[t, :, :hidden], slopes[t, :, hidden:2 * hidden], slopes[t, :, 2 * hidden:] = d_z, d_r, d_new
                d_own = np.concatenate([d_z, d_r, d_new * r], axis=1)
                du += state.T @ d_own
                carry = carry * z + d_own @ u.T
            order = np.argsort(read.T.reshape(-1), kind="stable")
            given = read.T.reshape(-1)[order]
            first = np.flatnonzero(np.diff(given, prepend=-1))
            dx[given[first]] = np.add.reduceat(slopes.reshape(-1, 3 * hidden)[order], first, axis=0)
            found[f"x{way}"], found[f"u{way}"] = dx, du
        return loss, found


def runs_of(word: bytes) -> list[bytes]:
    """The runs of bytes the network reads for a word and the space behind it."""
    word += b" "
    return [word[at:at + RUN_BYTES] for at in range(0, len(word), RUN_BYTES)]


def padded(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    length = np.fromiter(map(len, runs), dtype=np.int64, count=len(runs))
    data = np.full((len(runs), int(length.max(initial=1))), 256, dtype=np.int64)
    data[np.arange(data.shape[1])[None, :] < length[:, None]] = np.frombuffer(b"".join(runs), dtype=np.uint8)
    return data, length


def train(texts: list[tuple[str, str]], words: int = WORDS, passes: int = PASSES, seed: int = 0) -> Network | None:
    """Network for (language, text) pairs; None without any.  Each language is drawn equally often."""
    chance = np.random.default_rng(seed)
    by: dict[str, list[bytes]] = {}
    for language in sorted({language for language, _ in texts}):
        own = [run for name, text in texts if name == language for word in text.split() for run in runs_of(word.encode())]
        if own:  # at most ``words`` runs of a language are held
            by[language] = own if len(own) <= words else [own[i] for i in chance.choice(len(own), words, replace=False).tolist()]
    languages = list(by)
    if not languages:
        return None
    network = Network.new(languages, seed=seed)
    first = {k: np.zeros_like(v) for k, v in network.weights.items()}
    second = {k: np.zeros_like(v) for k, v in network.weights.items()}
    step, total = 0, passes * (words // BATCH)
    for _ in range(passes):
        drawn = []
        for label, language in enumerate(languages):
            own = by[language]
            drawn += [(own[i], label) for i in chance.integers(0, len(own), words // len(languages)).tolist()]
        chance.shuffle(drawn := np.array(drawn, dtype=object))
        for at in range(0, len(drawn) - BATCH + 1, BATCH):
            some = drawn[at:at + BATCH]
            data, length = padded(some[:, 0].tolist())
            _, slope = network.gradients(data, length, some[:, 1].astype(np.int64))
            step += 1
            rate = RATE * max(0.05, 1 - step / max(total, 1))
            for name, value in network.weights.items():  # Adam
                first[name] = 0.9 * first[name] + 0.1 * slope[name]
                second[name] = 0.999 * second[name] + 0.001 * slope[name] ** 2
                value -= (rate * (first[name] / (1 - 0.9 ** step)) / (np.sqrt(second[name] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return network


class Reader:
    """Pooled probabilities of texts; each distinct word is computed once."""

    def __init__(self, network: Network) -> None:
        self.network = network
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.sums = np.zeros((1 << 12, len(self.network.languages) + 1), dtype=np.float32)

    def learn(self, words: list[str]) -> None:
        runs, owner = [], []
        for i, word in enumerate(words):
            own = runs_of(word.encode())
            runs += own
            owner += [i] * len(own)
        sums = np.zeros((len(words), self.sums.shape[1]), dtype=np.float64)
        owner = np.array(owner, dtype=np.int64)
        size = np.fromiter(map(len, runs), dtype=np.int64, count=len(runs))
        order = np.argsort(size, kind="stable")
        for at in range(0, len(order), 2048):
            some = order[at:at + 2048]
            data, length = padded([runs[i] for i in some.tolist()])
            chance, mask = self.network.forward(data, length)
            np.add.at(sums[:, :-1], owner[some], np.einsum("btc,bt->bc", chance, mask.astype(np.float32)))
            np.add.at(sums[:, -1], owner[some], length)
        first = len(self.known)
        while len(self.sums) < first + len(words):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        self.sums[first:first + len(words)] = sums
        for i, word in enumerate(words):
            self.known[word] = first + i

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if len(self.known) > CACHE_WORDS:
            self.clear()
        parts = [text.split() for text in texts]
        wanted = set()
        for part in parts:
            wanted.update(part)
        known = self.known
        self.learn([w for w in sorted(wanted) if w not in known])
        names, scores = [], []
        for text, part in zip(texts, parts):
            if not part or not any(map(str.isalpha, text)):
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            rows = np.fromiter(map(known.__getitem__, part), dtype=np.int64, count=len(part))
            total = self.sums[rows].sum(axis=0, dtype=np.float64)
            mean = total[:-1] / total[-1]
            best = int(mean.argmax())
            names.append(self.network.languages[best])
            scores.append(min(1.0, float(mean[best])))
        return names, scores


def label_positions(network: Network, text: str) -> np.ndarray:
    """Probabilities of every language at every byte of a text; white space between words shares the last position of a word."""
    out = np.zeros((len(text.encode()), len(network.languages)))
    at = 0
    raw = text.encode()
    last = np.full(len(network.languages), 1 / max(1, len(network.languages)))
    for word in text.split():
        own = word.encode()
        start = raw.index(own, at)
        out[at:start] = last
        data, length = padded(runs_of(own))
        chance, mask = network.forward(data, length)
        rows = chance[mask]
        out[start:start + len(own)] = rows[:len(own)]
        last, at = rows[-1], start + len(own)
    out[at:] = last
    return out


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def drawn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
          spare: bool = False) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(language, text) of the bounded training sample, and of as many other documents if ``spare`` ones are asked for.

    Neither has documents that are held out or have no language.
    """
    sample = _sample(docs, doc_id, text, lang, spare)
    return [(r.lang, r.text) for r in sample if r.trained], [(r.lang, r.text) for r in sample if not r.trained]


def _sample(docs: DataFrame, doc_id: str, text: str, lang: str, spare: bool) -> list[Row]:
    """The documents of ``drawn`` (lang, text, id, trained)."""
    rows = docs.select(named(docs, doc_id).alias("id"), named(docs, lang).cast("string").alias("lang"),
                       named(docs, text).cast("string").alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    counts = materialize(rows.groupBy("lang").count(), "languages")
    each = max(1, min(DOCS_PER_LANGUAGE, SAMPLE_DOCS // max(1, counts.count())))
    limit = each * (2 if spare else 1)
    # By the hash of its id a document is among a few times as many as are wanted, so a language's rows are few before they are ranked.
    mixed = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    early = rows.join(counts, "lang").filter(mixed < F.lit(float(1 << 40)) * (4 * limit + 50) / F.col("count"))
    start = F.pmod(F.xxhash64(F.lit(1), "id"), F.greatest(F.length("text") - PASSAGE_CHARS, F.lit(0)) + 1).cast("int") + 1
    passages = early.select("id", "lang", "count", F.substring("text", start, F.lit(PASSAGE_CHARS)).alias("text"))
    line = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "text")
    chosen = passages.withColumn("n", F.row_number().over(line)).filter(F.col("n") <= limit)
    trained = F.lit(each)
    if spare:
        trained = F.least(trained, F.ceil(F.col("count") * (1 - SPARE_SHARE)))
    # At most ``limit`` passages of each language.
    sample = chosen.select("lang", "text", "id", (F.col("n") <= trained).alias("trained")).collect()
    return sorted(sample, key=lambda r: (r.lang, r.id, r.text))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **options: int) -> Network | None:
    """Train on the bounded sample of documents that are not held out and have a language."""
    return train(drawn(docs, doc_id, text, lang)[0], **options)


def lowest_scores(network: Network | None, texts: list[tuple[str, str]]) -> dict[str, float]:
    """Score of each language that ``KEPT_SHARE`` of its rightly predicted texts reach.

    A language with too few of them to tell has the score that as many of all
    languages' reach.  If these are too few as well, it is the lowest score less
    its distance from the median; 0 if there are none at all.
    """
    if network is None:
        return {}
    reader, right = Reader(network), {}
    for at in range(0, len(texts), 64):
        some = texts[at:at + 64]
        for (language, _), name, score in zip(some, *reader.predict([text for _, text in some])):
            if name == language:
                right.setdefault(language, []).append(score)
    everything = [score for own in right.values() for score in own] or [0.0]
    found = {}
    for language in network.languages:
        own = right.get(language, [])
        own = sorted(own if len(own) * (1 - KEPT_SHARE) >= 1 else everything)
        lost = int((1 - KEPT_SHARE) * len(own))
        found[language] = own[lost] if lost else max(0.0, 2 * own[0] - own[len(own) // 2])
    return found


def lowest_found(right: DataFrame, languages: list[str]) -> dict[str, float]:
    """``lowest_scores`` of all rightly predicted documents (lang, score) of a table of any size; no score is left out."""
    right = materialize(right.select("lang", "score"), "right_scores")
    counts = {r["lang"]: r["count"] for r in right.groupBy("lang").count().collect()}  # one row per language
    lost = {name: int((1 - KEPT_SHARE) * n) for name, n in counts.items()}
    places = [(name, n + 1) for name, n in lost.items() if n]
    found = {}
    if places:
        wanted = right.sparkSession.createDataFrame(places, "lang string, rank long")
        ranked = full_rank(right, ["lang"], [F.asc("score")])
        found = {r.lang: r.score for r in ranked.join(F.broadcast(wanted), ["lang", "rank"]).collect()}
    if any(name not in found for name in languages):
        total = sum(counts.values())
        all_lost = int((1 - KEPT_SHARE) * total)
        places = [all_lost + 1] if all_lost else [1, total // 2 + 1]
        at = {r["rank"]: r.score for r in full_rank(right, [], [F.asc("score")]).filter(F.col("rank").isin(places)).collect()}
        rest = 0.0 if not total else at[all_lost + 1] if all_lost else max(0.0, 2 * at[1] - at[total // 2 + 1])
        found = {name: found.get(name, rest) for name in languages}
    return {name: found[name] for name in languages}


def identify(docs: DataFrame, network: Network | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score; columns of these names are replaced.

    ``und`` with score 0 for a null text, one without a letter, or where no
    language was learned; an empty table stays empty.
    """
    bound_batches(docs)
    kept = without(docs, ["lang_pred", "score"])
    version = uuid.uuid4().hex  # of the network, for the workers' readers

    @F.pandas_udf("lang_pred string, score double")
    def read(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        readers = worker_state("language_readers")
        if network is not None and version not in readers:
            readers.clear()
            readers[version] = Reader(network)
        for part in parts:
            names: list[str] = []
            scores: list[float] = []
            for group in string_groups(part.tolist()):
                found = ([UNKNOWN] * len(group), [0.0] * len(group)) if network is None else readers[version].predict(group)
                names += found[0]
                scores += found[1]
            yield pd.DataFrame({"lang_pred": names, "score": scores})
        readers.clear()  # a task meets as many words as are kept, so the next one has little use for them
        release()

    # Only the text travels to the workers.
    found = kept.select("*", read(whole_text(named(docs, text))).alias("_found"))
    return found.select(*[named(kept, c) for c in kept.columns], "_found.lang_pred", "_found.score")


def kept_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Documents whose language is known with a score that clear documents of the language have.

    The lowest score is that of ``lowest_scores`` on all labelled documents that
    this network was not trained on; they are read once, with all others, and the
    found languages are written before the scores are compared.  With one language
    learned all scores are 1, and only texts without a letter are dropped.
    """
    own = docs.columns
    sample = [r for r in _sample(docs, doc_id, text, lang, True) if r.trained]
    network = train([(r.lang, r.text) for r in sample])
    packed = docs.select(F.struct(*[named(docs, c) for c in own]).alias("_row"), whole_text(named(docs, text)).alias("text"),
                         named(docs, doc_id).alias("id"), named(docs, lang).cast("string").alias("lang"))
    found = identify(packed, network, "text")  # the struct keeps the rows' own columns apart from the new ones
    labelled = F.col("lang").isNotNull() & ~held_out(F.col("id"))
    found = materialize(found.select("_row", "lang_pred", "score", F.when(labelled, F.col("lang")).alias("lang"),
                                     F.col("id").cast("string").alias("id")), "found_languages")
    trained = docs.sparkSession.createDataFrame(sorted({(str(r.id),) for r in sample}), "id string")  # a bounded sample
    right = found.filter(F.col("lang") == F.col("lang_pred")).join(F.broadcast(trained), "id", "left_anti")
    lowest = lowest_found(right, network.languages) if network else {}
    clear = F.lit(False)
    for language, score in lowest.items():  # the score itself is rounded when words are summed in another order
        clear = clear | ((F.col("lang_pred") == language) & (F.col("score") >= score - 1e-6))
    return found.filter((F.col("lang_pred") != UNKNOWN) & clear).select("_row.*")
