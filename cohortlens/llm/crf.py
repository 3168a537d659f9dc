"""Language identification by a linear-chain conditional random field over words.

Each word has a language. Its features are affixes, character n-grams, the word
itself and whether each language's lexicon holds it; transitions between the
languages of neighbouring words are learned too, so a text may switch. A
document's language is the one with the greatest mean marginal probability, by
forward-backward over the whole text.

The model is fitted on a bounded sample of labelled documents. Their words take
their document's label; transitions are learned from texts spliced of them.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens.llm.common import longs_again, longs_as_text, stored

CHUNK = 64
# Numbers (words x languages) of a task's documents that are held at once, and word types it remembers.
SCORES_AT_ONCE = 800_000
TYPES_KEPT = 200_000
WORD_LIKE = re.compile(r"[^\W\d_]+")


def words_in(text: str | None) -> list[str]:
    """Runs of letters, lower-cased; fractions, Roman numerals and the like are no letters."""
    words = WORD_LIKE.findall(text.lower()) if text else []
    if not words or "".join(words).isalpha():
        return words
    return [w for run in words for w in "".join(c if c.isalpha() else " " for c in run).split()]


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # features x languages
    moves: np.ndarray  # log weight of language to language
    starts: np.ndarray
    lexicon: dict[str, int] = field(default_factory=dict)  # word to a bit set of languages
    token: str = field(default_factory=lambda: uuid.uuid4().hex)  # tells models of a session apart

    def features(self, word: str) -> list[int]:
        """Hashed features of a word."""
        size, edged = len(self.weights), f"<{word}>"
        names = ["w" + word]
        names += [f"p{word[:k]}" for k in (1, 2, 3)] + [f"s{word[-k:]}" for k in (1, 2, 3)]
        names += [f"g{edged[i : i + k]}" for k in (2, 3) for i in range(len(edged) - k + 1)]
        found = self.lexicon.get(word, 0)
        names += [f"l{i}" for i in range(len(self.languages)) if found >> i & 1]
        return [zlib.crc32(n.encode("utf-8", "replace")) % size for n in names]


class _Buckets(dict):
    """The bucket of every feature name of one kind; names recur, so each is hashed once."""

    def __init__(self, kind: str, size: int):
        super().__init__()
        self.kind, self.size = kind, size

    def __missing__(self, name: str) -> int:
        if len(self) >= TYPES_KEPT:
            self.clear()
        self[name] = bucket = zlib.crc32((self.kind + name).encode("utf-8", "replace")) % self.size
        return bucket


class WordScores:
    """The scores of word types under a model, each type scored once while it is remembered."""

    def __init__(self, model: LanguageModel):
        self.model = model
        size = len(model.weights)
        self.affixes, self.endings, self.grams = (_Buckets(kind, size) for kind in "psg")
        self.forget()

    def forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.table = np.zeros((1 << 12, len(self.model.languages)))

    def _features(self, word: str) -> list[int]:
        """The list of :meth:`LanguageModel.features`, from remembered buckets."""
        size, edged, n = len(self.model.weights), f"<{word}>", len(word) + 2
        p, s, g = self.affixes, self.endings, self.grams
        found = [zlib.crc32(b"w" + word.encode("utf-8", "replace")) % size]
        found += [p[word[:1]], p[word[:2]], p[word[:3]], s[word[-1:]], s[word[-2:]], s[word[-3:]]]
        found += [g[edged[i : i + 2]] for i in range(n - 1)]
        found += [g[edged[i : i + 3]] for i in range(n - 2)]
        bits = self.model.lexicon.get(word, 0)
        if bits:
            found += [zlib.crc32(b"l%d" % i) % size for i in range(len(self.model.languages)) if bits >> i & 1]
        return found

    def codes(self, words: list[str]) -> np.ndarray:
        """Row numbers of ``words`` in ``table``."""
        new = list(set(words).difference(self.seen))
        if len(self.seen) + len(new) > TYPES_KEPT and self.seen:
            self.forget()
            return self.codes(words)
        for begin in range(0, len(new), 10_000):
            part = new[begin : begin + 10_000]
            features = [self._features(word) for word in part]
            counts = np.fromiter(map(len, features), np.int64, len(features))
            flat = np.fromiter(chain.from_iterable(features), np.int64, int(counts.sum()))
            sums = np.add.reduceat(self.model.weights[flat], np.cumsum(counts) - counts, axis=0)
            n = len(self.seen)
            if n + len(part) > len(self.table):
                grown = np.zeros((2 * (n + len(part)), self.table.shape[1]))
                grown[:n] = self.table[:n]
                self.table = grown
            self.table[n : n + len(part)] = sums
            self.seen.update(zip(part, range(n, n + len(part))))
        return np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))


# A worker process runs many tasks: what it knows of a model's words stays for the next.
_REMEMBERED: dict[str, WordScores] = {}


def _word_scores(model: LanguageModel) -> WordScores:
    if model.token not in _REMEMBERED:
        _REMEMBERED.clear()
        _REMEMBERED[model.token] = WordScores(model)
    return _REMEMBERED[model.token]


def _normal(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def marginals(model: LanguageModel, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Probability of each language for each word, by forward-backward.

    ``scores``: words x languages of all documents in turn, of ``lengths`` words. A
    document is cut into chunks, and all chunks are swept side by side, the longest
    first, so that those still running at word t are the first ``live[t]``. Documents
    of several chunks get the messages between them from the chunks' transfer matrices.
    The result is that of a sweep over the whole document. Memory is a few times that
    of ``scores``, and the transfer matrices' square of languages for every 64 words.
    """
    n_langs, n_words = len(model.languages), len(scores)
    if not n_words:
        return np.zeros((0, n_langs))
    move = np.exp(model.moves - model.moves.max())
    start = np.exp(model.starts - model.starts.max())
    chunks = -(-lengths // CHUNK)
    first = np.cumsum(chunks) - chunks  # each document's first chunk
    total = int(chunks.sum())
    sizes = np.full(total, CHUNK)
    ends = (first + chunks - 1)[chunks > 0]
    sizes[ends] = (lengths - (chunks - 1) * CHUNK)[chunks > 0]
    rank = np.empty(total, np.int64)  # by falling size
    rank[np.argsort(-sizes, kind="stable")] = np.arange(total)
    live = total - np.searchsorted(np.sort(sizes), np.arange(CHUNK), side="right")
    rows = np.cumsum(live) - live  # where word t of all chunks is kept
    place = np.arange(n_words) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = rows[place % CHUNK] + rank[np.repeat(first, lengths) + place // CHUNK]
    emit = np.empty((n_words, n_langs))
    emit[at] = np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-12
    begins = np.zeros(total, bool)
    begins[rank[first[chunks > 0]]] = True

    # What enters a chunk before its first word, and what comes back after its last.
    enter = np.full((total, n_langs), 1.0 / n_langs)
    leave = np.full((total, n_langs), 1.0 / n_langs)
    several = np.repeat(chunks > 1, chunks)
    if several.any():
        own = rank[several]  # the chunks that are carried between
        order = np.argsort(own)
        own = own[order]
        carried = np.searchsorted(own, np.arange(total))
        whole = np.broadcast_to(np.eye(n_langs), (len(own), n_langs, n_langs)).copy()
        opening = begins[own]
        for t in range(CHUNK):
            n = int(np.searchsorted(own, live[t]))
            now = emit[rows[t] + own[:n]]
            new = (whole[:n].reshape(-1, n_langs) @ move).reshape(n, n_langs, n_langs)
            if t == 0:
                new[opening[:n]] = start
            new *= now[:, None, :]
            new /= new.sum(axis=(1, 2), keepdims=True)
            whole[:n] = new
        for r in range(1, int(chunks.max())):
            now = first[chunks > r] + r
            message = whole[carried[rank[now - 1]]]
            enter[rank[now]] = _normal(np.einsum("ni,nij->nj", enter[rank[now - 1]], message))
            last = (first + chunks - 1)[chunks > r] - r
            message = whole[carried[rank[last + 1]]]
            leave[rank[last]] = _normal(np.einsum("nij,nj->ni", message, leave[rank[last + 1]]))
    ahead = np.empty((n_words, n_langs))
    for t in range(CHUNK):
        n = live[t]
        if not n:
            break
        now = enter[:n] @ move
        if t == 0:
            now[begins] = start
        now *= emit[rows[t] : rows[t] + n]
        now /= now.sum(axis=1, keepdims=True)
        ahead[rows[t] : rows[t] + n] = enter[:n] = now
    for t in range(CHUNK - 1, -1, -1):
        n = live[t]
        if n:
            span = slice(rows[t], rows[t] + n)
            ahead[span] *= leave[:n]
            ahead[span] /= ahead[span].sum(axis=1, keepdims=True)
            leave[:n] = _normal((emit[span] * leave[:n]) @ move.T)
    return ahead[at]


def fit(
    texts: list[tuple[str, str]],
    *,
    buckets: int = 1 << 16,
    lexicon_words: int = 200,
    rounds: int = 40,
    rate: float = 0.3,
    decay: float = 1e-6,
    span: int = 20,
    seed: int = 0,
) -> LanguageModel:
    """A model of the languages in ``texts`` (text, language), by gradient steps on the likelihood.

    Every text is used twice: whole, and cut into spans of ``span`` words on average
    that are spliced with the spans of all others, from which transitions are learned.
    """
    languages = sorted({lang for _, lang in texts})
    n_langs, rng = len(languages), np.random.default_rng(seed)
    number = {lang: i for i, lang in enumerate(languages)}
    rows = [(words_in(text), number[lang]) for text, lang in texts]
    rows = [r for r in rows if r[0]]
    model = LanguageModel(
        languages, np.zeros((buckets, n_langs)), np.zeros((n_langs, n_langs)), np.zeros(n_langs)
    )
    if n_langs < 2 or not rows:
        return model
    for i in range(n_langs):
        common = Counter(w for words, lang in rows if lang == i for w in words)
        for word, _ in sorted(common.items(), key=lambda x: (-x[1], x[0]))[:lexicon_words]:
            model.lexicon[word] = model.lexicon.get(word, 0) | 1 << i
    kinds: dict[str, int] = {}
    coded = [(np.array([kinds.setdefault(w, len(kinds)) for w in words]), lang) for words, lang in rows]
    spans = []
    for ids, lang in coded:
        cuts = np.flatnonzero(rng.random(len(ids)) < 1 / span)
        spans += [(part, lang) for part in np.split(ids, cuts) if len(part)]
    order = rng.permutation(len(spans))
    stream = [*coded, *[spans[i] for i in order]]
    ids = np.concatenate([s[0] for s in stream])
    labels = np.concatenate([np.full(len(s[0]), s[1]) for s in stream])
    size = -(-len(ids) // CHUNK) * CHUNK
    # The last sequence is filled up from the beginning.
    ids, labels = np.resize(ids, size).reshape(-1, CHUNK), np.resize(labels, size).reshape(-1, CHUNK)
    feats = [model.features(w) for w in kinds]
    counts = np.array([len(f) for f in feats])
    flat = np.concatenate(feats).astype(np.int64)
    offsets = np.cumsum(counts) - counts
    n = len(ids)
    truth = np.eye(n_langs)[labels]
    true_moves = np.einsum("nti,ntj->ij", truth[:, :-1], truth[:, 1:])
    params = [model.weights, model.moves, model.starts]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, rounds + 1):
        # a language at a time, since a row for every feature of every word type is large
        emit = np.stack([np.add.reduceat(w[flat], offsets) for w in model.weights.T], axis=1)[ids]
        emit = np.exp(emit - emit.max(axis=2, keepdims=True)) + 1e-12
        move = np.exp(model.moves - model.moves.max())
        ahead, behind = np.empty_like(emit), np.empty_like(emit)
        ahead[:, 0] = _normal(np.exp(model.starts - model.starts.max()) * emit[:, 0])
        for t in range(1, CHUNK):
            ahead[:, t] = _normal(ahead[:, t - 1] @ move * emit[:, t])
        behind[:, -1] = 1
        for t in range(CHUNK - 2, -1, -1):
            behind[:, t] = _normal((behind[:, t + 1] * emit[:, t + 1]) @ move.T)
        gap = truth - _normal(ahead * behind)
        right = behind[:, 1:] * emit[:, 1:]
        scale = np.einsum("nti,ij,ntj->nt", ahead[:, :-1], move, right, optimize=True)
        expected = move * np.einsum("nti,ntj->ij", ahead[:, :-1] / scale[..., None], right, optimize=True)
        by_kind = np.stack(
            [np.bincount(ids.ravel(), gap[..., i].ravel(), len(kinds)) for i in range(n_langs)], axis=1
        )
        grads = [
            np.stack([np.bincount(flat, np.repeat(g, counts), buckets) for g in by_kind.T], axis=1),
            true_moves - expected,
            gap[:, 0].sum(axis=0),
        ]
        for i, (p, g) in enumerate(zip(params, grads)):
            g = g / n - decay * p
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            p += rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
    return model


def training_sample(
    docs: DataFrame,
    *,
    text: str,
    lang: str,
    doc_id: str,
    per_language: int,
    max_chars: int,
    max_languages: int,
) -> list[tuple[str, str]]:
    """At most ``per_language`` whole texts of each language, of ``max_chars`` characters or fewer.

    They are those whose ids have the smallest hashes, in the ``max_languages``
    languages that most rows have (in a tie, by name). So many rows, and no more,
    reach the driver.
    """
    stated = docs.select(F.col(f"`{lang}`").alias("lang")).filter("lang IS NOT NULL")
    most = stated.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages)
    learned = [r["lang"] for r in most.collect()]
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("id"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")
    ).filter(
        F.col("id").isNotNull()
        & F.col("lang").isin(learned)
        & F.col("text").isNotNull()
        & (F.length("text") <= max_chars)
    )
    # Chosen on narrow rows; the filter on a row number keeps a few of each task only.
    order = W.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = (
        rows.select("id", "lang", F.row_number().over(order).alias("n"))
        .filter(F.col("n") <= per_language)
        .select("id", "lang")
        .distinct()
    )
    chosen = stored(chosen, "sample")
    found = rows.join(chosen, ["id", "lang"], "left_semi").orderBy("lang", "id").collect()
    return [(r["text"], r["lang"]) for r in found]


def _predict(shared, text: str, carry_text: bool, want_spans: bool):
    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model: LanguageModel = shared.value
        n_langs, known = len(model.languages), _word_scores(model)
        words_at_once = max(1, SCORES_AT_ONCE // n_langs)

        def judge(texts: list[list[str]]) -> pd.DataFrame:
            lengths = np.array([len(w) for w in texts], np.int64)
            ids = known.codes(list(chain.from_iterable(texts)))  # the table may grow
            p = marginals(model, known.table[ids], lengths)
            ends = np.cumsum(lengths)

            def mean(values: np.ndarray) -> np.ndarray:
                sums = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0)])
                return (sums[ends] - sums[ends - lengths]) / np.maximum(lengths, 1)[:, None]

            shares = mean(p)
            best = shares.argmax(axis=1)
            out = pd.DataFrame(
                {
                    "lang_pred": np.where(lengths > 0, np.array(model.languages, object)[best], "und"),
                    "score": np.clip(np.where(lengths > 0, shares.max(axis=1), 0.0), 0.0, 1.0),
                    "certainty": np.clip(mean(p.max(axis=1, keepdims=True))[:, 0], 0.0, 1.0),
                    "n_letter_words": lengths,
                }
            )
            if want_spans:
                spans, pick = [], p.argmax(axis=1)
                for end, n in zip(ends, lengths):
                    own = pick[end - n : end]
                    cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), n] if n else [0]
                    spans.append(
                        [
                            {"begin": a, "end": b, "lang": model.languages[own[a]]}
                            for a, b in zip(cuts, cuts[1:])
                        ]
                    )
                out["spans"] = spans
            return out

        for batch in batches:
            parts, held, size = [], [], 0
            for body in batch[text]:
                held.append(words_in(body))
                size += len(held[-1])
                if size >= words_at_once:
                    parts.append(judge(held))
                    held, size = [], 0
            parts.append(judge(held))
            found = pd.concat(parts, ignore_index=True)
            kept = batch if carry_text else batch.drop(columns=text)
            yield pd.concat([kept.reset_index(drop=True), found], axis=1)

    return predict


def identify_languages(
    docs: DataFrame,
    *,
    learn: Column | None = None,
    text: str = "text",
    lang: str = "lang",
    doc_id: str = "doc_id",
    carry: list[str] | None = None,
    spans: bool = True,
    per_language: int = 150,
    max_chars: int = 20_000,
    max_languages: int = 64,
    **fitting,
) -> DataFrame:
    """The columns ``carry`` (all but the text, if None) with lang_pred, score, certainty, n_letter_words, spans.

    The model learns from rows where ``learn`` holds and text and language are not
    null, at most ``per_language`` for each language and of ``max_chars`` characters
    or fewer; the language and the id of a row are no inputs of its prediction.
    Of more than ``max_languages`` languages, those with the most rows are learned.
    ``score`` is the mean probability of ``lang_pred`` over the words, and ``certainty``
    that of each word's own most probable language, which is high in texts that switch
    too. ``spans`` are the runs of words (runs of letters) of one language. A null text, or one without
    a letter, is ``und`` with score 0, and so is everything where nothing was learned.
    Rows are kept one for one. An input column called like a result is replaced.
    """
    results = ("lang_pred", "score", "certainty", "n_letter_words", "spans")
    names = [c for c in (docs.columns if carry is None else carry) if c not in results]
    names = [c for c in names if carry is not None or c != text]
    known = docs.filter(learn) if learn is not None else docs
    sample = training_sample(
        known,
        text=text,
        lang=lang,
        doc_id=doc_id,
        per_language=per_language,
        max_chars=max_chars,
        max_languages=max_languages,
    )
    # A carried text goes to the tasks and back once.
    own = text if text in names else "_text"
    while own != text and own in names:
        own += "_"
    rows = docs.select(
        *[F.col(f"`{c}`") for c in names], *([] if own in names else [F.col(f"`{text}`").alias(own)])
    )
    model = fit(sample, **fitting)
    if not model.languages:
        model = LanguageModel(["und"], np.zeros((1, 1)), np.zeros((1, 1)), np.zeros(1))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    carried = longs_as_text(rows, [c for c in names if c != own])
    kept = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema.fields if f.name in names
    )
    kind = "lang_pred string, score double, certainty double, n_letter_words long"
    kind += ", spans array<struct<begin: int, end: int, lang: string>>" if spans else ""
    found = carried.mapInPandas(
        _predict(shared, own, own in names, spans), f"{kept}, {kind}" if kept else kind
    )
    found = longs_again(found, rows)
    if model.languages == ["und"]:
        found = found.withColumns({"score": F.lit(0.0), "certainty": F.lit(0.0)})
    return found
