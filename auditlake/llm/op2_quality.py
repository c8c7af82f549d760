"""Operator 2, quality rules by line sequence labelling.

A linear-chain conditional random field labels every line content or boilerplate from shape features of
the line; Viterbi decoding takes the most probable labels of the whole document, and the share of its
words in content lines decides whether it is kept. The field is trained here on a bounded sample of
documents of known quality. Their lines' labels are not known, so learning alternates: the field labels the
lines, the document's quality corrects them (content lines must hold at least CONTENT_SHARE of the words of a
good document and less of a bad one; the lines nearest to the other label change first), and the field is
fitted to these label sequences, lines and transitions.

A null text has no words and fails the base rules; rows are independent; without labels of both kinds
the field keeps its prior weights; texts have no length limit; an empty table gives an empty result;
other columns are not read."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import Interned, importable, intern_words, runs, short, table, text_bytes

#: Bound of the training sample, in documents; all their lines are learned from, in sequences of at most so many.
TRAIN_DOCS = 800
SEQUENCE_LINES = 64
ROUNDS = 3
#: Least share of words in content lines.
CONTENT_SHARE = 0.5
WINDOW = 8
RUN_BYTES = 1 << 20
SPACES = b" \t\n\v\f\r"

#: Measures of a line and the upper bounds of their classes; each class is a feature.
MEASURES = (
    ("symbols a word", (0.0, 0.1, 0.3, 0.6)),
    ("capitals among letters", (0.1, 0.25, 0.5, 0.8)),
    ("repeated words", (0.0, 0.2, 0.4, 0.6, 0.8)),
    ("exclamation marks a word", (0.0, 0.2, 0.6)),
    ("words", (1, 3, 8, 30)),
    ("letters a word", (2, 4, 7, 12)),
)
#: Prior weights of content over boilerplate for the classes of the first four measures.
PRIOR = ((1.0, 0.5, -1.0, -2.0, -3.0), (1.0, 0.5, -0.5, -2.0, -3.0), (1.0, 1.0, 0.5, -1.0, -2.0, -3.0), (0.5, -0.5, -1.5, -3.0))
WIDTH = sum(len(b) + 1 for _, b in MEASURES) + 1


@dataclass
class Read:
    """Counts of each text, and of each of its lines with a word."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    line_text: np.ndarray
    line_words: np.ndarray
    features: np.ndarray


def _flags(characters: bytes) -> np.ndarray:
    out = np.zeros(256, np.int32)
    out[list(characters)] = 1
    return out


_SPACE, _SYMBOL, _BANG, _CAPITAL = _flags(SPACES) > 0, _flags(b"#*$%&|<>"), _flags(b"!"), _flags(bytes(range(65, 91)))
_LETTER = _flags(bytes([*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]))
_START = 1 - _flags(bytes(range(0x80, 0xC0)))  # of a code point


def _ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for each different pair."""
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1].astype(np.int64) if len(a) else a


def repeated(ids: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
    """Words of each text in windows of eight that it holds twice or more. Windows are named by
    doubling: pairs of words, pairs of those, and so on, so equal names mean equal words."""
    n = len(ids) - WINDOW + 1
    if n <= 0:
        return np.zeros(n_texts, np.int64)
    name, span = ids, 1
    while span < WINDOW:
        name, span = _ranks(name[:-span], name[span:]), span * 2
    inside = np.flatnonzero(text[:n] == text[WINDOW - 1 :])
    _, inverse, count = np.unique(text[inside] * (int(name.max()) + 1) + name[inside], return_inverse=True, return_counts=True)
    hit = inside[count[inverse] > 1]
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, hit, 1)
    np.add.at(change, hit + WINDOW, -1)
    return np.bincount(text[np.cumsum(change[:-1]) > 0], minlength=n_texts)


def read(texts: list[bytes]) -> Read:
    n = len(texts)
    # Each text ends with a line end of its own, so lines and words never run across texts.
    block = np.frombuffer(b"".join(t + b"\n" for t in texts), np.uint8)
    lengths = np.array([len(t) + 1 for t in texts])
    ends = np.cumsum(lengths)
    space = _SPACE[block]
    first = ~space
    first[1:] &= space[:-1]
    at = np.flatnonzero(first)
    breaks = block == 10
    line_of = (np.cumsum(breaks) - breaks)[at]
    text_of = np.searchsorted(ends, at, "right")
    numbers = Interned()
    ids = intern_words([w for t in texts for w in t.split()], numbers)

    def by_text(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags[block])])
        return sums[ends] - sums[ends - lengths]

    dup = np.zeros(n, np.int64)
    for i, t in enumerate(texts):
        lines = [x for x in t.split(b"\n") if x.strip(SPACES)]
        dup[i] = len(lines) - len(set(lines))
    # Lines with a word, and their measures.
    lines, index, words = np.unique(line_of, return_index=True, return_counts=True)
    stops = np.flatnonzero(breaks)
    begins = np.concatenate([[0], stops[:-1] + 1]) if len(stops) else stops

    def by_line(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags[block])])
        return sums[stops[lines]] - sums[begins[lines]]

    distinct = np.bincount(np.unique(line_of * (len(numbers) + 1) + ids) // (len(numbers) + 1), minlength=int(lines.max()) + 1)[lines] if len(ids) else words
    letters = by_line(_LETTER)
    measures = (by_line(_SYMBOL) / np.maximum(words, 1), by_line(_CAPITAL) / np.maximum(letters, 1), 1 - distinct / np.maximum(words, 1), by_line(_BANG) / np.maximum(words, 1), words, letters / np.maximum(words, 1))
    columns, base = [], 0
    for (_, bounds), values in zip(MEASURES, measures, strict=True):
        columns.append(base + np.searchsorted(bounds, values, "left"))
        base += len(bounds) + 1
    columns.append(np.full(len(lines), base))
    return Read(
        np.bincount(text_of, minlength=n), by_text(_START * ~_SPACE), by_text(_SYMBOL), dup, repeated(ids, text_of, n), text_of[index], words, np.stack(columns, axis=1) if len(lines) else np.zeros((0, len(columns)), np.int64)
    )


@dataclass
class Field:
    """Weights of content over boilerplate: `state` of features, `move[a][b]` of neighbouring labels."""

    state: np.ndarray
    move: np.ndarray

    def viterbi(self, features: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Most probable labels (True: content) of lines; lines of one text stand together."""
        gain = self.state[features].sum(axis=1).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        owners = owner.tolist()
        back: list[tuple[bool, bool]] = []
        bad = good = 0.0
        for i, g in enumerate(gain):
            if not i or owners[i] != owners[i - 1]:
                back.append((False, False))
                bad, good = 0.0, g
                continue
            to_bad, to_good = good + m10 > bad + m00, good + m11 > bad + m01
            back.append((to_bad, to_good))
            bad, good = (good + m10 if to_bad else bad + m00), (good + m11 if to_good else bad + m01) + g
            if bad + good > 1e6 or bad + good < -1e6:
                bad, good = 0.0, good - bad
            gain[i] = good - bad
        # `gain` of a text's last line now tells its better end.
        out = np.zeros(len(owners), bool)
        label = False
        for i in range(len(owners) - 1, -1, -1):
            if i == len(owners) - 1 or owners[i] != owners[i + 1]:
                label = gain[i] > 0
            out[i] = label
            label = back[i][label]
        return out


def prior() -> Field:
    state, base = np.zeros(WIDTH), 0
    for (_, bounds), own in zip(MEASURES, PRIOR, strict=False):
        state[base : base + len(own)] = own
        base += len(bounds) + 1
    return Field(state, np.array([[0.5, -0.5], [-0.5, 0.5]]))


@dataclass
class Known:
    """A training document: features and words of its lines, and its quality."""

    features: np.ndarray
    words: np.ndarray
    quality: int


def line_labels(field: Field, doc: Known, least: float = CONTENT_SHARE) -> np.ndarray:
    """The field's labels of a document's lines, changed where they contradict its quality: the lines whose features speak
    least against it first."""
    label = field.viterbi(doc.features, np.zeros(len(doc.features), np.int64))
    total, good = int(doc.words.sum()), int(doc.words[label].sum())
    gain = field.state[doc.features].sum(axis=1)
    for i in np.argsort(-gain if doc.quality else gain, kind="stable").tolist():
        if (good >= least * total) == bool(doc.quality):
            break
        if label[i] != bool(doc.quality):
            label[i] = bool(doc.quality)
            good += int(doc.words[i]) * (1 if doc.quality else -1)
    return label


def train(documents: list[Known], rounds: int = ROUNDS) -> Field:
    """A field fitted to documents of both qualities; the prior if there is only one."""
    field = prior()
    if len({d.quality for d in documents}) < 2:
        return field
    # Both kinds of documents count the same.
    share = {q: 0.5 / sum(d.quality == q for d in documents) for q in (0, 1)}
    for _ in range(rounds):
        sequences = []
        for d in documents:
            label = line_labels(field, d).astype(np.int64)
            sequences += [(d.features[i : i + SEQUENCE_LINES], label[i : i + SEQUENCE_LINES], share[d.quality]) for i in range(0, len(label), SEQUENCE_LINES)]
        field = fit(sequences)
    return field


def fit(sequences: list[tuple[np.ndarray, np.ndarray, float]], steps: int = 40, pull: float = 0.02) -> Field:
    """Most likely weights for labelled sequences (features, labels, weight), with a pull to the prior, by gradient steps;
    marginals come from the forward and backward sums over all sequences at once."""
    field, start = prior(), prior()
    n, longest = len(sequences), max(len(f) for f, _, _ in sequences)
    used = np.zeros((longest, n), bool)
    feats = np.zeros((longest, n, len(MEASURES) + 1), np.int64)
    label = np.zeros((longest, n), np.int64)
    for j, (f, y, _) in enumerate(sequences):
        used[: len(f), j], feats[: len(f), j], label[: len(f), j] = True, f, y
    share = np.array([w for _, _, w in sequences])
    moments = [np.zeros(WIDTH), np.zeros((2, 2))]
    for _ in range(steps):
        local = np.zeros((longest, n, 2))
        local[..., 1] = field.state[feats].sum(axis=2)
        ahead, behind = np.zeros((longest, n, 2)), np.zeros((longest, n, 2))
        ahead[0] = local[0]
        for t in range(1, longest):
            step = np.logaddexp.reduce(ahead[t - 1][:, :, None] + field.move, axis=1) + local[t]
            ahead[t] = np.where(used[t][:, None], step, ahead[t - 1])
        for t in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(field.move + (local[t + 1] + behind[t + 1])[:, None, :], axis=2)
            behind[t] = np.where(used[t + 1][:, None], step, 0)
        total = np.logaddexp.reduce(ahead[-1], axis=1)
        chance = np.exp(ahead + behind - total[:, None])[..., 1]
        error = np.where(used, label - chance, 0) * share
        grads = [np.bincount(feats.ravel(), np.repeat(error.ravel(), feats.shape[2]), WIDTH), np.zeros((2, 2))]
        for t in range(1, longest):
            both = np.exp(ahead[t - 1][:, :, None] + field.move + (local[t] + behind[t])[:, None, :] - total[:, None, None])
            seen = np.zeros((n, 2, 2))
            seen[np.arange(n), label[t - 1], label[t]] = 1
            grads[1] += ((seen - both) * (share * used[t])[:, None, None]).sum(axis=0)
        for w, w0, g, m in ((field.state, start.state, grads[0], moments[0]), (field.move, start.move, grads[1], moments[1])):
            g = g - pull * (w - w0) / n
            m += g * g
            w += 0.3 * g / np.sqrt(m + 1e-12)
    return field


def training_sample(docs: DataFrame, labels: DataFrame) -> list[Known]:
    """At most TRAIN_DOCS documents of known quality. A doc_id that repeats, as a label or a row, gives one of them."""
    importable(docs.sparkSession)
    known = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches, 1):
            found = []
            for doc, text, quality in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                r = read([text])
                if len(r.features):
                    found.append((doc, int(quality), r.features.astype(np.uint8).tobytes(), r.line_words.astype(np.int32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["doc_id", "quality", "features", "words"])

    # At most TRAIN_DOCS rows on one side, one for each document.
    rows = docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(picked), "doc_id").mapInArrow(run, "doc_id long, quality int, features binary, words binary")
    one = rows.groupBy("doc_id", "quality").agg(F.min(F.struct("features", "words")).alias("x")).orderBy("doc_id").collect()
    return [Known(np.frombuffer(r["x"]["features"], np.uint8).reshape(-1, len(MEASURES) + 1).astype(np.int64), np.frombuffer(r["x"]["words"], np.int32), r["quality"]) for r in one]


def quality_rows(df: DataFrame, field: Field, least: float = CONTENT_SHARE) -> DataFrame:
    """The counts, verdicts and content shares of each row's text."""
    importable(df.sparkSession)
    columns = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_(), "n_content_lines": pa.int64(), "n_boilerplate_lines": pa.int64(), "content_share": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches, 1):
            texts = [t or b"" for t in text_bytes(batch.column(1))]
            parts: list[list[np.ndarray]] = []
            for a, b in runs([len(t) for t in texts], RUN_BYTES):
                r = read(texts[a:b])
                good = field.viterbi(r.features, r.line_text)
                n = b - a
                share = np.bincount(r.line_text, r.line_words * good, n) / np.maximum(r.n_words, 1)
                failed = (r.n_words < 20) | (100 * r.n_repeat_words > 30 * r.n_words)
                content = np.bincount(r.line_text, good, n).astype(np.int64)
                parts.append([r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, failed, ~failed & (share >= least), content, np.bincount(r.line_text, minlength=n) - content, share])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.concatenate([p[k] for p in parts]) if parts else [], t) for k, t in enumerate(columns.values()))], names=["doc_id", *columns])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_content_lines long, n_boilerplate_lines long, content_share double")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rows(docs, train(training_sample(docs, table(spark, sf_dir, "labels"))))
