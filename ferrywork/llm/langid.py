"""Language of documents by a linear-chain conditional random field over their words.

A word is described by hashed features: its byte n-grams with marked ends, which hold prefixes and suffixes,
and the whole word, the lexicon.  The field adds learned transitions between the languages of neighbouring words, so that
switches within a text are followed; forward-backward gives each word's language probabilities, and a document's are
their mean over words with letters.  Training takes a bounded sample of labelled documents, whose passages are also
spliced into mixed texts, as labels per word; prediction runs over all documents, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrywork.llm.frames import released, rows_of, slices, small_batches
from ferrywork.llm.textcodes import Words, gathered, run_hashes, utf8

SAMPLE_DOCS, SAMPLE_CHARS, FEATURE_BITS, GRAMS, STEPS, CHUNK, SPLICE, UNKNOWN = 400, 20_000, 17, (1, 2, 3, 4), 40, 64, 40, "und"
# Of each language at least, where so many languages share the sample; passages of a long text.
LEAST_DOCS, PASSAGES = 20, 4
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LETTER = np.array([chr(b).isalpha() and b < 128 or b >= 128 for b in range(256)])


@dataclass
class Field:
    """Weights per feature and label, transitions and starts; labels in order; and which features the sample had."""

    labels: list[str]
    weights: np.ndarray
    moves: np.ndarray
    starts: np.ndarray
    seen: np.ndarray | None = None


def word_features(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers in a row, how many each distinct word has, each word's distinct number, and whether each has a letter."""
    _, index, number = np.unique(words.hash, return_index=True, return_inverse=True)
    start, end = words.start[index], words.end[index]
    size = end - start
    # Each distinct word between two marks.
    room = size + 2
    at = np.cumsum(room) - room
    buffer = np.full(int(room.sum()), 1, dtype=np.uint8)
    inside = gathered(np.arange(len(buffer)), at + 1, size)
    raw = gathered(words.raw, start, size)
    buffer[inside] = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
    found, owner = [], []
    for n in GRAMS:
        count = np.maximum(room - n + 1, 0)
        first = gathered(np.arange(len(buffer)), at, count)
        found.append(run_hashes(buffer, first, first + n, _BASE))
        owner.append(np.repeat(np.arange(len(index)), count))
    found.append(run_hashes(buffer, at, at + room, _BASE))
    owner.append(np.arange(len(index)))
    found, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    letters = np.logical_or.reduceat(_LETTER[raw], np.cumsum(size) - size) if len(index) else np.zeros(0, bool)
    return (found[order] >> np.uint64(64 - FEATURE_BITS)).astype(np.int32), np.bincount(owner, minlength=len(index)), number, letters[number] if len(index) else letters


def emissions(weights: np.ndarray, features: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Mean feature weight per distinct word and label, scaled back by the root of the count."""
    if not len(count):
        return np.zeros((0, weights.shape[1]), dtype=np.float32)
    sums = np.add.reduceat(weights[features], np.cumsum(count) - count, axis=0)
    return sums / np.sqrt(count)[:, None]


def _unit(x: np.ndarray, axes=-1) -> np.ndarray:
    return x / x.sum(axis=axes, keepdims=True)


def forward_backward(scores: np.ndarray, first: np.ndarray, moves: np.ndarray, starts: np.ndarray):
    """Marginals of each word, and forward and backward messages, for texts at ``first`` of ``scores``.

    Texts are laid out in chunks that are worked on side by side: products over whole chunks
    carry the messages from chunk to chunk, so a long text costs no more steps than its number of chunks.
    """
    size, labels = np.diff(first), scores.shape[1]
    evidence = np.exp(scores - scores.max(axis=1, keepdims=True))
    chunks = -(-size // CHUNK)
    text_of = np.repeat(np.arange(len(size)), chunks)
    ordinal = np.arange(len(text_of)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    place = first[text_of][:, None] + ordinal[:, None] * CHUNK + np.arange(CHUNK)
    inside = place < first[text_of + 1][:, None]
    held = evidence[np.where(inside, place, 0)]
    held[~inside] = 1
    step, begin = np.exp(moves), np.exp(starts)
    opens = (ordinal == 0)[:, None]
    whole = np.broadcast_to(np.eye(labels), (len(text_of), labels, labels)).copy()
    for t in range(CHUNK):
        ahead = whole @ step if t else np.where(opens[:, :, None], np.broadcast_to(begin, whole.shape), step)
        ahead = ahead * held[:, t, None, :]
        whole = np.where(inside[:, t, None, None], _unit(ahead, (1, 2)), whole)
    enter = np.full((len(text_of), labels), 1 / labels)
    leave = np.full((len(text_of), labels), 1 / labels)
    head = np.cumsum(chunks) - chunks
    for k in range(int(chunks.max(initial=0)) - 1):
        at = head[chunks > k + 1] + k
        enter[at + 1] = _unit(np.einsum("ci,cij->cj", enter[at], whole[at]))
        last = (head + chunks)[chunks > k + 1] - 1 - k
        leave[last - 1] = _unit(np.einsum("cij,cj->ci", whole[last], leave[last]))
    forward, backward = np.empty_like(held), np.empty_like(held)
    now = enter
    for t in range(CHUNK):
        ahead = now @ step if t else np.where(opens, begin, now @ step)
        now = np.where(inside[:, t, None], _unit(ahead * held[:, t]), now)
        forward[:, t] = now
    now = leave
    for t in range(CHUNK - 1, -1, -1):
        backward[:, t] = now
        now = np.where(inside[:, t, None], _unit((now * held[:, t]) @ step.T), now)
    forward, backward = forward[inside], backward[inside]
    return _unit(forward * backward), forward, backward, evidence


def train(texts: list[str], langs: list[str], steps: int = STEPS) -> Field | None:
    """Fit a field by gradient ascent on the likelihood of the texts and of spliced texts; None without labelled words."""
    labels = sorted(set(langs))
    words = Words(*utf8(pa.array(texts, pa.string())))
    if not len(words.start):
        return None
    features, count, number, _ = word_features(words)
    truth = np.array([labels.index(x) for x in langs])[words.text]
    # Passages of SPLICE words, dealt anew, make texts that switch language; the texts themselves come after them.
    rng = np.random.default_rng(7)
    cuts = np.unique(np.concatenate([words.first[:-1], *[np.arange(a, b, SPLICE) for a, b in zip(words.first[:-1], words.first[1:])]]))
    cuts = cuts[cuts < len(words.start)]
    length = np.diff(np.append(cuts, len(words.start)))
    order = rng.permutation(len(cuts))
    mixed = gathered(np.arange(len(words.start)), cuts[order], length[order])
    group = np.cumsum(length[order])[4::5]
    line = np.concatenate([mixed, np.arange(len(words.start))])
    first = np.unique(np.concatenate([[0], group, len(mixed) + words.first]))
    number, truth = number[line], truth[line]
    k = len(labels)
    field = Field(labels, np.zeros((1 << FEATURE_BITS, k), dtype=np.float32), np.zeros((k, k)), np.zeros(k), np.zeros(1 << FEATURE_BITS, dtype=bool))
    field.seen[features] = True
    wanted = np.zeros((len(line), k))
    wanted[np.arange(len(line)), truth] = 1
    inner = np.ones(len(line), dtype=bool)
    inner[first[first < len(line)]] = False
    after = np.flatnonzero(inner)
    seen_moves = np.zeros((k, k))
    np.add.at(seen_moves, (truth[after - 1], truth[after]), 1)
    seen_starts = wanted[~inner].sum(axis=0)
    squares = [np.full_like(x, 1e-8) for x in (field.weights, field.moves, field.starts)]
    for _ in range(steps):
        scores = emissions(field.weights, features, count)[number]
        marginal, forward, backward, evidence = forward_backward(scores, first, field.moves, field.starts)
        pairs = np.zeros((k, k))
        for part in np.array_split(after, 1 + len(after) // 50_000):
            seen = forward[part - 1][:, :, None] * np.exp(field.moves)[None] * (evidence[part] * backward[part])[:, None, :]
            pairs += _unit(seen, (1, 2)).sum(axis=0)
        error = wanted - marginal
        per_word = np.stack([np.bincount(number, error[:, j], minlength=len(count)) for j in range(k)], axis=1) / np.sqrt(count)[:, None]
        slope = np.stack([np.bincount(features, np.repeat(per_word[:, j], count), minlength=1 << FEATURE_BITS) for j in range(k)], axis=1).astype(np.float32)
        grads = (slope - 0.05 * field.weights, seen_moves - pairs - field.moves, seen_starts - marginal[~inner].sum(axis=0) - field.starts)
        for value, grad, square in zip((field.weights, field.moves, field.starts), grads, squares):
            square += grad * grad
            value += 0.5 * grad / np.sqrt(square)
    return field


def tag(field: Field, texts: pa.Array):
    """Words of ``texts`` and the probabilities of their languages."""
    words, letters, marginal, _ = tag_with_familiar(field, texts)
    return words, letters, marginal


def tag_with_familiar(field: Field, texts: pa.Array):
    """As :func:`tag`, and what share of each word's features any language's sample had."""
    words = Words(*utf8(texts))
    features, count, number, letters = word_features(words)
    scores = emissions(field.weights, features, count)[number]
    marginal = forward_backward(scores, words.first, field.moves, field.starts)[0] if len(number) else np.zeros((0, len(field.labels)))
    familiar = np.add.reduceat(field.seen[features], np.cumsum(count) - count, dtype=np.int64)[number] / count[number] if len(number) else np.zeros(0)
    return words, letters, marginal, familiar


def _passages(column: str, longest: int):
    """The text, or so many passages of it, evenly spread, where it has more than ``longest`` characters."""
    size, length = max(1, longest // (2 * PASSAGES)), F.length(column)
    cuts = [F.substring(column, (1 + (length - size) * k / (PASSAGES - 1)).cast("int"), F.lit(size)) for k in range(PASSAGES)]
    return F.when(length <= longest, F.array(column)).otherwise(F.array(*cuts))


def _joined(passages: list[str]) -> str:
    """Passages without the words that their ends may have cut."""
    for k, text in enumerate(passages):
        words = text.split()
        if len(passages) > 1 and len(words) > 2:
            words = words[k > 0 : len(words) - (k < len(passages) - 1)]
            passages[k] = " ".join(words)
    return " ".join(passages)


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Field | None:
    """Train on ``sample_docs`` distinct texts of ``docs(text, lang)``, dealt to the languages in turn, so that each gets its share or all it has.

    Where that is under ``LEAST_DOCS`` texts for a language, because there are very many languages, the sample grows to that many for each.  Texts are picked by hash;
    of one with more than ``sample_chars`` characters, some passages are taken.  Training time and driver memory grow with the number of languages.
    """
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text", F.xxhash64("text").alias("h"))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    dealt = known.select("lang", "h").distinct().withColumn("turn", turn).where(F.col("turn") <= sample_docs).orderBy("turn", "h", "lang")
    languages = known.select("lang").distinct().count()
    picked = {(r.lang, r.h) for r in dealt.limit(max(sample_docs, LEAST_DOCS * languages)).collect()}
    wanted = known.where(F.col("h").isin([h for _, h in sorted(picked)])).groupBy("lang", "h").agg(F.min(_passages("text", sample_chars)).alias("passages"))
    rows = sorted((r.lang, r.h, _joined(r.passages)) for r in wanted.collect() if (r.lang, r.h) in picked)
    return train([text for _, _, text in rows], [lang for lang, _, _ in rows])


def predict(docs: DataFrame, field: Field | None) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (mean probability of that language over words with letters, 0 to 1) and ``familiar`` in place of any columns so named.

    The probabilities are shared out among the learned languages alone, so the score cannot tell a text in none of them.  ``familiar`` can: it is the
    mean share of a word's n-grams that the training sample had, in any language, over words with letters.  ``und`` with score 0 where the text is null or has no letter, or where nothing could be learned.  Repeated rows are kept, other columns stay.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "familiar")]
    source = docs.select(F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("rest"))
    result = T.StructType([source.schema["rest"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("familiar", T.DoubleType())])

    def run(batches):
        for part in slices(batches):
            texts = part.column("text")
            found, score, known = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows), np.zeros(part.num_rows)
            if field is not None:
                words, letters, marginal, familiar = tag_with_familiar(field, texts)
                weight = np.where(letters[:, None], marginal, 0)
                sums = np.stack([np.bincount(words.text, weight[:, j], minlength=part.num_rows) for j in range(len(field.labels))], axis=1)
                total = np.bincount(words.text, letters, minlength=part.num_rows)
                share = np.bincount(words.text, np.where(letters, familiar, 0), minlength=part.num_rows)
                for k, text in enumerate(texts):
                    if total[k] and (text.as_py().isascii() or any(map(str.isalpha, text.as_py()))):
                        best = int(np.argmax(sums[k]))
                        found[k], score[k] = field.labels[best], min(1.0, float(sums[k, best] / total[k]))
                        known[k] = min(1.0, float(share[k] / total[k]))
            yield pa.RecordBatch.from_arrays([part.column("rest"), pa.array(found, pa.string()), pa.array(score), pa.array(known)], names=["rest", "lang_pred", "score", "familiar"])

    done = source.mapInArrow(released(run), result)
    return done.select(*[F.col(f"rest.`{c}`").alias(c) for c in kept], "lang_pred", "score", "familiar")


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of the id as text leaves 2 on division by 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """``docs`` with ``held_out, lang_pred, score, familiar``, learned from its labelled rows that are not held out (a null id is not learned from)."""
    field = fit(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    return predict(docs.withColumn("held_out", held_out()), field)
