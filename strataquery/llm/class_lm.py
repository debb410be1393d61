"""Language-model scoring by Brown class-based bigrams.

Method: exchange clustering assigns words to classes so that the likelihood of class bigrams grows; a text's probability
is the product of smoothed class transitions and word emissions. The most frequent words are moved between classes round
by round. Then every other word of the vocabulary is placed, by the same likelihood, in the class that its own neighbours
speak for: first the frequent ones, beside the words placed already, then all the rest beside these. Once every word has a
class, the most frequent words are exchanged again, now with all their neighbours in the whole text. How the words of one
kind of ending are spread over the classes is the prior of words that are seen too rarely to speak for themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import id_crc, materialize, table, tidy
from .textvec import Counter, Words, byte_view, chunks, find, finish, words_of

FOLDS, HELD_FOLD = 7, 2
#: Words that exchange places round by round, classes (class 0 is the end's alone), most rounds, smoothing of transitions.
WORDS, CLASSES, ROUNDS, ALPHA = 1024, 32, 12, 0.5
#: Most frequent words whose counts and classes every task holds; those of all others are joined by shuffle.
HELD = 1 << 18
END, ITEMS = WORDS, WORDS + 1
#: The class code of a word that has none yet, and codes on one side of a word.
NONE, SLOTS = CLASSES, CLASSES + 1
#: Codes of a neighbour: the item that it is, or the class code of any other word.
CODES = ITEMS + SLOTS
#: Rows of place_rest that are no neighbour of a word: bigrams of codes, and bigrams of two words that are not held.
OF_CODES, OF_REST = -1, -2
#: Kinds of endings; occurrences from which a word is placed without a prior and counts for its kind's; weight of the
#: prior, and how many words of the general spread are added to each kind's.
KINDS, PLAIN_FROM, PRIOR_WEIGHT, PRIOR_WORDS = 502, 24, 10.0, 2.0
#: Marks that an ending leaves out.
_MARKS = np.isin(np.arange(256), [ord(c) for c in ".,;:!?)]}\"'"])
_LETTER = np.arange(256)
_LETTER[0x41:0x5B] += 0x20


def endings(raw: np.ndarray, words: Words) -> np.ndarray:
    """The kind of ending of each word: its last two bytes before a closing mark, and whether there is one."""
    if not len(words.starts):
        return np.zeros(0, np.int64)
    last = words.starts + words.sizes - 1
    marked = _MARKS[raw[last]] & (words.sizes > 1)
    end = last - marked
    before = np.where(end > words.starts, _LETTER[raw[np.maximum(end - 1, 0)]], 0)
    return (before * 31 + _LETTER[raw[end]]) % (KINDS // 2) * 2 + marked


def sequence(values: np.ndarray, edges: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words' values with an end after each text, what stands before each, and each one's text."""
    n, sizes = len(edges) - 1, np.diff(edges) + 1
    owner = np.repeat(np.arange(n), sizes)
    now = np.full(int(sizes.sum()), end, np.int64)
    is_word = np.ones(len(now), bool)
    is_word[np.cumsum(sizes) - 1] = False
    now[is_word] = values
    before = np.concatenate([[end], now[:-1]]) if len(now) else now
    return now, before, owner


@dataclass
class Bigrams:
    """Counts of all bigrams of a text, by item where an item stands in them and by class elsewhere."""

    counts: np.ndarray  # [item before, item]
    ahead: np.ndarray  # [item, class of another word behind it]
    behind: np.ndarray  # [item, class of another word before it]
    others: np.ndarray  # [class before, class], of two other words

    def of_classes(self, klass: np.ndarray) -> np.ndarray:
        """Class bigrams [before, now], when the items have these classes."""
        member = np.eye(len(self.others))[klass]
        return member.T @ self.counts @ member + member.T @ self.ahead + self.behind.T @ member + self.others


def between_items(counts: np.ndarray, classes: int = CLASSES) -> Bigrams:
    n = len(counts)
    return Bigrams(counts, np.zeros((n, classes)), np.zeros((n, classes)), np.zeros((classes, classes)))


def exchange_classes(counts: np.ndarray | Bigrams, classes: int = CLASSES, rounds: int = ROUNDS, start: np.ndarray | None = None) -> np.ndarray:
    """Class of each item for counts[before, now]: each item in turn moves to the class that makes class bigrams likeliest,
    from the classes of start on, if there are any. Words that are no items keep their classes.

    The last item, the end, stays alone in class 0; items that never occur stay in class 1.
    """
    every = counts if isinstance(counts, Bigrams) else between_items(counts, classes)
    counts, n = every.counts, len(every.counts)
    total = counts.sum(axis=0) + counts.sum(axis=1) + every.ahead.sum(axis=1) + every.behind.sum(axis=1)
    order = [i for i in np.lexsort((np.arange(n), -total)) if i != n - 1 and total[i] > 0]
    klass = np.ones(n, np.int64)
    klass[n - 1] = 0
    for place, i in enumerate(order):
        klass[i] = 1 + place % (classes - 1)
    if start is not None:
        klass = start.copy()
    g = every.of_classes(klass)
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    for _ in range(rounds):
        moved = 0
        for i in order:
            old = klass[i]
            out = np.bincount(klass, counts[i], classes) + every.ahead[i]
            into = np.bincount(klass, counts[:, i], classes) + every.behind[i]
            own = counts[i, i]
            g[old] -= out
            g[:, old] -= into
            g[old, old] += own
            out[old] -= own
            into[old] -= own
            rows, columns = g.sum(axis=1) + into, g.sum(axis=0) + out  # the item's neighbours stand beside it in any class
            a, b = f(g + out) - f(g), f(g + into[:, None]) - f(g)
            gain = a.sum(axis=1) - np.diag(a) + b.sum(axis=0) - np.diag(b)
            d = np.diag(g)
            gain += f(d + out + into + own) - f(d)
            gain -= f(rows + out.sum() + own) - f(rows) + f(columns + into.sum() + own) - f(columns)
            gain[0] = -np.inf
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9:
                new = int(old)
            g[new] += out
            g[:, new] += into
            g[new, new] += own
            moved += new != old
            klass[i] = new
        if not moved:
            break
    return klass


def transitions(g: np.ndarray) -> np.ndarray:
    """Smoothed P(class | class before) of class bigram counts g[before, now]."""
    return (g + ALPHA) / (g.sum(axis=1, keepdims=True) + ALPHA * len(g))


def best_class(slots: np.ndarray, n: np.ndarray, step: np.ndarray, totals: np.ndarray, prior: np.ndarray | float = 0.0) -> np.ndarray:
    """The class in which each word makes its neighbourhood likeliest.

    slots: a row a word with how often each class (and, last, no class) stands before it, then the same behind it. n: how
    often it occurs, step: P(class | class before), totals: tokens of each class, prior: a row a word of log P(class), for
    words under PLAIN_FROM occurrences. Class 0 takes no word; of equal classes the first is taken.
    """
    log = np.log(step)
    likely = slots[:, :CLASSES] @ log + slots[:, SLOTS : SLOTS + CLASSES] @ log.T - n[:, None] * np.log(totals + 1.0)
    likely += np.where((n < PLAIN_FROM)[:, None], PRIOR_WEIGHT * prior, 0.0)
    return 1 + np.argmax(likely[:, 1:], axis=1)


def kind_prior(kinds: np.ndarray, klass: np.ndarray) -> np.ndarray:
    """log P(class | kind of ending), from words whose classes are known."""
    spread = np.bincount(kinds * CLASSES + klass, minlength=KINDS * CLASSES).reshape(KINDS, CLASSES).astype(float)
    every = spread.sum(axis=0) + 1.0 / CLASSES
    spread += PRIOR_WORDS * every / every.sum()
    return np.log(spread / spread.sum(axis=1, keepdims=True))


def _counted(batches: Iterator[pa.RecordBatch], keys_of: Callable[[np.ndarray, Words], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(key, n): how often each key that keys_of finds in a text chunk occurs."""
    counter = Counter()
    give = lambda keys, counts: pa.RecordBatch.from_arrays([pa.array(keys.astype(np.uint64).view(np.int64)), pa.array(counts.astype(np.int64))], names=["key", "n"])
    for batch in batches:
        for part in chunks(batch, 0):
            raw, offsets = byte_view(part.column(0))
            if (full := counter.add(*np.unique(keys_of(raw, words_of(raw, offsets)), return_counts=True))) is not None:
                yield give(*full)
    yield give(*counter.take())


def counted(texts: DataFrame, keys_of: Callable[[np.ndarray, Words], np.ndarray]) -> DataFrame:
    """(key, n) over all whole texts of a one-column table."""
    return texts.mapInArrow(tidy(lambda batches: _counted(batches, keys_of)), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """The words that every task holds: sorted hashes, counts, and classes (NONE while a word has none)."""

    keys: np.ndarray
    counts: np.ndarray
    klass: np.ndarray

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each word (-1 where not held) and its class code."""
        at = find(self.keys, keys)
        return at, np.where(at >= 0, self.klass[at], NONE) if len(self.keys) else np.full(len(keys), NONE)


@dataclass
class Training:
    held: Lexicon
    rest: DataFrame  # (key, klass, n) of all words that are not held
    transition: np.ndarray  # log10 P(class | class before)
    emission: np.ndarray  # log10 of what divides a word's count + 1 in its class
    unseen: np.ndarray  # class of words that training lacks, for each kind of ending
    train_tokens: int
    vocabulary: int
    documents: int


def frequent_words(counts: DataFrame) -> tuple[Lexicon, int, int]:
    """The at most HELD most frequent words of (key, n), whole levels of frequency at a time; number of tokens, of words."""
    level = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    tokens, distinct, least, held = 0, 0, None, 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("tokens")).collect(), key=lambda r: -r.level):
        tokens, distinct = tokens + r.tokens, distinct + r.words
        if held is not None and held + r.words <= HELD:
            held, least = held + r.words, r.level
        else:
            held = None
    rows = counts.where(F.lit(False) if least is None else level >= least).toArrow()
    keys, n = rows["key"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(keys)
    return Lexicon(keys[order], n[order], np.full(len(keys), NONE)), tokens, distinct


def top_classes(texts: DataFrame, held: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exchange among the WORDS most frequent words, whose classes it sets in held: where they are in held, the bigram counts
    between them, and the items' classes. These are only where the other words' classes begin: place_rest exchanges the
    items again, with all their neighbours.

    The driver gets at most ITEMS**2 counts.
    """
    top = np.sort(np.lexsort((held.keys, -held.counts))[:WORDS])
    keys = held.keys[top]

    def pairs(raw: np.ndarray, words: Words) -> np.ndarray:
        now, before, _ = sequence(find(keys, words.hashes), words.edges, END)
        both = (now >= 0) & (before >= 0)
        return (before[both] * ITEMS + now[both]).astype(np.uint64)

    found = counted(texts, pairs).toArrow()
    bigrams = np.zeros(ITEMS * ITEMS)
    bigrams[found["key"].to_numpy()] = found["n"].to_numpy()
    bigrams = bigrams.reshape(ITEMS, ITEMS)
    klass = exchange_classes(bigrams)
    held.klass[top] = klass[: len(top)]
    return top, bigrams, klass


def class_totals(held: Lexicon, documents: int) -> np.ndarray:
    """Tokens of each class among the words that have one; class 0 counts the ends."""
    placed = held.klass < NONE
    totals = np.bincount(held.klass[placed], held.counts[placed], CLASSES)
    totals[0] += documents
    return totals


def slot_rows(batch: pa.RecordBatch, column: int, slot_of: np.ndarray | None = None) -> np.ndarray:
    """A column of lists of (slot, n) as a dense row for each list; slot_of tells what slot a number in the list means."""
    lists = batch.column(column)
    out = np.zeros((len(lists), 2 * SLOTS))
    owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    flat = lists.flatten()
    slots = flat.field(0).to_numpy(zero_copy_only=False)
    np.add.at(out, (owner, slots if slot_of is None else slot_of[slots]), flat.field(1).to_numpy(zero_copy_only=False))
    return out


def place_held(texts: DataFrame, held: Lexicon, g: np.ndarray, documents: int) -> np.ndarray:
    """Set the classes of the held words that have none, each by the classed words beside it; the kinds' prior, from those
    of PLAIN_FROM occurrences or more. The driver gets a row a word."""

    def beside(raw: np.ndarray, words: Words) -> np.ndarray:
        at, klass = held.look(words.hashes)
        wanted = np.where((at >= 0) & (klass == NONE), at * KINDS + endings(raw, words), -1)
        now, before, _ = sequence(klass, words.edges, 0)
        who, who_before, _ = sequence(wanted, words.edges, -1)
        left, right = (who >= 0) & (before < NONE), (who_before >= 0) & (now < NONE)
        return np.concatenate([who[left] * (2 * SLOTS) + before[left], who_before[right] * (2 * SLOTS) + SLOTS + now[right]]).astype(np.uint64)

    waiting = held.klass == NONE
    step, totals, counts = transitions(g), class_totals(held, documents), held.counts
    rows = counted(texts, beside).select(
        F.expr(f"key div {2 * SLOTS * KINDS}").alias("word"), F.expr(f"key div {2 * SLOTS} % {KINDS}").alias("kind"), F.struct((F.col("key") % (2 * SLOTS)).cast("int").alias("slot"), "n").alias("cell")
    )
    rows = materialize(rows.groupBy("word").agg(F.max("kind").alias("kind"), F.collect_list("cell").alias("cells")), "held")

    def place(prior: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                who, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                klass = best_class(slot_rows(batch, 2), counts[who], step, totals, 0.0 if prior is None else prior[kind])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(klass)], names=["word", "kind", "klass"])

        found = rows.mapInArrow(tidy(run), "word long, kind long, klass long").toArrow()
        return tuple(found[c].to_numpy() for c in ("word", "kind", "klass"))

    who, kind, klass = place(None)
    sure = counts[who] >= PLAIN_FROM
    prior = kind_prior(kind[sure], klass[sure])
    if not sure.all():
        who, kind, klass = place(prior)
    held.klass[waiting] = best_class(np.zeros((int(waiting.sum()), 2 * SLOTS)), counts[waiting], step, totals)
    held.klass[who] = klass
    return prior


def place_rest(texts: DataFrame, held: Lexicon, top: np.ndarray, bigrams: np.ndarray, klass: np.ndarray, prior: np.ndarray, documents: int) -> tuple[DataFrame, np.ndarray]:
    """(key, klass, n) of all words that are not held, each by the held words beside it; class bigram counts of the texts.

    No bigram is missing in the counts: those of two words that are not held are counted by joins once both have a class. With
    all of them the items (top in held) are exchanged again, and their classes set in held. The driver gets at most
    2 * CODES * CLASSES counts of codes.
    """
    code_of = ITEMS + held.klass
    code_of[top] = np.arange(len(top))
    unknown = ITEMS + NONE

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CODES * CODES, np.int64)

        def give(key: np.ndarray, slot: np.ndarray, n: np.ndarray, other: np.ndarray | None = None) -> pa.RecordBatch:
            others = pa.nulls(len(key), pa.int64()) if other is None else pa.array(other.view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(slot.astype(np.int32)), others, pa.array(n.astype(np.int64))], names=["key", "slot", "other", "n"])

        for batch in batches:
            for part in chunks(batch, 0):
                raw, offsets = byte_view(part.column(0))
                words = words_of(raw, offsets)
                at = find(held.keys, words.hashes) if len(held.keys) else np.full(len(words.hashes), -1)
                code = np.where(at >= 0, code_of[at], unknown) if len(held.keys) else np.full(len(at), unknown)
                now, before, _ = sequence(code, words.edges, END)
                both = (now != unknown) & (before != unknown) & ((now >= ITEMS) | (before >= ITEMS))  # those of two items are known
                total += np.bincount(before[both] * CODES + now[both], minlength=CODES * CODES)
                number, number_before, _ = sequence(np.where(at < 0, np.arange(len(at)), -1), words.edges, -1)
                left, right = number >= 0, number_before >= 0
                pair = left & right
                if pair.any():
                    first = words.hashes[number_before[pair]]
                    yield give(first, np.full(len(first), OF_REST), np.ones(len(first)), words.hashes[number[pair]])
                which = np.concatenate([number[left], number_before[right]])
                keys = words.hashes[which]
                slots = np.concatenate([before[left], CODES + now[right]]) + endings(raw, words)[which] * (2 * CODES)
                order = np.lexsort((slots, keys))
                keys, slots = keys[order], slots[order]
                new = np.ones(len(keys), bool)
                new[1:] = (keys[1:] != keys[:-1]) | (slots[1:] != slots[:-1])
                first = np.flatnonzero(new)
                yield give(keys[first], slots[first], np.diff(first, append=len(keys)))
        cells = np.flatnonzero(total)
        yield give(cells.astype(np.uint64), np.full(len(cells), OF_CODES), total[cells])

    class_of_code = np.concatenate([klass, np.arange(SLOTS)])
    slot_of = np.concatenate([class_of_code, SLOTS + class_of_code])
    step, totals = transitions(between_items(bigrams).of_classes(klass)), class_totals(held, documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, kind = slot_rows(batch, 2, slot_of), batch.column(1).to_numpy()
            n = slots[:, :SLOTS].sum(axis=1)  # something stands before every word
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best_class(slots, n, step, totals, prior[kind])), pa.array(n.astype(np.int64)), batch.column(2)], names=["key", "klass", "n", "cells"])

    found = texts.mapInArrow(tidy(beside), "key long, slot int, other long, n long").repartition("key").groupBy("key", "slot", "other").agg(F.sum("n").alias("n"))
    found = materialize(found, "beside")
    cell = F.struct((F.col("slot") % (2 * CODES)).alias("slot"), "n")
    words = found.where("slot >= 0").groupBy("key").agg(F.max(F.expr(f"slot div {2 * CODES}")).alias("kind"), F.collect_list(cell).alias("cells"))
    rest = materialize(words.mapInArrow(tidy(run), "key long, klass long, n long, cells array<struct<slot:int,n:long>>"), "rest")
    every = between_items(bigrams)

    def count(before: np.ndarray, now: np.ndarray, n: np.ndarray) -> None:
        """Add bigrams of codes of which at most one is an item."""
        for here, to in (
            ((before < ITEMS), (every.ahead, before, now - ITEMS)), ((now < ITEMS), (every.behind, now, before - ITEMS)), ((before >= ITEMS) & (now >= ITEMS), (every.others, before - ITEMS, now - ITEMS)),
        ):
            np.add.at(to[0], (to[1][here], to[2][here]), n[here])

    columns = lambda rows, *names: (x[c].to_numpy() for x in [rows.toArrow()] for c in names)
    key, n = columns(found.where(f"slot = {OF_CODES}").select("key", "n"), "key", "n")
    count(key // CODES, key % CODES, n)
    cells = rest.select("klass", F.explode("cells").alias("cell")).groupBy("klass", F.col("cell.slot").alias("slot")).agg(F.sum("cell.n").alias("n"))
    own, slot, n = columns(cells.where(F.col("slot") % CODES != unknown), "klass", "slot", "n")
    other, left = slot % CODES, slot < CODES
    count(np.where(left, other, ITEMS + own), np.where(left, ITEMS + own, other), n)
    pairs = found.where(f"slot = {OF_REST}").select("key", "other", F.col("n").alias("times"))
    pairs = pairs.join(rest.select("key", F.col("klass").alias("before")), "key").join(rest.select(F.col("key").alias("other"), F.col("klass").alias("now")), "other")
    before, now, n = columns(pairs.groupBy("before", "now").agg(F.sum("times").alias("n")), "before", "now", "n")
    count(ITEMS + before, ITEMS + now, n)
    klass = exchange_classes(every, start=klass)
    held.klass[top] = klass[: len(top)]
    return rest.select("key", "klass", "n"), every.of_classes(klass)


def train(texts: DataFrame) -> Training:
    """Learn from all texts of a one-column table. The driver gets at most HELD words, ITEMS**2 bigram counts of the WORDS
    most frequent ones, and tables of classes; all else stays in the cluster. No texts give a model that knows no word."""
    counts = materialize(counted(texts, lambda raw, words: words.hashes), "words")
    documents = texts.count()
    held, tokens, distinct = frequent_words(counts)
    top, bigrams, klass = top_classes(texts, held)
    prior = place_held(texts, held, between_items(bigrams).of_classes(klass), documents)
    rest, g = place_rest(texts, held, top, bigrams, klass, prior, documents)
    totals, kinds = class_totals(held, documents), np.bincount(held.klass, minlength=CLASSES).astype(float)
    for r in rest.groupBy("klass").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect():
        totals[r.klass] += r.n
        kinds[r.klass] += r.words
    unseen = 1 + np.argmax(prior[:, 1:], axis=1)
    return Training(held, rest, np.log10(transitions(g)), np.log10(totals + kinds + 1), unseen, tokens + documents, distinct + (documents > 0), documents)


def score_documents(documents: DataFrame, learned: Training, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row's whole text.

    A null text is empty and holds the end alone. Repeated rows are scored each; a null id is not held out. A word that
    training lacks counts 0 in the likeliest class of its ending. Without training texts the base score is 0.
    An empty table gives an empty result.
    """
    held, step, emission, unseen = learned.held, learned.transition, learned.emission, learned.unseen
    logs_of = np.log10(held.counts + 1.0) - emission[held.klass] if len(held.keys) else np.zeros(0)
    base_of = np.log10(held.counts + 1.0)
    is_held = (F.pmod(id_crc(id_col), F.lit(FOLDS)) == HELD_FOLD) & F.col(id_col).isNotNull()
    ready = documents.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("id"), is_held.alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each text a row with what its held words give and, as pairs of codes, its bigrams with other words; a row
        for each of these words. A code is a class, or SLOTS and the word's number among the text's other words."""
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in chunks(batch, 0):
                raw, offsets = byte_view(part.column(0))
                words = words_of(raw, offsets)
                n = part.num_rows
                at, klass = held.look(words.hashes)
                known, sums = at >= 0, lambda who, what: np.bincount(who, what, n) if len(who) else np.zeros(n)
                rare_owner, rare, number, times, some = distinct_rare(words, ~known)
                kinds_of = endings(raw, words)[~known][some]
                code = klass.astype(np.int64)
                code[~known] = SLOTS + number
                now, before, owner = sequence(code, words.edges, 0)
                plain = (now < NONE) & (before < NONE)
                moves = sums(owner[plain], step[before[plain], now[plain]])
                odd = np.stack([before[~plain], now[~plain]], axis=1).astype(np.int32)
                cuts = np.concatenate([[0], np.cumsum(np.bincount(owner[~plain], minlength=n))])
                rows, m = np.arange(row, row + n), len(rare)
                own_keys = finish(rows.astype(np.uint64), 3)
                absent = lambda x, kind: pa.concat_arrays([pa.array(x, kind), pa.nulls(m, kind)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([rows, rows[rare_owner]])), pa.array(np.concatenate([own_keys, rare]).view(np.int64)),
                        pa.array(np.concatenate([np.zeros(n, np.int64), times])), absent(part.column(1), pa.int64()), absent(part.column(2), pa.bool_()),
                        absent(np.diff(words.edges), pa.int64()), absent(np.bincount(words.owner[known], minlength=n), pa.int64()),
                        absent(sums(words.owner[known], base_of[at[known]]), pa.float64()), absent(sums(words.owner[known], logs_of[at[known]]) + moves, pa.float64()),
                        absent([odd[x:y].tobytes() for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary()),
                        *(pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(x)]) for x in (np.arange(m) - np.searchsorted(rare_owner, rare_owner), kinds_of)),
                    ],
                    names=["row", "key", "times", "id", "held_out", "n_words", "known", "base", "score", "odd", "number", "kind"],
                )
                row += n

    rows = ready.mapInArrow(tidy(run), "row long, key long, times long, id long, held_out boolean, n_words long, known long, base double, score double, odd binary, number long, kind long")
    joined = rows.join(learned.rest, "key", "left")
    whole = F.col("odd").isNotNull()
    other = F.when(~whole, F.struct("number", "times", "kind", "klass", "n"))
    per_row = joined.groupBy("row").agg(*(F.max(c).alias(c) for c in ("id", "held_out", "n_words", "known", "base", "score", "odd")), F.collect_list(other).alias("others"))
    ends, total, kinds = learned.documents, learned.train_tokens, learned.vocabulary
    per_end, divisor = float(np.log10(ends + 1)), float(np.log10(total + kinds + 1))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda name: batch.column(name).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            lists = batch.column("others")
            owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            number, times, kind, klass, n = (lists.flatten().field(i) for i in range(5))
            seen = n.is_valid().to_numpy(zero_copy_only=False)
            number, times, kind = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (number, times, kind))
            klass = np.where(seen, klass.fill_null(0).to_numpy(zero_copy_only=False), unseen[kind])
            log_n = np.log10(n.fill_null(0).to_numpy(zero_copy_only=False) + 1.0)
            sums = lambda what: np.bincount(owner, what, len(lists)) if len(owner) else np.zeros(len(lists))  # noqa: B023, E731
            known = get("known") + sums(times * seen).astype(np.int64)
            base = get("base") + sums(times * log_n)
            score = get("score") + sums(times * (log_n - emission[klass]))
            begin = np.searchsorted(owner, np.arange(len(lists)))
            of = np.empty(len(owner), np.int64)
            of[begin[owner] + number] = klass  # the words of a text in the order of their numbers
            pairs = [np.frombuffer(x, np.int32) for x in batch.column("odd").to_pylist()]
            sizes = np.fromiter(map(len, pairs), np.int64, len(pairs)) // 2
            flat = np.concatenate(pairs).reshape(-1, 2).astype(np.int64) if len(pairs) else np.zeros((0, 2), np.int64)
            whose = np.repeat(np.arange(len(pairs)), sizes)
            at = begin[whose][:, None] + flat - SLOTS
            codes = np.where(flat >= SLOTS, of[np.clip(at, 0, max(0, len(of) - 1))] if len(of) else 0, flat)
            score += np.bincount(whose, step[codes[:, 0], codes[:, 1]], len(pairs)) if len(whose) else 0.0
            n_tokens = get("n_words") + 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), batch.column("held_out"), pa.array(n_tokens), pa.array(known + int(ends > 0)), pa.array(np.full(len(lists), total, np.int64)),
                    pa.array(base + per_end - n_tokens * divisor), pa.array(score), pa.array(10.0 ** (-score / n_tokens)),
                ],
                names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
            )

    schema = f"`{id_col}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return per_row.mapInArrow(tidy(settle), schema)


def distinct_rare(words: Words, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words that rare marks: owner and hash of each text's distinct ones, each occurrence's number among those of
    its text, how often each distinct one occurs, and where one of its occurrences is."""
    owner, keys = words.owner[rare], words.hashes[rare]
    order = np.lexsort((keys, owner))
    sorted_owner, sorted_keys = owner[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (sorted_keys[1:] != sorted_keys[:-1]) | (sorted_owner[1:] != sorted_owner[:-1])
    first = np.flatnonzero(new)
    which = np.cumsum(new) - 1
    number = np.empty(len(keys), np.int64)
    if len(keys):
        number[order] = which - np.searchsorted(sorted_owner[first], sorted_owner)
    return sorted_owner[first], sorted_keys[first], number, np.diff(first, append=len(keys)), order[first]


def op7_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    learns = (F.pmod(id_crc("doc_id"), F.lit(FOLDS)) != HELD_FOLD) | F.col("doc_id").isNull()
    return score_documents(documents, train(documents.where(learns).select("text")))
