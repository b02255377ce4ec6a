"""Spelling variants: the vocabulary acceptor, a one-edit transducer and the acceptor again, composed.

Two words are near if one code point is inserted, deleted or replaced. All near
pairs are the pairs that the composition A o E o A accepts, where A is the minimal
acyclic acceptor of the vocabulary and E copies its input but for one edit.

The composition is partitioned by its initial state. A pair whose shorter word has
L code points shares the first L // 2 code points (the edit lies behind them), or
else the last L - L // 2. So a word enters, for L its own length and one less, the
partition of its first half and, read backwards, that of its last half: four rows,
whatever the vocabulary's size. In a partition the machine starts in the state
that the shared half leads to. A partition of more than ``LIMIT`` words is split
on by one code point at a time: either that code point is shared as well (a
smaller partition with a later initial state), or the edit is there, and the
machine starts behind it: in a partition of the words that agree in all the rest.

In a task, partitions come sorted; runs of them form one minimal acceptor, built
word by word. E edits where the two words first differ, so that a pair is accepted
once: walking (p, copy, p), two different labels a, b lead to (a p, done, b p)
(replaced) or, with one side a step ahead, to a deletion; behind the edit both
sides read the same, and states that cannot finish at the same length are left
at once. A pair found backwards counts only if its first difference lies in the
first half, so that no pair is counted twice.

Forms are followed to their roots by doubling: a form has at least ``FACTOR`` times
the count, so the number of rounds is known from the largest count.

Words are counted with map-side totals; corrupted runs are decided per document
and distinct run. Defined cases: null and empty texts have no runs; a null
``doc_id`` is hashed as ``null``; repeated rows count again; ties among forms go to
the smallest word by code points; very long texts and runs are handled in whole;
an empty table gives no words; further columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Distinct words that a task counts before it hands them on.
FLUSH = 300_000
#: Words of a partition of the composition; larger ones are split.
LIMIT = 20_000
#: A form occurs at least so many times as often as the word.
FACTOR = 5
#: Words of one acceptor: enough partitions to share states, few enough for a small table.
ACCEPTOR = 20_000


def word_counts(docs: DataFrame, modulus: int = 199, shortest: int = 6, least: int = 5) -> DataFrame:
    """``word, n``: runs of letters, one in ``modulus`` with a code point deleted, counted over all documents."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.coalesce(docs["doc_id"].cast("string"), F.lit("null")).alias("id"), docs["text"])

    def run(batches):
        total: Counter = Counter()

        def flush():
            got = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())],
                                             ["word", "n"])
            total.clear()
            return got

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                seed = zlib.crc32(f"{doc}:".encode())
                # bytes.lower changes A-Z alone
                for word, k in Counter(RUN.findall(text.encode().lower().decode())).items():
                    size = len(word)
                    if size < shortest:
                        continue
                    h = zlib.crc32(word.encode(), seed)
                    if h % modulus == 0:
                        if size == shortest:
                            continue
                        word = word[:h % size] + word[h % size + 1:]
                    total[word] += k
                if len(total) >= FLUSH:
                    yield flush()
        if total:
            yield flush()

    counted = slim.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least)


class Acceptor:
    """Minimal acyclic acceptor of label sequences that come sorted: equal right languages are one state."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.final = [False]
        self.words = [0]  # words that a state accepts
        self.ends = [0]  # bit k % 64: one of them has k labels
        self.known: dict = {}
        self.path = [0]
        self.last: list = []

    def _settle(self, keep: int) -> None:
        path, last, known = self.path, self.last, self.known
        while len(path) > keep + 1:
            state = path.pop()
            out = self.next[state]
            key = (self.final[state], *out.items())
            same = known.get(key)
            if same is None:
                known[key] = same = state
                self.words[state] = self.final[state] + sum(self.words[t] for t in out.values())
                bits = 0
                for t in out.values():
                    bits |= self.ends[t]
                self.ends[state] = (bits << 1 | bits >> 63) & 0xFFFFFFFFFFFFFFFF | self.final[state]
            self.next[path[-1]][last[len(path) - 1]] = same

    def add(self, labels: list) -> None:
        keep, last = 0, self.last
        most = min(len(labels), len(last))
        while keep < most and labels[keep] == last[keep]:
            keep += 1
        self._settle(keep)
        for label in labels[keep:]:
            state = len(self.next)
            self.next.append({})
            self.final.append(False)
            self.words.append(0)
            self.ends.append(0)
            self.next[self.path[-1]][label] = state
            self.path.append(state)
        self.final[self.path[-1]] = True
        self.last = labels

    def done(self) -> None:
        self._settle(0)

    def common(self, p: int, q: int, size: int):
        """Words of ``size`` labels that both states accept: the machine behind its edit."""
        nexts, ends = self.next, self.ends
        word: list = []
        stack = [(p, q, 0, "")]
        while stack:
            p, q, k, label = stack.pop()
            if k:
                word[k - 1:] = [label]
            if k == size:
                if self.final[p] and self.final[q]:
                    yield "".join(word)
                continue
            bit = 1 << (size - k - 1) % 64
            b = nexts[q]
            for label, t in nexts[p].items():
                if ends[t] & bit:
                    u = b.get(label)
                    if u is not None and ends[u] & bit:
                        stack.append((t, u, k + 1, label))

    def near(self, start: int, size: int):
        """Pairs that the composition accepts from (start, copy, start), the shorter word with ``size`` labels."""
        nexts, final, ends = self.next, self.final, self.ends
        read: list = []
        stack = [(start, 0, "")]
        while stack:
            p, k, label = stack.pop()
            if k:
                read[k - 1:] = [label]
            out = list(nexts[p].items())
            rest = size - k - 1  # labels behind the edit
            if rest < 0:
                if final[p]:  # deleted at the very end
                    for a, s in out:
                        if final[s]:
                            done = "".join(read[:k])
                            yield done + a, done
                continue
            bit = 1 << rest % 64
            for i, (a, s) in enumerate(out):
                for b, u in nexts[s].items():  # a deleted: the other side reads b, which is not a
                    if ends[u] & bit and a != b:
                        t = nexts[p].get(b)
                        if t is not None and ends[t] & bit:
                            for w in self.common(u, t, rest):
                                done = "".join(read[:k])
                                yield done + a + b + w, done + b + w
                if ends[s] & bit:
                    for b, t in out[i + 1:]:  # a replaced by b
                        if ends[t] & bit:
                            for w in self.common(s, t, rest):
                                done = "".join(read[:k])
                                yield done + a + w, done + b + w
                if self.words[s] > 1:
                    stack.append((s, k + 1, a))


def _halves(words: DataFrame) -> DataFrame:
    """``back, l, half, edit, word, n``: the four partitions of each word, without an edit."""
    size = F.char_length("word")
    w = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("l")).where("l > 0")
    h = F.floor(F.col("l") / 2).cast("int")
    ahead = w.select(F.lit(False).alias("back"), "l", "word", "n", h.alias("at"))
    back = w.select(F.lit(True).alias("back"), "l", F.reverse("word").alias("word"), "n", (F.col("l") - h).alias("at"))
    return ahead.unionByName(back).select("back", "l", F.expr("substring(word, 1, at)").alias("half"),
                                          F.lit(-1).alias("edit"), "word", "n")


def partitions(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``back, l, half, edit, word, n``: the initial states with their words, none of more than ``limit`` words.

    ``half`` is what the words share. Where a partition had to be split, ``edit`` is the position of the edit and
    ``half`` the word without that code point, or the whole word if it is the shorter one; such partitions hold no
    more words than there are code points.
    """
    key = ["back", "l", "half", "edit"]
    todo, done = _halves(words), []
    while True:
        large = written(todo.where("edit < 0").groupBy(*key).agg(F.count("*").alias("words"))
                        .where(F.col("words") > limit).select(*key), "variant-large")
        if large.isEmpty():
            done.append(todo)
            break
        done.append(todo.join(large, key, "left_anti"))
        todo = written(todo.join(large, key, "left_semi"), "variant-split")
        at, size = F.char_length("half"), F.char_length("word")
        more = todo.where(size > at)
        # the edit is at the next code point: words meet without it, a longer one meets the whole shorter one
        gone = F.expr("concat(half, substring(word, char_length(half) + 2))")
        done.append(more.select("back", "l", gone.alias("half"), at.alias("edit"), "word", "n"))
        done.append(todo.where(size == F.col("l")).select("back", "l", F.col("word").alias("half"), at.alias("edit"),
                                                          "word", "n"))
        # or it comes later, and the next code point is shared
        todo = more.select("back", "l", F.expr("substring(word, 1, char_length(half) + 1)").alias("half"), "edit", "word", "n")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _edited(l: int, half: str, at: int, words: list[str]):
    """Pairs of a partition behind its edit: words without one code point, or a shorter word and those longer by one."""
    if len(half) < l:
        for i, a in enumerate(words):
            for b in words[i + 1:]:
                yield a, b
    elif half in words:
        for a in words:
            if len(a) > l and a[at] != half[at:at + 1]:
                yield a, half


def _accepted(batches):
    """Near pairs of partitions that come sorted; one acceptor for about ``ACCEPTOR`` words of whole partitions."""
    names = ["a", "b", "a_n", "b_n"]
    waiting: list = []
    held = 0

    def emit(rows):
        for lo in range(0, len(rows), 50_000):
            cols = list(zip(*rows[lo:lo + 50_000]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (
                pa.string(), pa.string(), pa.int64(), pa.int64()))], names)

    def solve():
        acceptor = Acceptor()
        for k, ((_, _, half, edit), group) in enumerate(waiting):
            if edit < 0:
                skip = len(half)
                for word in sorted(group):
                    acceptor.add([k, *word[skip:]])
        acceptor.done()
        rows: list = []
        for k, ((back, l, half, edit), group) in enumerate(waiting):
            if edit < 0:
                start, skip = acceptor.next[0][k], len(half)
                found = ((half + a, half + b) for a, b in acceptor.near(start, l - skip))
            else:
                found = _edited(l, half, edit, list(group))
            front = l // 2
            for a, b in found:
                if back:
                    x, y = a[::-1], b[::-1]
                    if x[:front] == y[:front]:
                        continue  # found forwards
                    rows.append((x, y, group[a], group[b]))
                else:
                    rows.append((a, b, group[a], group[b]))
            if len(rows) >= 50_000:
                yield from emit(rows)
                rows = []
        yield from emit(rows)

    key, group = None, {}
    for batch in batches:
        for *k, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            if k != key:
                if len(group) > 1:
                    waiting.append((key, group))
                    held += len(group)
                    if held >= ACCEPTOR:
                        yield from solve()
                        waiting, held = [], 0
                key, group = k, {}
            group[word] = n
    if len(group) > 1:
        waiting.append((key, group))
    if waiting:
        yield from solve()


def near_pairs(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``a, b, a_n, b_n``: every pair of the distinct ``words(word, n)`` that differ by one edit, once."""
    key = ["back", "l", "half", "edit"]
    dealt = partitions(words, limit).repartition(*key).sortWithinPartitions(*key)
    return dealt.select(*key, "word", "n").mapInArrow(_accepted, "a string, b string, a_n long, b_n long")


def variants(words: DataFrame, factor: int = FACTOR, limit: int = LIMIT) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of each of the distinct ``words(word, n)``.

    The form is the near word of the largest count (ties: the smallest word) if that is ``factor`` times the word's.
    """
    pairs = near_pairs(words, limit)
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("m")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("m")))).alias("p")).select("p.*")
    # the largest count, then the smallest word: the minimum of (-count, word)
    best = both.groupBy("word").agg(F.count("*").alias("n_near"),
                                    F.min(F.struct((-F.col("m")).alias("m"), F.col("other"))).alias("best"))
    got = words.join(best, "word", "left")
    enough = -F.col("best.m") >= factor * F.col("n")
    got = written(got.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                             F.when(enough, F.col("best.other")).alias("form"),
                             F.when(enough, -F.col("best.m")).alias("form_n")), "variant-forms")
    bounds = got.agg(F.min("n").alias("lo"), F.max("n").alias("hi")).first()
    links = got.where("form is not null").select("word", F.col("form").alias("root"))
    if bounds["lo"]:
        steps = max(1, int(math.log(bounds["hi"] / bounds["lo"], factor)) + 1)  # forms in a row, at most
        for _ in range(math.ceil(math.log2(steps))):
            ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
            links = written(links.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")),
                            "variant-roots")
    return got.join(links, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_report(docs: DataFrame) -> DataFrame:
    """The variants of all words of ``docs``."""
    return variants(written(word_counts(docs), "variant-words"))
