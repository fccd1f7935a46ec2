"""Spelling variants: words one edit apart, found by search schemes over FM-indexes of the vocabulary.

Two words one edit (a code point inserted, deleted or replaced) apart share one half of either of them: the
edit lies in the other. So the first scheme matches the first half of a word exactly and extends to the right
with one error; the second matches the last half and extends to the left. The second is the first on words
read backwards. A near word that keeps the first half is the first scheme's, any other the second's.

The vocabulary is never in one place. A word is filed under the starts that a near word may share with it as
its half (two lengths, forwards and backwards); files are dealt into shards of bounded size, and each shard
builds the FM-index of its words, delimited, and searches for its own words all at once: intervals of suffix
ranks, one step of all of them at a time. What does not fit a shard is split; its words then ask every part.
What leaves a shard is one row for each word that found something, not pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import written

LEAST_LETTERS = 6
LEAST_COUNT = 5
RATIO = 5
COUNTS_HELD = 200_000
SHARD_WORDS = 20_000

RUN = re.compile("[A-Za-z\u00C0-\u00FF]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

Change = Callable[[int | None, list[str]], list[str]]


def lowered(word: str) -> str:
    """A-Z to a-z and nothing else."""
    return word.lower() if word.isascii() else word.translate(LOWER)


def vocabulary(docs: DataFrame, change: Change | None = None, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: every word of at least `least_letters` letters with at least `least_count` occurrences in all texts.

    `change` may alter or shorten the distinct lower-case words of a document before they are counted. Null and
    empty texts have no words; repeated rows count as often as they stand there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return made

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own: Counter[str] = Counter()
                for word, n in Counter(RUN.findall(text or "")).items():
                    if len(word) >= least_letters:
                        own[lowered(word)] += n
                for word, n in zip(change(doc_id, list(own)) if change else list(own), own.values(), strict=True):
                    if len(word) >= least_letters:
                        total[word] += n
                if len(total) > COUNTS_HELD:
                    yield out()
        yield out()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = source.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= least_count)


class Index:
    """FM-index of words read backwards between delimiters, so that a search takes letters from the first on.

    A state is an interval [low, high) of suffix ranks. The places of every symbol in the transformed text are
    kept in one sorted array, so a step of any number of states is two binary searches.
    """

    def __init__(self, words: list[str]):
        self.words = words
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        self.alphabet = np.unique(points)
        # 0 delimits; letters follow in order. Word i stands backwards before its own delimiter.
        self.firsts = np.concatenate([[0], np.cumsum(lengths)])
        self.letters = np.searchsorted(self.alphabet, points) + 1
        n = len(points) + len(words) + 1
        text = np.zeros(n, np.int64)
        ends = self.firsts[1:] + np.arange(1, len(words) + 1)  # place of the delimiter after each word
        place = np.repeat(ends - 1, lengths) - (np.arange(len(points)) - np.repeat(self.firsts[:-1], lengths))
        text[place] = self.letters
        self.word_at = {int(e) - int(m) - 1: i for i, (e, m) in enumerate(zip(ends, lengths, strict=True))}
        self.n = n
        self.order = suffix_order(text)
        self.last = text[self.order - 1]  # the symbol before each suffix
        ranks = np.arange(n)
        by_symbol = np.argsort(self.last, kind="stable")
        self.steps = self.last[by_symbol] * (n + 1) + ranks[by_symbol]

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals after taking one more symbol."""
        at = symbol * (self.n + 1)
        return np.searchsorted(self.steps, at + low), np.searchsorted(self.steps, at + high)

    def symbols(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, symbol) for every letter that can follow a state."""
        width, kinds = high - low, len(self.alphabet)
        narrow = np.flatnonzero(width <= kinds)
        state = np.repeat(narrow, width[narrow])
        ramp = np.arange(len(state)) - np.repeat(np.cumsum(width[narrow]) - width[narrow], width[narrow])
        seen = np.unique(state * (kinds + 1) + self.last[low[state] + ramp])
        wide = np.flatnonzero(width > kinds)
        both = np.concatenate([seen, np.repeat(wide, kinds) * (kinds + 1) + np.tile(np.arange(1, kinds + 1), len(wide))])
        state, symbol = np.divmod(both, kinds + 1)
        return state[symbol > 0], symbol[symbol > 0]

    def near(self, asked: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word asked, word found): all words of the index one edit from words[asked] that share its first `exact` letters."""
        starts, lengths = self.firsts[asked], self.firsts[asked + 1] - self.firsts[asked]
        all_rows = np.zeros(len(asked), np.int64)
        low, high = self.step(all_rows, all_rows, all_rows + self.n)
        who = np.arange(len(asked))  # states without an error so far
        pool = [np.zeros(0, np.int64)] * 3  # states with one: who, low, high
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for t in range(int(lengths.max(initial=-1)) + 1):
            fresh: list[tuple[np.ndarray, ...]] = []  # with the error, and this step behind them
            open_ = np.flatnonzero(t >= exact[who])
            if len(open_):
                state, symbol = self.symbols(low[open_], high[open_])
                state = open_[state]
                more = t < lengths[who[state]]
                own = self.letters[np.minimum(starts[who[state]] + t, len(self.letters) - 1)]
                other = ~more | (symbol != own)
                state, symbol, more = state[other], symbol[other], more[other]
                a, b = self.step(symbol, low[state], high[state])
                real = b > a
                state, more, a, b = state[real], more[real], a[real], b[real]
                fresh.append((who[state][more], a[more], b[more]))  # replaced
                pool = [np.concatenate(x) for x in zip(pool, (who[state], a, b), strict=True)]  # inserted: the letter itself is still to come
                skip = open_[t < lengths[who[open_]]]
                fresh.append((who[skip], low[skip], high[skip]))  # deleted
            # words that end here: the delimiter closes what has its error
            done = lengths[pool[0]] == t
            found.append((pool[0][done], self.located(*(x[done] for x in pool[1:]))))
            pool = self.moved([x[~done] for x in pool], starts, t)
            pool = [np.concatenate(x) for x in zip(pool, *fresh, strict=True)]
            who, low, high = self.moved([x[t < lengths[who]] for x in (who, low, high)], starts, t)
        whom, what = (np.concatenate(x) for x in zip(*found, strict=True))
        whom, what = whom[what >= 0], what[what >= 0]
        pairs = np.unique(whom * max(1, len(self.words)) + what)
        whom, what = np.divmod(pairs, max(1, len(self.words)))
        return asked[whom], what

    def moved(self, states: list[np.ndarray], starts: np.ndarray, t: int) -> list[np.ndarray]:
        """States after taking the letter t of their words; those without a match go."""
        who, low, high = states
        a, b = self.step(self.letters[starts[who] + t], low, high) if len(who) else (low, high)
        real = b > a
        return [who[real], a[real], b[real]]

    def located(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The word of each state that a delimiter closes, -1 for the rest. Words are distinct, so it is one."""
        a, b = self.step(np.zeros(len(low), np.int64), low, high)
        return np.fromiter((self.word_at[int(self.order[x])] if y > x else -1 for x, y in zip(a, b, strict=True)), np.int64, len(a))


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling the length they are told apart by."""
    n, k = len(text), 1
    rank = text.copy()
    while True:
        after = np.full(n, -1, np.int64)
        after[:-k] = rank[k:]
        key = rank * (n + 2) + after + 1
        order = np.argsort(key, kind="stable")
        changed = np.concatenate([[0], np.diff(key[order]) != 0]).cumsum()
        rank = np.empty(n, np.int64)
        rank[order] = changed
        if changed[-1] == n - 1 or k >= n:
            return order
        k *= 2


def halves(word: str) -> tuple[int, int]:
    """Letters of the first and of the last half."""
    return len(word) // 2, len(word) - len(word) // 2


def _filed(words: DataFrame) -> DataFrame:
    """side, start, word, n, exact: every word under the starts by which a near word may ask for it.

    A word asks under the start of its own half; words one letter shorter or longer have other halves, so
    it is filed under those too. On side 1 words stand backwards. `exact` is the half of a word that asks
    under this start, null if it is only to be found there.
    """
    size = F.length("word")
    first = lambda n: F.floor(n / 2)
    sides = [
        F.struct(F.lit(0).alias("side"), F.col("word").alias("read"), first(size).alias("own"), F.array_distinct(F.array(first(size - 1), first(size), first(size + 1))).alias("lengths")),
        F.struct(
            F.lit(1).alias("side"),
            F.reverse("word").alias("read"),
            (size - first(size)).alias("own"),
            F.array_distinct(F.array(size - 1 - first(size - 1), size - first(size), size + 1 - first(size + 1))).alias("lengths"),
        ),
    ]
    rows = words.select("n", F.explode(F.array(*sides)).alias("s")).select("n", "s.*")
    rows = rows.select("n", "side", "read", "own", F.explode("lengths").alias("taken"))
    return rows.select(
        "side",
        F.substring("read", F.lit(1), F.col("taken").cast("int")).alias("start"),
        F.col("read").alias("word"),
        "n",
        F.when(F.col("taken") == F.col("own"), F.col("own")).cast("int").alias("exact"),
    )


def _search(table: pa.Table) -> pa.Table:
    """Near words inside one shard: for each word that asks, how many, and the most frequent (then smallest) one."""
    out: dict[str, list] = {"word": [], "n_near": [], "best_n": [], "best": []}
    sides, words, counts, exact, found_here = (table.column(c).to_pylist() for c in ("side", "word", "n", "exact", "is_found"))
    for side in (0, 1):
        rows = [i for i, s in enumerate(sides) if s == side]
        asks = {words[i]: exact[i] for i in rows if exact[i] is not None}
        there = {words[i]: counts[i] for i in rows if found_here[i]}
        names = list(there.keys() | asks.keys())
        if not asks or not there:
            continue
        index = Index(names)
        asked = np.array([k for k, w in enumerate(names) if w in asks], np.int64)
        whom, what = index.near(asked, np.array([asks[names[k]] for k in asked], np.int64))
        best: dict[int, list] = {}
        for a, b in zip(whom.tolist(), what.tolist(), strict=True):
            word, near = names[a], names[b]
            if near not in there:
                continue
            if side:
                word, near = word[::-1], near[::-1]
                half = halves(word)[0]
                if near[:half] == word[:half]:
                    continue  # the other scheme's
            own = best.setdefault(a, [word, 0, None])
            own[1] += 1
            rank = (-there[names[b]], near)
            own[2] = rank if own[2] is None else min(own[2], rank)
        for word, n, (minus, near) in best.values():
            for c, v in zip(out, (word, n, -minus, near), strict=True):
                out[c].append(v)
    return pa.Table.from_pydict(out, pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())]))


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """word, n_near, best_n, best of every word with a near one; `words` has distinct (word, n), read several times."""
    shards = max(1, 4 * words.count() // shard_words)
    dealt = _filed(words).withColumn("shard", F.pmod(F.xxhash64("side", "start"), F.lit(shards)))
    # a start that many words share makes a shard too large: then every part of its words asks every part
    parts = F.ceil(F.count("*") / (2 * shard_words)).cast("int").alias("parts")
    dealt = dealt.join(dealt.groupBy("shard").agg(parts), "shard")
    home, parts = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"), F.sequence(F.lit(0), F.col("parts") - 1)

    def cell(part: F.Column, asking: F.Column, exact: F.Column, is_found: bool) -> F.Column:
        return F.struct(part.alias("part"), asking.alias("asking"), exact.alias("exact"), F.lit(is_found).alias("is_found"))

    found_in = F.transform(parts, lambda k: cell(home, k, F.lit(None).cast("int"), True))
    asked_in = F.transform(parts, lambda k: cell(k, home, F.col("exact"), False))
    cells = (
        F.when(F.col("parts") == 1, F.array(cell(F.lit(0), F.lit(0), F.col("exact"), True)))
        .when(F.col("exact").isNull(), found_in)
        .otherwise(F.concat(found_in, asked_in))
    )
    rows = dealt.select("shard", "side", "word", "n", F.explode(cells).alias("c")).select("shard", "side", "word", "n", "c.*")
    found = rows.groupBy("shard", "part", "asking").applyInArrow(_search, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.w").alias("best")
    )


def roots(forms: DataFrame, max_rounds: int = 40) -> DataFrame:
    """word, root of every (word, form), forms followed to the last by doubling the way in every round."""
    links = written(forms.select("word", F.col("form").alias("root")), "spelling-links")
    for _ in range(max_rounds):
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-links")
        links = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return links
    raise RuntimeError(f"forms did not end in {max_rounds} rounds")


def group_variants(
    docs: DataFrame,
    change: Change | None = None,
    least_letters: int = LEAST_LETTERS,
    least_count: int = LEAST_COUNT,
    ratio: int = RATIO,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary of `docs`.

    A word's form is its most frequent near word (ties: the smallest), if that is at least `ratio` times as
    frequent; root is where the forms lead, the word itself without one. Words need `least_letters` of 6 or
    more, so that halves are words of their own. Null and empty texts add nothing; rows without doc_id and
    repeated rows count like others; an empty table gives no rows. Columns beside doc_id and text play no part.
    """
    words = written(vocabulary(docs, change, least_letters, least_count), "spelling-words")
    near = near_words(words, shard_words)
    known = words.join(near, "word", "left")
    chosen = F.col("best_n") >= ratio * F.col("n")
    rows = written(
        known.select("word", F.when(chosen, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, F.col("best_n")).alias("form_n")),
        "spelling-forms",
    )
    last = roots(rows.filter("form is not null"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def drop_letters(every: int) -> Change:
    """Words of a document of which one in `every`, by checksum of document and word, loses a letter."""

    def change(doc_id: int | None, words: list[str]) -> list[str]:
        before = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
        out = []
        for word in words:
            h = zlib.crc32(word.encode(), before)
            if h % every == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            out.append(word)
        return out

    return change
