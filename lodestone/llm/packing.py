"""Packing documents into fixed-length sequences by bin completion.

Documents are tokenized; only those longer than the capacity are cut, into pieces of the
capacity and a rest. How many sequences are needed depends on the piece lengths alone, so
the search runs on a histogram of at most ``capacity`` lengths, whatever the number of
documents, and its answer is a list of fillings with multiplicities.

The incumbent is best-fit decreasing, done on the histogram: all pieces of a length at
once, into the fullest open fillings that take them; a narrow search of at most
``max_nodes`` nodes (six fillings each, used as often as they can be) may better it.
Branch and bound then tries bin completion around the largest piece left: all fillings
of the rest of its sequence are enumerated lazily, fullest first, by the sums that the
stock can reach. Those that another one dominates (a piece more, or a larger piece in
the place of one, within the capacity) are skipped, and a branch is cut when the waste
so far exceeds what the incumbent allows (capacity * (incumbent - 1) - total). A filling
is used as often as the stock has it; when all fillings were tried so, they are tried
again with each lower multiplicity. Sequences around pieces of one length are filled in
the order of the enumeration, so no packing is tried twice. The search ends at the waste
bound, at its own end (then the packing is optimal), or after ``max_nodes`` nodes (a
filling tried, or a partial one given up), with the best packing so far.

Pieces are then numbered within their length (in parts, so that a hot length isn't in
one task) and number r of a length goes to the r-th place for that length.

Defined results: a null or empty text is the end token alone; rows that repeat are
packed each (they need a place of their own); an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ranked

_tokenizers: dict[str, "WordTokenizer"] = {}

#: A filling: how often it is used, and its piece lengths in order.
Filling = tuple[int, tuple[int, ...]]


#: Letters that NFC leaves alone, and ASCII punctuation without the apostrophe, which
#: can start a contraction: a word of these (and digits) is tokenized part by part.
_LETTERS, _MARKS = "a-zÀ-ÖØ-öø-ÿ", re.escape("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
_PLAIN = re.compile(f"[{_LETTERS}0-9{_MARKS}]+")
_PARTS = re.compile(f"[{_LETTERS}]+|[0-9]|[{_MARKS}]+")


class _Recent:
    """A bounded memory in two generations: when the young one is full it becomes the
    old one, and what is not used before the next turn is forgotten."""

    def __init__(self, most: int):
        self.most = most
        self.young: dict = {}
        self.old: dict = {}

    def unknown(self, keys: set) -> list:
        """The keys in neither generation; those in the old one become young."""
        if len(self.young) + len(keys) > self.most:
            self.young, self.old = {}, self.young
        young, old, missing = self.young, self.old, []
        for k in keys:
            known = old.get(k)
            if known is not None:
                young[k] = known
            elif k not in young:
                missing.append(k)
        return missing


class WordTokenizer:
    """Ids of a tokenizer whose normalizer lower-cases and drops white space and whose
    words never span it: words between ASCII spaces are tokenized once and remembered,
    as the bytes of little-endian unsigned 32-bit ids. Words of plain letters and marks
    are put together from their parts, which recur more often. Strings of special tokens
    in a text are these tokens, as is the tokenizer's default: the text is cut there."""

    def __init__(self, path: str, words: int = 300_000, parts: int = 500_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # words are lower-cased first; specials are cut out before
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
            raise ValueError("the tokenizer has added tokens that take in what stands around them")
        self.special = {t.content: np.array([i], "<u4").tobytes() for i, t in added.items()}
        self.at_special = re.compile("(" + "|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) + ")") if added else None
        self.words, self.parts = _Recent(words), _Recent(parts)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def ids(self, text: str) -> bytes:
        if self.at_special and self.at_special.search(text):
            return b"".join([self.special.get(x) or self._plain(x) for x in self.at_special.split(text)])
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        # bytes.split() splits at [\x20\x09-\x0D] only, bytes.lower() changes A-Z only
        given = text.encode("utf-8", "replace").lower().split()
        out = list(map(self.words.young.get, given))
        if None in out:
            self._learn({w for w, known in zip(given, out) if known is None})
            young = self.words.young
            out = [young[w] if known is None else known for w, known in zip(given, out)]
        return b"".join(out)

    def _learn(self, needed: set[bytes]) -> None:
        split: dict[bytes, list[str]] = {}
        whole: list[bytes] = []
        for w in self.words.unknown(needed):
            text = w.decode("utf-8")
            if _PLAIN.fullmatch(text):
                split[w] = _PARTS.findall(text)
            else:
                whole.append(w)
        words = self.words.young
        if whole:
            words.update(zip(whole, self._encode([w.decode("utf-8") for w in whole])))
        if split:
            self._learn_parts({p for x in split.values() for p in x})
            parts = self.parts.young
            for w, x in split.items():
                words[w] = parts[x[0]] if len(x) == 1 else b"".join([parts[p] for p in x])

    def _learn_parts(self, needed: set[str]) -> None:
        fresh = self.parts.unknown(needed)
        if not fresh:
            return
        # one text of all: every part is one word to the tokenizer, so ends of words part the ids
        (ids,) = self._encode([" ".join(fresh)])
        ends = np.flatnonzero(self.ends[np.frombuffer(ids, "<u4")]) + 1
        if len(ends) != len(fresh):
            self.parts.young.update(zip(fresh, self._encode(fresh)))
            return
        at = 0
        for p, end in zip(fresh, (ends * 4).tolist()):
            self.parts.young[p] = ids[at:end]
            at = end

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def word_tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def best_fit(histogram: dict[int, int], capacity: int) -> list[Filling]:
    """Best-fit decreasing over a histogram {length: pieces}."""
    open_: dict[int, Counter[tuple[int, ...]]] = {}
    rests: list[int] = []

    def put(rest: int, filling: tuple[int, ...], n: int) -> None:
        if rest not in open_:
            open_[rest] = Counter()
            insort(rests, rest)
        open_[rest][filling] += n

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            i = bisect_left(rests, length)
            if i == len(rests):
                each = capacity // length
                if full := left // each:
                    put(capacity - each * length, (length,) * each, full)
                if left % each:
                    put(capacity - (left % each) * length, (length,) * (left % each), 1)
                break
            rest = rests[i]
            fillings = open_[rest]
            filling, n = next(iter(fillings.items()))
            # as many of the pieces as the rest takes, as best fit would place them
            each = min(rest // length, left)
            used = min(n, left // each)
            fillings[filling] -= used
            if not fillings[filling]:
                del fillings[filling]
            if not fillings:
                del open_[rest]
                rests.pop(i)
            put(rest - each * length, filling + (length,) * each, used)
            left -= used * each
    return [(n, f) for rest in rests for f, n in open_[rest].items()]


def completions(counts: dict[int, int], lengths: list[int], first: int, room: int, waste: int, after: tuple[int, ...] | None = None) -> Iterator[tuple[int, ...] | None]:
    """All undominated fillings of ``room`` around a piece of length ``first`` that leave
    at most ``waste``, fullest first and then by their pieces, the largest first; only
    those later in this order than ``after``. None for each partial one given up.
    ``lengths``: those in stock, ascending."""
    room -= first
    lengths = lengths[: bisect_right(lengths, room)]
    stock = [counts[x] - (x == first) for x in lengths]
    # bit r of reach[i]: the first i lengths have pieces that sum to r
    reach, mask = [1], (1 << (room + 1)) - 1
    for x, n in zip(lengths, stock):
        sums, n, step = reach[-1], min(n, room // x), 1
        while n > 0:
            step = min(step, n)
            sums |= (sums << (x * step)) & mask
            n, step = n - step, 2 * step
        reach.append(sums)
    used: dict[int, int] = {}

    def swapped(x: int, rest: int) -> bool:
        """Whether a larger piece left in stock can stand for one of length ``x``."""
        for d in lengths[bisect_right(lengths, x) : bisect_right(lengths, x + rest)]:
            if counts[d] - (d == first) > used.get(d, 0):
                return True
        return False

    def fill(i: int, left: int, rest: int, chosen: tuple[int, ...], bound: tuple[int, ...] | None) -> Iterator[tuple[int, ...] | None]:
        # fillings of exactly ``left`` from the first i lengths, below the pieces ``bound``
        while i > 0 and (left or lengths[0] <= rest):
            i -= 1
            x = lengths[i]
            at_bound = bool(bound) and bound[0] == x
            most = 0 if bound and x > bound[0] else min(stock[i], left // x)
            if at_bound:
                most = min(most, bound.count(x))
            least = stock[i] if x <= rest else 1  # what fits the rest as well has to be in
            for k in range(most, max(least, 1) - 1, -1):
                if not reach[i] >> (left - k * x) & 1:
                    continue
                used[x] = k
                if rest and swapped(x, rest):
                    yield None
                else:
                    below = bound[k:] if at_bound and bound.count(x) == k else None
                    yield from fill(i, left - k * x, rest, (*chosen, *(x,) * k), below)
                del used[x]
            if x <= rest and stock[i]:
                yield None
                return
            if not reach[i] >> left & 1:
                return
            if bound and x <= bound[0]:
                bound = None
        if not left and bound is None:
            yield (first, *chosen)

    top = room if after is None else sum(after) - first
    for left in range(top, max(room - waste, 0) - 1, -1):
        if reach[-1] >> left & 1:
            yield from fill(len(lengths), left, room - left, (), after[1:] if after is not None and left == top else None)


def first_completions(counts: dict[int, int], lengths: list[int], first: int, capacity: int, most: int) -> list[tuple[int, ...]]:
    """The first ``most`` fillings around a piece of length ``first`` that a descent by
    the largest pieces meets, without those dominated among them, the fullest first.
    ``lengths``: those in stock, ascending."""
    found: list[tuple[int, tuple[int, ...]]] = []
    budget = [most * 40]

    def grow(rest: int, top: int, chosen: tuple[int, ...]) -> None:
        if len(found) >= most or budget[0] <= 0:
            return
        budget[0] -= 1
        i = bisect_right(lengths, min(rest, top)) - 1
        grown = False
        while i >= 0 and len(found) < most:
            x = lengths[i]
            if counts[x] > chosen.count(x) + (x == first):
                grown = True
                grow(rest - x, x, (*chosen, x))
                if rest - x == 0:
                    break  # a piece that fills the rest dominates all smaller ones
            i -= 1
        if not grown:
            found.append((rest, (first, *chosen)))

    grow(capacity - first, capacity, ())
    unique = sorted(dict.fromkeys(found))
    kept: list[tuple[int, tuple[int, ...]]] = []
    for rest, filling in unique:
        # dominated: a fuller one has the same pieces but for one swapped by a larger
        if not any(len(f) == len(filling) and all(a >= b for a, b in zip(f, filling)) for _, f in kept):
            kept.append((rest, filling))
    return [f for _, f in kept]


class _Stock:
    """The pieces still to be packed, and what the fillings in use took: one copy, from
    which fillings are taken and to which they are put back."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity = capacity
        self.counts = {k: v for k, v in histogram.items() if v}
        self.lengths = sorted(self.counts)
        self.used = self.waste = 0

    def times(self, filling: tuple[int, ...]) -> int:
        """How often the stock has the filling."""
        return min(self.counts[x] // n for x, n in Counter(filling).items())

    def use(self, filling: tuple[int, ...], times: int) -> None:
        """Take the filling from the stock, or put it back where ``times`` is negative."""
        counts, lengths = self.counts, self.lengths
        self.used += times
        self.waste += times * (self.capacity - sum(filling))
        for x, n in Counter(filling).items():
            had = counts.get(x, 0)
            counts[x] = had - n * times
            if not counts[x]:
                del counts[x], lengths[bisect_left(lengths, x)]
            elif not had:
                insort(lengths, x)


def narrow_search(histogram: dict[int, int], capacity: int, best: list[Filling], bound: int, max_nodes: int, branches: int) -> list[Filling]:
    """A better incumbent than ``best``, if there is one among ``branches`` fillings a
    node, each used as often as the stock has it. It proves nothing. It holds one stock
    and the fillings in use, so the driver's memory doesn't grow with the nodes."""
    stock = _Stock(histogram, capacity)
    total = sum(k * v for k, v in histogram.items())
    n_best = sum(n for n, _ in best)
    nodes = 0
    taken: list[Filling] = []
    # (how many of ``taken`` stand before it, the filling to take) still to be tried, the latest first
    stack: list[tuple[int, tuple[int, ...] | None]] = [(0, None)]
    while stack and n_best > bound and nodes < max_nodes:
        depth, filling = stack.pop()
        nodes += 1
        while len(taken) > depth:
            times, last = taken.pop()
            stock.use(last, -times)
        if filling is not None:
            taken.append((stock.times(filling), filling))
            stock.use(filling, taken[-1][0])
        if not stock.counts:
            if stock.used < n_best:
                best, n_best = list(taken), stock.used
            continue
        if stock.waste > capacity * (n_best - 1) - total:
            continue  # no completion beats the incumbent
        options = first_completions(stock.counts, stock.lengths, stock.lengths[-1], capacity, branches)
        stack += [(len(taken), f) for f in reversed(options)]
    return best


def pack(histogram: dict[int, int], capacity: int, max_nodes: int = 20_000, branches: int = 6) -> list[Filling]:
    """Fillings that hold all pieces of a histogram, as few as the search finds.
    ``branches``: fillings a node of the narrow search for an incumbent; the search
    itself tries all."""
    stock = _Stock(histogram, capacity)
    counts, lengths = stock.counts, stock.lengths
    total = sum(k * v for k, v in counts.items())
    best = best_fit(counts, capacity)
    bound = max(-(-total // capacity), sum(v for k, v in counts.items() if 2 * k > capacity))
    best = narrow_search(counts, capacity, best, bound, max_nodes, branches)
    n_best = sum(n for n, _ in best)
    nodes = 0

    # the path of open nodes: [first, latest filling, its times in use, fillings tried,
    # whether they are used less often than they could be, the last filling of a
    # parent with the same first]
    path: list[list] = []

    def enter(after: tuple[int, ...] | None) -> None:
        path.append([lengths[-1], after, 0, 0, False, after])

    if n_best > bound:
        enter(None)
    while path and n_best > bound and nodes < max_nodes:
        node = path[-1]
        first, filling, times, tried, fewer, start = node
        if times:
            stock.use(filling, -times)
            node[2] = 0
        allowed = capacity * (n_best - 1) - total - stock.waste
        if allowed < 0:  # no completion beats the incumbent
            path.pop()
            continue
        if fewer and times > 1:
            times -= 1
        else:
            found = None
            for found in completions(counts, lengths, first, capacity, allowed, filling):
                nodes += found is None
                if found is not None or nodes >= max_nodes:
                    break
            if found is None:
                if nodes >= max_nodes:
                    break
                if fewer or not tried:
                    path.pop()
                else:
                    node[1], node[4] = start, True
                continue
            node[1], node[3] = found, tried + 1
            filling = found
            times = stock.times(filling) - fewer
            if not times:
                continue
        nodes += 1
        if times * (capacity - sum(filling)) > allowed:
            if not fewer:
                continue
            times = allowed // (capacity - sum(filling))
            if not times:
                continue
        stock.use(filling, times)
        node[2] = times
        if counts:
            enter(filling if lengths[-1] == first else None)
        elif stock.used < n_best:
            best, n_best = [(x[2], x[1]) for x in path], stock.used
    return best


def places(fillings: list[Filling]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks, first sequences and offsets of its runs of places.
    A run of a filling's place covers as many ranks as the filling is used, so there are
    as many runs as the fillings have places, however many documents there are: best fit
    turns one entry into another or adds up to three for each length, so it has 3 * capacity
    entries at most, and the search takes a filling up for one entry or less."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    next_rank: Counter[int] = Counter()
    sequence = 0
    for n, filling in fillings:
        offset = 0
        for length in filling:
            runs.setdefault(length, []).append((next_rank[length], sequence, offset))
            next_rank[length] += n
            offset += length
        sequence += n
    return {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in runs.items()}  # type: ignore[misc]


def token_pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """(_id, piece, start, length, ids_crc32) of every document."""
    end = np.array([end_id], "<u4").tobytes()
    kind = docs.schema[id_col].dataType.simpleString()

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # kept by the worker from task to task, with the words it knows
        tokenizer = word_tokenizer(tokenizer_path)
        step = 4 * capacity
        for batch in batches:
            out = []
            for i, text in enumerate(batch["_text"]):
                ids = tokenizer.ids(text) + end
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    out.append((i, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            rows = pd.DataFrame(out, columns=["i", "piece", "start", "length", "ids_crc32"])
            rows.insert(0, "_id", batch["_id"].to_numpy()[rows["i"]] if len(rows) else batch["_id"][:0])
            yield rows.drop(columns="i")

    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return rows.mapInPandas(each, f"_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack_documents(
    docs: DataFrame,
    *,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int = 0,
    max_nodes: int = 20_000,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) per piece."""
    pieces = materialize(token_pieces(docs, id_col, text_col, tokenizer_path, capacity, end_id), "pieces")
    lengths = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``capacity`` rows
    where = places(pack({r["length"]: r["n"] for r in lengths}, capacity, max_nodes))
    rows = ranked(pieces, ["length"], ["_id", "piece", "ids_crc32"], "_rank")
    names = ["_id", "piece", "start", "length", "ids_crc32", "_rank"]
    shared = docs.sparkSession.sparkContext.broadcast(where)  # as many runs as the fillings have places

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs = shared.value
        for batch in batches:
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            rank, length = batch["_rank"].to_numpy(), batch["length"].to_numpy()
            for x in np.unique(length):
                mine = np.flatnonzero(length == x)
                first, sequences, offsets = runs[int(x)]
                run = np.searchsorted(first, rank[mine], "right") - 1
                sequence[mine] = sequences[run] + rank[mine] - first[run]
                offset[mine] = offsets[run]
            yield batch.drop(columns="_rank").assign(sequence_id=sequence, offset=offset)

    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.select(*names).mapInPandas(place, f"_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("_id", id_col)
