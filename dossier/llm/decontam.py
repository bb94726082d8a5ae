"""Benchmark decontamination by q-gram lemma filtering and banded alignment (op1)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import claim, ship_code

#: Characters of a q-gram; items too short for it have shorter ones.
Q = 6
#: Edits allowed for each character of an item.
RATE = 0.1
#: Normalized characters of texts that are searched at once; a longer text goes in overlapping windows.
BLOCK = 1 << 16
#: Characters of items that one index holds; more items make more indexes, searched one after another.
INDEX_CHARS = 1 << 22
#: Hits that are held at once before they are counted, and cells of an alignment that go together.
HITS, CELLS = 1 << 21, 1 << 20
#: Buckets of the first, rough count of a block's hits.
BUCKETS = 1 << 17

_FOLD_TO = 0x20000
_START = 32  # bits of a band's first place in an alignment's value
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _fold_table() -> np.ndarray:
    """Code point -> its lower case, 0 for what is neither letter nor digit; from U+20000 on they stay."""
    out = np.zeros(_FOLD_TO, np.uint32)
    for c in range(_FOLD_TO):
        if chr(c).isalnum():
            out[c] = ord(chr(c).lower()[0])
    return out


_fold = _fold_table()


def normalize(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points with one 0 for each run of other characters, none at the ends; and where each stood."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    f = np.where(c < _FOLD_TO, _fold[np.minimum(c, _FOLD_TO - 1)], c)
    solid = f != 0
    keep = solid.copy()
    keep[1:] |= solid[:-1]
    at = np.flatnonzero(keep)
    if len(at) and not solid[at[-1]]:
        at = at[:-1]
    return f[at], at


def codes(c: np.ndarray, q: int, step: int = 1) -> np.ndarray:
    """64-bit codes of the q-grams that begin at 0, step, 2 step and so on."""
    n = len(c) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros((n + step - 1) // step, np.uint64)
    for k in range(q):
        h = h * _BASE + c[k : k + n : step].astype(np.uint64) + np.uint64(1)
    h ^= h >> np.uint64(31)
    return h * _BASE


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0] .. first[0] + n[0] - 1, first[1] .. and so on."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def gram_size(m: int, edits: int, longest: int) -> int:
    """The longest q-gram, up to ``longest``, of which an item of m characters keeps a sample for sure; 0: none."""
    return next((q for q in range(longest, 0, -1) if (m - edits - q + 1) // q - edits >= 1), 0)


class Index:
    """Q-grams of items, with each item's edit budget and the hits that the lemma demands.

    An occurrence with e edits is at least m - e characters long and so holds
    floor((m - e - q + 1) / q) whole samples of the text, taken every q characters. Samples do not
    overlap, so an edit spoils one at most: that number less e hits lie in a band of e + 1 diagonals.
    """

    def __init__(self, text: list[np.ndarray], budget: list[int], q: int):
        self.q, self.text = q, text
        self.size = np.array([len(c) for c in text], np.int64)
        self.budget = np.array(budget, np.int64)
        self.need = (self.size - self.budget - q + 1) // q - self.budget
        self.need_all = self.size - q + 1 - q * self.budget  # of all q-grams, not only of samples
        self.shift = np.array([int(e).bit_length() for e in budget], np.int64)  # bands of 2 ** shift > e diagonals
        parts = [codes(c, q) for c in text]
        self.codes = h = np.concatenate(parts)
        self.begin = np.cumsum([0, *map(len, parts)])
        order = np.argsort(h, kind="stable")
        self.item = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])[order]
        self.place = np.concatenate([np.arange(len(p), dtype=np.int32) for p in parts])[order]
        self.gram, first = np.unique(h[order], return_index=True)
        self.first = first.astype(np.int32)
        self.count = np.diff(np.append(first, len(h))).astype(np.int32)
        self.slot_bits = 18
        self.slots = np.searchsorted(self.gram >> np.uint64(64 - self.slot_bits), np.arange((1 << self.slot_bits) + 1, dtype=np.uint64))
        self.deepest = int(np.diff(self.slots).max(initial=0))

    def found(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(gram, place in ``text``) of the samples that are in any item."""
        h = codes(text, self.q, self.q)
        slot = (h >> np.uint64(64 - self.slot_bits)).astype(np.int64)
        at, end = self.slots[slot], self.slots[slot + 1]
        live = np.flatnonzero(at < end)
        grams, where = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _ in range(self.deepest):
            if not len(live):
                break
            a = at[live]
            same = self.gram[a] == h[live]
            grams.append(a[same]), where.append(live[same])
            at[live] += 1
            live = live[~same]
            live = live[at[live] < end[live]]
        return np.concatenate(grams), np.concatenate(where) * self.q

    def regions(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, first diagonal) of the overlapping bands with enough hits, of 2 * 2 ** shift diagonals each.

        Only occupied bands are held. A text that repeats itself hits the same item place again and
        again: distinct places count.
        """
        gram, at = self.found(text)
        if not len(gram):
            return gram, at
        n = self.count[gram].astype(np.int64)
        part = np.searchsorted(np.cumsum(n), np.arange(HITS, int(n.sum()) + HITS, HITS), "right") + 1
        least = int(self.size.max())
        width = ((len(text) + least) >> int(self.shift.min())) + 3
        spans = list(zip([0, *part[:-1].tolist()], part.tolist()))

        def cells(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            g, few = gram[a:b], n[a:b]
            k = _ranges(self.first[g].astype(np.int64), few)
            item, p = self.item[k].astype(np.int64), self.place[k].astype(np.int64)
            return item * width + ((np.repeat(at[a:b], few) - p + least) >> self.shift[item]) + 1, p, item

        # all hits of a band and of those that share its bucket: too few even so in most
        kept = cells(*spans[0]) if len(spans) == 1 else None
        rough = np.zeros(BUCKETS, np.int64)
        for span in spans:
            rough += np.bincount((kept or cells(*span))[0] % BUCKETS, minlength=BUCKETS)
        cell, place = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for span in spans:
            c, p, item = kept or cells(*span)
            own, need = rough[c % BUCKETS], self.need[item]
            on = (own + rough[(c + 1) % BUCKETS] >= need) | (own + rough[(c - 1) % BUCKETS] >= need)
            cell, place = distinct_pairs(np.concatenate([cell, c[on]]), np.concatenate([place, p[on]]))
        if not len(cell):
            return cell, place
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        full, n = cell[first], np.diff(np.append(first, len(cell)))
        pair = np.sort(np.concatenate([full, full - 1]))  # a band and the next one, by the first of them
        pair = pair[np.append(True, pair[1:] != pair[:-1])]

        def held(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            k = np.minimum(np.searchsorted(full, cells), len(full) - 1)
            return first[k], np.where(full[k] == cells, n[k], 0)

        many = held(pair)[1] + held(pair + 1)[1] >= self.need[pair // width]
        pair = pair[many]
        who, where = [], []
        for cells in (pair, pair + 1):
            f, c = held(cells)
            who.append(np.repeat(np.arange(len(pair)), c)), where.append(place[_ranges(f, c)])
        who, _ = distinct_pairs(np.concatenate(who), np.concatenate(where))
        pair = pair[np.bincount(who, minlength=len(pair)) >= self.need[pair // width]]
        item = pair // width
        return self._all_shared(text, item, ((pair % width - 1) << self.shift[item]) - least)

    def _all_shared(self, text: np.ndarray, item: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The regions that also hold m - q + 1 - q e of all q-grams of the item."""
        low = np.maximum(diagonal, 0)
        high = np.minimum(diagonal + (2 << self.shift[item]) + self.size[item] + self.q, len(text))
        n = np.maximum(high - low, 0)
        keep = np.zeros(len(item), bool)
        part = np.unique(np.append(np.searchsorted(np.cumsum(n), np.arange(CELLS, int(n.sum()), CELLS), "right") + 1, len(item)))
        for a, b in zip([0, *part[:-1].tolist()], part.tolist()):
            who = np.repeat(np.arange(b - a), n[a:b])
            there = codes(text[_ranges(low[a:b], n[a:b])], self.q) if len(who) else np.zeros(0, np.uint64)
            inside = who[: len(there)] == who[len(who) - len(there) :]  # not across the border of two regions
            own = self.size[item[a:b]] - self.q + 1
            asks = np.repeat(np.arange(b - a), own)
            here = self.codes[_ranges(self.begin[item[a:b]], own)]
            # a code and its region in one number
            shared = np.isin(here + asks.astype(np.uint64) * _BASE, there[inside] + who[: len(there)][inside].astype(np.uint64) * _BASE)
            keep[a:b] = np.bincount(asks[shared], minlength=b - a) >= self.need_all[item[a:b]]
        return item[keep], diagonal[keep]

    def align(self, text: np.ndarray, item: np.ndarray, diagonal: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Least edits of each region's item inside text[low:high], on the band's diagonals and as many more as it has edits.

        Returns edits, start and end in ``text``. All regions go together, one step for each item
        character. A value is edits << 32 | offset of the start, so the least edits win, then the earliest start.
        """
        budget = self.budget[item]
        wide = int((2 << self.shift[item]).max() + 2 * budget.max()) + 1
        size, one = self.size[item], 1 << _START
        base = diagonal - budget  # text place of column 0 in row 0
        letters = np.zeros((len(item), int(size.max())), np.int64)
        for r, i in enumerate(item):
            letters[r, : size[r]] = self.text[i]
        column = np.arange(wide)
        place = base[:, None] + column[None, :]
        beyond = np.int64(1 << 60)
        row = np.where((place >= low[:, None]) & (place <= high[:, None]), column[None, :], beyond)
        done, padded = row.copy(), np.concatenate([text.astype(np.int64), [-1]])
        for i in range(letters.shape[1]):
            at = place + i
            inside = (at >= low[:, None]) & (at < high[:, None])
            letter = padded[np.where(inside, at, len(text))]
            stay = row + np.where(letter == letters[:, i : i + 1], 0, one)
            stay = np.where(inside, stay, beyond)
            drop = np.concatenate([row[:, 1:], np.full((len(row), 1), beyond)], 1) + one
            # stay: column k of row i + 1 ends behind text place at[k]; drop: the item's character has no partner
            new = np.minimum(stay, drop)
            new = np.minimum.accumulate(new - column * one, 1) + column * one
            row = np.minimum(new, beyond)
            ended = size == i + 1
            if ended.any():
                done[ended] = row[ended]
        best = done.argmin(1)
        value = done[np.arange(len(item)), best]
        return np.where(value >= beyond // 2, beyond, value >> _START), base + (value & (one - 1)), base + best + size

    def search(self, text: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(segment, item, edits, start, end) of occurrences in the segments of ``text`` that begin at ``starts``; places in the segment."""
        item, diagonal = self.regions(text)
        if not len(item):
            return
        # a band's occurrences may lie in several segments: those that it overlaps
        left = np.searchsorted(starts, np.maximum(diagonal - self.budget[item], 0), "right") - 1
        right = np.searchsorted(starts, np.minimum(diagonal + (2 << self.shift[item]) + self.size[item] + self.budget[item], len(text) - 1), "right") - 1
        n = right - left + 1
        which = np.repeat(np.arange(len(item)), n)
        seg = _ranges(left, n)
        order = np.argsort(self.size[item[which]], kind="stable")  # alike lengths together
        need = np.maximum(self.size, (2 << self.shift) + 2 * self.budget + 1)[item[which[order]]]
        c = 0
        while c < len(order):
            step = 1
            while step < 256 and c + step < len(order) and (step + 1) * need[c + step] <= CELLS:
                step += 1
            w, d = which[order[c : c + step]], seg[order[c : c + step]]
            i = item[w]
            edits, s, e = self.align(text, i, diagonal[w], starts[d], starts[d + 1] - 1)
            for k in np.flatnonzero(edits <= self.budget[i]):
                yield int(d[k]), int(i[k]), int(edits[k]), int(s[k] - starts[d[k]]), int(e[k] - starts[d[k]])
            c += step


class Exact:
    """Items of one length that may have no edit and are too short for samples: the whole item is its q-gram."""

    def __init__(self, text: list[np.ndarray], budget: list[int], q: int):
        self.q, self.text = q, np.array(text, np.uint32).reshape(-1, q)
        h = np.array([codes(c, q)[0] for c in text], np.uint64)
        self.order = np.argsort(h, kind="stable")
        self.gram = h[self.order]

    def search(self, text: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """The first occurrence of each item in each segment; the same columns as Index.search."""
        h = codes(text, self.q)
        first, last = (np.searchsorted(self.gram, h, side) for side in ("left", "right"))
        n = last - first
        at = np.repeat(np.arange(len(h)), n)
        item = self.order[_ranges(first, n)]
        seg = np.searchsorted(starts, at, "right") - 1
        _, one = np.unique(seg * len(self.order) + item, return_index=True)  # places ascend, so the first one stays
        for s, i, a in zip(seg[one].tolist(), item[one].tolist(), at[one].tolist()):
            if np.array_equal(text[a : a + self.q], self.text[i]):
                yield s, i, 0, a - int(starts[s]), a - int(starts[s]) + self.q


class Search:
    """Items by the q-gram that their length and budget allow, each with the whole budget of ``rate`` of its characters.

    Items without a letter or digit are nowhere. Items with no edit allowed and under 2 q - 1 characters
    are searched as they are.
    """

    def __init__(self, items: list[str | None], q: int = Q, rate: float = RATE):
        groups: dict[tuple[bool, int], tuple[list[int], list[np.ndarray], list[int]]] = {}
        self.reach = 0
        for number, text in enumerate(items):
            c, _ = normalize(text or "")
            edits = int(rate * len(c))
            if not len(c):
                continue
            exact = edits == 0 and len(c) < 2 * q - 1
            size = len(c) if exact else gram_size(len(c), edits, q)
            if not size:
                raise ValueError(f"at a rate of {rate} an item of {len(c)} characters keeps no sample for sure")
            for held, value in zip(groups.setdefault((exact, size), ([], [], [])), (number, c, edits)):
                held.append(value)
            self.reach = max(self.reach, len(c) + edits + 1)
        self.parts = [(numbers, (Exact if exact else Index)(text, budget, size)) for (exact, size), (numbers, text, budget) in sorted(groups.items(), key=lambda x: x[0])]

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text number, item number, edits, start, end) of the best occurrence of each item in each text.

        Short texts go together in blocks; a long one in windows that overlap by the longest occurrence.
        """
        if not self.parts:
            return
        block, total = [], 0
        for k, t in enumerate(texts):
            c, at = normalize(t)
            if total and total + len(c) >= BLOCK:
                yield from self._best(block)
                block, total = [], 0
            block.append((k, 0, c, at))
            total += len(c) + 1
        if block:
            yield from self._best(block)

    def _best(self, block: list[tuple]) -> Iterator[tuple[int, int, int, int, int]]:
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        size, step = len(block[0][2]), max(BLOCK, self.reach)
        if len(block) == 1 and size > step + self.reach:
            cuts = [[(0, a, block[0][2][a : a + step + self.reach])] for a in range(0, size - self.reach, step)]
        else:
            cuts = [[(n, 0, c) for n, (_, _, c, _) in enumerate(block)]]
        gap = np.array([0xFFFFFFFF], np.uint32)
        for cut in cuts:
            text = np.concatenate([x for _, _, c in cut for x in (c, gap)])
            starts = np.cumsum([0] + [len(c) + 1 for _, _, c in cut])
            for numbers, part in self.parts:
                for seg, i, edits, s, e in part.search(text, starts):
                    n, ahead, _ = cut[seg]
                    key, value = (n, numbers[i]), (edits, s + ahead, e + ahead)
                    if key not in best or value < best[key]:
                        best[key] = value
        for (n, i), (edits, s, e) in sorted(best.items()):
            place = block[n][3]
            e = max(e, s + 1)
            yield block[n][0], i, edits, int(place[s]), int(place[min(e, len(place)) - 1]) + 1


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple]]:
    """(id, text) of the items, in blocks of a bounded number of characters."""
    block, size = [], 0
    for r in benchmark.select(id_col, text_col).where(F.length(text_col) > 0).toLocalIterator():
        if block and size + len(r[1]) > INDEX_CHARS:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += len(r[1])
    if block:
        yield block


def _searcher(key: str, texts, q: int, rate: float) -> Search:
    """The search over a broadcast block of item texts, built once by each Python worker."""
    return claim(("decontam", key), lambda: Search(texts.value, q, rate))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", q: int = Q, rate: float = RATE) -> DataFrame:
    """(``id_col``, ``item_col``, edits, start, end) of every item that a text holds within its edit budget.

    Case, punctuation and white space do not count: they are folded away before edits are counted, and
    the budget is ``rate`` of the item's folded characters, whatever its length (under 10 of them: none).
    An item of a letter or two is so in nearly every text. start and end are code points of the text as
    given; of several occurrences in a text the one with the fewest edits, then the first, is told. Null
    and empty texts hold nothing; null items and those without letter or digit are nowhere; repeated rows
    are told each; empty tables give an empty result; ids are of any type; other columns are ignored.

    The items are the stated queries: they come to the driver in blocks of INDEX_CHARS, each block is sent
    to the executors, and all texts are read once for each block and not shuffled.
    """
    spark = docs.sparkSession
    ship_code(spark)
    kinds = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    item_kind = to_arrow_type(benchmark.schema[item_col].dataType)
    schema = f"`{id_col}` {kinds[0]}, `{item_col}` {kinds[1]}, edits int, start int, end int"

    def finder(ids, texts):
        key = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _searcher(key, texts, q, rate)
            for batch in batches:
                cols = list(zip(*index.search(batch.column(1).to_pylist()))) or [[]] * 5
                rows = batch.column(0).take(pa.array(cols[0], pa.int64()))
                items = pa.array([ids.value[i] for i in cols[1]], item_kind)
                yield pa.RecordBatch.from_arrays([rows, items, *[pa.array(c, pa.int32()) for c in cols[2:]]], names=[id_col, item_col, "edits", "start", "end"])

        return run

    whole = None
    for block in item_blocks(benchmark, item_col, item_text):
        sent = [spark.sparkContext.broadcast([r[k] for r in block]) for k in (0, 1)]
        part = docs.select(id_col, text_col).where(F.length(text_col) > 0).mapInArrow(finder(*sent), schema)
        whole = part if whole is None else whole.union(part)
    return whole if whole is not None else spark.createDataFrame([], schema)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", q: int = Q, rate: float = RATE) -> DataFrame:
    """The rows of ``docs`` whose text holds no item, with all their columns; nothing is shuffled."""
    spark = docs.sparkSession
    ship_code(spark)
    at = docs.columns.index(text_col)
    schema = docs.schema

    def cleaner(texts):
        key = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _searcher(key, texts, q, rate)
            for batch in batches:
                hit = np.zeros(batch.num_rows, bool)
                hit[[x[0] for x in index.search([t or "" for t in batch.column(at).to_pylist()])]] = True
                yield batch.filter(pa.array(~hit))

        return run

    for block in item_blocks(benchmark, item_col, item_text):
        docs = docs.mapInArrow(cleaner(spark.sparkContext.broadcast([r[1] for r in block])), schema)
    return docs
