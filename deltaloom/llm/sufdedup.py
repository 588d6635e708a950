"""Removal of long strings that occur more than once, by a hash-compared suffix sort.

All suffixes that could share `length` symbols are brought together and sorted by their first symbols. Symbols are bytes, or
hashes of words. Sorting every suffix of a corpus would move each text hundreds of times, so suffixes meet by anchors. Of the
k-grams inside a `length`-string, the one with the least hash (the leftmost of equals) depends on the string alone. So two
equal strings have equal anchors at the same offset, and a string can repeat only if its anchor's k-gram does.

1. Anchors: the starts that share an anchor form a window, `length` symbols from its first start to its last. What occurs
   again within one text is compared there, symbol by symbol, and only one of each window leaves the text.
2. Windows with one k-gram and one 128-bit digest are equal; they are counted, and stand for each other from here on.
3. Suffix sort: k-grams with several different windows send one of each. Within a k-gram and offset, suffixes are
   merge-sorted; a comparison finds the common extension by binary search over prefix polynomial hashes. Neighbours that
   share `length` symbols are repeats, after their symbols have been compared.
4. A k-gram with more than GROUP windows would be too much for one task. Its windows are split into ranges of starts, and
   those of a range meet by what all strings of the range have in common: a longer string than the k-gram. Steps 2 and 3
   then go on with the smaller groups, with ranges down to one start; windows that differ only outside a range
   become equal and are counted, so a passage that very many texts share leaves no large group.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm.common import drop_folder, hold, keep, ship, slices

LENGTH = 400
GRAM = 64
#: Windows of one key that are sorted in one task; those of a larger group are split into so many ranges of starts each.
GROUP, PARTS = 512, 8
#: Symbols that are sorted at once, and of a text that are hashed at once.
CHUNK = 1 << 20
SEGMENT = 2 << 20
KEPT_POWERS = 2 << 20
# Odd base of the polynomial hashes modulo 2^64, and the multiplier that mixes a hash before hashes are ordered.
BASE, MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9

_powers: dict[bool, object] = {}

# Scripts without blanks between words, in UTF-8: Thai and Lao, kana and Chinese characters.
_UNSPACED = rb"\xe0[\xb8-\xbb][\x80-\xbf]|\xe3[\x81-\xbf][\x80-\xbf]|[\xe4-\xe9][\x80-\xbf]{2}|\xf0[\xa0-\xbf][\x80-\xbf]{2}"
_unspaced = re.compile(_UNSPACED).search
_words = re.compile(rb"%s|(?:(?!%s)\S)+" % (_UNSPACED, _UNSPACED))


def word_edges(data: bytes):
    """Where words begin and end: what stands between blanks, or a character of a script that has none."""
    import numpy as np

    array = np.frombuffer(data, np.uint8)
    if not data.isascii() and array.max() >= 0xE0 and _unspaced(data):
        return tuple(np.array([m.span() for m in _words.finditer(data)], np.int64).reshape(-1, 2).T)
    blank = np.zeros(256, bool)
    blank[list(b" \t\n\r\x0b\x0c")] = True
    at = blank[array]
    edges = np.flatnonzero(at[1:] != at[:-1]) + 1
    edges = np.r_[[0] * (len(at) > 0 and not at[0]), edges, [len(at)] * (len(at) > 0 and not at[-1])].astype(np.int64)
    return edges[::2], edges[1::2]


def symbols(data: bytes, words: bool):
    """The bytes, or a 64-bit hash of each word: its polynomial hash and its length, mixed."""
    import numpy as np

    array = np.frombuffer(data, np.uint8)
    return _word_hashes(array, *word_edges(data)) if words else array


def _word_hashes(array, begin, end):
    import numpy as np

    out = np.empty(len(begin), np.uint64)
    for part in np.split(np.arange(len(begin)), np.flatnonzero(np.diff(begin // CHUNK)) + 1) if len(begin) else []:
        base, b, e = begin[part[0]], begin[part], end[part]
        prefix = prefix_hashes(array[base : e[-1]])
        h = (prefix[e - base] - prefix[b - base]) * powers(len(prefix), True)[b - base]
        out[part] = mixed(mixed(h) + (e - b).astype(np.uint64))
    return out


def symbols_of_many(texts: list[bytes], words: bool) -> list:
    """symbols of several texts; words are found in all of them at once, with a line feed between texts."""
    import numpy as np

    if not words or any(not t.isascii() and _unspaced(t) for t in texts):
        return [symbols(t, words) for t in texts]
    whole = b"\n".join(texts)
    ends = np.cumsum([len(t) + 1 for t in texts])[:-1]
    begin, end = word_edges(whole)
    return np.split(_word_hashes(np.frombuffer(whole, np.uint8), begin, end), np.searchsorted(begin, ends))


def word_spans(data: bytes, spans) -> list[tuple[int, int]]:
    """Spans of words as spans of data, from a first word's first byte to a last word's last."""
    if not spans:
        return []
    begin, end = word_edges(data)
    return [(int(begin[b]), int(end[e - 1])) for b, e in spans]


def merged(spans, touching: bool = True) -> list[list[int]]:
    """The union of (begin, end) spans as disjoint ones; those that only touch become one, or stay two."""
    out: list[list[int]] = []
    for b, e in sorted(spans):
        if out and (b <= out[-1][1] if touching else b < out[-1][1]):
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return out


def powers(n: int, inverse: bool = False):
    """BASE^0 ... BASE^(n - 1) modulo 2^64, or their inverses."""
    import numpy as np

    got = _powers.get(inverse)
    if got is None or len(got) < n:
        size = max(n, 1 << 17, 0 if got is None else 2 * len(got))
        got = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, pow(BASE, -1, 1 << 64) if inverse else BASE, np.uint64)])
        if size <= KEPT_POWERS:
            _powers[inverse] = got
    return got[:n]


def prefix_hashes(data):
    """P[i] = sum over j < i of (data[j] + 1) * BASE^j modulo 2^64."""
    import numpy as np

    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=out[1:])
    return out


def window_hashes(prefix, width: int):
    n = len(prefix) - width
    return (prefix[width:] - prefix[:n]) * powers(n, True)


def mixed(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(32))) * np.uint64(MIX)
    return h ^ (h >> np.uint64(29))


def digest(*parts) -> bytes:
    h = hashlib.blake2b(digest_size=16)
    for x in parts:
        h.update(x)
    return h.digest()


def anchors(data, length: int = LENGTH, gram: int = GRAM):
    """(first start, starts, shift, k-gram hash) arrays of the windows: every start of a `length`-string is in one.

    data: symbols. shift: where the anchor is, from the window's first start.
    """
    import numpy as np

    firsts, counts, shifts, grams = [], [], [], []
    for begin in range(0, max(0, len(data) - length + 1), SEGMENT - length + 1):
        part = data[begin : begin + SEGMENT]
        if len(part) < length:
            continue
        h, least = _anchored(part, length, gram)
        first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        firsts.append(first + begin)
        counts.append(np.diff(np.r_[first, len(least)]))
        shifts.append(least[first] - first)
        grams.append(h[least[first]].view(np.int64))
    if not firsts:
        return (np.zeros(0, np.int64),) * 4
    return tuple(map(np.concatenate, (firsts, counts, shifts, grams)))


def _anchored(part, length: int, gram: int):
    """The mixed hashes of all k-grams, and where the anchor of each `length`-string is: the least k-gram, leftmost of equals."""
    import numpy as np

    wide, n = length - gram + 1, len(part) - length + 1
    h = mixed(window_hashes(prefix_hashes(part), gram))
    at = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
    rows = -(-len(at) // wide)
    grid = np.full(rows * wide, np.iinfo(np.uint64).max)
    grid[: len(at)] = at
    grid = grid.reshape(rows, wide)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return h, (np.minimum(back[:n], ahead[wide - 1 : wide - 1 + n]) & np.uint64(0xFFFFFF)).astype(np.int64)


def windows_of(data, length: int, gram: int):
    """The different windows of one text and what repeats within it: (first, starts, shift, gram, digests, many), and spans.

    many: the window occurs again in the text. Its later places have been compared with the first and are among the spans.
    """
    return _different(*anchors(data, length, gram), data, length)


def _digests(data, first, starts, length: int):
    import numpy as np

    view, size = memoryview(data.tobytes()), data.itemsize
    cut = [view[a * size : b * size] for a, b in zip(first.tolist(), (first + starts - 1 + length).tolist())]
    return cut, np.frombuffer(b"".join([hashlib.blake2b(c, digest_size=16).digest() for c in cut]), "<i8").reshape(-1, 2)


def _different(first, starts, shift, grams, data, length: int):
    import numpy as np

    cut, digests = _digests(data, first, starts, length)
    if len(set(digests[:, 0].tolist())) == len(first):
        return first, starts, shift, grams, digests, np.zeros(len(first), bool), []
    seen: dict[bytes, int] = {}
    stays, many, spans = [], [], []
    for k, d in enumerate(map(bytes, digests)):
        j = seen.setdefault(d, k)
        if j == k:
            stays.append(k)
        elif cut[j] == cut[k]:
            spans += [(int(first[i]), int(first[i] + starts[i]) - 1 + length) for i in (j, k)]
            many.append(j)
        else:  # two windows with one digest: both stay
            stays.append(k)
    many = np.isin(stays, many)
    return *(x[stays] for x in (first, starts, shift, grams, digests)), many, merged(spans, False)


def windows_of_many(texts, length: int, gram: int):
    """windows_of for several short texts at once, as one table: (text, first, starts, shift, gram, digests, many), and spans.

    texts: arrays of symbols. The texts lie end to end; windows across an end are left out. spans: (text, begin, end).
    """
    import numpy as np

    data, sizes = np.concatenate(texts), np.array([len(t) for t in texts])
    base = np.cumsum(sizes) - sizes
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none, none.reshape(0, 2), none > 0, []
    h, least = _anchored(data, length, gram)
    text = np.repeat(np.arange(len(texts)), sizes)[: len(least)]
    valid = np.flatnonzero(np.arange(len(least)) + length <= (base + sizes)[text])
    least, text = least[valid], text[valid]
    new = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (text[1:] != text[:-1])]) if len(valid) else none
    first, text, starts = valid[new], text[new], np.diff(np.r_[new, len(valid)]) if len(new) else none
    shift, grams = least[new] - first, h[least[new]].view(np.int64)
    _, digests = _digests(data, first, starts, length)
    many, spans, stays = np.zeros(len(first), bool), [], np.ones(len(first), bool)
    order = np.lexsort((digests[:, 0], text))
    again = order[1:][(digests[order[1:], 0] == digests[order[:-1], 0]) & (text[order[1:]] == text[order[:-1]])]
    for t in np.unique(text[again]).tolist():  # texts that repeat something within themselves
        at = np.flatnonzero(text == t)
        own = first[at] - base[t]
        kept, *_, twice, inner = _different(own, starts[at], shift[at], grams[at], texts[t], length)
        stays[at] = np.isin(own, kept)
        many[at[stays[at]]] = twice
        spans += [(t, b, e) for b, e in inner]
    return *(x[stays] for x in (text, first - base[text], starts, shift, grams, digests, many)), spans


def sort_suffixes(buffer, segment, start, length: int):
    """Merge-sort of suffixes within segments (numbers, ascending): the order, and whether each equals the one before it.

    buffer: symbols, `length` of them from each start. Runs are merged by ranking each suffix in its neighbour run.
    A comparison is O(log length): the longest common prefix comes from binary search over prefix hashes.
    """
    import numpy as np

    prefix, inverse = prefix_hashes(buffer), powers(len(buffer) + 1, True)
    n = len(start)

    def value(at, width):
        return (prefix[at + width] - prefix[at]) * inverse[at]

    whole = value(start, length)

    def less(x, y, or_equal):
        """Whether suffix x comes before y."""
        out = np.zeros(len(x), bool)
        open_ = np.flatnonzero(whole[x] != whole[y])
        out[:] = or_equal
        p, q = start[x[open_]], start[y[open_]]
        lo, hi = np.zeros(len(open_), np.int64), np.full(len(open_), length)
        while (live := hi - lo > 1).any():  # equal for lo bytes, different for hi
            mid = (lo + hi) >> 1
            same = value(p, mid) == value(q, mid)
            lo, hi = np.where(live & same, mid, lo), np.where(live & ~same, mid, hi)
        out[open_] = buffer[p + lo] < buffer[q + lo]
        return out

    bounds = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
    sizes = np.diff(np.r_[bounds, n])
    base, size = np.repeat(bounds, sizes), np.repeat(sizes, sizes)
    order, index = np.arange(n), np.arange(n)
    width = 1
    while width < size.max(initial=0):
        own = index - base
        run = own // width
        sibling = run ^ 1
        lo = base + sibling * width
        top = np.minimum(base + size, lo + width)
        live = np.flatnonzero(lo < base + size)
        low, high = lo[live].copy(), top[live].copy()
        right = (sibling[live] < run[live])  # the sibling stands before: equal ones of it come first
        x = order[live]
        while (at := np.flatnonzero(low < high)).size:
            mid = (low[at] + high[at]) >> 1
            before = less(order[mid], x[at], right[at])
            low[at[before]] = mid[before] + 1
            high[at[~before]] = mid[~before]
        place = index.copy()
        place[live] = base[live] + np.minimum(run[live], sibling[live]) * width + (own[live] - run[live] * width) + (low - lo[live])
        moved = np.empty(n, np.int64)
        moved[place] = order
        order, width = moved, 2 * width
    same = np.zeros(n, bool)
    pair = np.flatnonzero((segment[order][1:] == segment[order][:-1]) & (whole[order[1:]] == whole[order[:-1]])) + 1
    wrong = []
    view = np.lib.stride_tricks.sliding_window_view(buffer, length) if len(buffer) >= length else None
    for k in range(0, len(pair), 4096):
        at = pair[k : k + 4096]
        equal = (view[start[order[at]]] == view[start[order[at - 1]]]).all(1)
        same[at] = equal
        wrong += at[~equal].tolist()
    for seg in {int(segment[order[k]]) for k in wrong}:  # two strings with one hash: this segment is sorted by its symbols
        at = np.flatnonzero(segment == seg)
        rows = sorted(at.tolist(), key=lambda i: (buffer[start[i] : start[i] + length].tolist(), i))
        order[at] = rows
        same[at] = [False, *((buffer[start[a] : start[a] + length] == buffer[start[b] : start[b] + length]).all() for a, b in zip(rows, rows[1:]))]
    return order, same


def runs_of(starts):
    """Ascending starts as (first, last) of each gapless run."""
    import numpy as np

    cut = np.flatnonzero(np.diff(starts) != 1)
    return zip(starts[np.r_[0, cut + 1]].tolist(), starts[np.r_[cut, len(starts) - 1]].tolist())


#: A window: what it meets others by, its digest, its text, its place there, where its anchor is, and whether it is known to occur twice.
ITEM = "key long, d0 long, d1 long, tid binary, at long, first long, starts long, shift long, many boolean"
NAMES = [x.split()[0] for x in ITEM.split(", ")]
SENT = "key long, tid binary, first long, starts long, shift long, many boolean, hot boolean, data binary"


def _table(rows, names: str):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [x.split() for x in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], [n for n, _ in fields])


def _tid(text) -> F.Column:
    return F.unhex(F.md5(F.encode(text, "UTF-8")))


def _anchor_table(docs: DataFrame, length: int, gram: int, words: bool) -> DataFrame:
    """The windows of each row's text; a row without a key has a span that is known to repeat, as first and starts."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        hold("powers", _powers.clear)

        def table(tids, text, first, starts, shift, key, digests, many, spans):
            t, b, e = np.array(spans, np.int64).reshape(-1, 3).T
            none, bare = np.zeros(len(b), np.int64), np.arange(len(first) + len(b)) >= len(first)
            tid = pa.array(tids, pa.binary()).take(pa.array(np.r_[text, t]))
            longs = (np.r_[digests[:, 0], none], np.r_[digests[:, 1], none], np.zeros(len(bare), np.int64), np.r_[first, b], np.r_[starts, e - b - length + 1], np.r_[shift, none])
            d0, d1, at, *rest = map(pa.array, longs)
            return pa.RecordBatch.from_arrays([pa.array(np.r_[key, none], mask=bare), d0, d1, tid, at, *rest, pa.array(np.r_[many, none > 0])], NAMES)

        def several(data):
            arrays = symbols_of_many(data, words)
            long = [k for k, a in enumerate(arrays) if len(a) >= length] or [0]
            return table([hashlib.md5(data[k]).digest() for k in long], *windows_of_many([arrays[k] for k in long], length, gram))

        for batch in batches:
            held: list[bytes] = []
            size = 0
            for i in range(batch.num_rows):
                text = batch.column("text")[i].as_py()
                if text is None or (not words and len(text) * 4 < length):
                    continue
                data = text.encode()
                if len(data) > CHUNK:
                    *cols, spans = windows_of(symbols(data, words), length, gram)
                    yield table([hashlib.md5(data).digest()], np.zeros(len(cols[0]), np.int64), *cols, [(0, b, e) for b, e in spans])
                    continue
                held.append(data)
                size += len(data)
                if size > CHUNK // 2:
                    yield several(held)
                    held, size = [], 0
            if held:
                yield several(held)

    return docs.select("text").mapInArrow(run, ITEM)


def _ranges(hot: DataFrame, length: int, width: int, words: bool) -> DataFrame:
    """The windows of large groups cut into ranges of `width` starts by their distance to the anchor."""

    def run(batches):
        import numpy as np

        size = 8 if words else 1
        for batch in batches:
            rows = []
            for key, tid, first, starts, shift, many, _, data in zip(*(c.to_pylist() for c in batch.columns)):
                data = memoryview(data)
                for j in range(max(0, shift - starts + 1) // width, shift // width + 1):
                    s0, s1 = j * width, (j + 1) * width  # starts s0 to s1 - 1 before the anchor
                    i0, i1 = max(0, shift - s1 + 1), min(shift - s0, starts - 1)
                    common = data[(shift - s0) * size : (shift - s1 + 1 + length) * size]
                    new = np.frombuffer(digest(common, f"{key} {j}".encode()), "<i8")[0]
                    d = np.frombuffer(digest(data[i0 * size : (i1 + length) * size], f"{shift - i0}".encode()), "<i8")
                    rows.append((int(new), int(d[0]), int(d[1]), tid, first, first + i0, i1 - i0 + 1, shift - i0, many))
                if len(rows) > 20_000:
                    yield _table(rows, ITEM)
                    rows = []
            if rows:
                yield _table(rows, ITEM)

    return hot.mapInArrow(run, ITEM)


def _send(wanted: DataFrame, length: int, words: bool, texts: bool) -> DataFrame:
    """wanted: a source's (tid, at, data, wanted) rows; gives the wanted windows with their symbols. texts: data is a text."""

    def run(batches):
        hold("powers", _powers.clear)
        size = 8 if words else 1
        for batch in batches:
            rows, held = [], 0
            for i in range(batch.num_rows):
                tid, at, data = (batch.column(c)[i].as_py() for c in ("tid", "at", "data"))
                data = symbols(data.encode(), words).tobytes() if texts else data
                for w in batch.column("wanted")[i].as_py():
                    piece = data[(w["first"] - at) * size : (w["first"] - at + w["starts"] - 1 + length) * size]
                    rows.append((w["key"], tid, w["first"], w["starts"], w["shift"], w["many"], w["hot"], piece))
                    held += len(piece)
                    if held > 8 << 20:
                        yield _table(rows, SENT)
                        rows, held = [], 0
            if rows:
                yield _table(rows, SENT)

    return wanted.select("tid", "at", "data", "wanted").mapInArrow(run, SENT)


def _sorted_repeats(spark: SparkSession, sent: DataFrame, length: int, words: bool) -> DataFrame:
    """The spans (tid, begin, end) of the windows in `sent` that occur once, by the suffix sort of each key's windows."""
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        import numpy as np

        hold("powers", _powers.clear)

        def solve(rows):
            key, tid, first, starts, shift, many, data = (list(x) for x in zip(*rows))
            buffer = np.frombuffer(b"".join(data), "<u8" if words else np.uint8)
            begin = np.cumsum([0, *(len(d) // buffer.itemsize for d in data)])[:-1]
            count = np.array(starts)
            window = np.repeat(np.arange(len(rows)), count)
            inner = np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count)
            group = np.unique(np.array(key), return_inverse=True)[1]
            # within a key, equal strings have their anchor at the same offset
            segment = group[window] * (1 << 20) + (np.array(shift)[window] - inner)
            by = np.argsort(segment, kind="stable")
            segment, window, inner = segment[by], window[by], inner[by]
            order, same = sort_suffixes(buffer, segment, begin[window] + inner, length)
            twice = np.zeros(len(order), bool)
            twice[order] = same | np.r_[same[1:], False]
            twice &= ~np.array(many, bool)[window]
            out = []
            hit = np.flatnonzero(twice)
            hit = hit[np.lexsort((inner[hit], window[hit]))]
            for part in np.split(hit, np.flatnonzero(np.diff(window[hit])) + 1) if len(hit) else []:
                k = int(window[part[0]])
                out += [(tid[k], first[k] + a, first[k] + b + length) for a, b in runs_of(inner[part])]
            return out

        rows, held = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held > CHUNK and rows[-1][0] != row[0]:
                    if spans := solve(rows):
                        yield _table(spans, SPAN)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[-1]) // (8 if words else 1)
        if rows and (spans := solve(rows)):
            yield _table(spans, SPAN)

    sent = sent.select("key", "tid", "first", "starts", "shift", "many", "data")
    return sent.repartition(n, "key").sortWithinPartitions("key", "tid", "first").mapInArrow(run, SPAN)


SPAN = "tid binary, begin long, end long"


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, words: bool = False, group: int | None = None) -> DataFrame:
    """(tid, spans): for each distinct text, by the MD5 of its bytes, its (begin, end) spans that repeats cover; unmerged.

    words: symbols are words instead of bytes; length, gram and the spans are in symbols. The result is a written table.
    """
    group = GROUP if group is None else group
    spark, folders = docs.sparkSession, []
    ship(spark)

    def kept(df: DataFrame, tag: str) -> DataFrame:
        out, path = keep(spark, df, tag)
        folders.append(path)
        return out

    span = lambda: [F.col("first").alias("begin"), (F.col("first") + F.col("starts") - 1 + length).alias("end")]
    items = kept(_anchor_table(docs, length, gram, words), "anchors")
    found = [items.where("key is null").select("tid", *span())]
    items, source, width = items.where("key is not null"), None, length - gram + 1
    while True:
        one = F.min(F.struct("tid", "at", "first", "starts", "shift"))
        classes = items.groupBy("key", "d0", "d1").agg(F.count("*").alias("n"), F.max("many").alias("many"), one.alias("one"))
        classes = kept(classes, "windows")
        twice = classes.where("n > 1").select("key", "d0", "d1")
        found.append(items.where("not many").join(twice, ["key", "d0", "d1"]).select("tid", *span()))
        kinds = classes.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1")
        hot = (F.col("kinds") > group) if width > 1 else F.lit(False)
        open_ = classes.join(kinds, "key").select("one.tid", "one.at", F.struct("key", "one.first", "one.starts", "one.shift", (F.col("many") | (F.col("n") > 1)).alias("many"), hot.alias("hot")).alias("w"))
        wanted = open_.groupBy("tid", "at").agg(F.collect_list("w").alias("wanted"))
        if source is None:
            rows = docs.select(_tid("text").alias("tid"), F.col("text").alias("data")).join(wanted, "tid").dropDuplicates(["tid"])
        else:
            rows = source.select("tid", F.col("first").alias("at"), "data").join(wanted, ["tid", "at"])
        sent = kept(_send(rows, length, words, source is None), "sent")
        found.append(_sorted_repeats(spark, sent.where("not hot"), length, words))
        source = sent.where("hot")
        if source.isEmpty():
            break
        width = -(-width // PARTS)
        items = kept(_ranges(source, length, width, words), "ranges")
    spans = found[0]
    for more in found[1:]:
        spans = spans.unionAll(more)
    out, _ = keep(spark, spans.groupBy("tid").agg(F.collect_set(F.struct("begin", "end")).alias("spans")), "spans")
    for path in folders:
        drop_folder(spark, path)
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, decode: bool = False, words: int | None = None, passages: int | None = None, group: int | None = None) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept (binary: the bytes that stay, in order).

    decode: instead of kept, text itself becomes the bytes that stay, without half characters at a cut (null: empty).
    words: strings are so many whole words instead, whatever blanks stand between them; length and gram are not used.
    passages: also n_passages, the maximal runs of so many words or more that occur again, and rest, the text without them.

    Removed is each byte covered by a `length`-byte string that also starts anywhere else, in the same text included;
    overlaps count, and strings are judged on the input. Strings never cross documents. A null text counts as empty.
    Every row of a repeated text is judged, whatever its doc_id: copies of `length` bytes or more lose all bytes. Shorter
    texts lose none. All columns of docs are kept; where one has the name of a new column, the new one replaces it. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    new = {"n_bytes", "n_removed", "n_spans", "kept", "tid__", "spans__", "runs__"} | ({"n_passages", "rest"} if passages else set())
    names = [c for c in docs.columns if c.lower() not in new]

    def spans(many: int | None, column: str) -> DataFrame:
        got = repeated_spans(docs, many, max(1, many * 4 // 25), True, group) if many else repeated_spans(docs, length, gram, False, group)
        return got.select(F.col("tid").alias("tid__"), F.col("spans").alias(column))

    rows = docs.select(*names, _tid(F.coalesce("text", F.lit(""))).alias("tid__")).join(spans(words, "spans__"), "tid__", "left")
    if passages:
        rows = rows.join(spans(passages, "runs__"), "tid__", "left")

    def without(data: bytes, gone) -> bytes:
        edges = [0, *(x for g in gone for x in g), len(data)]
        return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))

    def cut(batches):
        import pyarrow as pa

        hold("powers", _powers.clear)
        for batch in (part for whole in batches for part in slices(whole)):
            size, removed, count, kept, runs, rest = [], [], [], [], [], []
            for i in range(batch.num_rows):
                data = (batch.column("text")[i].as_py() or "").encode()
                at = lambda c: [(s["begin"], s["end"]) for s in batch.column(c)[i].as_py() or ()]  # noqa: B023, E731
                gone = merged(at("spans__") if words is None else word_spans(data, merged(at("spans__"), False)))
                size.append(len(data))
                removed.append(sum(e - b for b, e in gone))
                count.append(len(gone))
                kept.append(without(data, gone).decode("utf-8", "ignore") if decode else without(data, gone))
                if passages:
                    gone = merged(word_spans(data, merged(at("runs__"), False)))
                    runs.append(len(gone))
                    rest.append(without(data, gone).decode())
            cols = {c: batch.column(c) for c in names} | {"n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(count, pa.int64())}
            cols |= {"text": pa.array(kept, pa.string())} if decode else {"kept": pa.array(kept, pa.binary())}
            if passages:
                cols |= {"n_passages": pa.array(runs, pa.int64()), "rest": pa.array(rest, pa.string())}
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema) + ", n_bytes long, n_removed long, n_spans long"
    return rows.drop("tid__").mapInArrow(cut, kind + ("" if decode else ", kept binary") + (", n_passages long, rest string" if passages else ""))
