"""Substring dedup by prefix-partitioned suffix trees over words.

A suffix starts at every word with at least `length` words after it (itself included); a repeated window of `length`
words is an internal node of the suffix tree at that depth or deeper. The trees are built in groups:

1. Sieve. In every window, the k-gram with the smallest hash, its anchor, stands for it; equal windows choose the same
   k-gram at the same place. Only windows whose anchor occurs elsewhere can have company below depth `length`; all
   others are leaves under shallow nodes and go no further (repeats.py finds the k-grams). The sieve loses no repeat.
2. Variable-length prefixes. The windows of one anchor follow each other; they travel as one stretch of words, each word
   once, as the suffix that starts at the anchor with the words left of it that its windows need. A stretch's group is
   named by the k words from its anchor on. Where more than `group_rows` anchors have that prefix, `length` words name
   the group and each window travels by itself, so that groups stay fit for memory. Stretches that repeat in one map
   task, word by word, are joined there and only one of them travels on, so a passage of a third of the documents
   doesn't fill a task.
3. Each task puts its groups' suffixes in the order of their words and takes the common prefixes of neighbours: those of
   at least `length` words are the deep internal nodes, and a node reaches deeper where `length` + 1 words agree.

Words are compared, not paths' hashes: a word is WIDTH bytes of its 64-bit hash, so two windows are taken as equal
wrongly only if every word in which they differ has the same WIDTH bytes, a chance of 2 ** -40 for windows that differ in
one word. The nodes' windows cover the words to remove. A maximal repeat (span) is a run of words in a text of which each
`length` + 1 in a row occur elsewhere too, or `length` words alone, and that can't be made longer; where a passage follows
another one, their spans are two. Windows are judged on the input. Words are runs of bytes other than 0x20 and 0x09-0x0D,
unchanged.

Null and empty texts have no words. Copies of a row count as occurrences of each other. Extra columns are ignored; an
empty table gives an empty result. Rows are told apart by a 64-bit hash of id and text. Broadcast: the prefixes of more
than group_rows anchors, at most MOST_OFTEN (beyond that, group_rows grows instead).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, cut, lean, mix, raw_column, runs, spread, table, word_hashes
from .repeats import n_buckets, packed, receive, send, unpacked

#: bytes of a word's name; prefixes that may be broadcast; windows put in order at once, about
WIDTH, MOST_OFTEN, AT_ONCE = 5, 1_000_000, 100_000


def _lowest(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w consecutive values, by doubling."""
    out, span = x, 1
    while span * 2 <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(out) - (w - span)], out[w - span :]) if w > span else out


class Windows:
    """All windows of some texts: where each starts (among the words of all texts) and which text it is of."""

    def __init__(self, texts: list[bytes], length: int, k: int):
        self.words, self.counts = word_hashes(texts, lower=False)
        self.length, self.k = length, k
        self.ends = np.cumsum(self.counts)
        self.first = self.ends - self.counts
        n = np.maximum(self.counts - length + 1, 0)
        self.of = np.repeat(np.arange(len(texts)), n)
        self.at = spread(self.first, n)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """For each window, the place of its chosen k-gram, and the hashes of all k-grams."""
        grams = runs(self.words, self.k, seed=1)
        if not len(self.at):
            return self.at, grams
        # hash and place in one value: of equal k-grams of a window, the first one
        w = self.length - self.k + 1
        low = _lowest((grams >> np.uint64(40)) << np.uint64(40) | np.arange(len(grams), dtype=np.uint64), w)
        return (low[self.at] & np.uint64((1 << 40) - 1)).astype(np.int64), grams

    def stretches(self, live: np.ndarray, often: np.ndarray):
        """Of the windows whose anchor is live (by place): text; first window's place in it << 16 | number of windows << 1 |
        whether a word follows; the group's name; the names of the words as bytes, the word that follows included."""
        at, grams = self.anchors()
        keep = np.flatnonzero(live[at])
        at, start, of = at[keep], self.at[keep], self.of[keep]
        many = np.isin(grams[at], often)
        new = many.copy()  # such a window is a stretch by itself
        if len(at):
            new[0] = True
            new[1:] |= (at[1:] != at[:-1]) | many[:-1]
        edges = np.flatnonzero(new)
        n = np.diff(edges, append=len(at))
        start, of, home = start[edges], of[edges], grams[at[edges]]
        if many.any():
            alone = many[edges]
            home[alone] = runs(self.words, self.length, seed=3)[start[alone]]
        lens = np.minimum(n + self.length, self.ends[of] - start)
        names = self.words[spread(start, lens)].astype(">u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()
        stops = np.cumsum(lens) * WIDTH
        strings = [names[a:b] for a, b in zip((stops - lens * WIDTH).tolist(), stops.tolist(), strict=True)]
        place = (start - self.first[of]).astype(np.uint64)
        return of, (place << np.uint64(16)) | (n.astype(np.uint64) << np.uint64(1)) | (lens == n + self.length).astype(np.uint64), mix(home), strings


def _sizes(where: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """How many windows and how many words stretches have."""
    n = ((where & np.uint64(0xFFFF)) >> np.uint64(1)).astype(np.int64)
    return n, n + (length - 1) + (where & np.uint64(1)).astype(np.int64)


def repeated(own: np.ndarray, where: np.ndarray, more: np.ndarray, strings: list[bytes], length: int, at_once: int = AT_ONCE) -> tuple[np.ndarray, np.ndarray]:
    """The runs of windows that occur more than once: text, and place << 16 | windows << 1 | whether the run goes on, that is,
    its words and the next one occur elsewhere too.

    where: place << 16 | windows << 1 | whether the stretch has a word after its last window; more: how many equal
    stretches stayed behind. Suffixes are put in the order of their words; neighbours' common prefixes are the internal nodes.
    """
    if not len(own):
        return own, where
    n, sizes = _sizes(where, length)
    sizes *= WIDTH
    flat = np.frombuffer(b"".join(strings) + b"\0" * WIDTH, dtype=np.uint8)
    offset = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(n)), n)
    start = spread(np.zeros(len(n), dtype=np.int64), n)
    at = offset[of] + start * WIDTH
    longer = (start + length) * WIDTH < sizes[of]  # whether the text has a word after the window
    depth = np.where(more[of] > 0, length + longer, 0)
    wide = (length + 1) * WIDTH
    view = np.lib.stride_tricks.sliding_window_view(flat, wide)
    # groups differ in their words, and so do the parts taken at once: by the first bytes
    lead = flat[at].astype(np.int64) << 8 | flat[at + 1]
    order = np.argsort(lead, kind="stable")
    stops = np.cumsum(np.bincount(lead))
    part_of = stops // at_once
    edges = stops[np.flatnonzero(np.diff(part_of, append=-1))]
    for a, b in zip([0, *edges[:-1].tolist()], edges.tolist(), strict=True):
        mine = order[a:b]
        if len(mine) < 2:
            continue
        suffix = view[at[mine]]
        suffix[~longer[mine], -WIDTH:] = 0
        turn = np.argsort(suffix.view(f"S{wide}").ravel(), kind="stable")
        mine, suffix = mine[turn], suffix[turn].reshape(-1, length + 1, WIDTH)
        same = (suffix[1:] == suffix[:-1]).all(2)
        common = np.where(same.all(1), length + 1, same.argmin(1))
        # the end of a text isn't a word that two suffixes share
        common -= (common > length) & ~(longer[mine[1:]] & longer[mine[:-1]])
        np.maximum.at(depth, mine[1:], common)
        np.maximum.at(depth, mine[:-1], common)
    hit = depth >= length
    new = hit.copy()
    new[1:] &= (depth[:-1] <= length) | (of[1:] != of[:-1])
    run, inside = np.flatnonzero(new), np.cumsum(new)
    many = np.bincount(inside[hit] - 1, minlength=len(run))
    last = run + many - 1
    place = (where >> np.uint64(16)).astype(np.int64)[of[run]] + start[run]
    return own[of[run]], (place.astype(np.uint64) << np.uint64(16)) | (many.astype(np.uint64) << np.uint64(1)) | (depth[last] > length).astype(np.uint64)


def _with_key(docs: DataFrame, doc_id: str, text: str, carry: bool) -> DataFrame:
    """id, text, key of each row and, if asked for, all other columns as one."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (doc_id, text)]
    own = [F.col(doc_id).alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(doc_id).cast("string"), F.col(text)).alias("key")]
    return docs.select(*own, *([F.struct(*rest).alias("row")] if carry and rest else []))


def _by_bucket(to: np.ndarray):
    """(bucket, places of its entries) of each bucket."""
    order = np.argsort(to, kind="stable")
    edges = np.flatnonzero(np.diff(to[order], prepend=-1)).tolist()
    for a, b in zip(edges, [*edges[1:], len(to)][: len(edges)], strict=True):
        yield int(to[order[a]]), order[a:b]


def _table(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(*x) for x in columns.values()], list(columns))


def _to_texts(own: np.ndarray, extra: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Entries dealt out by text, packed."""
    out = [(k, packed(own[at], extra[at])) for k, at in _by_bucket((own % np.uint64(buckets)).astype(np.int64))]
    return _table(bucket=([x[0] for x in out], pa.int32()), entries=([x[1] for x in out], pa.binary()))


def _gathered(rows: DataFrame, partitions: int) -> DataFrame:
    """key, places: what was dealt out by text, one row for each text, sorted and distinct."""

    def by_text(batches):
        lean()
        held = [unpacked(e, 2) for batch in batches for e in batch.column("entries").to_pylist() if e]
        if held:
            own, extra = np.concatenate(held, axis=1)
            order = np.lexsort((extra, own))
            own, extra = own[order], extra[order]
            new = np.concatenate([[True], (own[1:] != own[:-1]) | (extra[1:] != extra[:-1])])
            own, extra = own[new], extra[new].astype("<u8")
            edges = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            ends = np.append(edges[1:], len(own))
            for i in range(0, len(edges), 10_000):
                a, b = edges[i : i + 10_000], ends[i : i + 10_000]
                yield _table(key=(own[a].view(np.int64),), places=([extra[x:y].tobytes() for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.binary()))

    return rows.select("bucket", "entries").repartition(partitions, "bucket").mapInArrow(by_text, "key bigint, places binary")


def live_anchors(docs: DataFrame, length: int, k: int, group_rows: int) -> tuple[DataFrame, np.ndarray]:
    """key, places (64-bit) of the anchors of each row that occur elsewhere too; the k-grams of more than group_rows anchors."""
    partitions, buckets = n_buckets(docs)

    def chosen(big, _):
        for batch in by_bytes(big, "text"):
            w = Windows(raw_column(batch, "text"), length, k)
            at, grams = w.anchors()
            new = np.flatnonzero(np.diff(at, prepend=-1))
            at, of = at[new], w.of[new]
            yield grams[at], batch.column("key").to_numpy().view(np.uint64)[of], (at - w.first[of]).astype(np.uint64)

    def finish(key, own, extra):
        batch = _to_texts(own, extra, 2 * partitions)
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], ["bucket", "entries", "often", "total"])

    def often(key, count):
        many = count > group_rows
        yield _table(bucket=([0], pa.int32()), entries=([None], pa.binary()), often=([packed(key[many], count[many]) if many.any() else None], pa.binary()), total=([int(count.sum())], pa.int64()))

    found = cut(receive(send(docs.select("key", "text"), chosen, buckets, by_id=False), partitions, finish, "bucket int, entries binary, often binary, total bigint", by_id=False, often=often))
    # sums over tasks; at most total / least prefixes have more than `least` anchors
    least = max(group_rows, (found.agg(F.sum("total")).first()[0] or 0) // MOST_OFTEN)

    def largest(batches):
        for batch in batches:
            out = [key[count > least].tobytes() for key, count in (unpacked(x, 2) for x in batch.column("often").to_pylist())]
            yield _table(often=(out, pa.binary()))

    names = [np.frombuffer(r["often"], dtype="<u8") for r in found.filter("often is not null").select("often").mapInArrow(largest, "often binary").toLocalIterator()]
    return _gathered(found.filter("entries is not null"), partitions), np.unique(np.concatenate([*names, np.zeros(0, dtype=np.uint64)]))


def repeated_windows(docs: DataFrame, length: int, k: int, group_rows: int) -> DataFrame:
    """key, places (64-bit: first window << 16 | windows << 1 | whether the run goes on) of the repeated windows of each
    row. docs: id, text, key."""
    partitions, buckets = n_buckets(docs)
    anchors, often = live_anchors(docs, length, k, group_rows)
    many = docs.sparkSession.sparkContext.broadcast(often)
    # all columns, as in the join that follows: so both read one exchange of the texts
    left = docs.join(anchors, "key").select(*docs.columns, "places")
    row = "bucket int, entries binary, strings binary, known binary"

    def as_rows(batch) -> pa.RecordBatch:
        return _table(bucket=([x[0] for x in batch], pa.int32()), **{c: ([x[i + 1] for x in batch], pa.binary()) for i, c in enumerate(("entries", "strings", "known"))})

    def suffixes(batches):
        lean()
        held, n = [], 0

        def flush():
            own, where, home = (np.concatenate([h[i] for h in held]) for i in range(3))
            strings = [x for h in held for x in h[3]]
            held.clear()
            seen: dict[bytes, int] = {}
            first = np.fromiter((seen.setdefault(x, i) for i, x in enumerate(strings)), dtype=np.int64, count=len(strings))
            more = np.bincount(first, minlength=len(strings)) - 1
            own_first = first == np.arange(len(strings))
            out: dict[int, list] = {}
            kept = np.flatnonzero(own_first)
            for bucket, at in _by_bucket((home[kept] % np.uint64(buckets)).astype(np.int64)):
                at = kept[at]
                out[bucket] = [packed(own[at], where[at], np.maximum(more[at], 0)), b"".join([strings[i] for i in at.tolist()]), None]
            # the others are known to repeat, each window of them and each step from one to the next
            late = np.flatnonzero(~own_first)
            for bucket, at in _by_bucket((own[late] % np.uint64(2 * partitions)).astype(np.int64)):
                out.setdefault(bucket, [None, None, None])[2] = packed(own[late[at]], where[late[at]])
            yield as_rows([(k_, *v) for k_, v in out.items()])

        for big in batches:
            for batch in by_bytes(big, "text"):
                w = Windows(raw_column(batch, "text"), length, k)
                live = np.zeros(len(w.words) + 1, dtype=bool)
                for a, blob in zip(w.first.tolist(), batch.column("places").to_pylist(), strict=True):
                    live[a + np.frombuffer(blob, dtype="<u8").astype(np.int64)] = True
                of, where, home, strings = w.stretches(live, many.value)
                held.append((batch.column("key").to_numpy().view(np.uint64)[of], where, home, strings))
                n += sum(map(len, strings))
                if n >= 16 << 20:
                    yield from flush()
                    n = 0
        if held:
            yield from flush()

    def trees(batches):
        """One bucket of groups after the other."""
        lean()
        held: dict[int, list] = {}
        for batch in batches:
            for bucket, entries, strings, known in zip(*(batch.column(c).to_pylist() for c in ("bucket", "entries", "strings", "known")), strict=True):
                if known:
                    yield _to_texts(*unpacked(known, 2), 2 * partitions)
                if entries:
                    held.setdefault(bucket, []).append((unpacked(entries, 3), strings))
        for bucket in list(held):
            parts = held.pop(bucket)
            own, where, more = np.concatenate([x for x, _ in parts], axis=1)
            strings = []
            for x, text in parts:
                stops = np.cumsum(_sizes(x[1], length)[1] * WIDTH).tolist()
                strings += [text[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]
            yield _to_texts(*repeated(own, where, more, strings, length), 2 * partitions)

    sent = left.mapInArrow(suffixes, row).repartition(partitions, "bucket")
    return _gathered(sent.mapInArrow(trees, "bucket int, entries binary"), partitions)


def without_repeats(docs: DataFrame, length: int = 35, k: int = 12, group_rows: int = 20_000, doc_id: str = "doc_id", text: str = "text", carry: bool = False, as_it_was: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept (text, words joined by one space), spans (maximal repeats: first word, number of
    words) and, with carry, row (all other columns). as_it_was: kept is the text itself where nothing is removed."""
    rows = _with_key(docs, doc_id, text, carry)
    held = ["row"] * ("row" in rows.columns)
    kind = rows.schema["id"].dataType.simpleString()
    places = repeated_windows(rows, length, k, group_rows)

    def cleaned(t: bytes, blob: bytes | None):
        words = t.split()
        if not blob:
            return len(words), 0, t if as_it_was else b" ".join(words), []
        where = np.frombuffer(blob, dtype="<u8")
        start, n = (where >> np.uint64(16)).astype(np.int64), _sizes(where, length)[0]
        live, on = np.zeros(len(words) + 1, dtype=bool), np.zeros(len(words) + 1, dtype=bool)
        at = spread(start, n)
        live[at] = on[at] = True
        on[start + n - 1] = (where & np.uint64(1)) > 0
        edge = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + n - 1 + length, -1)
        gone = np.cumsum(edge)[:-1] > 0
        first = live.copy()
        first[1:] &= ~on[:-1]
        last = live & ~on
        spans = [{"first": a, "words": b - a + length} for a, b in zip(np.flatnonzero(first).tolist(), np.flatnonzero(last).tolist(), strict=True)]
        return len(words), int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]), spans

    def run(batches):
        lean()
        span = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32())]))
        for big in batches:
            for batch in by_bytes(big, "text"):
                out = [cleaned(t, blob) for t, blob in zip(raw_column(batch, "text"), batch.column("places").to_pylist(), strict=True)]
                cols = list(zip(*out, strict=True)) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([batch.column("id"), *(batch.column(c) for c in held), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()).cast(pa.string()), pa.array(cols[3], span)], ["id", *held, "n_words", "n_removed", "kept", "spans"])

    both = rows.join(places, "key", "left").select(*rows.columns, "places")
    fields = "".join(f"row {rows.schema[c].dataType.simpleString()}, " for c in held)
    return both.mapInArrow(run, f"id {kind}, {fields}n_words bigint, n_removed bigint, kept string, spans array<struct<first:int,words:int>>").withColumnRenamed("id", doc_id)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
