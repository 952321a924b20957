"""N-gram Jaccard join: documents whose sets of word n-grams have a Jaccard similarity of at least `percent` / 100.

Words are runs of bytes other than white space (0x20, 0x09-0x0D) of the text with A-Z lower-cased. A set holds the
distinct 64-bit hashes of the n-grams of a text; fewer than n words make one n-gram together.

1. Texts of equal words are one node (the hash of their words); only nodes are compared from here on.
2. N-grams are counted over all texts in a table of fixed size; n-grams are ordered by that count, rarest first, then
   by hash. Two sets that link share an n-gram among the first |x| - ceil(t |x|) + 1 of each (prefix filter).
3. Prefix n-grams that only one node has are dropped (repeats.py); the others are the join's postings.
4. Pivot round: in each n-gram's postings, the pair of every node with one hub, which has it earliest, is tried. That links large groups of
   near copies with as many pairs as postings, not with the square of the group.
5. Last round: all pairs of postings of one n-gram whose components still differ, so no link that could change a
   component is left out. Pairs must pass the length filter, the positional filter and the suffix filter: of each set it is
   known how many hashes lie in each of LANES ranges, and two sets share no more than the smaller numbers' sum. Only then are
   texts sent to pairs; pairs tried before are left out, and each remaining one is verified once against the whole sets.

Components of all links found are those of all links. For the number of links, every pair of nodes of a component, which
holds all its links, is compared once, in blocks that return counts (links_of). Defined cases: null and empty texts, and
texts without words, have an empty set, link with nothing and are their own component. Rows that repeat a doc_id are taken
as one more document with that id, and rows with a null id link like any other; a component's id is the smallest that is
not null, or null if all are. Extra columns are ignored; an empty table gives an empty result.

Broadcast: the ranks of the count table, 2 ** COUNT_BITS bytes whatever the input. 64-bit hashes stand for n-grams and
texts: among 10 ** 9 distinct ones, the chance that any two agree is 3 %, among 10 ** 10 two or three pairs are expected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, cut, drop, lean, mix, raw_column, runs, table, word_hashes
from .components import components
from .repeats import Counter, n_buckets, receive, send, sum_chunks

COUNT_BITS, LANES = 20, 64
#: nodes and bytes of text of a block, about; columns of n-grams at once
BLOCK, BLOCK_BYTES, COLUMNS = 2048, 16 << 20, 1024


def need(size_sum, percent: int):
    """The least overlap of two sets that link, by the sum of their sizes."""
    return -(-percent * size_sum // (100 + percent))


def nodes_of(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The hash of each text's words."""
    ends = np.cumsum(counts)
    starts = ends - counts
    place = np.arange(len(words), dtype=np.uint64) - np.repeat(starts, counts).astype(np.uint64)
    each = mix(words ^ mix(place + np.uint64(1)))  # the word and its place
    total = np.concatenate([[np.uint64(0)], np.cumsum(each, dtype=np.uint64)])
    return mix(total[ends] - total[starts] + counts.astype(np.uint64))


def shingles(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams text by text (not distinct), how many each text has, and the hash of each text's words."""
    words, counts = word_hashes(texts, lower=True)
    ends = np.cumsum(counts)
    starts = ends - counts
    grams = runs(words, n)
    # a text's n-grams start at its words but the last n - 1; fewer words give one n-gram, hashed as a whole
    sizes = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    out = np.zeros(int(sizes.sum()), dtype=np.uint64)
    at = 0
    whole = nodes_of(words, counts)
    for i in range(len(texts)):
        k = int(sizes[i])
        if counts[i] >= n:
            out[at : at + k] = grams[starts[i] : starts[i] + k]
        elif k:
            out[at] = mix(whole[i : i + 1] ^ np.uint64(counts[i]))[0]
        at += k
    return out, sizes, whole


def _sets(texts: list[bytes], n: int):
    """Each text's sorted distinct n-gram hashes."""
    grams, sizes, whole = shingles(texts, n)
    ends = np.cumsum(sizes)
    return [np.unique(grams[a:b]) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)], whole


def documents_and_counts(docs: DataFrame, n: int, doc_id: str, text: str) -> tuple[DataFrame, np.ndarray]:
    """id, node, n_shingles, lanes of every row (written), and a rank of rarity for each cell of the count table."""
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["id", "node", "n_shingles", "lanes", "chunk", "counts"]

    def run(batches):
        lean()
        seen, id_type = Counter(COUNT_BITS), None
        for big in batches:
            id_type = big.schema.field("id").type
            for batch in by_bytes(big, "text"):
                sets, whole = _sets(raw_column(batch, "text"), n)
                k = len(sets)
                all_ = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
                seen.add(all_)
                lens = np.array([len(s) for s in sets], dtype=np.int64)
                lanes = np.bincount(np.repeat(np.arange(k), lens) * LANES + (all_ >> np.uint64(58)).astype(np.int64), minlength=k * LANES)
                offsets = pa.array(np.arange(k + 1) * LANES, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(whole.view(np.int64)), pa.array(lens), pa.ListArray.from_arrays(offsets, pa.array(lanes, pa.int32())), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
        if id_type is not None:
            part = list(seen.chunks())
            k = len(part)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, id_type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.list_(pa.int32())), pa.array([c for c, _ in part], pa.int32()), pa.array([x.astype("<i8").tobytes() for _, x in part], pa.binary())], names)

    both = cut(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, node bigint, n_shingles bigint, lanes array<int>, chunk int, counts binary"))
    counts = Counter.collected(sum_chunks(both.filter("chunk is not null"), 64), COUNT_BITS)[0]
    rank = np.minimum(255, np.round(8 * np.log2(counts + 1.0))).astype(np.uint8)
    return both.filter("chunk is null").select("id", "node", "n_shingles", "lanes"), rank


def texts_of(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """node, text of the wanted nodes, once each; of equal words, any row's text. A task sends a node's text once."""

    def run(batches):
        lean()
        seen: set[int] = set()
        for big in batches:
            for batch in by_bytes(big, "text"):
                nodes = nodes_of(*word_hashes(raw_column(batch, "text"), lower=True)).view(np.int64)
                _, first = np.unique(nodes, return_index=True)
                new = np.array([i for i, x in zip(first.tolist(), nodes[first].tolist(), strict=True) if x not in seen], dtype=np.int64)
                if len(seen) > 200_000:
                    seen.clear()
                seen.update(nodes[new].tolist())
                yield pa.RecordBatch.from_arrays([pa.array(nodes[new]), batch.column("text").take(pa.array(new))], ["node", "text"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(run, "node bigint, text string")
    return rows.join(wanted, "node", "left_semi").dropDuplicates(["node"])


def _ordered(s: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """N-gram hashes of a set, rarest first. The rank takes the place of the hash's lowest 8 bits."""
    return np.sort((rank[(s >> np.uint64(64 - COUNT_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8)))


def postings(docs: DataFrame, rank: np.ndarray, n: int, percent: int, text: str) -> DataFrame:
    """gram, node, size, pos: the prefix n-grams that several nodes have."""
    sent_rank = docs.sparkSession.sparkContext.broadcast(rank)

    def entries_of(big, _):
        for batch in by_bytes(big, "text"):
            sets, whole = _sets(raw_column(batch, "text"), n)
            keys, own, extra = [], [], []
            first = {int(w): i for i, w in reversed(list(enumerate(whole.tolist())))}
            for i in first.values():
                size = len(sets[i])
                if size:
                    p = size - need_alone(size, percent) + 1
                    keys.append(_ordered(sets[i], sent_rank.value)[:p])
                    own.append(np.full(p, whole[i]))
                    extra.append((np.uint64(size) << np.uint64(32)) | np.arange(p, dtype=np.uint64))
            if keys:
                key = np.concatenate(keys)
                yield key, np.concatenate(own), np.concatenate(extra)

    def finish(key, own, extra):
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(own.view(np.int64)), pa.array((extra >> np.uint64(32)).astype(np.int64)), pa.array((extra & np.uint64(0xFFFFFFFF)).astype(np.int64))], ["gram", "node", "size", "pos"])

    rows = docs.select(F.col(text).alias("text"))
    partitions, buckets = n_buckets(docs)
    return receive(send(rows, entries_of, buckets), partitions, finish, "gram bigint, node bigint, size bigint, pos bigint")


def need_alone(size: int, percent: int) -> int:
    """The least overlap of a set of this size with any set that it links with."""
    return -(-percent * size // 100)


def admitted(a: str, b: str, percent: int):
    """The length filter and the positional filter for two postings of one n-gram."""
    size_a, size_b, pos_a, pos_b = (F.col(f"{t}.{c}") for c in ("size", "pos") for t in (a, b))
    length = F.least(size_a, size_b) * 100 >= F.greatest(size_a, size_b) * percent
    return length & (F.least(size_a - pos_a, size_b - pos_b) * (100 + percent) >= (size_a + size_b) * percent)


def possible(pairs: DataFrame, lanes: DataFrame, percent: int) -> DataFrame:
    """The suffix filter: pairs a, b whose ranges of hashes can hold the least overlap; lanes: node, lanes."""
    of = lambda x: lanes.select(F.col("node").alias(x), F.col("lanes").alias(f"lanes_{x}"))
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, y: s + y)
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    most = total(F.zip_with("lanes_a", "lanes_b", lambda x, y: F.least(x, y)))
    return both.filter(most * (100 + percent) >= (total(F.col("lanes_a")) + total(F.col("lanes_b"))) * percent).select("a", "b")


def verified(pairs: DataFrame, node_texts: DataFrame, n: int, percent: int) -> DataFrame:
    """a, b, similar of pairs a, b; node_texts: node, text. Each text is joined to the pairs of its node."""
    left = pairs.join(node_texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(node_texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches):
        lean()
        for big in batches:
            for batch in by_bytes(big, "text_b"):
                # a hub's text comes with each of its pairs: made into a set once a batch
                nodes_a, nodes_b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
                at: dict[int, int] = {}
                texts: list[bytes] = []
                for nodes, name in ((nodes_a, "text_a"), (nodes_b, "text_b")):
                    new = {node: i for i, node in enumerate(nodes) if node not in at}
                    for t, node in zip(batch.column(name).take(pa.array(list(new.values()), pa.int64())).cast(pa.binary()).to_pylist(), new, strict=True):
                        at[node] = len(texts)
                        texts.append(t)
                sets, _ = _sets(texts, n)
                similar = []
                for p, q in zip(nodes_a, nodes_b, strict=True):
                    x, y = sets[at[p]], sets[at[q]]
                    similar.append(len(np.intersect1d(x, y, assume_unique=True)) >= need(len(x) + len(y), percent))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(similar, pa.bool_())], ["a", "b", "similar"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint, similar boolean")


def _as_pairs(joined: DataFrame, x: str, y: str) -> DataFrame:
    p, q = F.col(f"{x}.node"), F.col(f"{y}.node")
    return joined.select(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")).distinct()


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many n-grams each set of `left` (places) has in common with each of `right`.

    Of an n-gram that most sets have, the sets without it are listed: x y = 1 - x' - y' + x' y'. Near copies of one text
    then differ in few n-grams, and few products are left.
    """
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    most = 2 * count > len(sets)
    missing = np.zeros(len(sets), dtype=np.float32)
    dense = np.flatnonzero(most)
    own = most[column]
    if len(dense):
        has = np.zeros((len(sets), len(dense)), dtype=bool)
        has[row[own], (np.cumsum(most) - 1)[column[own]]] = True
        r, c = np.nonzero(~has)
        del has
        missing += np.bincount(r, minlength=len(sets))
        row, column = np.concatenate([row[~own], r]), np.concatenate([column[~own], dense[c]])
    count = np.bincount(column, minlength=len(count))
    shared = count[column] > 1
    row, column = row[shared], (np.cumsum(count > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = len(dense) - missing[left][:, None] - missing[right][None, :]
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        x, y = np.searchsorted(column, [a, a + COLUMNS])
        held = np.zeros((len(sets), min(COLUMNS, int(column[-1]) + 1 - a)), dtype=np.float32)
        held[row[x:y], column[x:y] - a] = 1
        out += held[left] @ held[right].T
    return out


def links_of(linked: DataFrame, nodes: DataFrame, node_texts: DataFrame, n: int, percent: int, partitions: int, block: int = BLOCK) -> DataFrame:
    """node, links: the rows of other nodes that a node links with; linked: node, component; nodes: node, copies."""
    own = linked.join(node_texts.select("node", F.octet_length("text").alias("bytes")), "node")
    sizes = own.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("bytes") / BLOCK_BYTES), F.lit(1)).cast("int").alias("parts"))
    placed = linked.join(sizes, "component").join(nodes.select("node", "copies"), "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    each = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = each.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "block", "copies").join(node_texts, "node")
    dealt = pairs.repartition(partitions, "component", "i", "j").sortWithinPartitions("component", "i", "j")

    def counted(key, rows) -> tuple[np.ndarray, np.ndarray]:
        nodes_, blocks, copies = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(3))
        sets, _ = _sets([r[3] for r in rows], n)
        lens = np.array([len(x) for x in sets], dtype=np.int64)
        left, right = np.flatnonzero(blocks == key[1]), np.flatnonzero(blocks == key[2])
        links = np.zeros(len(rows), dtype=np.int64)
        both = overlaps(sets, left, right)
        for a in range(0, len(left), 256):
            at = left[a : a + 256]
            similar = both[a : a + 256] >= need(lens[at][:, None] + lens[right][None, :], percent)
            similar &= at[:, None] != right[None, :]
            links[at] += similar @ copies[right]
            if key[1] != key[2]:
                links[right] += copies[at] @ similar
        return nodes_, links

    def run(batches):
        now, held = None, []

        def ended():
            nodes_, links = counted(now, held)
            return pa.RecordBatch.from_arrays([pa.array(nodes_), pa.array(links)], ["node", "links"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("component", "i", "j", "node", "block", "copies")]
            for component, i, j, *row, text in zip(*columns, raw_column(batch, "text"), strict=True):
                if now != (component, i, j):
                    if held:
                        yield ended()
                    now, held = (component, i, j), []
                held.append((*row, text))
        if held:
            yield ended()

    counts = dealt.select("component", "i", "j", "node", "block", "copies", "text").mapInArrow(run, "node bigint, links bigint")
    return counts.groupBy("node").agg(F.sum("links").alias("links"))


def ngram_join(docs: DataFrame, n: int = 5, percent: int = 75, doc_id: str = "doc_id", text: str = "text", links_too: bool = False, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) of every row and, with links_too, n_links: the
    other rows that it links with, copies included."""
    rows, rank = documents_and_counts(docs, n, doc_id, text)
    live = cut(postings(docs, rank, n, percent, text))
    nodes = cut(rows.groupBy("node").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")))
    # what the nodes that have postings hold, once each
    wanted = cut(live.select("node").distinct())
    lanes = cut(rows.select("node", "lanes").join(wanted, "node", "left_semi").dropDuplicates(["node"]))
    node_texts = cut(texts_of(docs, text, wanted))
    # pivot round; an edited copy's own n-grams are rare and come first, so the node that has an n-gram earliest is the
    # likeliest to be what the others were made from
    hubs = cut(live.groupBy("gram").agg(F.min(F.struct("pos", "node", "size")).alias("h")).select("gram", "h.*"))
    tried = live.alias("x").join(hubs.alias("y"), "gram").filter("x.node <> y.node").filter(admitted("x", "y", percent))
    first = cut(verified(possible(_as_pairs(tried, "x", "y"), lanes, percent), node_texts, n, percent))
    links = first.filter("similar").select("a", "b")
    comp = components(links).withColumnRenamed("id", "node")
    # written tables go as soon as nothing reads them any more
    # last round: postings of n-grams whose nodes are not of one component yet
    placed = cut(live.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node")))
    drop(live, hubs, wanted)
    mixed = cut(placed.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("gram"))
    open_ = cut(placed.join(mixed, "gram"))
    across = open_.alias("x").join(open_.alias("y"), (F.col("x.gram") == F.col("y.gram")) & (F.col("x.component") < F.col("y.component")) & admitted("x", "y", percent))
    left = _as_pairs(across, "x", "y").join(first.select("a", "b"), ["a", "b"], "left_anti")
    last = cut(verified(possible(left, lanes, percent), node_texts, n, percent).filter("similar").select("a", "b"))
    drop(placed, mixed, open_, lanes)
    linked = components(links.unionByName(last)).withColumnRenamed("id", "node")
    named = cut(nodes.join(linked, "node", "left").select("node", "id", F.coalesce("component", "node").alias("component")))
    least = cut(named.groupBy("component").agg(F.min("id").alias("component_id")))
    of_node = named.join(least, "component").select("node", "component_id")
    if links_too:
        own = links_of(linked, nodes, node_texts, n, percent, n_buckets(docs)[0], block)
        of_node = of_node.join(nodes.select("node", "copies"), "node").join(own, "node", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("links", F.lit(0)))
    of_node = cut(of_node)
    drop(first, last, nodes, named, least, node_texts)
    more = ["n_links"] * links_too
    full = rows.filter("n_shingles > 0").join(of_node, "node", "left").select("id", "n_shingles", "component_id", *more)
    none = rows.filter("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"), *[F.lit(0).cast("long").alias(c) for c in more])
    return full.unionByName(none).withColumnRenamed("id", doc_id)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"), links_too=True)
