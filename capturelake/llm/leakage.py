"""Evaluation texts in training texts: BM25 inverted index of test items, block-max WAND, exact verification."""

from __future__ import annotations

import html
import re
import unicodedata
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.session import materialise, qualified, remove_at_end, shared_dir

#: Running words of an item that make a leak.
RUN = 13
#: Words of a passage; passages overlap by RUN - 1 words, so that each run lies in one.
PASSAGE = 26
#: Items of a block, for which one upper bound per term is kept.
BLOCK = 8
#: Words of the items of a shard of the index, which is what a worker holds at once; there are as many shards as it takes.
SHARD_WORDS = 1 << 20
#: Shards that a worker keeps after use, and characters of the documents that it searches at once.
_KEPT_SHARDS, _HELD = 4, 1 << 20
#: Bounds of passages and blocks that are held at once.
_BOUNDS = 1 << 21

_K1, _B = 1.2, 0.75

_TAGS = re.compile(r"<!--.*?-->|</?[a-zA-Z][^<>]*>", re.S)
_INVISIBLE = re.compile(
    "[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164"
    "\ufe00-\ufe0f\ufeff\uffa0\ufff9-\ufffb\U000e0000-\U000e0fff\x00-\x08\x0e-\x1f\x7f]"
)
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, in lower case; markup tags, entities and invisible characters do not count. [] for NULL."""
    if not text:
        return []
    if "<" in text:
        text = _TAGS.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    elif not text.isprintable():
        text = _INVISIBLE.sub("", text)
    return _WORD.findall(text.lower())


def tokenised(items: DataFrame, item_id: str, text: str, run: int) -> DataFrame:
    """(item_id, words) of the items with at least ``run`` words."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [words(t) for t in b.column(1).to_pylist()]
            kept = [k for k, w in enumerate(found) if len(w) >= run]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(kept, pa.int64())), pa.array([found[k] for k in kept], pa.list_(pa.string()))], names=["item_id", "words"])

    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("_text"))
    return rows.mapInArrow(split, "item_id bigint, words array<string>")


def write_index(items: DataFrame, *, item_id: str = "item_id", text: str = "text", run: int = RUN) -> tuple[str, list[int]]:
    """(folder, shards) of an inverted index in the shared folder: the words of each item, and its postings with BM25 weights.

    Document frequencies, the mean length and the weights are counted over all items by Spark. The items are
    dealt to shards of about ``SHARD_WORDS`` words, each a folder of its own; two numbers and the list of shards are all that comes to the driver.
    """
    spark = items.sparkSession
    known = materialise(tokenised(items, item_id, text, run).withColumn("item", F.monotonically_increasing_id()), "items")
    size = F.size("words")
    total = known.agg(F.coalesce(F.sum(size), F.lit(0)).alias("words")).first()["words"]
    n_shards = -(-total // SHARD_WORDS)
    if not n_shards:
        return "", []
    known = known.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(n_shards)).cast("int"))
    stats = known.agg(F.count(F.lit(1)).alias("_n"), F.avg(size).alias("_mean"))  # one row
    counts = known.select("shard", "item", size.alias("length"), F.explode("words").alias("term")).groupBy("shard", "item", "length", "term").agg(F.count(F.lit(1)).alias("f"))
    holders = counts.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    idf = F.log(1 + (F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    weight = idf * F.col("f") * (_K1 + 1) / (F.col("f") + _K1 * (1 - _B + _B * F.col("length") / F.col("_mean")))
    postings = counts.join(holders, "term").join(F.broadcast(stats)).select("shard", "term", "item", weight.alias("weight"))
    folder = f"{shared_dir(spark)}/leak-index-{uuid.uuid4().hex}"
    for name, df in (("items", known), ("postings", postings)):
        df.repartition(min(n_shards, 1000), "shard").write.partitionBy("shard").parquet(f"{folder}/{name}")
    remove_at_end(spark, folder)
    shards = sorted(r["shard"] for r in known.select("shard").distinct().collect())
    return qualified(spark, folder), shards


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each span, one span after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class Index:
    """A shard: for each term its postings, its largest weight in each block of items, and its largest of all."""

    def __init__(self, ids: list[int], item_words: list[list[str]], postings: dict[str, list], run: int = RUN):
        """``postings`` has item (place in ``ids``), term and weight, in any order."""
        self.ids, self.run = np.array(ids, dtype=np.int64), run
        n = len(ids)
        self.term = {t: k + 1 for k, t in enumerate(sorted(set(postings["term"])))}  # 0 is an unknown word
        self.blocks = -(-n // BLOCK)
        terms = np.array([self.term[t] for t in postings["term"]], dtype=np.int64)
        items, weights = np.asarray(postings["item"], dtype=np.int64), np.asarray(postings["weight"], dtype=np.float64)
        order = np.lexsort((items, terms))
        self.items, self.weights, terms = items[order], weights[order], terms[order]
        keys = terms * self.blocks + self.items // BLOCK
        self.entry = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if n else np.zeros(0, np.int64)  # first posting of a term in a block
        self.entry_size = np.diff(np.append(self.entry, len(keys)))
        self.entry_key = keys[self.entry]
        self.block_max = np.maximum.reduceat(self.weights, self.entry) if n else np.zeros(0)
        self.block_of = self.entry_key % max(self.blocks, 1)
        self.entries = np.searchsorted(self.entry_key, np.arange(len(self.term) + 2) * self.blocks)  # entries of a term
        self.upper = np.array([self.block_max[a:b].max() if b > a else 0.0 for a, b in zip(self.entries[:-1], self.entries[1:])])
        self._runs([np.array([self.term[t] for t in w], dtype=np.int64) for w in item_words], terms)

    def _runs(self, item_words: list[np.ndarray], terms: np.ndarray) -> None:
        """Hashes of all runs, and the least score that a passage with a run of the item has: none with a run is missed."""
        run = self.run
        n = len(self.ids)
        self.words = np.concatenate([*item_words, np.zeros(0, np.int64)])
        sizes = np.array([len(w) for w in item_words], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        at = _spans(starts, sizes - run + 1)
        owner = np.repeat(np.arange(n), sizes - run + 1)
        self.posting_key = terms * n + self.items  # sorted, as the postings are
        least = np.full(self.blocks * BLOCK, np.inf)
        scores = np.zeros(len(at))
        window = np.stack([self.words[at + k] for k in range(run)], axis=1) if len(at) else np.zeros((0, run), np.int64)
        ordered = np.sort(window, axis=1)
        for k in range(run):  # each distinct word counts once
            new = np.ones(len(at), bool) if k == 0 else ordered[:, k] != ordered[:, k - 1]
            scores += np.where(new, self.weights[np.searchsorted(self.posting_key, ordered[:, k] * n + owner)], 0.0)
        np.minimum.at(least, owner, scores)
        self.least = least * 0.9999 - 1e-4
        self.block_least = self.least.reshape(self.blocks, BLOCK).min(axis=1)
        self.theta = self.block_least.min() if n else np.inf
        keys = self._key(self._hash(self.words, at), owner)
        order = np.argsort(keys, kind="stable")
        self.run_key, self.run_at, self.run_owner = keys[order], at[order], owner[order]

    def _hash(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hash of the run at each place."""
        out = np.zeros(len(at), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(self.run):
                out = out * np.uint64(0x9E3779B97F4A7C15) + ids[at + k].astype(np.uint64)
        return out

    @staticmethod
    def _key(hashes: np.ndarray, items: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return hashes ^ (items.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))

    def candidates(self, terms: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Passages and items of all pairs with a score of at least the item's threshold.

        ``terms`` are the distinct known terms of each passage, in order of ``passages``. For a batch of passages at once:
        terms whose bounds together stay below the least threshold of all cannot lift an item over it alone, so
        only the lists of the others are met (the pivot); a block whose bound stays below its least threshold is
        skipped; the items of what is left are scored, and those that can still reach theirs get the weights of the rest.
        """
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(terms) or not len(self.ids):
            return none
        order = np.lexsort((self.upper[terms], passages))
        terms, passages = terms[order], passages[order]
        upper = self.upper[terms]
        first = np.flatnonzero(np.concatenate([[True], passages[1:] != passages[:-1]]))
        size = np.diff(np.append(first, len(terms)))
        sums = np.cumsum(upper)
        sums -= np.repeat(sums[first] - upper[first], size)
        pivot = sums >= self.theta
        e = np.flatnonzero(pivot)
        if not len(e):
            return none
        rest_sum, rest = np.add.reduceat(np.where(pivot, 0.0, upper), first), np.add.reduceat((~pivot).astype(np.int64), first)
        group = np.repeat(np.arange(len(first)), size)
        n = self.entries[terms[e] + 1] - self.entries[terms[e]]
        at = _spans(self.entries[terms[e]], n)
        keys = np.repeat(group[e], n) * self.blocks + self.block_of[at]
        bounds = np.bincount(keys, weights=self.block_max[at], minlength=len(first) * self.blocks)
        live = np.flatnonzero((bounds.reshape(-1, self.blocks) + rest_sum[:, None] >= self.block_least) & (bounds.reshape(-1, self.blocks) > 0))
        # scores of the items of the blocks that are left, by the lists met
        place = np.full(len(bounds), -1, dtype=np.int64)
        place[live] = np.arange(len(live))
        owner = place[keys]
        at, owner = at[owner >= 0], owner[owner >= 0]
        n = self.entry_size[at]
        posting = _spans(self.entry[at], n)
        scores = np.bincount(np.repeat(owner, n) * BLOCK + self.items[posting] % BLOCK, weights=self.weights[posting], minlength=len(live) * BLOCK)
        g, b = live // self.blocks, live % self.blocks
        hit = np.flatnonzero((scores.reshape(-1, BLOCK) + rest_sum[g, None] >= self.least.reshape(-1, BLOCK)[b]) & (scores.reshape(-1, BLOCK) > 0))
        g, item, score = g[hit // BLOCK], b[hit // BLOCK] * BLOCK + hit % BLOCK, scores[hit]
        # the weights of the other terms in the items that may still come over their thresholds
        owner = np.repeat(np.arange(len(g)), rest[g])
        wanted = terms[_spans(first[g], rest[g])] * len(self.ids) + item[owner]
        posting = np.minimum(np.searchsorted(self.posting_key, wanted), len(self.posting_key) - 1)
        known = self.posting_key[posting] == wanted
        score = score + np.bincount(owner[known], weights=self.weights[posting[known]], minlength=len(g))
        found = score >= self.least[item]
        return passages[first[g[found]]], item[found]

    def leaks(self, texts: list[list[str]]) -> Iterator[tuple[int, int]]:
        """(text number, item id) of all leaks in texts given as words: candidates of each passage, verified word by word."""
        passage = max(PASSAGE, 2 * self.run)
        step = passage - self.run + 1
        ids = np.fromiter((self.term.get(t, 0) for w in texts for t in w), dtype=np.int64, count=sum(map(len, texts)))
        sizes = np.array([len(w) for w in texts], dtype=np.int64)
        runs = np.maximum(sizes - self.run + 1, 0)
        count = -(-runs // step)
        owners = np.repeat(np.arange(len(texts)), count)
        base = np.cumsum(sizes) - sizes
        inner = (np.arange(len(owners)) - np.repeat(np.cumsum(count) - count, count)) * step
        begins = base[owners] + inner
        starts = np.minimum(step, runs[owners] - inner)  # runs that start in the passage
        words = np.minimum(passage, sizes[owners] - inner)
        pairs = np.unique(np.repeat(np.arange(len(owners)), words) * (len(self.term) + 1) + ids[_spans(begins, words)])
        terms, passages = pairs % (len(self.term) + 1), pairs // (len(self.term) + 1)
        # so many passages at once that the bounds of their blocks stay few
        bounds = np.searchsorted(passages, np.arange(0, len(owners) + 1, max(1, _BOUNDS // max(self.blocks, 1))))
        parts = [self.candidates(t[t > 0], p[t > 0]) for t, p in zip(np.split(terms, bounds[1:]), np.split(passages, bounds[1:]))]
        passages, items = (np.concatenate(x) for x in zip(*parts))
        found = self.verify(ids, begins[passages], starts[passages], items)
        for n, item in sorted({(int(n), int(i)) for n, i in zip(owners[passages[found]], self.ids[items[found]])}):
            yield n, item

    def verify(self, ids: np.ndarray, begins: np.ndarray, starts: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Which of the pairs of a passage and an item have a run of the item, compared word by word."""
        at = _spans(begins, starts)
        pair = np.repeat(np.arange(len(begins)), starts)
        keys = self._key(self._hash(ids, at), items[pair])
        place = np.searchsorted(self.run_key, keys)
        found = np.zeros(len(begins), bool)
        live = np.arange(len(at))
        while len(live):  # more than once only where hashes of different runs are equal
            live = live[place[live] < len(self.run_key)]
            live = live[self.run_key[place[live]] == keys[live]]
            same = self.run_owner[place[live]] == items[pair[live]]
            for k in range(self.run):
                same &= self.words[self.run_at[place[live]] + k] == ids[at[live] + k]
            found[pair[live[same]]] = True
            live = live[~same]
            place[live] += 1
        return np.flatnonzero(found)


_shards: OrderedDict[tuple[str, int], Index] = OrderedDict()


def shard_index(folder: str, shard: int, run: int = RUN) -> Index:
    """A shard read from the shared folder; a worker process keeps the last few."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    key = (f"{folder}#{run}", shard)
    if key not in _shards:
        scheme, _, rest = folder.partition(":")
        system, path = fs.FileSystem.from_uri(f"file://{rest}" if scheme == "file" and not rest.startswith("//") else folder)
        read = lambda name, columns: pq.read_table(f"{path}/{name}/shard={shard}", columns=columns, filesystem=system, partitioning=None)
        items = read("items", ["item", "item_id", "words"]).sort_by("item")
        postings = read("postings", ["item", "term", "weight"])
        place = np.searchsorted(items.column("item").to_numpy(), postings.column("item").to_numpy())
        columns = {"item": place, "term": postings.column("term").to_pylist(), "weight": postings.column("weight").to_numpy()}
        _shards[key] = Index(items.column("item_id").to_pylist(), items.column("words").to_pylist(), columns, run)
        while len(_shards) > _KEPT_SHARDS:
            _shards.popitem(last=False)
    _shards.move_to_end(key)
    return _shards[key]


def leaks(
    documents: DataFrame, items: DataFrame, *, row_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", run: int = RUN
) -> DataFrame:
    """(row_id, item_id): each document and each item of which at least ``run`` running words stand in its text.

    Every document is cut into passages of 26 words that overlap by ``run - 1``; each passage is a query
    against a BM25 index of the items. An item's threshold is the least score which a passage with a run
    of it can have, so that the retrieval loses nothing, and candidates are verified word by word. Items
    shorter than ``run`` words, and NULL or empty texts, have no leaks; a pair comes out once for each row of the
    document, however often its item is stored. The documents are scanned and their words taken once; the index is
    a table in the shared folder, of which a worker holds one bounded shard after the other. There is no exchange of documents.
    """
    id_type = documents.schema[row_id].dataType.simpleString()
    schema = f"`{row_id}` {id_type}, item_id bigint"
    folder, shards = write_index(items, item_id=item_id, text=item_text, run=run)
    if not shards:
        return documents.sparkSession.createDataFrame([], schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            begin = held = 0
            for k, t in enumerate(texts):
                held += len(t or "")
                if held < _HELD and k + 1 < len(texts):
                    continue
                taken = [words(x) for x in texts[begin : k + 1]]
                pairs = sorted({p for shard in shards for p in shard_index(folder, shard, run).leaks(taken)})
                if pairs:
                    ids = b.column(0).take(pa.array([begin + n for n, _ in pairs]))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([i for _, i in pairs], pa.int64())], names=[row_id, "item_id"])
                begin, held = k + 1, 0

    return documents.select(row_id, text).mapInArrow(search, schema)
