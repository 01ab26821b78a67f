"""The trie of conversations' turns: a node for each distinct sequence of first turns.

A turn is the pair of its role and text, of which 128 bits of SHA-256 stand for
it; null role or text is empty. Turns follow by their number, null first, and
by that digest where numbers are equal. ``rebuilt`` gives a conversation the
beginning of another one. Rows without a conversation id belong to none.

The nodes come from an LCP-aware external mergesort. Conversations, one row each
with the digests of its turns, are dealt by ranges of (digests, id), so a hot
sequence is spread by its ids. A task sorts what it gets into runs of bounded
size; each row carries its LCP, the number of turns that it shares with the row
before it. Runs go as short chunks to Spark's sort, by their first rows, which
spills where it must; so chunks are opened in the order in which a merge needs
them, and only those that overlap are held. A loser tree merges them: of two
rows the one that shares more turns with the last one given out comes first,
and only rows that share equally many are compared, from there on. The merged
rows and their LCPs drive a stack, the path of open nodes: a row closes the
nodes that it doesn't share and opens those that are new. A node that is closed
is finished: it has all its members, children and sums.

Only the nodes on a task's first or last path may go on in other tasks. Their
parts are added up by node; what they owe to the nodes above them is passed up
by pointer doubling, in as many rounds as the logarithm of the depth. The ids of
conversations that end at such a node, or at a node with more than ``ENDS`` of them, are
sent as pieces of text, sorted, and hashed as a stream. Parents' ids are joined
by the hash of the path.

Nothing holds all rows of a node: one row is held for each conversation (its
digests and word counts), for each open node, and ``ENDS`` ids. An empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.llm.common import cut, discard, few, table

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a turn's digest.
TOKEN = 16
#: Conversations of a base are those with the same ``id - id % BASE``; up to HEADS - 1 turns come from the first of them.
BASE = 20
HEADS = 4
#: Rows and bytes of a run, and rows of a chunk of it.
RUN = 1 << 13
RUN_BYTES = 1 << 25
CHUNK = 256
#: Ids that end at a node, up to which they are hashed where they are found.
ENDS = 1 << 13
EMPTY = hashlib.sha256(b"").hexdigest()

Row = tuple[bytes, int, list[int]]  # (digests, id, words of each turn)


def turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as (token, words); the token is hexadecimal."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    token = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * TOKEN)
    slim = conversations.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), token.alias("token"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    row = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", "token", "words")
    listed = slim.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("x"))
    return listed.select("conv_id", F.transform("x", lambda t: F.struct(t["token"].alias("token"), t["words"].alias("words"))).alias("turns"))


def rebuilt(listed: DataFrame) -> DataFrame:
    """``listed`` (conv_id, turns) where the first turns of each are those of the base's: as many as crc32 of the id modulo ``HEADS``."""
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(BASE))
    heads = listed.where(F.pmod("conv_id", F.lit(BASE)) == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEADS - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    joined = listed.select("conv_id", "turns", base.alias("base"), h.alias("h")).join(heads, "base", "left")
    empty = F.slice("turns", 1, 0)
    head = F.slice(F.coalesce("head", empty), F.lit(1), F.col("h"))
    return joined.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """The number of turns that two paths share, ``known`` of them already."""
    low, high = known, min(len(a), len(b)) // TOKEN
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * TOKEN : mid * TOKEN] == b[low * TOKEN : mid * TOKEN]:
            low = mid
        else:
            high = mid - 1
    return low


def run_of(rows: list[Row]) -> Iterator[tuple[list[Row], list[int]]]:
    """Chunks of the sorted ``rows``, with the LCP of each and the row before it in the run."""
    rows.sort(key=lambda r: r[:2])
    lcps = [0, *(common(a[0], b[0]) for a, b in zip(rows, rows[1:], strict=False))]
    for lo in range(0, len(rows), CHUNK):
        yield rows[lo : lo + CHUNK], lcps[lo : lo + CHUNK]


class LoserTree:
    """Merges sorted lists of rows; ``lcp[i]`` is what the head of list ``i`` shares with the last row given out, or with the head that beat it."""

    def __init__(self, lists: list[tuple[list[Row], list[int]]], at: list[int], last: bytes) -> None:
        self.lists, self.at = lists, at
        self.lcp = [common(rows[k][0], last) for (rows, _), k in zip(lists, at, strict=True)]
        self.losers = [-1] * len(lists)
        self.winner = self._play(1) if lists else -1

    def _play(self, node: int) -> int:
        """The winner below a node, with the losers of all matches noted."""
        n = len(self.lists)
        if node >= n:
            return node - n
        first, second = self._match(self._play(2 * node), self._play(2 * node + 1))
        self.losers[node] = second
        return first

    def _match(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two lists; the loser's LCP is then the one with the winner."""
        if self.at[a] < 0 or self.at[b] < 0:  # a list that has ended
            return (b, a) if self.at[a] < 0 else (a, b)
        if self.lcp[a] != self.lcp[b]:
            return (a, b) if self.lcp[a] > self.lcp[b] else (b, a)
        x, y = self.head(a), self.head(b)
        shared = common(x[0], y[0], self.lcp[a])
        cut_ = shared * TOKEN
        if (x[0][cut_ : cut_ + TOKEN], x[1]) > (y[0][cut_ : cut_ + TOKEN], y[1]):
            a, b = b, a
        self.lcp[b] = shared
        return a, b

    def head(self, i: int) -> Row:
        return self.lists[i][0][self.at[i]]

    def next(self) -> tuple[Row, int]:
        """The smallest row and its LCP with the one given out before it."""
        i = self.winner
        out, lcp = self.head(i), self.lcp[i]
        rows, lcps = self.lists[i]
        self.at[i] += 1
        if self.at[i] < len(rows):
            self.lcp[i] = lcps[self.at[i]]
        else:
            self.at[i] = -1
        node = (i + len(self.lists)) // 2
        while node:
            i, self.losers[node] = self._match(i, self.losers[node])
            node //= 2
        self.winner = i
        return out, lcp

    def ended(self) -> bool:
        return self.winner < 0 or self.at[self.winner] < 0


def merged(chunks: Iterator[tuple[list[Row], list[int]]]) -> Iterator[tuple[Row, int]]:
    """Rows of all ``chunks`` in order, each with its LCP with the one before it; chunks come in the order of their first rows."""
    last = b""
    tree = LoserTree([], [], last)
    for chunk in chunks:
        first = chunk[0][0][:2]
        while not tree.ended() and tree.head(tree.winner)[:2] < first:
            row, lcp = tree.next()
            last = row[0]
            yield row, lcp
        alive = [i for i, k in enumerate(tree.at) if k >= 0]
        tree = LoserTree([*(tree.lists[i] for i in alive), chunk], [*(tree.at[i] for i in alive), 0], last)
    while not tree.ended():
        yield tree.next()


class Node:
    """An open node: what has been seen of it."""

    __slots__ = ("children", "edge", "ids", "key", "leaves", "least", "n", "saved", "sent", "words")

    def __init__(self, key: bytes, words: int, edge: bool) -> None:
        self.key, self.words, self.edge = key, words, edge
        self.n = self.children = self.leaves = self.saved = 0
        self.least: int | None = None
        self.ids: list[int] = []
        self.sent = False


DONE, PART, PIECE = range(3)
_FIELDS = (("kind", "int"), ("key", "binary"), ("above", "binary"), ("depth", "long"), ("conv_id", "long"), ("n", "long"), ("children", "long"), ("leaves", "long"), ("saved", "long"), ("words", "long"), ("ends", "string"))
_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}


def nodes_of(rows: Iterator[tuple[Row, int]]) -> Iterator[tuple]:
    """Rows of ``_FIELDS`` from sorted rows with LCPs.

    Kind ``DONE`` is a finished node, ``PART`` this task's part of a node on its
    first or last path (children, leaves and sums are of finished ones below it),
    ``PIECE`` a piece of the ids that end at a node, with the first of them as ``conv_id``.
    """
    path: list[Node] = []

    def piece(node: Node, depth: int) -> tuple:
        out = (PIECE, node.key, None, depth, node.ids[0], 0, 0, 0, 0, 0, ",".join(map(str, node.ids)))
        node.ids, node.sent = [], True
        return out

    def close() -> Iterator[tuple]:
        node, depth = path.pop(), len(path)
        up = path[-1] if path else None
        if (node.edge or node.sent) and node.ids:
            yield piece(node, depth)
        if up:
            up.n += node.n
            up.least = node.least if up.least is None else min(up.least, node.least)
        above = up.key if up else None
        if node.edge:
            yield (PART, node.key, above, depth, node.least, node.n, node.children, node.leaves, node.saved, node.words, None)
            return
        node.saved += (node.n - 1) * node.words
        node.leaves = node.leaves if node.children else 1
        if up:
            up.children += 1
            up.leaves += node.leaves
            up.saved += node.saved
        ends = None if node.sent else hashlib.sha256(",".join(map(str, node.ids)).encode()).hexdigest()
        yield (DONE, node.key, above, depth, node.least, node.n, node.children, node.leaves, node.saved, node.words, ends)

    for (key, conv_id, words), lcp in rows:
        first = not path
        if first:
            path.append(Node(bytes(TOKEN), 0, True))
        while len(path) > lcp + 1:
            yield from close()
        for d in range(len(path) - 1, len(words)):
            own = xxhash.xxh3_128_digest(path[-1].key + key[d * TOKEN : (d + 1) * TOKEN])
            path.append(Node(own, words[d], first))
        end = path[-1]
        end.n += 1
        end.least = conv_id if end.least is None else min(end.least, conv_id)
        end.ids.append(conv_id)
        if len(end.ids) >= ENDS:
            yield piece(end, len(path) - 1)
    for node in path:
        node.edge = True
    while path:
        yield from close()


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, key, words) to the chunks of sorted runs."""
    rows: list[Row] = []
    size = 0

    def give() -> Iterator[pa.RecordBatch]:
        for chunk, lcps in run_of(rows):
            columns = [pa.array([chunk[0][0]], pa.binary()), pa.array([chunk[0][1]], pa.int64()), pa.array([[r[0] for r in chunk]], pa.list_(pa.binary())), pa.array([[r[1] for r in chunk]], pa.list_(pa.int64())), pa.array([[r[2] for r in chunk]], pa.list_(pa.list_(pa.int64()))), pa.array([lcps], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["first", "id", "keys", "ids", "words", "lcps"])

    for b in batches:
        for conv_id, key, words in zip(*(c.to_pylist() for c in b.columns), strict=True):
            rows.append((key, conv_id, words))
            size += len(key) * 2
            if len(rows) >= RUN or size >= RUN_BYTES:
                yield from give()
                rows, size = [], 0
    yield from give()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in the order of their first rows to rows of nodes."""

    def chunks() -> Iterator[tuple[list[Row], list[int]]]:
        for b in batches:
            for k in range(b.num_rows):
                keys, ids, words, lcps = (b.column(c)[k].as_py() for c in ("keys", "ids", "words", "lcps"))
                yield list(zip(keys, ids, words, strict=True)), lcps

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(zip(*rows, strict=True), _FIELDS, strict=True)], [name for name, _ in _FIELDS])

    out: list[tuple] = []
    for row in nodes_of(merged(chunks())):
        out.append(row)
        if len(out) >= 4096:
            yield batch(out)
            out = []
    if out:
        yield batch(out)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (key, conv_id, ends), sorted, to one digest for each key: a stream, whatever the number of pieces."""
    here, state = None, None
    for b in batches:
        keys, found = [], []
        for key, text in zip(b.column("key").to_pylist(), b.column("ends").to_pylist(), strict=True):
            if key != here:
                if state:
                    keys.append(here)
                    found.append(state.hexdigest())
                here, state = key, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.string())], ["key", "digest"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([here], pa.binary()), pa.array([state.hexdigest()])], ["key", "digest"])


def passed_up(parts: DataFrame) -> DataFrame:
    """``parts`` (key, above, ..., leaves, saved) with both sums taken over all nodes below.

    After ``k`` rounds a node has the sums of those less than ``2 ** k`` below it, and knows the node ``2 ** k`` above.
    """
    sums = cut(parts.select("key", "above", "leaves", "saved"), "sums")
    while not sums.where("above is not null").isEmpty():
        gained = sums.where("above is not null").groupBy(F.col("above").alias("key")).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("extra"))
        higher = sums.select(F.col("key").alias("above"), F.col("above").alias("higher"))
        zero = F.lit(0).cast("long")
        added = sums.join(gained, "key", "left").join(higher, "above", "left")
        last, sums = sums, cut(added.select("key", F.col("higher").alias("above"), (F.col("leaves") + F.coalesce("more", zero)).alias("leaves"), (F.col("saved") + F.coalesce("extra", zero)).alias("saved")), "sums")
        discard(last)
    return parts.drop("leaves", "saved").join(sums.drop("above"), "key")


def prefix_nodes(listed: DataFrame) -> DataFrame:
    """The nodes of ``listed`` (conv_id, turns): conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    tokens = F.array_join(F.transform("turns", lambda t: t["token"]), "")
    paths = cut(listed.select("conv_id", F.unhex(tokens).alias("key"), F.transform("turns", lambda t: t["words"]).alias("words")), "paths")
    dealt = paths.repartitionByRange("key", "conv_id").select("conv_id", "key", "words")
    runs = dealt.mapInArrow(_sort, "first binary, id long, keys array<binary>, ids array<long>, words array<array<long>>, lcps array<long>")
    found = cut(runs.sortWithinPartitions("first", "id").mapInArrow(_merge, ", ".join(f"{n} {t}" for n, t in _FIELDS)), "trie")
    discard(paths)
    parts = found.where(F.col("kind") == PART).groupBy("key").agg(
        F.first("above").alias("above"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.first("words").alias("words"), *(F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved"))
    )
    edges = cut(parts, "edges")
    below = edges.groupBy(F.col("above").alias("key")).agg(F.count("*").alias("below"))
    children = F.col("children") + F.coalesce("below", F.lit(0).cast("long"))
    whole = edges.join(below, "key", "left").withColumns({"children": children, "saved": F.col("saved") + (F.col("n") - 1) * F.col("words")})
    whole = passed_up(cut(whole.withColumn("leaves", F.when(F.col("children") == 0, F.lit(1).cast("long")).otherwise(F.col("leaves"))).drop("below"), "edges"))
    columns = ["key", "above", "depth", "conv_id", "n", "children", "leaves", "saved"]
    every = cut(found.where(F.col("kind") == DONE).select(*columns, "ends").union(whole.select(*columns, F.lit(None).cast("string"))), "nodes")
    pieces = found.where(F.col("kind") == PIECE).select("key", "conv_id", "ends").repartition("key").sortWithinPartitions("key", "conv_id")
    digests = cut(pieces.mapInArrow(_digests, "key binary, digest string"), "digests")
    parents = cut(every.where("children > 0").select(F.col("key").alias("above"), F.col("conv_id").alias("parent_conv_id")), "parents")
    discard(found, edges)
    named = every.join(few(digests), "key", "left").join(few(parents), "above", "left")
    return named.select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", "digest", F.lit(EMPTY)).alias("ends_sha256")
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_nodes(rebuilt(turns(table(spark, sf_dir, "conversations"))))


_BIT = "CASE WHEN i % 8 = 0 THEN xor(c, ascii(s[i // 8 + 1])::BIGINT) ELSE c END"
_CRC = f"xor(list_reduce(range(0, 8 * len(s)), lambda c, i: xor(({_BIT}) >> 1, 3988292384 * (({_BIT}) & 1)), 4294967295::BIGINT), 4294967295::BIGINT)"
_ORACLE = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, conv_id::VARCHAR AS s, conv_id - ((conv_id % {BASE}) + {BASE}) % {BASE} AS b, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, substr(sha256(len(role) || ':' || role || text), 1, {2 * TOKEN})) AS own FROM t GROUP BY 1),
h AS (SELECT conv_id, b, own, ({_CRC}) % {HEADS} AS h FROM o),
p AS (SELECT h.conv_id, list_concat(coalesce(o.own[1:h], []), h.own[h + 1:]) AS path FROM h LEFT JOIN o ON h.b = o.conv_id),
m AS (SELECT conv_id, path, d, path[1:d] AS k FROM p, range(0, (SELECT max(len(path)) FROM p) + 1) r(d) WHERE d <= len(path)),
g AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(path) = d), '')) AS ends_sha256,
  CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(k[d].text, '{WORD}')) END AS words FROM m GROUP BY 1, 2),
c AS (SELECT k[1:d - 1] AS k, count(*) AS n FROM g WHERE d > 0 GROUP BY 1),
w AS (SELECT g.k, g.d, coalesce(c.n, 0) AS children, (g.n - 1) * words AS saved FROM g LEFT JOIN c USING (k)),
s AS (SELECT k[1:a] AS k, count(*) FILTER (WHERE children = 0) AS leaves, sum(saved) AS saved FROM w, range(0, (SELECT max(d) FROM g) + 1) r(a) WHERE a <= d GROUP BY 1)
SELECT g.conv_id, g.d AS depth, u.conv_id AS parent_conv_id, g.n AS n_convs, w.children AS n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, g.ends_sha256
FROM g JOIN w USING (k) JOIN s USING (k) LEFT JOIN g u ON g.d > 0 AND u.k = g.k[1:g.d - 1]"""

ORACLES = {"op13_prefix_trie": _ORACLE}
QUERIES = {"op13_prefix_trie": op13_prefix_trie}
