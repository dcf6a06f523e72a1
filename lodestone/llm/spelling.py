"""Spelling variants: pairs of words at distance one, by a self-join of the vocabulary's trie.

Two words are near if one inserted, deleted or replaced code point makes them equal. The trie of the
vocabulary is cut at prefixes, and what hangs below one prefix is joined with itself: from the
prefix down, each node passes its active nodes, those whose words differ from its own by one edit,
to its children. A child's active nodes are its parent, its siblings, its own children, and what its
parent's active nodes reach over the child's letter. Active terminals of a terminal are near words.

Words may also differ before the prefix ends. Of two near words, the shorter of m code points, either
the first m / 2 code points agree or the last ones do, so the trie of the reversed words is cut
likewise, and a word stands in one prefix of either trie for each m that it may have a part in, its
length and the one below. Words below a prefix that very many share are cut again, in the same way,
at halves of what is left of them, until few share a prefix: no pair is lost, and no task holds
more than a prefix's words.

Counting words and cutting prefixes are DataFrame functions; tries are numpy arrays over the sorted
words of many prefixes at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MIN_LENGTH, MIN_COUNT, FORM_RATIO, ERASE = 7, 2, 10, 31
#: Words below a prefix above which it is cut again; at most one in MOST_CUTS of all words, if that is more.
CROWD, MOST_CUTS = 20_000, 10_000
#: Rows, and letters of them, that a task makes a trie of at a time; what one prefix has stays together.
ROWS, CELLS = 40_000, 1_500_000
#: Doublings after which all chains of forms have ended: each step needs counts FORM_RATIO times as large.
MOST_DOUBLINGS = 8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CODES = 0x110000


def words_of(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = MIN_LENGTH, erase: int = ERASE) -> DataFrame:
    """(word) of all texts, with repeats: maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z
    lower-cased, of `least` code points or more.

    Where `erase` divides the CRC-32 of "<key>:<run>", the run loses the code point at the checksum
    modulo its length. A null key is written as null; null texts have no words.
    """
    # runs can't grow, so shorter ones needn't be taken out at all
    runs = F.regexp_extract_all(F.translate(F.col(text), _UPPER, _LOWER), F.lit(rf"[a-zÀ-ÿ]{{{least},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("key"), F.explode(runs).alias("run"))
    rows = rows.select("run", F.crc32(F.concat("key", F.lit(":"), "run")).alias("sum"))
    at = F.pmod(F.col("sum"), F.char_length("run")).cast("int")
    rest = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return rows.select(F.when(F.col("sum") % erase == 0, rest).otherwise(F.col("run")).alias("word")).filter(F.char_length("word") >= least)


def vocabulary(words: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    """(word, n) of words that occur `least` times or more."""
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _cut(rows: DataFrame) -> DataFrame:
    """Rows (size, prefix, rest, word, n) under longer prefixes: once below the first half of what is
    left, once, reversed, below the last.

    size: the length of the shorter words of pairs looked for; rest: what is left of a word behind
    its prefix. A pair of words whose rests are near shares one of both prefixes.
    """
    # what the shorter words have left
    left = F.col("size") - (F.char_length("word") - F.char_length("rest"))
    first, last = F.floor(left / 2).cast("int"), F.ceil(left / 2).cast("int")
    whole = F.char_length("rest")
    front = F.struct(F.concat("prefix", F.lit(">"), F.substring("rest", F.lit(1), first)).alias("prefix"), F.substring("rest", first + 1, whole).alias("rest"))
    back = F.struct(F.concat("prefix", F.lit("<"), F.substring("rest", whole - last + 1, last)).alias("prefix"), F.reverse(F.substring("rest", F.lit(1), whole - last)).alias("rest"))
    return rows.select("size", F.explode(F.array(front, back)).alias("c"), "word", "n").select("size", "c.prefix", "c.rest", "word", "n")


def prefixes(vocab: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(size, prefix, rest, word, n): the words below each prefix of the tries."""
    count, least = vocab.agg(F.count("*"), F.min(F.char_length("word"))).first()
    # pairs need a word of their size; the longer ones stand under a size less than their own as well
    sizes = F.filter(F.array(F.char_length("word") - 1, F.char_length("word")), lambda s: s >= max(least or 0, 1))
    rows = _cut(vocab.select(F.explode(sizes).alias("size"), F.lit("").alias("prefix"), F.col("word").alias("rest"), "word", "n"))
    done, total = [], 4 * count
    left = F.col("size") - (F.char_length("word") - F.char_length("rest"))
    while True:
        # at most MOST_CUTS prefixes are crowded, so they may be sent to all tasks. What has one letter
        # left can't be cut, and has as many words as there are letters
        crowded = rows.groupBy("size", "prefix").agg(F.count("*").alias("rows"), F.max(left).alias("left"))
        crowded = common.durable(crowded.filter((F.col("rows") > max(crowd, total // MOST_CUTS)) & (F.col("left") > 1)))
        total = 2 * (crowded.agg(F.sum("rows")).first()[0] or 0)
        if not total:
            break
        marks = crowded.select("size", "prefix", F.lit(True).alias("again"))
        marked = common.durable(rows.join(F.broadcast(marks), ["size", "prefix"], "left"))
        done.append(marked.filter("again IS NULL").select(*rows.columns))
        rows = _cut(marked.filter("again").select(*rows.columns))
    for d in done:
        rows = rows.union(d)
    return rows


def near_rows(group: np.ndarray, rests: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (i, j), both ways, of rests of one group that are one edit apart.

    Rows are sorted by group and rest, and no rest is twice in a group.
    """
    n, lengths = len(rests), np.fromiter(map(len, rests), np.int64, len(rests))
    width = int(lengths.max(initial=0))
    letters = np.zeros((n, width), np.int64)
    letters[np.arange(width) < lengths[:, None]] = np.frombuffer("".join(rests).encode("utf-32-le", "surrogatepass"), "<u4")
    # a row makes nodes below what it shares with the row before
    differs = np.zeros((n, width + 1), bool)
    differs[0] = True
    differs[1:, 0] = group[1:] != group[:-1]
    differs[1:, 1:] = letters[1:] != letters[:-1]
    fresh = np.logical_or.accumulate(differs, axis=1)
    fresh &= np.arange(width + 1) <= lengths[:, None]
    number = np.cumsum(fresh.ravel()).reshape(fresh.shape) - 1
    # the row that made the node at each place of each row
    maker = np.maximum.accumulate(np.where(fresh, np.arange(n)[:, None], 0), axis=0)
    node = number[maker, np.arange(width + 1)]
    rows, depths = np.nonzero(fresh)
    nodes = len(rows)
    parent = np.where(depths > 0, node[rows, np.maximum(depths - 1, 0)], -1)
    letter = np.where(depths > 0, letters[rows, np.maximum(depths - 1, 0)] if width else 0, 0)
    word = np.full(nodes, -1, np.int64)
    word[node[np.arange(n), lengths]] = np.arange(n)
    # children by parent, and by (parent, letter)
    ordered = np.argsort(parent, kind="stable")
    ordered = ordered[np.searchsorted(parent[ordered], 0) :]
    begin = np.searchsorted(parent[ordered], np.arange(nodes + 1))
    keys = parent[ordered] * _CODES + letter[ordered]
    by_key = np.argsort(keys, kind="stable")
    keys, named = keys[by_key], ordered[by_key]

    def children(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into of, child) for each child."""
        counts = begin[of + 1] - begin[of]
        at = np.repeat(np.arange(len(of)), counts)
        within = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
        return at, ordered[begin[of][at] + within]

    found = []
    by_depth = np.argsort(depths, kind="stable")
    levels = np.searchsorted(depths[by_depth], np.arange(width + 2))
    here = by_depth[: levels[1]]
    at, child = children(here)
    a, b = here[at], child
    for depth in range(width + 1):
        both = (word[a] >= 0) & (word[b] >= 0)
        found.append((word[a[both]], word[b[both]]))
        if depth == width:
            break
        # what the active nodes of a node reach over a child's letter
        at, child = children(a)
        wanted = b[at] * _CODES + letter[child]
        spot = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = keys[spot] == wanted if len(keys) else np.zeros(0, bool)
        here = by_depth[levels[depth + 1] : levels[depth + 2]]
        beside, sibling = children(parent[here])
        under, grandchild = children(here)
        a = np.concatenate([child[hit], here, here[beside], here[under]])
        b = np.concatenate([named[spot[hit]], parent[here], sibling, grandchild])
        apart = a != b
        pairs = np.unique(a[apart] * nodes + b[apart])
        a, b = pairs // nodes, pairs % nodes
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _joined(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """(word, other, other_n) of rows sorted by size, prefix and rest, each prefix with all its rows."""
    size, prefix = rows["size"].to_numpy(np.int64), rows["prefix"].to_numpy(object)
    if not len(rows):
        return
    same = (size[1:] == size[:-1]) & (prefix[1:] == prefix[:-1])
    group = np.cumsum(np.insert(~same, 0, True))
    # most prefixes have one word
    shared = np.append(same, False) | np.insert(same, 0, False)
    group, size = group[shared], size[shared]
    rest, word, n = (rows[c].to_numpy(object)[shared] for c in ("rest", "word", "n"))
    lengths = np.fromiter(map(len, rest), np.int64, len(rest))
    begins = np.append(np.nonzero(np.diff(group, prepend=-1))[0], len(group))
    at = 0
    while at < len(group):
        # whole prefixes, until a table of their letters has CELLS; long words widen no others' table
        widest = np.maximum.accumulate(lengths[at : at + ROWS])
        fit = at + int(np.argmax(np.append(widest * np.arange(1, len(widest) + 1) > CELLS, True)))
        cut = int(begins[max(np.searchsorted(begins, fit, "right") - 1, np.searchsorted(begins, at) + 1)])
        here = slice(at, cut)
        i, j = near_rows(group[here], rest[here].tolist())
        long = np.fromiter(map(len, word[here]), np.int64, cut - at) > size[here]
        own = ~(long[i] & long[j])  # two longer words are a pair of the next size
        i, j = i[own] + at, j[own] + at
        if len(i):
            yield pd.DataFrame({"word": word[i], "other": word[j], "other_n": n[j].astype(np.int64)})
        at = cut


def _tries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Near words of a partition sorted by size, prefix and rest, some whole prefixes at a time."""
    held: list[pd.DataFrame] = []
    count, enough = 0, ROWS
    for batch in batches:
        held.append(batch)
        count += len(batch)
        if count < enough:
            continue
        rows = pd.concat(held, ignore_index=True)
        # the last prefix may go on in the next batch
        more = ((rows["size"] == rows["size"].iloc[-1]) & (rows["prefix"] == rows["prefix"].iloc[-1])).to_numpy()
        yield from _joined(rows[~more])
        held, count = [rows[more]], int(more.sum())
        enough = max(ROWS, 2 * count)
    if held:
        yield from _joined(pd.concat(held, ignore_index=True))
    common.release_memory()


def near_pairs(vocab: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(word, other, other_n) of all near words, both ways, each once."""
    common.ship(vocab.sparkSession)
    rows = prefixes(vocab, crowd).repartition("size", "prefix").sortWithinPartitions("size", "prefix", "rest")
    return rows.select("size", "prefix", "rest", "word", "n").mapInPandas(_tries, "word string, other string, other_n long").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form): where following forms ends, by doubling."""
    now = common.durable(forms.select("word", F.col("form").alias("root")))
    for _ in range(MOST_DOUBLINGS):
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = common.durable(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        now = step.select("word", "root")
        if not step.filter("moved").take(1):
            return now
    raise RuntimeError("forms did not end")


def spelling_groups(vocab: DataFrame, ratio: int = FORM_RATIO, crowd: int = CROWD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of a vocabulary (word, n).

    Words are near if exactly one inserted, deleted or replaced code point makes them equal. A word's
    form is its near word of the largest n, ties by code points, if that is ratio times its own n or
    more, else null. root is the last form that following forms leads to, the word itself without
    one. form_n is the form's n, or null; n_near counts near words, 0 if there are none. Words must
    be distinct and not null; an empty vocabulary gives no rows, an empty word has no near word of
    length 0. Other columns are dropped.
    """
    vocab = common.durable(vocab.select("word", "n"))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))
    near = near_pairs(vocab, crowd).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    known = vocab.join(near, "word", "left")
    worthy = -F.col("best.less") >= ratio * F.col("n")
    told = common.durable(known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(worthy, F.col("best.other")).alias("form"), F.when(worthy, -F.col("best.less")).alias("form_n")))
    roots = _roots(told.filter("form IS NOT NULL"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Spelling groups of the words of all documents."""
    return spelling_groups(vocabulary(words_of(common.table(spark, sf_dir, "documents"))))


#: op12_spelling_variants in DuckDB SQL: the checksum bit by bit, near words by what is left of them
#: without one code point.
OP12_SQL = """
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i::BIGINT] || [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) AS r(i))
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{00C0}-\\x{00FF}]{7,}')) AS run FROM documents
), counted AS (
  SELECT doc_id, run, count(*) AS n FROM runs GROUP BY doc_id, run
), summed AS (
  SELECT run, n, xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, 'null') || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + unicode(x) // 64, 128 + unicode(x) % 64]::BIGINT[] END)),
    lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1])), 4294967295) AS h FROM counted, crc
), vocab AS (
  SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM summed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cut AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM vocab)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN vocab b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN vocab b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word
), told AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * v.n THEN other END AS form, CASE WHEN other_n >= 10 * v.n THEN other_n END AS form_n FROM vocab v LEFT JOIN best USING (word)
), follow(word, spot) AS (
  SELECT word, word FROM told UNION ALL SELECT f.word, t.form FROM follow f JOIN told t ON t.word = f.spot WHERE t.form IS NOT NULL
)
SELECT t.word, t.form, f.spot AS root, t.n, t.n_near, t.form_n FROM told t JOIN follow f USING (word) JOIN told e ON e.word = f.spot AND e.form IS NULL
"""
