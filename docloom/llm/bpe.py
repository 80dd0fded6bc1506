"""Byte-level BPE by DuckDB inside the tasks of a Spark job.

Each task cuts its texts by the tokenizer's pattern, and DuckDB merges the task's distinct words: a recursive query over
rows (word, position, id) contracts in every word its leftmost pair of least rank, joins the pairs that this makes with the
merge table, and ends when no pair can be merged. Decoding joins rows (text, position, id) with the vocabulary and
aggregates the pieces in order. Whole texts, no special tokens, no shuffle; memory is bounded by the Arrow batch and by
the slices that DuckDB gets.

Null and empty texts have no ids; an id outside the vocabulary fails the job, as does a null among the ids.
"""

import base64
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docloom.llm.worker import freeing, gather, kept, parts, starts_of, text_parts

#: Unicode White_Space, which the tokenizer's pattern calls \s. Fixed values.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPACES = [chr(i) for i in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]

SLICE_WORDS = 20_000
SLICE_CHARS = 1 << 21
SLICE_IDS = 1 << 19
#: Rows that the rounds over a slice of words keep at most: for each word about half the square of its bytes.
SLICE_ROWS = 2_000_000
#: Words, and pieces of texts, that a task knows at most when it begins a slice.
KEPT_WORDS = 300_000
LONG = 256

# A row knows the id after it (nid) and the order of that pair among its word's (k: rank, then place), so a round looks up only the
# two pairs that are new in a word. Rows of a word that is done are given once more, marked, and end there.
MERGE = """
WITH RECURSIVE step(w, g, id, ng, nid, k, done) AS (
  SELECT w, g, id, ng, nid, m.t::BIGINT * 4294967296 + g, false FROM start LEFT JOIN merges m ON m.l = id AND m.r = nid
  UNION ALL
  (WITH held AS (SELECT * FROM step WHERE NOT done),
   best AS (SELECT w, min(k) AS k, arg_min(ng, k) AS gone FROM held WHERE k IS NOT NULL GROUP BY w),
   merged AS (SELECT b.w, (b.k >> 32)::INT AS t, (b.k & 4294967295)::INT AS g, b.gone, s.ng, s.nid FROM best b JOIN held s ON s.g = b.gone),
   contracted AS (
     SELECT p.w, p.g, p.k, b.w IS NULL AS done, coalesce(p.g = b.g OR p.ng = b.g, false) AS new,
       CASE WHEN p.g = b.g THEN b.t ELSE p.id END AS id, CASE WHEN p.g = b.g THEN b.ng ELSE p.ng END AS ng,
       CASE WHEN p.g = b.g THEN b.nid WHEN p.ng = b.g THEN b.t ELSE p.nid END AS nid
     FROM held p LEFT JOIN merged b ON b.w = p.w WHERE b.w IS NULL OR p.g <> b.gone)
   SELECT c.w, c.g, c.id, c.ng, c.nid, CASE WHEN c.new THEN m.t::BIGINT * 4294967296 + c.g ELSE c.k END, c.done
   FROM contracted c LEFT JOIN merges m ON m.l = CASE WHEN c.new THEN c.id END AND m.r = c.nid)
)
SELECT w, id FROM step WHERE done ORDER BY g
"""

# For a long word, round by round, each in place of the one before. No token of lower rank starts or ends with a safe one, so
# contracting one pair of it makes none that would come before the next: all its pairs go in one round, every second one
# where they overlap.
PAIRS = """
CREATE OR REPLACE TEMP TABLE pairs AS
SELECT s.g, s.id, m.t, m.safe
FROM (SELECT row_number() OVER (ORDER BY g) AS g, id, lead(id) OVER (ORDER BY g) AS nid FROM step) s
LEFT JOIN possible m ON m.l = s.id AND m.r = s.nid
"""
CHOSEN = """
CREATE OR REPLACE TEMP TABLE chosen AS
WITH hits AS (SELECT g, safe, g - row_number() OVER (ORDER BY g) AS run FROM pairs WHERE t = (SELECT min(t) FROM pairs))
SELECT g FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY g) AS n, min(g) OVER () AS first FROM hits)
WHERE CASE WHEN safe THEN n % 2 = 1 ELSE g = first END
"""
STEP = """
CREATE OR REPLACE TEMP TABLE step AS
SELECT p.g, CASE WHEN c.g IS NULL THEN p.id ELSE p.t END AS id
FROM pairs p LEFT JOIN chosen c ON c.g = p.g LEFT JOIN chosen d ON d.g + 1 = p.g WHERE d.g IS NULL
"""

# DuckDB runs on one thread here, so rows reach the aggregate in the order of the subquery; sorting inside the aggregate
# would sort every group by itself, at four times the cost.
DECODE = """
SELECT d, string_agg(bytes, '') AS bytes, count(*) AS n
FROM (SELECT r.d, v.bytes FROM rows r JOIN vocab v USING (id) ORDER BY r.g) GROUP BY d
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of lines `base64 rank`."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge_rows(ranks: dict[bytes, int]) -> list[tuple[int, int, int, bool]]:
    """(left, right, merged, safe) for every way to make a token of two."""
    splits = [(token, token[:k], token[k:], rank) for token, rank in ranks.items() for k in range(1, len(token))]
    unsafe = {ranks[part] for _, a, b, rank in splits for part in (a, b) if ranks.get(part, -1) > rank}
    return [(ranks[a], ranks[b], rank, rank not in unsafe) for _, a, b, rank in splits if a in ranks and b in ranks]


#: Rank of a pair that is none.
NONE = np.iinfo(np.int32).max


def first_pairs(ranks: dict[bytes, int], unsafe: set[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables by two bytes: the rank of the pair if it is safe, and the least rank of a merge that may take one of its bytes from it.

    `before[a, b]` is of the merges of any token that ends in a with the byte b, `after[c, d]` of the byte c with any that starts in d.
    A safe pair of lower rank than both beside it is merged whatever else is, since neither of its bytes can go elsewhere before, and
    nothing that is made of it comes before it.
    """
    pair, before, after = (np.full((256, 256), NONE, np.int32) for _ in range(3))
    for token, rank in ranks.items():
        if len(token) == 2 and rank not in unsafe:
            pair[token[0], token[1]] = rank
        if len(token) > 1:
            if token[:-1] in ranks:
                before[token[-2], token[-1]] = min(before[token[-2], token[-1]], rank)
            if token[1:] in ranks:
                after[token[0], token[1]] = min(after[token[0], token[1]], rank)
    return pair, before, after


class Tables:
    """The merges and the vocabulary as columns; small, so workers keep them."""

    def __init__(self, ranks: dict[bytes, int]):
        rows = merge_rows(ranks)
        self.l, self.r, self.t, self.safe = (np.array(c, kind) for c, kind in zip(zip(*rows), (np.int32, np.int32, np.int32, bool)))
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.pair, self.before, self.after = first_pairs(ranks, set(self.t[~self.safe].tolist()))
        # Bytes as the code points 0 to 255, since text can be aggregated in order.
        self.vocab = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "bytes": [token.decode("latin-1") for token in ranks]})


class Codec:
    """A task's DuckDB with the tables, and the ids of words that the task met so far."""

    def __init__(self, tables: Tables, pattern: str | None):
        """Without a pattern for decoding only."""
        import duckdb
        import regex

        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self.l, self.r, self.t, self.safe, self.single = tables.l, tables.r, tables.t, tables.safe, tables.single
        self.pair, self.before, self.after = tables.pair, tables.before, tables.after
        if pattern is None:
            self.con.register("given", tables.vocab)
            self.con.execute("CREATE TABLE vocab AS SELECT id, bytes FROM given")
        else:
            self.con.register("given", pa.table({"l": self.l, "r": self.r, "t": self.t}))
            self.con.execute("CREATE TABLE merges AS SELECT l, r, t FROM given")
            self.words_in = regex.compile(pattern).findall
            # Whether a space and letters are always one match, so that such a piece need not be searched.
            self.letters = all(self.words_in(f" {w}") == [f" {w}"] for w in ("a", "Z", "ab", "AB", "aB", "Ab", "letterLETTERletter"))
            self.chunks_in = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall
        self.con.unregister("given")
        self.forget()

    def forget(self):
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        # Pieces of texts, and the numbers of their words one after another.
        self.index = _Index()
        self.words = np.zeros(0, np.int64)
        self.per_chunk = np.zeros(0, np.int64)

    def merge(self, raw: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after another, and how many each has."""
        x = np.frombuffer(b"".join(raw), np.uint8)
        w = np.repeat(np.arange(len(raw), dtype=np.int32), sizes)
        # Pairs of bytes that are merged whatever else is, at once; place i is the pair of bytes i and i + 1.
        inside = w[1:] == w[:-1]
        rank = np.where(inside, self.pair[x[:-1], x[1:]], NONE)
        sure = rank < NONE
        sure[1:] &= rank[1:] < np.where(inside[:-1], self.before[x[:-2], x[1:-1]], NONE)
        sure[:-1] &= rank[:-1] < np.where(inside[1:], self.after[x[1:-1], x[2:]], NONE)
        ids = self.single[x]
        ids[:-1][sure] = rank[sure]
        left = np.append(True, ~sure)
        w, ids = w[left], ids[left]
        last = np.append(w[1:] != w[:-1], True)
        g = np.arange(len(w), dtype=np.int32)
        ng, nid = g + 1, np.append(ids[1:], ids[:1])
        ng[last] = nid[last] = -1
        start = {"w": w, "g": g, "id": ids, "ng": ng, "nid": nid}
        self.con.register("start", pa.table(start))
        out = self.con.sql(MERGE).to_arrow_table()
        self.con.unregister("start")
        return out["id"].to_numpy(), np.bincount(out["w"].to_numpy(), minlength=len(raw))

    def merge_long(self, word: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of one word of any length, and how many it has."""
        raw = np.frombuffer(word, np.uint8)
        self.con.register("start", pa.table({"g": np.arange(len(raw)), "id": self.single[raw]}))
        self.con.execute("CREATE OR REPLACE TEMP TABLE step AS SELECT g, id FROM start")
        self.con.unregister("start")
        # The merges that the bytes of the word can come to.
        met = np.zeros(1 + max(self.l.max(), self.r.max(), self.t.max(), self.single.max()), bool)
        met[self.single[raw]] = True
        possible, n = np.zeros(len(self.l), bool), -1
        while n != (n := int(possible.sum())):
            possible = met[self.l] & met[self.r]
            met[self.t[possible]] = True
        some = {c: getattr(self, c)[possible] for c in ("l", "r", "t", "safe")}
        self.con.register("given", pa.table(some))
        self.con.execute("CREATE OR REPLACE TEMP TABLE possible AS SELECT * FROM given")
        self.con.unregister("given")
        while True:
            self.con.execute(PAIRS)
            self.con.execute(CHOSEN)
            if not self.con.execute("SELECT count(*) FROM chosen").fetchall()[0][0]:
                break
            self.con.execute(STEP)
        ids = self.con.sql("SELECT id FROM step ORDER BY g").to_arrow_table()["id"].to_numpy()
        for name in ("step", "possible", "pairs", "chosen"):
            self.con.execute(f"DROP TABLE {name}")
        return ids, np.array([len(ids)])

    def learn(self, words: list[str]):
        """Make the ids of new words known."""
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        # Short words first, as many at once as the limits allow.
        order = np.argsort(sizes > LONG, kind="stable")
        if sizes.max(initial=0) > LONG:
            words, raw, sizes = [words[i] for i in order], [raw[i] for i in order], sizes[order]
        n_short, rows = int(np.count_nonzero(sizes <= LONG)), np.cumsum(sizes**2 // 2 + 1)
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        all_ids, all_lengths, at = [self.ids], [self.lengths], 0
        while at < len(raw):
            if at < n_short:
                most = int(np.searchsorted(rows, (rows[at - 1] if at else 0) + SLICE_ROWS, "right"))
                end = max(at + 1, min(most, at + SLICE_WORDS, n_short))
                ids, lengths = self.merge(raw[at:end], sizes[at:end])
            else:
                end = at + 1
                ids, lengths = self.merge_long(raw[at])
            all_ids.append(ids)
            all_lengths.append(lengths)
            at = end
        self.ids, self.lengths = np.concatenate(all_ids), np.concatenate(all_lengths)
        self.starts = starts_of(self.lengths)

    def chunks(self, text: str) -> tuple[list, bool]:
        """The text in pieces that the pattern never matches across, and whether each after the first lacks its space."""
        if not any(s + " " in text for s in SPACES):
            # Every space follows something else, so a match starts at it.
            return text.split(" "), True
        return self.chunks_in(text), False

    def cut(self, chunk: str | tuple[str]) -> list[str]:
        """The words of a piece. A plain key is a piece without its space, a tuple a piece as it is."""
        if chunk.__class__ is tuple:
            return self.words_in(chunk[0])
        word = " " + chunk
        return [word] if self.letters and chunk.isascii() and chunk.isalpha() else self.words_in(word)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after another, and how many each text has."""
        if max(len(self.known), len(self.index)) > KEPT_WORDS:
            self.forget()
        index, before = self.index, len(self.index)
        refs, sizes = [], []
        for text in texts:
            pieces, bare = self.chunks(text) if text else ([], False)
            if bare:
                pieces[0] = (pieces[0],)
            else:
                pieces = [(p,) for p in pieces]
            refs.extend(map(index.__getitem__, pieces))
            sizes.append(len(pieces))
        cut = list(map(self.cut, islice(index, before, None)))
        new = [w for w in dict.fromkeys(chain.from_iterable(cut)) if w not in self.known]
        if new:
            self.learn(new)
        found = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64)
        self.words = np.concatenate([self.words, found])
        self.per_chunk = np.concatenate([self.per_chunk, np.fromiter(map(len, cut), np.int64, len(cut))])
        words, per_chunk = self.words, self.per_chunk
        chunk = np.array(refs, np.int64)
        del refs, cut
        # Texts are rows of chunks, chunks rows of words, words rows of ids.
        words = words[gather(starts_of(per_chunk)[chunk], per_chunk[chunk])]
        per_word = self.lengths[words]
        ids = self.ids[gather(self.starts[words], per_word)]
        ends = np.concatenate([[0], np.cumsum(per_word)])
        word_ends = np.concatenate([[0], np.cumsum(per_chunk[chunk])])
        text_ends = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])
        return ids, np.diff(ends[word_ends[text_ends]])

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """The bytes of each row of ids."""
        rows = {"d": np.repeat(np.arange(len(lengths), dtype=np.int32), lengths), "g": np.arange(len(ids), dtype=np.int32), "id": ids}
        self.con.register("rows", pa.table(rows))
        out = self.con.sql(DECODE).to_arrow_table()
        self.con.unregister("rows")
        if sum(out["n"].to_pylist()) != len(ids):
            raise ValueError("ids outside the vocabulary")
        found = dict(zip(out["d"].to_pylist(), out["bytes"].to_pylist()))
        return [found.get(i, "").encode("latin-1") for i in range(len(lengths))]


class _Index(dict):
    def __missing__(self, key):
        self[key] = value = len(self)
        return value


def _codec(ranks, pattern: str | None) -> Codec:
    return Codec(kept(("bpe", hash(frozenset(ranks.value.items()))), lambda: Tables(ranks.value)), pattern)


def encode(df: DataFrame, text: str, ranks: dict[bytes, int], pattern: str, out: str = "ids") -> DataFrame:
    """Add the token ids of a text column as an array. `out` replaces a column of that name."""
    spark = df.sparkSession
    kept_columns = [c for c in df.columns if c != out]
    at = kept_columns.index(text)
    shared = spark.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, pattern)
        for part in text_parts(batches, at, SLICE_CHARS):
            ids, lengths = codec.encode(part.column(at).to_pylist())
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, ids)], names)
        codec.con.close()

    names = [*kept_columns, out]
    schema = T.StructType([*df.select(*map(_quoted, kept_columns)).schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    return df.select(*map(_quoted, kept_columns)).mapInArrow(freeing(run), schema)


def decode(df: DataFrame, ids: str, ranks: dict[bytes, int], out: str = "bytes") -> DataFrame:
    """Add the bytes that an array of ids stands for; null ids count as none. `out` replaces a column of that name."""
    spark = df.sparkSession
    kept_columns = [c for c in df.columns if c != out]
    at = kept_columns.index(ids)
    shared = spark.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, None)
        for batch in batches:
            for part in parts(batch, pc.list_value_length(batch.column(at)), SLICE_IDS):
                column = part.column(at)
                lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
                values = codec.decode(np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.int32), lengths)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values, pa.binary())], names)
        codec.con.close()

    names = [*kept_columns, out]
    schema = T.StructType([*df.select(*map(_quoted, kept_columns)).schema.fields, T.StructField(out, T.BinaryType())])
    return df.select(*map(_quoted, kept_columns)).mapInArrow(freeing(run), schema)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"

