"""Phrases whose words keep company: frequent n-grams by Misra-Gries summaries, then exact counts and scores.

An n-gram of a language that occurs `least` times must not be missed, and there are far more n-grams than memory. N-grams are
hashed, and the hash deals them to partitions that are so many that a partition's occurrences stay below `least` / 2 times
the counters its summary has. Tasks add up what their texts hold and send it to the partitions, packed; a partition merges what
comes in, and whenever it has more keys than counters it takes the count of the first that has no place off all of them.
The sum of what was taken off, `cut`, stays below `least` (see `capacity`), and a key's true count is at most its counter and
`cut`: so every key that may have `least` occurrences is known, and few others.

Words and pairs are summarised first; triples and fours only where all their pairs came through, since no n-gram is more
frequent than a part of it. Then the texts are read once more and what came through is counted exactly, as words and not as
hashes, and added up in as many partitions. Of the summaries nothing but a bitmap of fixed size is broadcast: it lets all of them
pass, and as many others as it is full; those are dropped by their exact counts.
"""

import string
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.shingles import spread
from docloom.llm.worker import freeing, text_parts
from docloom.session import materialize

#: What ends a piece, as fixed by the definition of a phrase; a piece's words stand between spaces and tabs.
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
#: Stands for the end of a piece: a byte that no text in UTF-8 has.
END = b"\xff"
#: A-Z in lower case, and piece ends as one byte; of white space only spaces and tabs are left then.
PLAIN = bytes.maketrans(PIECE_ENDS + string.ascii_uppercase.encode(), END * len(PIECE_ENDS) + string.ascii_lowercase.encode())
LONGEST = 4
#: Counters of a summary, n-grams that a task adds up before it sends them, and words it knows at once.
COUNTERS = 1 << 18
HELD = 1 << 21
KNOWN = 400_000
#: Bits of the map of what came through: 8 MB, whatever the input.
BITS = 1 << 26
#: Scores are shares in millionths; doubled, so that a phrase that is all its parts' occurrences has a million.
SCALE = 2_000_000


class Words(dict):
    """Numbers of words, in order of appearance; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({END: 0})
        self.words = [END]
        self.hashes = array("Q", [0])

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return n


def numbered(known: Words, langs: list[str], texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts with an end after each, and for each place the number of its language among `langs`."""
    found = []
    for text in texts:
        tokens = text.encode("utf-8", "surrogatepass").translate(PLAIN).replace(END, b" \xff ").split() if text else []
        tokens.append(END)
        found.append(np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens)))
    lengths = np.array([len(x) for x in found], np.int64)
    return np.concatenate(found), np.repeat(np.array([known_lang(x) for x in langs], np.uint64), lengths)


def known_lang(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"), seed=1)


def ngrams(words: np.ndarray, hashes: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 1, 2, ... words: a hash for each place, and whether an n-gram of one piece begins there."""
    h = hashes[words]
    key, whole = spread(h), words != 0
    yield key, whole
    for k in range(1, longest):
        key = spread(key[:-1] + h[k:]) if len(key) else key
        whole = whole[:-1] & (words[k:] != 0)
        yield key, whole


def capacity(mass: int, least: int, counters: int) -> int:
    """Counters a summary must have when it has seen `mass` occurrences.

    Taking d off costs d * (counters + 1) occurrences. Up to a mass of least / 2 * counters that is less than least / 2 in
    all. Each time the mass doubles beyond, the counters grow fourfold, so what the j-th doubling takes off is less than
    least / 2 * 2^j / 4^j: the sum of all stays below `least`, whatever the mass.
    """
    at = max(counters * least // 2, 1)
    grown = counters
    while mass > at:
        at, grown = 2 * at, 4 * grown
    return grown


class Summary:
    """A Misra-Gries summary that others' counts are merged into."""

    def __init__(self, least: int, counters: int):
        self.least, self.counters = least, counters
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.cut = self.mass = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.mass += int(counts.sum())
        self.keys, self.counts = added(np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts]))
        room = capacity(self.mass, self.least, self.counters)
        if len(self.keys) > room:
            off = int(np.partition(self.counts, len(self.counts) - room - 1)[len(self.counts) - room - 1])
            self.cut += off
            kept = self.counts > off
            self.keys, self.counts = self.keys[kept], self.counts[kept] - off

    def frequent(self) -> np.ndarray:
        """Every key that may have `least` occurrences."""
        if self.cut >= self.least:
            raise AssertionError("more was taken off than a summary may")
        return self.keys[self.counts + self.cut >= self.least]


def added(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, in order, and the sums of their counts."""
    if counts is None:
        keys, sums = np.unique(keys, return_counts=True)
        return keys, sums.astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def merged(grams: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, words, counts) of n-grams, with those that follow one another in the order of their hashes added up if they are the
    same words. Others of the same hash stay apart; where they alternate, one may come twice, and is added up later."""
    keys, words, n = map(np.concatenate, zip(*grams))
    order = np.argsort(keys)
    keys, words, n = keys[order], words[order], n[order]
    new = keys[1:] != keys[:-1]
    for column in words.T:
        new |= column[1:] != column[:-1]
    first = np.concatenate([[0], np.flatnonzero(new) + 1])
    return keys[first], words[first], np.add.reduceat(n, first)


def place(keys: np.ndarray) -> np.ndarray:
    """Place of a key in the bitmap."""
    return (keys >> np.uint64(7)).astype(np.int64) & (BITS - 1)


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = place(keys)
    return (bits[at >> 6] >> (at & 63)) & 1 == 1


def possible(words: np.ndarray, lang: np.ndarray, hashes: np.ndarray, longest: int, bits: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, keys, where) of the n-grams of k words whose pairs, as far as there are such, all pass."""
    pairs = None
    for k, (key, whole) in enumerate(ngrams(words, hashes, longest), 1):
        mixed = spread(key ^ lang[: len(key)])
        if k == 2 and bits is not None:
            pairs = whole & passes(bits, mixed)
        good = whole
        if k > 2 and pairs is not None:
            good = whole.copy()
            for at in range(k - 1):
                good &= pairs[at : at + len(whole)]
        where = np.flatnonzero(good)
        yield k, mixed[where], where


def bitmap(keys: DataFrame) -> np.ndarray:
    """The bitmap of fixed size of all keys; its words are made in Spark."""
    at = F.shiftright("key", 7).bitwiseAND(F.lit(BITS - 1))
    words = keys.select(at.alias("p")).groupBy(F.shiftright("p", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("word"))
    found = words.toPandas()
    bits = np.zeros(BITS // 64, np.int64)
    bits[found["at"].to_numpy(np.int64)] = found["word"].to_numpy(np.int64)
    return bits


def summarised(docs: DataFrame, sizes: tuple[int, ...], bits: np.ndarray | None, least: int, partitions: int, counters: int) -> DataFrame:
    """(key) of every n-gram of these sizes that may have `least` occurrences. docs: lang, text."""
    shared = None if bits is None else docs.sparkSession.sparkContext.broadcast(bits)

    def send(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        part = ((keys >> np.uint64(33)) % np.uint64(partitions)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        keys, counts, part = keys[order], counts[order], part[order]
        cuts = np.flatnonzero(np.diff(part)) + 1
        packed = [[x.tobytes() for x in np.split(a, cuts)] for a in (keys, counts.astype(np.uint32))]
        first = part[np.concatenate([[0], cuts])]
        return pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), *(pa.array(p, pa.binary()) for p in packed)], ["part", "keys", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, n = Words(), [], 0
        for batch in text_parts(batches, 1):
            words, lang = numbered(known, batch.column(0).to_pylist(), batch.column(1).to_pylist())
            hashes = np.array(known.hashes, np.uint64)
            for k, keys, _ in possible(words, lang, hashes, max(sizes), shared.value if shared else None):
                if k in sizes and len(keys):
                    held.append(added(keys))
                    n += len(held[-1][0])
            if len(known) > KNOWN:
                known = Words()
            if n > HELD or len(held) > 1024:
                yield send(*added(*map(np.concatenate, zip(*held))))
                held, n = [], 0
        if held:
            yield send(*added(*map(np.concatenate, zip(*held))))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, summary = None, None
        out = lambda s: pa.RecordBatch.from_arrays([pa.array(s.frequent().view(np.int64))], ["key"])
        for batch in batches:
            for p, keys, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if p != part:
                    if summary:
                        yield out(summary)
                    part, summary = p, Summary(least, counters)
                summary.add(np.frombuffer(keys.as_buffer(), np.uint64), np.frombuffer(counts.as_buffer(), np.uint32).astype(np.int64))
        if summary:
            yield out(summary)

    sent = docs.mapInArrow(freeing(count), "part long, keys binary, counts binary")
    return sent.repartition("part").sortWithinPartitions("part").mapInArrow(freeing(merge), "key long")


def counted(docs: DataFrame, bits: np.ndarray, least: int, partitions: int) -> DataFrame:
    """(lang, phrase, words, n) of every n-gram that passes the bitmap and has `least` occurrences; the phrase of no words counts
    all words. Tasks send what they counted packed to the partitions of the phrases' hashes, which add it up."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def send(held: dict, totals: dict, known: Words) -> pa.RecordBatch:
        packed: dict[tuple[int, str], tuple[list[bytes], list[bytes]]] = {}
        names = np.array(known.words, object)
        for (lang, _), grams in held.items():
            keys, words, n = merged(grams)
            part = ((keys >> np.uint64(33)) % np.uint64(partitions)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            part, n, spelled = part[order], n[order], names[words[order]]
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for start, end in zip(cuts, cuts[1:]):
                said, counts = packed.setdefault((int(part[start]), lang), ([], []))
                said.append(b"\n".join(map(b" ".join, spelled[start:end].tolist())))
                counts.append(n[start:end].tobytes())
        for lang, n in totals.items():
            said, counts = packed.setdefault((0, lang), ([], []))
            said.append(b"")
            counts.append(np.int64(n).tobytes())
        columns = [pa.array([part for part, _ in packed], pa.int64()), pa.array([lang for _, lang in packed], pa.string())]
        columns.append(pa.array([b"\n".join(p) for p, _ in packed.values()], pa.binary()))
        columns.append(pa.array([b"".join(n) for _, n in packed.values()], pa.binary()))
        return pa.RecordBatch.from_arrays(columns, ["part", "lang", "phrases", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What was found, by language and number of words: hashes, word numbers and counts.
        known, held, totals, n = Words(), {}, {}, 0
        for batch in text_parts(batches, 1):
            langs, texts = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
            for lang in dict.fromkeys(langs):
                at = np.flatnonzero(langs == lang)
                words, mix = numbered(known, [lang] * len(at), [texts[i] for i in at])
                hashes = np.array(known.hashes, np.uint64)
                for k, keys, where in possible(words, mix, hashes, LONGEST, shared.value):
                    if k == 1:
                        totals[lang] = totals.get(lang, 0) + len(where)
                    good = passes(shared.value, keys)
                    keys, where = keys[good], where[good]
                    if len(where):
                        grams = np.stack([words[where + at] for at in range(k)], 1).astype(np.int32)
                        held.setdefault((lang, k), []).append(merged([(keys, grams, np.ones(len(keys), np.int64))]))
                        n += len(held[lang, k][-1][0])
            if n > HELD // 2:
                held = {of: [merged(grams)] for of, grams in held.items()}
                n = sum(len(grams[0][0]) for grams in held.values())
            if n > HELD // 4 or len(known) > KNOWN:
                yield send(held, totals, known)
                held, totals, n = {}, {}, 0
            if len(known) > KNOWN:
                known = Words()
        if totals:
            yield send(held, totals, known)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(lang: str, held: dict) -> pa.RecordBatch:
            enough = {p: n for p, n in held.items() if n >= least or not p}
            sizes = [p.count(b" ") + 1 if p else 0 for p in enough]
            columns = [pa.array([lang] * len(enough), pa.string()), pa.array(list(enough), pa.binary())]
            return pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int32()), pa.array(list(enough.values()), pa.int64())], ["lang", "phrase", "words", "n"])

        of, held = None, {}
        for batch in batches:
            for part, lang, phrases, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if (part, lang) != of:
                    if held:
                        yield rows(of[1], held)
                    of, held = (part, lang), {}
                for phrase, n in zip(phrases.split(b"\n"), np.frombuffer(counts, np.int64).tolist()):
                    held[phrase] = held.get(phrase, 0) + n
        if held:
            yield rows(of[1], held)

    sent = docs.mapInArrow(freeing(count), "part long, lang string, phrases binary, counts binary")
    return sent.repartition("part").sortWithinPartitions("part", "lang").mapInArrow(freeing(merge), "lang string, phrase binary, words int, n long")


def counts(df: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, counters: int = COUNTERS) -> DataFrame:
    """(lang, phrase, words, n): all n-grams of one to four words with at least so many occurrences in their language, and
    as the phrase of no words the number of all its words."""
    docs = df.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    # A word takes a character and one that ends it: words and pairs are no more than characters and texts.
    mass = docs.agg(F.sum(F.length("text") + 1).alias("m")).first().m or 0
    partitions = 1 + 2 * mass // (least * counters)
    first = materialize(summarised(docs, (1, 2), None, least, partitions, counters), "frequent-pairs")
    longer = materialize(summarised(docs, tuple(range(3, LONGEST + 1)), bitmap(first), least, partitions, counters), "frequent-phrases")
    found = counted(docs, bitmap(first.unionByName(longer)), least, partitions)
    return materialize(found.select("lang", F.decode("phrase", "utf-8").alias("phrase"), "words", "n"), "phrase-counts")


def phrases(
    df: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, inside: int = 80, top: int = 2000, counters: int = COUNTERS
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of two to four words of each language.

    Only A-Z is lower-cased. a, l and r are the occurrences of the phrase and of the two parts its lowest-scoring cut gives
    (ties: the earliest), n of all words of the language; score is floor(2000000 a / (l + r)). A phrase goes if a longer one that
    holds it has `inside` percent of its occurrences. Rows without a language are of `und`; null and empty texts
    have no words, and count for nothing. Repeated rows count as often as they occur; an empty table gives an empty result.
    Other columns of any name are not read.
    """
    known = counts(df, text, lang, least, counters)
    some = known.where("words > 0")
    several = some.where("words > 1")
    cuts = several.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', cut)"))
    cuts = cuts.withColumn("right", F.expr("substring(phrase, length(left) + 2)"))
    part = lambda p, n: some.select("lang", F.col("phrase").alias(p), F.col("n").alias(n))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    # Products of 64-bit counts: decimals.
    score = F.expr(f"cast({SCALE} as decimal(7, 0)) * cast(n as decimal(20, 0)) div (cast(l as decimal(20, 0)) + r)")
    best = cuts.groupBy("lang", "phrase", "words", F.col("n").alias("a")).agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))

    def within(size: int, wider: int) -> DataFrame:
        """The parts of `size` words of phrases of `wider` words."""
        at = F.explode(F.sequence(F.lit(0), F.lit(wider - size)))
        parts = several.where(F.col("words") == wider).select("lang", F.split("phrase", " ").alias("w"), F.col("n").alias("longer"), at.alias("at"))
        return parts.select("lang", F.array_join(F.slice("w", F.col("at") + 1, size), " ").alias("phrase"), "longer")

    held = within(2, 3).unionByName(within(2, 4)).unionByName(within(3, 4)).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    scored = best.join(held, ["lang", "phrase"], "left")
    scored = scored.where("longer is null or cast(100 as decimal(3, 0)) * cast(longer as decimal(20, 0)) < " f"cast({inside} as decimal(3, 0)) * cast(a as decimal(20, 0))")
    rows = scored.select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score"))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The first of every 64th of a language, then of those: no task gets more than 64 times `top` rows of a language.
    rows = rows.withColumn("at", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "at").orderBy(*order))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    total = known.where("words = 0").select("lang", F.col("n"))
    out = rows.join(total, "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
