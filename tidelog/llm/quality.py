"""Quality rules: written rules, then perplexity bands under a modified Kneser-Ney n-gram model.

The model is over runs of ORDER bytes of UTF-8, one per language. Python workers count the runs of each batch and
Spark adds them up over the distinct texts of all documents that are references, so copies of a text count once; lower orders, counts of counts, discounts and back-off
weights come from joins and aggregations of those counts (Chen and Goodman, 1998). References are all documents that
pass the written rules, have at most one symbol for ten words, and mostly lower-case letters; none is sampled. The
finished model is a table of exact runs, which grows with the distinct runs of the corpus. Scoring gets it as sorted arrays
for each language and order. Where it has more than MOST entries, it is cut into shards that are broadcast one after another,
each for one pass over the documents. A run's shard follows from its second and third byte from the end: all its longer
suffixes and contexts have these too, and entries of at most two bytes are in each shard, so a shard settles its runs alone.

A document's score is its mean negative log probability for each byte, in thousandths of a nat. A language's band
runs from BAND interquartile ranges below the references' lower quartile to as many above the upper one, from exact
counts of the scores of the references' distinct texts. Documents outside the band are rejected: above it what the language does not
look like (symbols, shouting, tables), below it what repeats itself.

Defined results: null text has no words; null language is a language of its own; a language without references has no
band, and the written rules alone decide; rows that repeat a doc_id are rows of their own, in keep_good too; an empty table gives an
empty result; columns besides doc_id, text and lang are ignored.
"""

from __future__ import annotations

import functools
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.common import discard, free_shuffles, keep_rows, table, tidy, written

ORDER = 5
#: Entries of the model that are broadcast at once, of about 12 bytes each.
MOST = 1 << 22
#: Bits of the number of places that texts' keys are marked in if several rows have them: a table of 2 MB.
PLACES = 24
BAND = 6.0
#: A band's least reach beyond the quartiles, in thousandths of a nat.
LEAST = 60
MIN_WORDS = 50
#: Bytes whose runs are sorted at once; a longer text is scored in pieces.
_CHUNK, _PIECE = 4 << 20, 1 << 20
_SYMBOLS = [bytes([b]) for b in b"#*$%&|<>"]
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_COLUMNS = [("doc_id", pa.int64()), ("lang", pa.string()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("reference", pa.bool_()), ("size", pa.int64()), ("micro", pa.int64()), ("tag", pa.int64())]
_SQL_COLUMNS = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, reference boolean, size long, micro long, tag long"


def repeat_words(words: list[bytes]) -> int:
    """How many words lie in a three-word window that the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:]))  # noqa: B905
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    hit, last = 0, -1
    for i, w in enumerate(windows):
        if w in often:
            hit += i + 2 - max(last, i - 1)
            last = i + 2
    return hit


def base(data: bytes, n_code_points: int) -> tuple[int, int, int, int, int, bool, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, reference of a text in UTF-8."""
    words = data.split()
    n, repeats, symbols = len(words), repeat_words(words), sum(map(data.count, _SYMBOLS))
    lines = [x for line in data.split(b"\n") if (x := line) and not x.isspace()]
    failed = n < MIN_WORDS or 100 * repeats > 50 * n
    fine = not failed and 10 * symbols <= n
    if fine:
        letters = len(data) - len(data.translate(None, _UPPER)), len(data) - len(data.translate(None, _LOWER))
        fine = 3 * letters[0] <= max(letters[1], len(data) // 3)
    return n, n_code_points - (len(data) - sum(map(len, words))), symbols, len(lines) - len(set(lines)), repeats, failed, fine


def _rows(batch, order):
    """Of each row: doc_id, lang, base(...), and the text in bytes."""
    for doc_id, text, lang in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
        data = text.as_buffer().to_pybytes() if text.is_valid else b""
        yield doc_id, lang or "", data


def _code_points(data: bytes) -> int:
    return len(data) - int(np.count_nonzero(np.frombuffer(data, np.uint8) >> 6 == 2)) if data else 0


def _runs(pieces: list[bytes], order: int) -> np.ndarray:
    """The run of `order` bytes that ends at each byte of the pieces; each piece brings order - 1 bytes of context."""
    flat = np.frombuffer(b"".join(pieces), np.uint8)
    n = len(flat) - order + 1
    runs = np.zeros(max(n, 0), np.uint64)
    for j in range(order):
        runs = runs << np.uint64(8) | flat[j : j + n]
    keep = np.ones(len(runs), bool)
    at = 0
    for piece in pieces[:-1]:
        at += len(piece)
        keep[at - order + 1 : at] = False  # runs that span two pieces
    return runs[keep]


def _pieces(data: bytes, order: int):
    pad = b"\n" * (order - 1)
    for at in range(0, len(data), _PIECE):
        yield (pad if at == 0 else data[at - order + 1 : at]) + data[at : at + _PIECE]


def _counts(order: int):
    def flush(held, total):
        for lang, pieces in held.items():
            runs, n = np.unique(_runs(pieces, order), return_counts=True)
            total.setdefault(lang, []).append((runs, n))
        held.clear()

    def merged(parts):
        runs, back = np.unique(np.concatenate([r for r, _ in parts]), return_inverse=True)
        return runs, np.bincount(back, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

    def run(batches):
        for batch in batches:
            held, total, size = {}, {}, 0
            for _, lang, data in _rows(batch, order):
                if not base(data, 0)[-1]:
                    continue
                held.setdefault(lang, []).extend(_pieces(data, order))
                size += len(data)
                if size >= _CHUNK:
                    flush(held, total)
                    size = 0
            flush(held, total)
            for lang, parts in total.items():
                runs, n = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(runs)), pa.array(runs.astype(np.int64)), pa.array(n)], names=["lang", "run", "n"])

    return run


def _text_columns(docs: DataFrame, text: str, doc_id: str, lang: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"), F.col(lang).cast("string").alias("lang"), _tag(text, lang).alias("tag"))


def _tag(text: str, lang: str):
    return F.xxhash64(F.col(text), F.col(lang))


def _places(docs: DataFrame, text: str, lang: str, bits: int) -> DataFrame:
    """text, lang, key, and the key's place of 2 ** bits: a word of 64 places, and its mark in it."""
    rows = docs.select(F.col(text).cast("binary").alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"))
    rows = rows.withColumn("key", F.xxhash64("text", "lang"))
    return rows.withColumns({"word": F.shiftrightunsigned("key", 70 - bits), "mark": F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - bits}) & 63 AS int))")})


def _copied(docs: DataFrame, text: str, lang: str, bits: int = PLACES) -> DataFrame:
    """word, marks: the places of keys that several rows have. However many these are, the table has a fixed size at most."""
    often = _places(docs, text, lang, bits).groupBy("key", "word", "mark").count().filter("count > 1")
    return often.groupBy("word").agg(F.bit_or("mark").alias("marks"))


def _distinct(docs: DataFrame, copied: DataFrame, text: str, lang: str, bits: int = PLACES) -> DataFrame:
    """doc_id (none), text, lang: each text of a language once.

    A text in a place that isn't marked has no copy and is not shuffled. The others are, by two hashes; copies meet in the
    partial aggregation, so none is hot.
    """
    rows = _places(docs, text, lang, bits).join(F.broadcast(copied), "word", "left")
    marked = F.coalesce(F.col("marks").bitwiseAND(F.col("mark")) != 0, F.lit(False))
    once = rows.filter(marked).groupBy("lang", F.xxhash64("text").alias("one"), F.xxhash64(F.lit(1), "text").alias("two")).agg(F.first("text").alias("text"))
    return rows.filter(~marked).select("text", "lang").unionByName(once.select("text", "lang")).select(F.lit(None).cast("long").alias("doc_id"), "text", "lang")


def _shard(part, shards: int):
    """The shard of the two bytes before a run's last one, dealt by an odd factor; for arrays and for columns."""
    mixed = part * 40503 % 65536 * shards
    return F.floor(mixed / 65536) if isinstance(part, Column) else mixed // 65536


def model(docs: DataFrame, order: int = ORDER, text: str = "text", lang: str = "lang") -> dict[int, DataFrame]:
    """k -> lang, kind, run, value; kind 2k has probabilities of runs of k bytes, 2k + 1 weights of their contexts."""
    copied = written(_copied(docs, text, lang), "copied")
    counted = _distinct(docs, copied, text, lang).mapInArrow(tidy(_counts(order)), "lang string, run long, n long").groupBy("lang", "run").agg(F.sum("n").alias("n"))
    now, out = written(counted, "counts"), {}
    discard(copied)
    free_shuffles(docs.sparkSession)
    # Each order is a table of its own: short plans.
    for k in range(order, 0, -1):
        tally = now.groupBy("lang").agg(*(F.count_if(F.col("n") == i).cast("double").alias(f"t{i}") for i in (1, 2, 3, 4)))
        y = F.col("t1") / F.greatest(F.col("t1") + 2 * F.col("t2"), F.lit(1.0))
        cut = [F.least(F.lit(float(i)), F.greatest(F.lit(0.05), i - (i + 1) * y * F.col(f"t{i + 1}") / F.greatest(F.col(f"t{i}"), F.lit(1.0)))).alias(f"d{i}") for i in (1, 2, 3)]
        context = now.groupBy("lang", F.shiftright("run", 8).alias("context")).agg(F.sum("n").alias("total"), *(F.count_if(c).alias(f"c{i}") for i, c in ((1, F.col("n") == 1), (2, F.col("n") == 2), (3, F.col("n") > 2))))
        context = context.join(tally.select("lang", *cut), "lang")
        less = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        seen = now.withColumn("context", F.shiftright("run", 8)).join(context, ["lang", "context"])
        own = seen.select("lang", F.lit(2 * k).alias("kind"), "run", ((F.col("n") - less) / F.col("total")).alias("value")).unionByName(
            context.select("lang", F.lit(2 * k + 1).alias("kind"), F.col("context").alias("run"), ((F.col("d1") * F.col("c1") + F.col("d2") * F.col("c2") + F.col("d3") * F.col("c3")) / F.col("total")).alias("value"))
        )
        out[k] = written(own.withColumn("value", F.col("value").cast("float")), "model")
        if k > 1:
            lower = written(now.groupBy("lang", F.col("run").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)).alias("run")).agg(F.count(F.lit(1)).alias("n")), "counts")
            discard(now)
            now = lower
    discard(now)
    return out


def _arrays(tables: dict[int, DataFrame], shard: int, shards: int) -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]:
    """(lang, kind) -> sorted runs and their values, of a shard. Each order comes to the driver on its own."""
    out = {}
    for k, rows in tables.items():
        if shards > 1 and k > 2:
            part = F.when(F.col("kind") == 2 * k, F.shiftright("run", 8)).otherwise(F.col("run"))
            rows = rows.filter(_shard(part.bitwiseAND(F.lit(65535)), shards) == shard)
        for kind in (2 * k, 2 * k + 1):
            got = rows.filter(F.col("kind") == kind).select("lang", "run", "value").toArrow()
            names = got.column(0).combine_chunks().dictionary_encode()
            if isinstance(names, pa.ChunkedArray):
                names = names.combine_chunks()
            code, runs, values = names.indices.to_numpy(), got.column(1).to_numpy().view(np.uint64), got.column(2).to_numpy()
            del got
            for i, lang in enumerate(names.dictionary.to_pylist()):
                mine = np.flatnonzero(code == i)
                mine = mine[np.argsort(runs[mine])]
                out[lang, kind] = runs[mine], values[mine]
    return out


def _found(array: tuple[np.ndarray, np.ndarray] | None, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if array is None or not len(array[0]):
        return np.zeros(len(runs), bool), np.zeros(len(runs))
    at = np.minimum(np.searchsorted(array[0], runs), len(array[0]) - 1)
    return array[0][at] == runs, array[1][at].astype(np.float64)


def surprise(arrays: dict, lang: str, runs: np.ndarray, order: int) -> np.ndarray:
    """Negative log probability of the last byte of each run after the others."""
    p = np.full(len(runs), 1 / 256)
    for k in range(1, order + 1):
        own = runs & np.uint64((1 << 8 * k) - 1)
        known, weight = _found(arrays.get((lang, 2 * k + 1)), own >> np.uint64(8))
        seen, value = _found(arrays.get((lang, 2 * k)), own)
        p = np.where(known, np.where(seen, value, 0) + weight * p, p)
    return -np.log(np.maximum(p, 1e-12))


def _sums(arrays, order: int, shard: int, shards: int):
    def sums(rows):
        """Millionths of a nat of each text, of the shard's runs only; the texts (lang, data) are scored in pieces."""
        out, held, size = [], {}, 0

        def flush():
            for lang, (pieces, owners) in held.items():
                runs, back = np.unique(_runs(pieces, order), return_inverse=True)
                if shards == 1:
                    each = surprise(arrays.value, lang, runs, order)
                else:
                    each, mine = np.zeros(len(runs)), _shard((runs >> np.uint64(8) & np.uint64(65535)).astype(np.int64), shards) == shard
                    each[mine] = surprise(arrays.value, lang, runs[mine], order)
                starts = np.concatenate(([0], np.cumsum([len(x) - order + 1 for x in pieces])[:-1]))
                for row, total in zip(owners, np.add.reduceat(each[back], starts), strict=True):
                    out[row] += total
            held.clear()

        for i, (lang, data) in enumerate(rows):
            out.append(0.0)
            for piece in _pieces(data, order):
                pieces, owners = held.setdefault(lang, ([], []))
                pieces.append(piece)
                owners.append(i)
            size += len(data)
            if size >= _CHUNK:
                flush()
                size = 0
        flush()
        return [int(1e6 * x + 0.5) for x in out]

    return sums


def _scores(arrays, order: int, shards: int):
    sums = _sums(arrays, order, 0, shards)

    def run(batches):
        for batch in batches:
            out = {n: [] for n, _ in _COLUMNS}

            def rows(batch=batch, out=out):
                for doc_id, lang, data in _rows(batch, order):
                    for name, value in zip(out, (doc_id, lang, *base(data, _code_points(data)), len(data)), strict=False):
                        out[name].append(value)
                    yield lang, data

            out["micro"] = sums(rows())
            out["tag"] = batch.column(3)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema(_COLUMNS))

    return run


def _more_scores(arrays, order: int, shard: int, shards: int):
    sums = _sums(arrays, order, shard, shards)

    def run(batches):
        for batch in batches:
            sizes = []

            def rows(batch=batch, sizes=sizes):
                for _, lang, data in _rows(batch, order):
                    sizes.append(len(data))
                    yield lang, data

            micro = sums(rows())
            yield pa.RecordBatch.from_arrays([batch.column(3), pa.array(sizes, pa.int64()), pa.array(micro, pa.int64())], names=["tag", "size", "more"])

    return run


def _scored(docs: DataFrame, order: int, most: int, text: str, doc_id: str, lang: str) -> DataFrame:
    """Per row of docs: the written rules' figures, and micro: the negative log probability in millionths of a nat."""
    spark, tables = docs.sparkSession, model(docs, order, text, lang)
    shards = max(1, -(-sum(t.count() for t in tables.values()) // most)) if order > 2 else 1
    rows, scores, more = _text_columns(docs, text, doc_id, lang), None, []
    for shard in range(shards):
        arrays = spark.sparkContext.broadcast(_arrays(tables, shard, shards))
        if shard:
            part = rows.mapInArrow(tidy(_more_scores(arrays, order, shard, shards)), "tag long, size long, more long")
            more.append(written(part.groupBy("tag", "size").agg(F.first("more").alias("more")), "scores"))
        else:
            scores = written(rows.mapInArrow(tidy(_scores(arrays, order, shards)), _SQL_COLUMNS), "scores")
        arrays.destroy()
    for t in tables.values():
        discard(t)
    if not more:
        return scores
    # Texts alike have one sum in each shard, so the sums are joined by text, whatever the number of its rows.
    total = functools.reduce(DataFrame.unionByName, more).groupBy("tag", "size").agg(F.sum("more").alias("more"))
    out = written(scores.join(total, ["tag", "size"]).withColumn("micro", F.col("micro") + F.col("more")).select(scores.columns), "scores")
    for t in (scores, *more):
        discard(t)
    return out


def bands(scores: DataFrame, reach: float = BAND) -> DataFrame:
    """lang, low, high: from exact quartiles of the scores of the references' distinct texts."""
    counts = scores.filter("reference").select("lang", "milli", "tag").distinct().groupBy("lang", "milli").agg(F.count(F.lit(1)).alias("n"))
    so_far, all_ = Window.partitionBy("lang").orderBy("milli"), Window.partitionBy("lang")
    counts = counts.withColumn("to", F.sum("n").over(so_far)).withColumn("total", F.sum("n").over(all_))
    quarters = counts.groupBy("lang").agg(*(F.min(F.when(F.col("to") * 4 >= F.col("total") * q, F.col("milli"))).alias(f"q{q}") for q in (1, 3)))
    wide = F.greatest(F.lit(float(LEAST)), reach * (F.col("q3") - F.col("q1")))
    return quarters.select("lang", (F.col("q1") - wide).alias("low"), (F.col("q3") + wide).alias("high"))


def _judged(docs: DataFrame, order: int, most: int, reach: float, text: str, doc_id: str, lang: str) -> DataFrame:
    milli = F.expr("(2 * micro div greatest(1, size) + 1000) div 2000")
    scores = _scored(docs, order, most, text, doc_id, lang).withColumn("milli", milli)
    out = scores.join(bands(scores, reach), "lang", "left")
    kept = ~F.col("base_failed") & F.coalesce(F.col("milli").between(F.col("low"), F.col("high")), F.lit(True))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.col("milli").alias("score_milli"), "lang", "low", "high", "tag")


def quality(docs: DataFrame, order: int = ORDER, most: int = MOST, reach: float = BAND, text: str = "text", doc_id: str = "doc_id", lang: str = "lang") -> DataFrame:
    """Per row of docs: doc_id, the written rules' figures, base_failed, kept, and the score, lang, low and high."""
    return _judged(docs, order, most, reach, text, doc_id, lang).drop("tag")


def keep_good(docs: DataFrame, order: int = ORDER, most: int = MOST, reach: float = BAND, text: str = "text", doc_id: str = "doc_id", lang: str = "lang") -> DataFrame:
    """docs without the rows that quality() rejects; of rows that share a doc_id, each is judged on its own."""
    verdicts = written(_judged(docs, order, most, reach, text, doc_id, lang).select("doc_id", "tag", "kept"), "verdicts")
    return keep_rows(docs, verdicts, _tag(text, lang), False, doc_id)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)
