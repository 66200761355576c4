"""License scans by diagonal voting.

Every text's runs of two and three words are hashed and joined with the positions of the same runs in the templates.
A run at word i of the text and word j of a template votes for the diagonal i - j. Votes are summed by diagonal;
neighbouring diagonals of one template that lie side by side in the text are merged, so that a few words too many or
too few don't part a passage; a passage is verified by the share of the template's runs that it covers, each counted once, and has
its label if that is enough. The words of each vote are compared, not just their hashes. The base phrases are templates of one run each.

The templates are a fixed list of some 1,500 runs, so they are broadcast. Each text is read once: besides the runs that
some template has, it sends one row for itself. Only votes and that row are shuffled, after partial aggregation. Time is
linear in a text's length, which is bounded by a row's size only.

Defined results: null text counts as empty; documents without a label have empty strings and score 0; rows that repeat a
doc_id are rows of their own; an empty table gives an empty result; columns besides doc_id and text are ignored.
Everything is DataFrame functions on the main path.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm import license_texts
from tidelog.llm.common import table

#: Phrases and labels that are found wherever the words stand.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Sentences and whole texts of public licenses, and their labels.
PASSAGES = (*license_texts.SENTENCES, *license_texts.WHOLE)
#: Share of a passage's runs that must be found, words by which neighbouring diagonals may differ, and words between them.
COVER, SHIFT, GAP = 0.8, 3, 6
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_OWN = "#"  # no word: the hash of the row that each document sends for itself
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(_UPPER, _LOWER)))


def template_rows(base=BASE, passages=PASSAGES) -> list[tuple]:
    """template, label, is_base, n_runs, at (word of the template, 0 the first), a, b, c (null in a run of two)."""
    out = [(0, "", False, 1, 0, _OWN, _OWN, _OWN)]
    for number, (text, label) in enumerate([*base, *passages], 1):
        words, is_base = words_of(text), number <= len(base)
        if len(words) < 2 or is_base and len(words) > 3:
            raise ValueError(f"a base phrase has two or three words, a passage two or more: {text}")
        k = min(3, len(words))
        runs = [words[i : i + k] + [None] * (3 - k) for i in range(len(words) - k + 1)]
        out += [(number, label, is_base, len(runs), i, *run) for i, run in enumerate(runs)]
    return out


def _lowered(text: Column) -> Column:
    """A-Z in lower case. lower() is quick and changes more, but never to or from an ASCII character, once the two that it
    would turn into ASCII are out of the way; words that aren't ASCII match nothing here."""
    out = F.coalesce(text, F.lit(""))
    for sign, other in (("\u212a", "\ue000"), ("\u0130", "\ue001")):
        out = F.replace(out, F.lit(sign), F.lit(other))
    return F.lower(out)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(_lowered(text), F.lit(WORD), F.lit(0))


def run_hash(words: list[str]) -> int:
    """What the engine's xxhash64 of these columns is."""
    from xxhash import xxh64_intdigest

    out = 42
    for w in words:
        out = xxh64_intdigest(w.encode(), out)
    return out - (1 << 64) if out >> 63 else out


def votes(docs: DataFrame, base=BASE, passages=PASSAGES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, version (of the text, where rows repeat a doc_id), n_words, template, diagonal, n, first, last, places (of the
    template; no more than it has).

    All runs of a text are hashed where its words are. Only places whose hash some template has leave the array, with their
    two or three words: time and memory are linear in the text's length.
    """
    listed = template_rows(base, passages)
    templates = docs.sparkSession.createDataFrame(listed, "template int, label string, is_base boolean, n_runs int, at int, a string, b string, c string")
    templates = templates.withColumn("hash", F.xxhash64("a", "b", "c")).select("hash", "template", "at", "a", "b", "c")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("version"), _words(F.col(text)).alias("words"))
    rows = rows.withColumn("n_words", F.size("words"))
    hits = [f"array(named_struct('word', 0, 'a', '{_OWN}', 'b', '{_OWN}', 'c', '{_OWN}'))"]
    for k in (2, 3):
        known = {run_hash([w for w in row[5:] if w is not None]) for row in listed if row[5] != _OWN and 3 - (row[7] is None) == k}
        if not known:
            continue
        run = ", ".join(f"get(words, i + {j})" for j in range(k))
        last = "get(words, i + 2)" if k == 3 else "CAST(NULL AS STRING)"
        places = f"filter(sequence(0, n_words - {k}), i -> xxhash64({run}) IN ({', '.join(f'{h}L' for h in sorted(known))}))"
        found = f"transform({places}, i -> named_struct('word', i, 'a', get(words, i), 'b', get(words, i + 1), 'c', {last}))"
        hits.append(f"if(n_words >= {k}, {found}, array())")
    rows = rows.select("doc_id", "version", "n_words", F.explode(F.expr(f"concat({', '.join(hits)})")).alias("hit"))
    rows = rows.select("doc_id", "version", "n_words", "hit.*").withColumn("hash", F.xxhash64("a", "b", "c"))
    # The hash passes over nulls, so the words are compared too.
    t = F.broadcast(templates).alias("t")
    same = (rows["hash"] == F.col("t.hash")) & (rows["a"] == F.col("t.a")) & (rows["b"] == F.col("t.b")) & rows["c"].eqNullSafe(F.col("t.c"))
    found = rows.join(t, same).select("doc_id", "version", "n_words", "template", (F.col("word") - F.col("at")).alias("diagonal"), "word", "at")
    sums = F.count(F.lit(1)).alias("n"), F.min("word").alias("first"), F.max("word").alias("last"), F.collect_set("at").alias("places")
    return found.groupBy("doc_id", "version", "n_words", "template", "diagonal").agg(*sums)


def scan(docs: DataFrame, base=BASE, passages=PASSAGES, cover: float = COVER, shift: int = SHIFT, gap: int = GAP, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label, first, last, score)."""
    key = ["doc_id", "version", "n_words"]
    about = docs.sparkSession.createDataFrame([(t, label, is_base, n) for t, label, is_base, n, at, *_ in template_rows(base, passages) if at == 0], "template int, label string, is_base boolean, n_runs int")
    found = votes(docs, base, passages, text, doc_id).join(F.broadcast(about), "template")
    # Rows of one document with one text send everything as often as they are: that is how often its row comes back.
    order = Window.partitionBy(*key, "template").orderBy("diagonal")
    before = lambda c: F.lag(c).over(order)
    apart = (F.col("diagonal") - before("diagonal") > shift) | (F.col("first") - before("last") > gap) | (before("first") - F.col("last") > gap)
    found = found.withColumn("new", F.coalesce(F.col("is_base") | apart, F.lit(True)).cast("int"))
    found = found.withColumn("passage", F.sum("new").over(order))
    sums = F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")
    covered = F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("covered")
    spans = found.groupBy(*key, "template", "label", "is_base", "n_runs", "passage").agg(*sums, covered)
    own = F.col("template") == 0
    times = F.max(F.when(own, F.col("n"))).over(Window.partitionBy(*key))
    spans = spans.withColumn("times", times).withColumn("score", F.col("covered") / F.col("n_runs"))
    base_hit = F.col("is_base")
    hit = ~own & (base_hit | (F.col("score") >= cover))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    out = spans.groupBy(*key, "times").agg(
        F.count_if(base_hit).alias("n_base"),
        F.min(F.when(base_hit, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base_hit, F.col("first"))).cast("long").alias("last_word"),
        joined(base_hit).alias("base_labels"),
        joined(hit).alias("labels"),
        F.coalesce(F.max(F.when(~own, F.col("score"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(hit, F.struct("label", "first", "last", "score")))).alias("spans"),
    )
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("spans")


def base_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of the query: its base columns."""
    return query(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


SQL = r"""
WITH t AS (
    SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), hits AS (
    SELECT row, i - 1 AS word, CASE w[i] WHEN 'mit' THEN 'mit' WHEN 'apache' THEN 'apache' ELSE 'gpl' END AS label
    FROM (SELECT row, w, unnest(range(1, len(w))) AS i FROM t WHERE list_has_any(w, ['license']))
    WHERE w[i] IN ('mit', 'apache') AND w[i + 1] = 'license' OR w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license'
), sums AS (
    SELECT row, count(*) AS n_base, min(word) AS first_word, max(word) AS last_word,
           string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
    FROM hits GROUP BY row
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels
FROM t LEFT JOIN sums USING (row)
"""
