"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

All of it is DataFrame functions. A block is what stands between blank lines or sentence ends (line breaks inside it are
white space, so that wrapped notices are whole; the dot of "v. 2" ends none); its set is that of its words, A-Z
lower-cased. A template is found in a block that contains ``threshold`` of its words or more. The join is exact:
template words are ordered by their count in the whole corpus, rarest first, and a block can only reach the threshold
if it has a word of the template's prefix (prefix filter), enough words (length filter) and, counted from the place of
the first shared word in either order, enough words left (positional filter). What passes is verified.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countloom.llm.common import written

#: Not in a word: all ASCII but digits and letters (texts are lower-cased).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK_END = r"[.!?]+[ \t\r\f\n]+|\n[ \t\r\f]*\n"
VERSION = r"\b([vV])\."
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases and the label of each.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Statements that licenses ask works to carry, and the label of each.
TEMPLATES = [
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("all-rights-reserved", "all rights reserved"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), BETWEEN), "")


def places(words: Column, phrase: str) -> Column:
    """Where the phrase's words stand consecutively (an array of starts)."""
    own = phrase.split()
    starts = F.sequence(F.lit(0), F.size(words) - len(own))

    def here(i: Column) -> Column:
        found = F.get(words, i) == own[0]
        for k, w in enumerate(own[1:], 1):
            found = found & (F.get(words, i + k) == w)
        return found

    rare = F.array_contains(words, max(own, key=len))
    return F.when((F.size(words) >= len(own)) & rare, F.filter(starts, here)).otherwise(F.array().cast("array<int>"))


def word_counts(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> DataFrame:
    """word, n over the whole table, of the vocabulary's words."""
    kept = F.filter(words_of(F.col(text_col)), lambda w: w.isin(*vocabulary))
    return docs.select(F.explode(kept).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def scan(docs: DataFrame, *, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None, threshold: float = 0.94, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables: a row a document, and a row for each block and template that meet.

    Documents: row (a number of its own), doc_id, n_words, n_base, first_word, last_word (of phrase starts; null
    without), base_labels, labels, score (the greatest containment found; a phrase counts as 1; else 0). Matches: row,
    doc_id, block_no, label, block, containment. A null text counts as empty; null and repeated ids keep their rows; repeated
    words of a block or template count once.
    """
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    sets = [(label, sorted(set(t.lower().split()))) for label, t in templates]
    vocabulary = sorted({w for _, s in sets for w in s})
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # One count for each word of the templates, however large the corpus is.
    counts = {r.word: r.n for r in word_counts(own, vocabulary).collect()}
    rank = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    rows, probes = [], []
    for number, (label, s) in enumerate(sets):
        order = sorted(rank[w] for w in s)
        need = ceil(threshold * len(order) - 1e-9)
        rows.append((number, label, order, need))
        probes += [(r, number, k) for k, r in enumerate(order[: len(order) - need + 1])]
    prefix_words = sorted({w for w in vocabulary if rank[w] in {r for r, _, _ in probes}})

    words = F.col("words")
    starts = F.concat(*(places(words, p) for p in phrases))
    base = [F.when(F.size(places(words, p)) > 0, F.lit(label)) for p, label in phrases.items()]
    read = own.select("doc_id", "text", words_of(F.col("text")).alias("words"))
    read = read.select("doc_id", F.size("words").alias("n_words"), starts.alias("starts"), F.array_sort(F.array_distinct(F.array_compact(F.array(*base)))).alias("base"), F.when(F.arrays_overlap(words, F.array(*map(F.lit, prefix_words))), F.col("text")).alias("candidate"))
    read = written(read.withColumn("row", F.monotonically_increasing_id()), "licenses")

    ranks = F.create_map(*(x for w, k in rank.items() for x in (F.lit(w), F.lit(k))))
    blocks = read.where("candidate IS NOT NULL").select("row", "doc_id", F.posexplode(F.split(F.regexp_replace("candidate", VERSION, "$1 "), BLOCK_END)).alias("block_no", "block"))
    blocks = blocks.withColumn("set", F.array_distinct(words_of(F.col("block")))).withColumn("n_set", F.size("set"))
    known = F.array_sort(F.transform(F.filter("set", lambda w: w.isin(*vocabulary)), lambda w: ranks[w]))
    blocks = blocks.withColumn("ranks", known).where(F.size("ranks") > 0)
    entries = blocks.select("row", "doc_id", "block_no", "block", "n_set", "ranks", F.posexplode("ranks").alias("at", "rank"))
    # Templates and their prefixes are as many as the caller's list has.
    prefixes = spark.createDataFrame(probes, "rank int, template int, place int")
    table = spark.createDataFrame(rows, "template int, label string, template_ranks array<int>, need int")
    table = prefixes.join(table, "template").withColumn("size", F.size("template_ranks"))
    near = entries.join(F.broadcast(table), "rank")
    near = near.where("n_set >= need")  # length
    near = near.where("1 + least(n_set - at - 1, size - place - 1) >= need")  # position
    shared = F.size(F.array_intersect("ranks", "template_ranks"))
    met = near.withColumn("containment", shared / F.col("size")).where(shared >= F.col("need"))
    matches = met.groupBy("row", "doc_id", "block_no", "block", "template", "label").agg(F.max("containment").alias("containment")).drop("template")

    found = matches.groupBy("row").agg(F.collect_set("label").alias("found"), F.max("containment").alias("containment"))
    joined = read.join(found, "row", "left")
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("found", F.array().cast("array<string>")))))
    documents = joined.select(
        "row",
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )
    return documents, matches


def oracle_sql(threshold: float = 0.94) -> str:
    """DuckDB SQL of the documents' rows (all but ``row``): every block against every template."""
    sep = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    quoted = ", ".join(f"({k}, '{label}', {sorted(set(t.split()))!r})" for k, (label, t) in enumerate(TEMPLATES))
    tests = []
    for phrase, label in PHRASES.items():
        own = phrase.split()
        tests.append(f"SELECT doc_id, i, '{label}' AS label FROM places WHERE " + " AND ".join(f"words[i + {k + 1}] = '{w}'" for k, w in enumerate(own)))
    return rf"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{sep}'), lambda x: x <> '') AS words FROM documents
), places AS (SELECT doc_id, words, unnest(range(len(words))) AS i FROM docs WHERE list_has_any(words, ['mit', 'apache', 'nc'])
), base AS ({" UNION ALL ".join(tests)}
), by_doc AS (
  SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list_distinct(list(label))) AS labels
  FROM base GROUP BY doc_id
), blocks AS (
  SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '\b([vV])\.', '\1 ', 'g'), '[.!?]+[ \t\r\f\n]+|\n[ \t\r\f]*\n')) AS block FROM docs
), sets AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(translate(block, '{UPPER}', '{LOWER}'), '{sep}'), lambda x: x <> '')) AS s FROM blocks
), templates(k, label, t) AS (VALUES {quoted}
), met AS (
  SELECT doc_id, label, len(list_intersect(s, t)) / len(t) AS c FROM sets, templates
  WHERE len(list_intersect(s, t)) >= ceil({threshold} * len(t) - 1e-9)
), found AS (SELECT doc_id, list_distinct(list(label)) AS labels, max(c) AS c FROM met GROUP BY doc_id)
SELECT d.doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(b.labels, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(c, 0.0) END::DOUBLE AS score
FROM docs d LEFT JOIN by_doc b USING (doc_id) LEFT JOIN found f USING (doc_id)
"""
