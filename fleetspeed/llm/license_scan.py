"""License scans: an exact set-similarity join of text blocks with license templates.

Blocks are twice as long as a stride and start at each stride, so any stretch of a stride lies in one block.
The stride is 32 words, or for a longer template the next power of two that holds it.  A template
is found in a block of its stride that contains at least 90 % of its distinct words.  Template words are
ordered by their count over all documents, rarest first.  A block that reaches the threshold shares
one of a template's first ``|T| - needed + 1`` words (prefix filter), has at least ``needed`` template
words (length filter), and has enough words left behind the first shared one on either side
(positional filter); what passes is counted exactly.  Words that no template has can't matter and are
left out first.  Templates are a parameter, so the join's other side is as small as they are.

Beside the join, set phrases are located word by word; their labels always count.

Null and empty texts have no words and no labels.  Rows with the same ``doc_id`` and text are one
document and get the same result; a null ``doc_id`` is an id like any other.  Empty input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspeed.llm.common import let, same_document, with_text

# Fixed values of the query's definition: word pattern, phrases and labels.
LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Public wording of licenses, by label.
TEMPLATES = (
    ("mit", "released under the mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software"
        " and associated documentation files",
    ),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted"
        " provided that the following conditions are met",
    ),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files the software to deal in the software without restriction including without limitation the"
        " rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit"
        " persons to whom the software is furnished to do so subject to the following conditions the above copyright notice"
        " and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby"
        " granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the"
        " license you may obtain a copy of the license at unless required by applicable law or agreed to in writing software"
        " distributed under the license is distributed on an as is basis without warranties or conditions of any kind either"
        " express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
)
STRIDE = 32
NEEDED_PERCENT = 90


def stride_of(template: str) -> int:
    """Words that blocks for a template are apart: it lies in one of them, wherever it starts."""
    return max(STRIDE, 1 << (len(template.split()) - 1).bit_length())


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(LICENSE_WORD), F.lit(0))


def _starts(words: Column, phrase: str) -> Column:
    tokens = phrase.split()

    def begins(at: Column) -> Column:
        hit = F.get(words, at) == tokens[0]
        for k, token in enumerate(tokens[1:], 1):
            hit &= F.get(words, at + k) == token
        return hit

    last = F.size(words) - len(tokens)
    found = F.filter(F.sequence(F.lit(0), last), begins)
    return F.when(last >= 0, found).otherwise(F.array().cast("array<int>"))


def phrase_places(text: Column) -> Column:
    """``n_words`` and the first words of all places, by label; texts without the word are only counted."""
    none = F.array().cast("array<int>")
    located = let(
        word_list(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), *(_starts(w, phrase).alias(label) for phrase, label in PHRASES)
        ),
    )
    counted = F.struct(
        F.regexp_count(text, F.lit(LICENSE_WORD)).cast("long").alias("n_words"), *(none.alias(label) for _, label in PHRASES)
    )
    return F.when(text.contains("license"), located).otherwise(counted)


def frequency_order(docs: DataFrame, templates=TEMPLATES) -> list[str]:
    """Words of the templates, the rarest over all documents first."""
    vocabulary = sorted({word for _, text in templates for word in text.split()})
    words = F.filter(word_list(lowered(F.col("text"))), lambda word: word.isin(vocabulary))
    counts = with_text(docs).select(F.explode(words).alias("word")).groupBy("word").count().collect()
    seen = {row["word"]: row["count"] for row in counts}  # a row for each template word at most
    return sorted(vocabulary, key=lambda word: (seen.get(word, 0), word))


def template_table(spark: SparkSession, order: list[str], templates=TEMPLATES) -> DataFrame:
    """A row for each prefix word of each template: its place, the stride, the words needed and all words as ranks."""
    rank = {word: n for n, word in enumerate(order, 1)}
    rows = []
    for label, text in templates:
        ranks = sorted({rank[word] for word in text.split()})
        needed = -(-NEEDED_PERCENT * len(ranks) // 100)
        rows += [(ranks[i], stride_of(text), label, i, needed, ranks) for i in range(len(ranks) - needed + 1)]
    return spark.createDataFrame(rows, "rank int, stride int, label string, place int, needed int, ranks array<int>")


def candidate_blocks(docs: DataFrame, order: list[str], prefixes: dict[int, list[str]]) -> DataFrame:
    """``doc_id``, ``_text_hash``, ``stride`` and the ranks, rarest first, of each block with a prefix word of any
    template of its stride."""
    inside = LICENSE_WORD[2:-2]
    every = sorted({word for words in prefixes.values() for word in words})
    any_prefix = f"(?<=^|[{inside}])(?:{'|'.join(every)})(?=$|[{inside}])"
    known = F.array(*map(F.lit, order))

    def blocks(words: Column) -> Column:
        return F.flatten(F.array(*(of_stride(words, stride, prefix) for stride, prefix in sorted(prefixes.items()))))

    def of_stride(words: Column, stride: int, prefix: list[str]) -> Column:
        at = F.filter(F.transform(words, lambda w, n: F.when(w.isin(prefix), n)), lambda n: n.isNotNull())
        numbers = F.array_distinct(
            F.flatten(F.transform(at, lambda n: F.array(F.floor(n / stride), F.floor(n / stride) - 1)))
        )
        return F.transform(
            F.filter(numbers, lambda b: b >= 0),
            lambda b: F.struct(F.lit(stride).alias("stride"), ranks(words, b, stride).alias("block")),
        )

    def ranks(words: Column, block: Column, stride: int) -> Column:
        part = F.slice(words, (block * stride + 1).cast("int"), F.lit(2 * stride))
        return F.sort_array(
            F.transform(
                F.filter(F.array_distinct(part), lambda w: w.isin(order)), lambda w: F.array_position(known, w).cast("int")
            )
        )

    return (
        with_text(docs)
        .select("doc_id", F.xxhash64("text").alias("_text_hash"), lowered(F.col("text")).alias("text"))
        .where(F.col("text").rlike(any_prefix))
        .select("doc_id", "_text_hash", F.explode(let(word_list(F.col("text")), blocks)).alias("found"))
        .select("doc_id", "_text_hash", "found.*")
    )


def find_templates(spark: SparkSession, docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """``doc_id``, ``_text_hash``, ``label`` and ``score`` of every block that reaches a template's threshold."""
    order = frequency_order(docs, templates)
    table = template_table(spark, order, templates)
    prefixes: dict[int, list[str]] = {}  # as many words as the templates have
    for row in table.select("stride", "rank").distinct().orderBy("stride", "rank").collect():
        prefixes.setdefault(row["stride"], []).append(order[row["rank"] - 1])
    blocks = candidate_blocks(docs, order, prefixes)
    size = F.size("block")
    placed = blocks.select("*", F.posexplode("block").alias("_at", "rank"))
    joined = placed.join(table, ["stride", "rank"]).where(
        (size >= F.col("needed"))
        & (F.least(F.size("ranks") - F.col("place"), size - F.col("_at")) >= F.col("needed"))
    )
    common = F.size(F.array_intersect("block", "ranks"))
    return joined.where(common >= F.col("needed")).select(
        "doc_id", "_text_hash", "label", (common / F.size("ranks")).alias("score")
    )


def report(spark: SparkSession, docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Phrase places, labels of phrases, all labels and the best score of every row."""
    found = (
        find_templates(spark, docs, templates)
        .groupBy("doc_id", "_text_hash")
        .agg(F.collect_set("label").alias("_labels"), F.max("score").alias("_score"))
    )
    rows = with_text(docs).select(
        "doc_id", F.xxhash64("text").alias("_text_hash"), phrase_places(lowered(F.col("text"))).alias("_places")
    )
    places = [F.col(f"_places.{label}") for _, label in PHRASES]
    base = F.filter(
        F.array(*(F.when(F.size(p) > 0, F.lit(label)) for p, (_, label) in zip(places, PHRASES, strict=True))),
        lambda label: label.isNotNull(),
    )
    rows = rows.select(
        "doc_id",
        "_text_hash",
        F.col("_places.n_words").alias("n_words"),
        F.flatten(F.array(*places)).alias("_all"),
        base.alias("_base"),
    )
    labels = F.array_union("_base", F.coalesce("_labels", F.array().cast("array<string>")))
    return rows.join(found, same_document(rows, found, "_text_hash"), "left").select(
        rows["doc_id"],
        "n_words",
        F.size("_all").cast("long").alias("n_base"),
        F.array_min("_all").cast("long").alias("first_word"),
        F.array_max("_all").cast("long").alias("last_word"),
        F.array_join(F.sort_array("_base"), ",").alias("base_labels"),
        F.array_join(F.sort_array(labels), ",").alias("labels"),
        F.when(F.size("_all") > 0, 1.0).otherwise(F.coalesce("_score", F.lit(0.0))).alias("score"),
    )
