"""Personal data: fixed patterns as seeds, and identifiers found by bootstrapped contexts.

The base kinds (email, ip, card, phone) are located by regular expressions.  They seed a graph of
contexts and instances, together with tokens of a published secret format (``FORMATS``) and with values that
are assigned to the name of a credential (``CREDENTIAL``) and have a digit and six characters or more.  An
instance is a token with a digit or an ``@``, or any token behind a ``=`` or ``:``; of ``key=value`` only the value.
Its contexts are the last word and the last two words between the instance before and it, or only the
key where it is assigned to one; its shape is its letters and digits reduced to classes.

Spark scores the graph in rounds.  A context is trusted for its share of occurrences that are followed by
a trusted instance, weighed against ``prior`` unknown ones.  A context at or above ``accept`` reaches an
instance by itself, whatever its shape; a weaker one reaches it as far as the shape is known, too.  Shapes
are scored like contexts, so instances of a new shape make it known in the next round.  In the end new
spans of kind ``id`` are: seeds outside the base kinds; tokens behind a context at or above ``accept``, also where the
token or its shape was seen nowhere else; and tokens before two words that are such a context, unless
the word before them was seen ``prior`` times and speaks against it.  Right-hand contexts take no part in the rounds.

Spans are code points, end exclusive, without punctuation around.  New spans never touch base ones; base
spans are never changed.  Null and empty texts have no spans.  Rows with the same ``doc_id`` and text are one
document and get the same result; a null ``doc_id`` is an id like any other.  Empty input gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspeed.llm.common import let, same_document, stored, unused, with_text

# Fixed values of the query's definition, written so that a search takes linear time: a match can
# begin only where its run of characters begins or where the last match ended (\G), and groups give
# nothing back.  ``email`` for example is [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
# What a text must have for any match of the kind; a cheap test before the search.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
# Published forms of secrets (cloud and service keys, web tokens).
FORMATS = (
    r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    r"AIza[0-9A-Za-z_-]{35}",
    r"gh[pousr]_[A-Za-z0-9]{36,}",
    r"glpat-[A-Za-z0-9_-]{20,}",
    r"xox[abprs]-[A-Za-z0-9-]{10,}",
    r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}",
    r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
)
# Last words of keys that hold credentials.
CREDENTIAL = (
    r"(?:^|[_.-])(?:password|passwd|pwd|passphrase|secret|token|api[_.-]?key|access[_.-]?key|private[_.-]?key"
    r"|credentials?)=$"
)
LEAST_SECRET = 6  # characters of a credential's value
# A token without white space that has a digit or an @, stands behind = or :, or assigns a value to a key.
TOKEN = (
    r"(?<![^\x20\x09-\x0D])(?:[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
    r"|(?<=[=:][\x20\x09-\x0D])[^\x20\x09-\x0D]++"
    r"|[^\x20\x09-\x0D=:]++[=:](?!//)[^\x20\x09-\x0D]++)"
)
_KEY = r"([A-Za-z][A-Za-z0-9_.-]*+)[\"']?"
INNER_KEY = rf"^[^A-Za-z0-9]*+{_KEY}[=:](?!//)(?=.)"  # at the start of a token
OUTER_KEY = rf"(?<![A-Za-z0-9_.-]){_KEY}[\x20\x09]*[=:][\x20\x09]*$"  # at the end of what stands before it
ID = "id"
SPAN = "struct<kind:string,start:int,end:int>"
CONTEXT = 80  # characters before a token in which its context words are looked for
BLOCK = 256  # matches placed at a time
BLOCK_CHARS = 1024  # characters of a text whose base spans are listed together
SHARES = 16  # places to which the contexts of one instance are dealt


@dataclass(frozen=True)
class Bootstrap:
    rounds: int = 3
    prior: float = 3.0  # unknown occurrences that a context or shape starts with
    trust: float = 0.5  # score from which an instance counts as known in the next round
    accept: float = 0.8  # score of a context from which it needs no known shape, and a token is a new span


def located(text: Column, pattern: str, valid) -> Column:
    """Start, end, text, preceding and following piece of the matches that ``valid`` accepts.

    Lengths of the pieces between matches are summed block by block, so a text with very many
    matches takes little more than linear time.
    """
    none = F.array().cast("array<struct<start:int,end:int,match:string,before:string,after:string>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def part(piece: Column, match: Column) -> Column:
        return F.struct(
            F.length(piece).alias("gap"),
            F.coalesce(F.length(match), F.lit(0)).alias("width"),
            match.alias("match"),
            F.substring(piece, -CONTEXT, CONTEXT).alias("before"),
            F.substring(piece, 1, CONTEXT).alias("begin"),
        )

    def followed(parts: Column) -> Column:
        rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p["begin"])
        return F.zip_with(parts, rest, lambda p, after: p.withField("after", after))

    def width(parts: Column) -> Column:
        return F.aggregate(parts, F.lit(0), lambda total, p: total + p["gap"] + p["width"])

    def add(state: Column, p: Column) -> Column:
        start = state["at"] + p["gap"]
        end = start + p["width"]
        span = F.struct(
            start.alias("start"),
            end.alias("end"),
            p["match"].alias("match"),
            p["before"].alias("before"),
            p["after"].alias("after"),
        )
        return F.struct(end.alias("at"), F.concat(state["all"], F.array(span)).alias("all"))

    def place(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), none.alias("all")), add, lambda state: state["all"])

    def spans(parts: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int"))
        return let(F.transform(numbers, lambda b: F.slice(parts, b * BLOCK + 1, F.lit(BLOCK))), from_blocks)

    def from_blocks(blocks: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        starts = F.aggregate(
            blocks,
            begin,
            lambda state, block: F.struct(
                (state["at"] + width(block)).alias("at"), F.concat(state["all"], F.array(state["at"])).alias("all")
            ),
            lambda state: state["all"],
        )
        return F.flatten(F.zip_with(blocks, starts, place))

    parts = let(F.zip_with(F.split(text, pattern, -1), found, part), followed)
    return F.filter(let(parts, spans), lambda s: s["match"].isNotNull() & valid(s["match"]))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    digits = F.reverse(_digits(match))
    doubled = F.transform(
        F.split(digits, ""),
        lambda d, n: F.when(n % 2 == 0, d.cast("int")).otherwise(
            d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)
        ),
    )
    total = F.aggregate(doubled, F.lit(0), lambda a, b: a + b)
    return F.when(F.length(digits).between(14, 19), total % 10 == 0).otherwise(F.lit(False))


VALID = {
    "email": lambda match: F.lit(True),
    "ip": lambda match: match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
    "card": _luhn,
    "phone": lambda match: F.length(_digits(match)).between(10, 15),
}


def _named(kind: str):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def _is(kind: str):
    return lambda s: s["kind"] == kind


def base_spans(text: Column) -> Column:
    """All base spans of a text by start, then kind as listed; most texts fail the cheap tests."""
    none = F.array().cast(f"array<{SPAN}>")
    parts = []
    for kind in KINDS:
        found = F.transform(located(text, PATTERNS[kind], VALID[kind]), _named(kind))
        parts.append(F.when(text.rlike(NEEDS[kind]), found).otherwise(none))
    return in_order(F.concat(*parts))


def in_order(spans: Column) -> Column:
    rank = F.array(*map(F.lit, (*KINDS, ID)))
    keyed = F.transform(
        spans, lambda s: F.struct(s["start"], F.array_position(rank, s["kind"]).alias("rank"), s.alias("span"))
    )
    return F.transform(F.sort_array(keyed), lambda k: k["span"])


def written(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def shape(token: Column) -> Column:
    """Runs of letters, of digits and of both as ``a``, ``9`` and ``x``, surrounding punctuation left out."""
    core = F.regexp_replace(F.substring(token, 1, CONTEXT), r"^[^A-Za-z0-9+(]+|[^A-Za-z0-9)]+$", "")
    classes = F.regexp_replace(F.regexp_replace(core, "[A-Za-z]+", "a"), "[0-9]+", "9")
    return F.regexp_replace(classes, "(?:a9|9a)[a9]*", "x")


def _touches(spans_by_block: Column, token: Column) -> Column:
    first, last = F.floor(token["start"] / BLOCK_CHARS).cast("int"), F.floor((token["end"] - 1) / BLOCK_CHARS).cast("int")
    return F.exists(
        F.slice(spans_by_block, first + 1, last - first + 1),
        lambda spans: F.exists(spans, lambda b: (b["start"] < token["end"]) & (b["end"] > token["start"])),
    )


def tokens_of(text: Column, spans: Column) -> Column:
    """Tokens of a text that may be instances: place, text, surroundings, whether a base span covers part of them."""
    numbers = F.sequence(F.lit(0), F.floor(F.length(text) / BLOCK_CHARS).cast("int"))
    by_block = F.transform(
        numbers,
        lambda n: F.filter(spans, lambda b: (b["start"] < (n + 1) * BLOCK_CHARS) & (b["end"] > n * BLOCK_CHARS)),
    )

    def tokens(blocks: Column) -> Column:
        return F.transform(
            located(text, TOKEN, lambda match: F.lit(True)), lambda s: s.withField("base", _touches(blocks, s))
        )

    return F.when(text.rlike("[0-9@=:]"), let(by_block, tokens))


def _split_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def instances(found: DataFrame) -> DataFrame:
    """Instances with their place, left and right contexts, shape, and whether they are base spans or other seeds."""
    start_of = F.substring("token", 1, CONTEXT)
    inner = F.regexp_extract(start_of, INNER_KEY, 0)
    key = F.when(inner != "", F.regexp_extract(start_of, INNER_KEY, 1)).otherwise(
        F.regexp_extract("before", OUTER_KEY, 1)
    )
    rows = (
        found.select("doc_id", "_text_hash", F.explode("tokens").alias("t"))
        .select("doc_id", "_text_hash", "t.*")
        .withColumnRenamed("match", "token")
        .withColumn("_skip", F.length(inner))
        .withColumn("_value", F.expr("substring(token, _skip + 1)"))
        # The value without surrounding punctuation.
        .withColumn("_lead", F.length(F.regexp_extract("_value", r"^[^A-Za-z0-9]*", 0)))
        .withColumn("_trail", F.length(F.regexp_extract(F.reverse("_value"), r"^[^A-Za-z0-9]*", 0)))
        .withColumn("_size", F.greatest(F.length("_value") - F.col("_lead") - F.col("_trail"), F.lit(0)))
        .withColumn("match", F.expr("substring(_value, _lead + 1, _size)"))
        .withColumn("_key", F.lower(key))
        .withColumn("_words", _split_words(F.col("before")))
        .withColumn("_next", _split_words(F.col("after")))
    )
    keyed, size, last = F.col("_key") != "", F.size("_words"), F.try_element_at("_words", F.lit(-1))
    near = F.when(keyed, F.concat("_key", F.lit("="))).otherwise(last)
    secret = near.rlike(CREDENTIAL) & (F.col("_size") >= LEAST_SECRET) & F.col("match").rlike("[0-9]")
    known_format = F.col("match").rlike(f"^(?:{'|'.join(FORMATS)})$")
    start = F.col("start") + F.col("_skip") + F.col("_lead")
    return rows.where(F.col("base") | (F.col("_size") > 0)).select(
        "doc_id",
        "_text_hash",
        start.alias("start"),
        (start + F.col("_size")).alias("end"),
        "match",
        "base",
        (F.col("base") | known_format | F.coalesce(keyed & secret, F.lit(False))).alias("seed"),
        near.alias("near"),
        F.when(~keyed & (size > 1), F.concat_ws(" ", F.get("_words", size - 2), last)).alias("far"),
        F.when(F.size("_next") > 1, F.concat_ws(" ", F.slice("_next", 1, 2))).alias("right"),
        shape(F.col("_value")).alias("shape"),
    )


def _left(tokens: DataFrame) -> DataFrame:
    return tokens.withColumn("context", F.explode(F.array_compact(F.array("near", "far"))))


def trusted(spark: SparkSession, tokens: DataFrame, bootstrap: Bootstrap = Bootstrap()) -> tuple[DataFrame, DataFrame]:
    """Scores of left contexts after the rounds, and how far each reached instance is ``known`` (``match``).

    The graph is kept as counts of (match, context, shape), so no context has more rows than it has
    different neighbours, whatever the number of occurrences.  Edges of one instance are dealt to
    ``SHARES`` places, as an instance may have very many contexts.
    """
    share = F.pmod(F.xxhash64("context"), F.lit(SHARES))
    edges = stored(
        spark,
        _left(tokens)
        .groupBy("match", "context", "shape")
        .agg(F.count("*").alias("n"), F.max("seed").alias("seed"))
        .withColumn("share", share),
        "context-graph",
    )
    scored = edges.select("match", "context", "shape", "n", F.col("seed").cast("double").alias("known"))
    reached = edges.where("seed").select("match", F.lit(1.0).alias("known")).distinct()
    for _ in range(bootstrap.rounds):
        contexts, shapes = _scores(scored, "context", bootstrap), _scores(scored, "shape", bootstrap)
        contexts, shapes = contexts.where("context_score > 0"), shapes.where("shape_score > 0")
        with_shape = F.least("context_score", F.coalesce("shape_score", F.lit(0.0)))
        reach = F.when(F.col("context_score") >= bootstrap.accept, F.col("context_score")).otherwise(with_shape)
        reached = stored(
            spark,
            edges.join(contexts, "context")
            .join(shapes, "shape", "left")
            .groupBy("match")
            .agg(F.max(reach).alias("reach"), F.max("seed").alias("is_seed"))
            .where(F.col("is_seed") | (F.col("reach") >= bootstrap.trust))
            .select("match", F.when(F.col("is_seed"), 1.0).otherwise(F.col("reach")).alias("known")),
            "known-instances",
        )
        everywhere = reached.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))))
        scored = stored(
            spark,
            edges.join(everywhere, ["match", "share"], "left").select(
                "match", "context", "shape", "n", F.coalesce("known", F.lit(0.0)).alias("known")
            ),
            "context-scores",
        )
    return _scores(scored, "context", bootstrap), reached


def _scores(scored: DataFrame, column: str, bootstrap: Bootstrap) -> DataFrame:
    score = F.sum(F.col("known") * F.col("n")) / (F.sum("n") + bootstrap.prior)
    return scored.groupBy(column).agg(score.alias(f"{column}_score"), F.sum("n").alias(f"{column}_n"))


def new_spans(spark: SparkSession, tokens: DataFrame, bootstrap: Bootstrap = Bootstrap()) -> DataFrame:
    """``doc_id``, ``_text_hash`` and the ``id`` spans of every text that has any."""
    contexts, reached = trusted(spark, tokens, bootstrap)
    accepted = contexts.where(F.col("context_score") >= bootstrap.accept).select("context")
    against = contexts.where(
        (F.col("context_n") >= bootstrap.prior) & (F.col("context_score") < 1 - bootstrap.accept)
    ).select(F.col("context").alias("near"))
    place = ["doc_id", "_text_hash", "start", "end"]
    # Seeds without a word before them are not in the graph.
    seeds = tokens.where("seed").select("match", F.lit(1.0).alias("known"))
    reached = reached.unionByName(seeds).groupBy("match").agg(F.max("known").alias("known"))
    sided = tokens.where(F.col("right").isNotNull()).groupBy("match", "right").agg(F.count("*").alias("n"))
    after = (
        _scores(sided.join(reached, "match", "left").fillna(0.0, ["known"]), "right", bootstrap)
        .where(F.col("right_score") >= bootstrap.accept)
        .select("right")
    )
    unknown = tokens.where(~F.col("seed"))
    found = (
        tokens.where(F.col("seed") & ~F.col("base"))
        .select(place)
        .unionByName(_left(unknown).join(accepted, "context", "left_semi").select(place))
        .unionByName(unknown.join(after, "right", "left_semi").join(against, "near", "left_anti").select(place))
    )
    span = F.struct(F.lit(ID).alias("kind"), "start", "end")
    return found.groupBy("doc_id", "_text_hash").agg(F.collect_set(span).alias("new"))


def find(spark: SparkSession, docs: DataFrame, bootstrap: Bootstrap = Bootstrap()) -> tuple[DataFrame, DataFrame]:
    """Base spans of every row (``doc_id``, ``_text_hash``, ``spans``), and the new spans of texts that have any."""
    text = F.col("text")
    # The generator keeps the spans from being searched once more for the tokens.
    rows = (
        with_text(docs)
        .select("doc_id", F.xxhash64("text").alias("_text_hash"), "text", F.explode(F.array(base_spans(text))).alias("spans"))
        .select("doc_id", "_text_hash", "spans", tokens_of(text, F.col("spans")).alias("tokens"))
    )
    rows = stored(spark, rows, "base-spans")
    tokens = stored(spark, instances(rows), "identifier-tokens")
    return rows.drop("tokens"), new_spans(spark, tokens, bootstrap)


def _all_spans() -> Column:
    none = F.array().cast(f"array<{SPAN}>")
    return in_order(F.concat(F.col("spans"), F.coalesce("new", none)))


def report(spark: SparkSession, docs: DataFrame, bootstrap: Bootstrap = Bootstrap()) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, all spans and how many are new, of every row."""
    rows, new = find(spark, docs, bootstrap)
    counts = [
        F.size(F.filter("spans", _is(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS
    ]
    return rows.join(new, same_document(rows, new, "_text_hash"), "left").select(
        rows["doc_id"],
        *counts,
        F.sha2(written(F.col("spans")).cast("binary"), 256).alias("base_sha256"),
        written(_all_spans()).alias("spans"),
        F.size(_all_spans()).cast("long").alias("n_spans"),
        F.size(F.coalesce("new", F.array().cast(f"array<{SPAN}>"))).cast("long").alias("n_id"),
    )


def redact(spark: SparkSession, docs: DataFrame, bootstrap: Bootstrap = Bootstrap()) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; ``n_chars`` follows where present.

    Of overlapping spans the union is replaced and named after its first one.
    """
    _, new = find(spark, docs, bootstrap)
    new = stored(spark, new, "identifier-spans")
    text_name, hash_name, span_name = (unused(docs, n) for n in ("_pii_text", "_pii_hash", "_pii_spans"))
    rows = docs.withColumn(text_name, F.coalesce("text", F.lit(""))).withColumn(hash_name, F.xxhash64(text_name))
    none = F.array().cast(f"array<{SPAN}>")
    joined = rows.join(
        new.select(F.col("doc_id").alias("_new_id"), F.col("_text_hash").alias("_new_hash"), "new"),
        rows["doc_id"].cast("long").eqNullSafe(F.col("_new_id")) & (rows[hash_name] == F.col("_new_hash")),
        "left",
    ).withColumn(span_name, in_order(F.concat(base_spans(F.col(text_name)), F.coalesce("new", none))))

    def replaced(text: Column, spans: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

        def step(state: Column, s: Column) -> Column:
            inside = s["start"] < state["at"]
            gap = F.substring(text, state["at"] + 1, s["start"] - state["at"])
            tag = F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))
            parts = F.when(inside, state["parts"]).otherwise(F.concat(state["parts"], F.array(gap, tag)))
            return F.struct(F.greatest(state["at"], s["end"]).alias("at"), parts.alias("parts"))

        def finish(state: Column) -> Column:
            return F.concat(F.array_join(state["parts"], ""), F.substring(text, state["at"] + 1, F.length(text)))

        return F.aggregate(spans, start, step, finish)

    marked = F.size(span_name) > 0
    text = F.when(marked, replaced(F.col(text_name), F.col(span_name))).otherwise(F.col("text"))
    redacted = joined.withColumn(text_name, text)
    changed = {"text": F.col(text_name)}
    if "n_chars" in docs.columns:
        length = F.length(text_name).cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(marked, length).otherwise(F.col("n_chars"))
    return redacted.select(*(changed.get(c, F.col(c)).alias(c) for c in docs.columns))
