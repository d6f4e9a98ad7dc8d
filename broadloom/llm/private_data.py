"""Personal data: fixed patterns, and terms that reveal them by corpus co-occurrence.

Base spans are matches of four patterns. Their values are the protected entities. How strongly a
term reveals an entity is estimated from all documents: the pointwise mutual information of both
occurring in a document, as a share of the information of the entity itself,

    strength = log(n(e, t) * n / (n(e) * n(t))) / log(n / n(e)),

which is 1 if the term only occurs beside the entity. Terms at or above ``DISCLOSES`` become spans
of kind ``term`` wherever they stand in a document with that entity; ``sanitise`` removes those at
or above ``REMOVES`` and generalises the others. Words of fewer than three characters or of
ASCII digits alone are no terms, however strongly they reveal an entity. An entity or pair counts only with evidence
from at least ``SUPPORT`` different texts, so copies of one text prove nothing.

Everything is DataFrame code: patterns are guarded by cheap tests, spans are running sums over the
pieces between matches, counts are grouped with map-side partial sums. Words are put in rows with
their places only for texts with an entity that has support.

Defined results: a null or empty text has no spans. Of overlapping kinds all spans are reported,
but a term never overlaps a base span. Repeated rows each get a row with the same spans; they count
once each in n, n(e), n(t). Places are code points, ends exclusive. Null ids are kept. Other
columns are ignored, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadloom.llm.rows import only, text_tag
from broadloom.session import materialize, small_side

KINDS = ("email", "ip", "card", "phone")
SUPPORT = 3
DISCLOSES = 0.8
REMOVES = 0.95

# The patterns as given, with possessive loops where no shorter match can help (they need no stack
# however long the match) and a look behind where no later start in a run can succeed.
_LOCAL = "[A-Za-z0-9._%+-]"
_PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_GUARDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"

_SPANS = "array<struct<kind:int,start:int,end:int,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        digit = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return total + F.when(i % 2 == 0, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _card(value: Column) -> Column:
    return F.when(F.length(_digits(value)).between(13, 19), _luhn(_digits(value))).otherwise(False)


def _at_most_255(part: Column) -> Column:
    # Of a part with leading zeros only the last three digits can count.
    short = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return F.when(F.length(short) <= 3, short.cast("int") <= 255).otherwise(False)


_VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda value: F.lit(True),
    "ip": lambda value: F.forall(F.split(value, r"\."), _at_most_255),
    "card": _card,
    "phone": lambda value: F.length(_digits(value)).between(9, 15),
}


def _pieces(text: Column, pattern: str) -> Column:
    """Text before each match, and the match; at the end what is left, with a null match."""
    gaps = F.split(text, pattern, -1)
    return F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))


def _spans_of(text: Column, kind: str) -> Column:
    nothing = F.array().cast(_SPANS)

    def good(piece: Column) -> Column:
        return F.when(piece["p"]["hit"].isNotNull(), _VALID[kind](piece["p"]["hit"])).otherwise(False)

    def span(piece: Column) -> Column:
        start = (piece["end"] - F.length(piece["p"]["hit"])).alias("start")
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), start, piece["end"].alias("end"), piece["p"]["hit"].alias("value"))

    def of_pieces(pieces: Column) -> Column:
        lengths = F.transform(pieces, lambda p: F.length(p["gap"]) + F.coalesce(F.length(p["hit"]), F.lit(0)))
        ended = F.arrays_zip(pieces.alias("p"), _running(lengths).alias("end"))
        return F.transform(F.filter(ended, good), span)

    # The pieces are bound to a name, as the array of one array, to be found only once.
    found = F.flatten(F.transform(F.array(_pieces(text, _PATTERNS[kind])), of_pieces))
    return F.when(text.rlike(_GUARDS[kind]), found).otherwise(nothing)


def _running(numbers: Column) -> Column:
    """Running sums of an array: each round adds what stands twice as far back as the last one."""
    rounds = F.ceil(F.log2(F.size(numbers))).cast("int")

    def add(sums: Column, k: Column) -> Column:
        back = F.pow(F.lit(2.0), k).cast("int")
        return F.transform(sums, lambda x, i: x + F.when(i >= back, F.get(sums, i - back)).otherwise(0))

    return F.aggregate(F.slice(F.sequence(F.lit(0), F.lit(31)), F.lit(1), rounds), numbers, add)


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, tag and the valid pattern matches of every text, by kind and start."""
    own = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        text_tag(docs).alias("tag"),
        F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"),
    )
    spans = F.concat(*(_spans_of(F.col("text"), kind) for kind in KINDS))
    return own.select("doc_id", "tag", spans.alias("spans"))


def _entity(span: Column) -> Column:
    """The same value in any spelling: lower case, or digits alone."""
    value = F.when(span["kind"] >= 2, _digits(span["value"])).otherwise(F.lower(span["value"]))
    return F.concat(span["kind"].cast("string"), F.lit(":"), value)


def _term(word: Column) -> Column:
    return F.lower(word)


def _is_term(term: Column) -> Column:
    return (F.length(term) >= 3) & term.rlike("[^0-9]")


def disclosing_terms(docs: DataFrame, base: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(entity, term, strength) at or above ``DISCLOSES``, and the words of the texts concerned.

    None if no entity has support.
    """
    total = base.count()
    pairs = base.filter(F.size("spans") > 0).select(
        "doc_id", "tag", F.explode(F.array_distinct(F.transform("spans", _entity))).alias("entity")
    )
    # Rows and one id per text and entity.
    per_text = pairs.groupBy("entity", "tag").agg(F.count("*").alias("rows"), F.max("doc_id").alias("doc_id"))
    per_text = materialize(per_text, "entities")
    supported = per_text.groupBy("entity").agg(F.sum("rows").alias("n_e"), F.count("*").alias("texts"))
    supported = materialize(supported.filter(F.col("texts") >= SUPPORT).drop("texts"), "supported")
    if supported.isEmpty():
        return None
    of_text = materialize(per_text.join(supported.select("entity"), "entity"), "entity-texts")

    texts = only(docs, of_text.select("doc_id", "tag")).select(text_tag(docs).alias("tag"), "text").dropDuplicates(["tag"])
    pieces = texts.select("tag", F.posexplode(_pieces(F.col("text").cast("string"), _WORD)).alias("i", "piece"))
    so_far = F.sum(F.length("piece.gap") + F.coalesce(F.length("piece.hit"), F.lit(0)))
    end = so_far.over(Window.partitionBy("tag").orderBy("i")).cast("int")
    words = pieces.withColumn("end", end).filter(F.col("piece.hit").isNotNull())
    words = words.select(
        "tag", _term(F.col("piece.hit")).alias("term"), (F.col("end") - F.length("piece.hit")).alias("start"), "end"
    )
    words = materialize(words.filter(_is_term(F.col("term"))), "words")

    together = words.select("tag", "term").distinct().join(of_text, "tag")
    joint = together.groupBy("entity", "term").agg(F.sum("rows").alias("n_et"), F.count("*").alias("texts"))
    joint = materialize(joint.filter(F.col("texts") >= SUPPORT).drop("texts"), "joint")
    terms = materialize(joint.select("term").distinct(), "terms")
    counted = _frequencies(docs, terms)
    measured = joint.join(supported, "entity").join(counted, "term").select(
        "entity",
        "term",
        (
            F.log2(F.col("n_et") * F.lit(total) / (F.col("n_e") * F.col("n_t")))
            / F.log2(F.lit(total) / F.col("n_e"))
        ).alias("strength"),
    )
    strong = materialize(measured.filter(F.col("strength") >= DISCLOSES), "strong")
    return strong, words.join(of_text.select("tag", "entity"), "tag")


def _frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """n_t: how many rows of all documents contain each term."""
    found = F.regexp_extract_all(F.col("text"), F.lit(_WORD), F.lit(0))
    own = docs.select(F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    each = own.select(F.explode(F.array_distinct(F.transform(found, _term))).alias("term"))
    return each.join(small_side(terms, terms.count()), "term", "left_semi").groupBy("term").agg(
        F.count("*").alias("n_t")
    )


def private_spans(docs: DataFrame) -> DataFrame:
    """doc_id, tag, base spans and added term spans (start, end, term, strength) of every document."""
    base = materialize(base_spans(docs), "base-spans")
    nothing = F.array().cast("array<struct<start:int,end:int,term:string,strength:double>>")
    found = disclosing_terms(docs, base)
    if found is None:
        return base.withColumn("terms", nothing)
    strong, words = found
    hits = words.join(small_side(strong, strong.count()), ["entity", "term"])
    hits = _apart(hits.groupBy("tag", "start", "end", "term").agg(F.max("strength").alias("strength")), base)
    per_text = hits.groupBy("tag").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "term", "strength"))).alias("terms")
    )
    per_text = materialize(per_text, "term-spans")
    joined = base.join(small_side(per_text, per_text.count(), 100_000), "tag", "left")
    return joined.select("doc_id", "tag", "spans", F.coalesce("terms", nothing).alias("terms"))


def _apart(hits: DataFrame, base: DataFrame) -> DataFrame:
    """The places of terms that overlap no base span, told in one pass over the places of each text."""
    texts = base.filter(F.size("spans") > 0).select("tag", "spans").dropDuplicates(["tag"])
    spans = texts.join(hits.select("tag").distinct(), "tag", "left_semi").select("tag", F.explode("spans").alias("s"))
    places = hits.unionByName(spans.select("tag", "s.start", "s.end"), allowMissingColumns=True)
    is_span, own = F.col("term").isNull(), Window.partitionBy("tag")
    upto = own.orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    after = own.orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, -1)
    marked = places.withColumn("_reach", F.max(F.when(is_span, F.col("end"))).over(upto)).withColumn(
        "_next", F.min(F.when(is_span, F.col("start"))).over(after)
    )
    free = (F.coalesce("_reach", F.lit(0)) <= F.col("start")) & (F.coalesce("_next", F.col("end")) >= F.col("end"))
    return marked.filter(~is_span & free).select(*hits.columns)


def _written(spans: Column, name: Callable[[Column], Column]) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string")))


def _count(kind: int) -> Column:
    return F.size(F.filter("spans", lambda span: span["kind"] == kind)).cast("long")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts per kind, digest of the base spans and all spans as text."""
    found = private_spans(docs)
    kinds = F.array(*map(F.lit, KINDS))
    base = _written(F.col("spans"), lambda s: F.element_at(kinds, s["kind"] + 1))
    terms = _written(F.col("terms"), lambda s: F.lit("term"))
    counts = [_count(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(base, terms), ",").alias("spans"),
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` with base spans replaced by their kind, terms generalised or removed.

    Of overlapping spans the one that starts first is replaced, of these the longest.
    """
    found = private_spans(docs).filter((F.size("spans") > 0) | (F.size("terms") > 0))
    kinds = F.array(*(F.lit(f"<{kind}>") for kind in KINDS))
    marks = F.concat(
        F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("last"), F.element_at(kinds, s["kind"] + 1).alias("by"))),
        F.transform("terms", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("last"), F.when(s["strength"] >= REMOVES, "").otherwise("<term>").alias("by"))),
    )
    marked = found.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), F.array_sort(marks).alias("_marks"))
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), text_tag(docs).alias("_t"))
    same = own["doc_id"].eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_tag"))
    joined = own.join(marked.dropDuplicates(["_id", "_tag"]), same, "left")

    def step(state: Column, mark: Column) -> Column:
        between = F.substring(F.col("text"), state["at"] + 1, mark["start"] - state["at"])
        new = F.struct((-mark["last"]).alias("at"), F.concat(state["out"], between, mark["by"]).alias("out"))
        return F.when(mark["start"] >= state["at"], new).otherwise(state)

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(
        "_marks", begin, step, lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text")))
    )
    return joined.select("doc_id", F.when(F.col("_marks").isNull(), F.col("text")).otherwise(done).alias("text"))
