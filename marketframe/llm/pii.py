"""Personal data: fixed patterns, and terms that give protected values away by their co-occurrence.  DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketframe.llm.common import maybe_among, written

#: Kinds in their order.  The patterns are possessive where a match can only end in one place, and an address starts only where a run
#: of its letters starts (or right after a match), so that no text, however long, is searched more than once from each run.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?+[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "term"]
#: Kind of a term that is to be taken out, in the cuts of ``find``.
_REMOVED = len(KINDS)
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_WORD = r"\p{L}{3,}+"
#: Matches whose places are summed in one go: n matches take time in proportion to n * (_RUN + n / _RUN).
_RUN = 128
#: Code points of a segment, for cutting long texts.
_SEGMENT = 1024
_SPAN = "struct<start: int, kind: int, end: int, value: string>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, where ``value`` is computed once however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _runs(items: Column, size: int) -> Column:
    """An array cut into arrays of ``size`` items."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / size).cast("int")), lambda k: F.slice(items, k * size + 1, F.lit(size)))


def _found(text: Column, pattern: str, kind: int) -> Column:
    """Leftmost matches that do not overlap, with their places in code points: what lies between them, and their lengths, add up."""
    none = F.array().cast(f"array<{_SPAN}>")

    def add(done: Column, pair: Column) -> Column:
        start = done["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), pair["hit"].alias("value"))
        return F.struct(end.alias("at"), F.concat(F.coalesce(done["spans"], none), F.array(span)).alias("spans"))

    def add_run(done: Column, run: Column) -> Column:
        part = F.aggregate(run, F.struct(done["at"].alias("at"), F.lit(None).cast(f"array<{_SPAN}>").alias("spans")), add)
        return _let(part, lambda p: F.struct(p["at"].alias("at"), F.concat(F.coalesce(done["runs"], F.array().cast(f"array<array<{_SPAN}>>")), F.array(p["spans"])).alias("runs")))

    def placed(hits: Column) -> Column:
        pairs = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), hits, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))
        start = F.struct(F.lit(0).alias("at"), F.lit(None).cast(f"array<array<{_SPAN}>>").alias("runs"))
        return F.when(F.size(hits) > 0, _let(pairs, lambda p: F.flatten(F.aggregate(_runs(p, _RUN), start, add_run)["runs"]))).otherwise(none)

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    return {
        "email": F.lit(True),
        "ip": value.rlike(f"^{_OCTET}(?:\\.{_OCTET}){{3}}$"),
        "card": F.length(digits).between(12, 19) & F.call_function("luhn_check", digits),
        "phone": F.length(digits).between(9, 15),
    }[kind]


def base_spans(text: Column) -> Column:
    """Valid matches of every kind in order of start, then kind: array of (start, kind number, end, value); end is exclusive."""


    def valid(kind: str, found: Column) -> Column:
        return F.filter(found, lambda s: _valid(kind, s["value"]))

    return F.array_sort(F.concat(*(valid(kind, _found(text, p, k)) for k, (kind, p) in enumerate(PATTERNS.items()))))


def _folded(text: Column) -> Column:
    """Lower case; every letter stays one code point."""
    return F.lower(F.translate(text, "\u0130", "i"))


def _terms(text: Column) -> Column:
    """The distinct words of three letters or more, in lower case."""
    return F.array_distinct(F.regexp_extract_all(_folded(text), F.lit(_WORD), F.lit(0)))


def find(docs: DataFrame, *, disclosure: float = 0.9, support: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of every text: doc_id, text_hash, spans (array of start, kind number, end), base (those of the patterns), removed, cuts.

    Base: the patterns, each validated.  Every distinct value found is a protected entity.  For each entity e and each word t in a
    text that holds it, however far from it, corpus counts say how much t reveals: ``PMI(e; t) / IC(e) = log(n_et * N / (n_e * n_t)) /
    log(N / n_e)``, n counting rows (n_et those that hold both).  A term that reaches ``disclosure``, together with e in ``support``
    different texts at least, becomes a span of kind ``term`` at every place, outside the base spans, of every text that holds both;
    removed holds the starts of those that reveal e in full (1 or more), which are to be taken out, while the others are to be
    generalised; cuts are the spans with such terms told apart.  A text of very many spans takes time nearly in proportion to them.

    A value that one text alone holds has no second text to count in.  But an address is told by the words that it is made of: each word of
    its local part is a protected entity, too, with the same measure over rows (n_e those with such an address, n_t those with the word
    anywhere), and needs no support, as the address itself spells it.  So a name stands in clear text no longer where its owner's address
    names it, unless the word is too common to tell.

    Null texts are empty and have no spans.  Repeated ids are separate rows; the same id with the same text gives equal rows.  An
    empty table gives no rows.  Columns other than the two named are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    maybe = F.col("text").rlike("[0-9@]")  # every pattern needs one
    spans = F.when(maybe, base_spans(F.col("text"))).otherwise(F.array().cast(f"array<{_SPAN}>"))
    looked = rows.withColumn("base", spans).withColumn("text", F.when(F.size("base") > 0, F.col("text"))).withColumn("place", F.monotonically_increasing_id())
    seen = written(looked.select("place", "doc_id", "text_hash", "base", "text"), "pii-base")
    total = max(1, seen.count())

    entity = ["kind", "value"]
    # Distinct as strings, which go through a hash set.
    names = F.array_distinct(F.transform("base", lambda s: F.concat(s["kind"].cast("string"), s["value"])))
    held = seen.where(F.size("base") > 0).select("place", "text_hash", F.explode(names).alias("e")).select("place", "text_hash", F.substring("e", 1, 1).cast("int").alias("kind"), F.expr("substring(e, 2)").alias("value"))
    own = held.groupBy(*entity).agg(F.count("*").alias("n_e"), F.countDistinct("text_hash").alias("texts"))
    # An entity in fewer texts than ``support`` has no pair in as many.
    own = written(own.where((F.col("texts") >= support) & (F.col("n_e") < total)).drop("texts"), "pii-entities")
    key = F.xxhash64(*entity)
    frequent = maybe_among(held.withColumn("key", key), "key", own.select(key.alias("key"))).join(own, entity).select("place", *entity, "n_e")
    frequent = written(frequent, "pii-held")
    # Words of those texts, and how often each is in any text.  Only then do words meet entities, so that most pairs never arise: of
    # n_et <= n_e follows that a term that tells so much has n_t <= N / (N / n_e) ** disclosure.
    words = maybe_among(seen, "place", frequent.select("place")).select("place", "text_hash", F.explode(_terms(F.col("text"))).alias("term"))
    shared = words.groupBy("term").agg(F.countDistinct("text_hash").alias("texts")).where(F.col("texts") >= support).select("term")
    spelled = written(held.where("kind = 0").select("place", F.explode(_terms(F.split_part("value", F.lit("@"), F.lit(1)))).alias("term")).distinct(), "pii-spelled")
    shared = written(shared.union(spelled.select("term")).distinct(), "pii-words")
    often = maybe_among(rows.select(F.explode(_terms(F.col("text"))).alias("term")), "term", shared).groupBy("term").agg(F.count("*").alias("n_t"))
    most = frequent.agg(F.coalesce(F.max("n_e"), F.lit(0))).first()[0]
    limit = lambda n: F.lit(float(total)) / F.pow(F.lit(float(total)) / n, F.lit(disclosure)) * (1 + 1e-9)
    often = often.join(shared, "term", "left_semi")
    named = spelled.groupBy("term").agg(F.count("*").alias("n_e"))
    most = max(most, named.agg(F.coalesce(F.max("n_e"), F.lit(0))).first()[0])
    often = written(often.where(F.col("n_t") <= limit(F.lit(float(max(1, most))))), "pii-often")
    met = maybe_among(words, "term", often.select("term")).join(often, "term").join(frequent, "place").where(F.col("n_t") <= limit(F.col("n_e")))
    met = written(met.select("place", "text_hash", *entity, "term", "n_t", "n_e"), "pii-met")
    pairs = met.groupBy(*entity, "term").agg(F.countDistinct("text_hash").alias("texts"), F.count("*").alias("n_et"), F.max("n_t").alias("n_t"), F.max("n_e").alias("n_e")).where(F.col("texts") >= support)
    share = F.log(F.col("n_et") * F.lit(float(total)) / (F.col("n_e") * F.col("n_t"))) / F.log(F.lit(float(total)) / F.col("n_e"))
    told = written(pairs.withColumn("share", share).where(F.col("share") >= disclosure).select(*entity, "term", "share"), "pii-told")
    # Every row with such an address has the word, in the address itself: n_et is n_e.
    own_words = named.where(F.col("n_e") < total).join(often, "term").withColumn("share", F.log(F.lit(float(total)) / F.col("n_t")) / F.log(F.lit(float(total)) / F.col("n_e"))).where(F.col("share") >= disclosure)
    extra = met.select("place", *entity, "term").join(told, [*entity, "term"]).select("place", "term", "share")
    extra = extra.unionByName(spelled.join(own_words, "term").select("place", "term", "share")).groupBy("place", "term").agg(F.max("share").alias("share"))
    extra = written(extra.select(F.col("place").alias("at"), "term", (F.col("share") > 1 - 1e-9).alias("full")), "pii-terms")

    # Places of told terms: words of the texts that have any, met by an equal join; then a window that runs within one text.
    worded = seen.join(extra.select("at").distinct(), F.col("place") == F.col("at"), "left_semi")
    words = worded.select("place", F.explode(_found(_folded(F.col("text")), _WORD, len(PATTERNS))).alias("w")).select("place", F.col("w.value").alias("term"), F.col("w.start").alias("start"), F.col("w.end").alias("end"))
    marks = words.join(extra.select(F.col("at").alias("place"), "term", "full"), ["place", "term"]).select("place", "start", "end", "full")
    bases = worded.select("place", F.explode("base").alias("b")).select("place", F.col("b.start").alias("start"), F.col("b.end").alias("end"), F.lit(None).cast("boolean").alias("full"))
    in_text = Window.partitionBy("place").orderBy("start")
    is_base = F.col("full").isNull()
    upto = F.max(F.when(is_base, F.col("end"))).over(in_text.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    following = F.min(F.when(is_base, F.col("start"))).over(in_text.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    marks = marks.unionByName(bases).withColumns({"upto": upto, "following": following}).where("full is not null and coalesce(upto <= start, true) and coalesce(following >= end, true)")
    span = F.struct("start", F.lit(len(PATTERNS)).alias("kind"), "end")
    cut = F.struct("start", F.when(F.col("full"), _REMOVED).otherwise(len(PATTERNS)).alias("kind"), "end")
    marks = marks.groupBy(F.col("place").alias("at")).agg(F.array_sort(F.collect_list(span)).alias("terms"), F.array_sort(F.collect_list(cut)).alias("cut"), F.array_sort(F.collect_list(F.when(F.col("full"), F.col("start")))).alias("removed"))
    both = seen.join(marks, F.col("place") == F.col("at"), "left")
    bare = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    both = both.withColumns({"base": bare} | {c: F.coalesce(c, F.array().cast("array<struct<start: int, kind: int, end: int>>")) for c in ("terms", "cut")})
    return both.select("doc_id", "text_hash", F.array_sort(F.concat("base", "terms")).alias("spans"), "base", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"), F.array_sort(F.concat("base", "cut")).alias("cuts"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(found: DataFrame) -> DataFrame:
    """doc_id, one count for each kind of pattern, base_sha256, spans."""
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as long) as n_{kind}") for k, kind in enumerate(PATTERNS)]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _between(segments: Column, start: Column, end: Column) -> Column:
    """Code points from ``start`` up to ``end`` of a text cut into segments; no more than those segments are looked at."""
    first, last = F.floor(start / _SEGMENT).cast("int"), F.floor(end / _SEGMENT).cast("int")
    segment = lambda k: F.coalesce(F.get(segments, k), F.lit(""))
    apart = F.concat(F.substring(segment(first), start - first * _SEGMENT + 1, F.lit(_SEGMENT)), F.array_join(F.slice(segments, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(segment(last), F.lit(1), end - last * _SEGMENT))
    return F.when(first == last, F.substring(segment(first), start - first * _SEGMENT + 1, F.greatest(end - start, F.lit(0)))).otherwise(apart)


def sanitised(text: Column, cuts: Column) -> Column:
    """The text with each span generalised to ``<kind>`` (terms that reveal all are removed); of overlapping spans the first to start, extended."""
    marks, step = F.array(*(F.lit(f"<{k}>") for k in KINDS), F.lit("")), "struct<start: int, kind: int, end: int, at: int>"

    def furthest(done: Column, s: Column) -> Column:
        """Each span with the end of all before it in its run."""
        new = F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), done["at"].alias("at"))
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.concat(F.coalesce(done["spans"], F.array().cast(f"array<{step}>")), F.array(new)).alias("spans"))

    def run(done: Column, part: Column) -> Column:
        made = F.aggregate(part, F.struct(done["at"].alias("at"), F.lit(None).cast(f"array<{step}>").alias("spans")), furthest)
        return _let(made, lambda p: F.struct(p["at"].alias("at"), F.concat(F.coalesce(done["runs"], F.array().cast(f"array<array<{step}>>")), F.array(p["spans"])).alias("runs")))

    def cut(made: Column, segments: Column) -> Column:
        """What stands before each span that is not covered, and its mark; then the rest."""
        fresh = F.filter(F.flatten(made["runs"]), lambda s: s["start"] >= s["at"])
        parts = F.transform(fresh, lambda s: F.concat(_between(segments, s["at"], s["start"]), F.element_at(marks, s["kind"] + 1)))
        return F.concat(F.array_join(parts, ""), _between(segments, made["at"], F.size(segments) * _SEGMENT))

    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast(f"array<array<{step}>>").alias("runs"))
    segments = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_SEGMENT}}}"), F.lit(0))
    return F.when(F.size(cuts) == 0, text).otherwise(_let(F.aggregate(_runs(cuts, _RUN), start, run), lambda made: _let(segments, lambda parts: cut(made, parts))))


def sanitise(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with personal data and revealing terms taken out of the texts; all rows and columns stay.  Null texts stay null."""
    found = find(docs, id_col=id_col, text_col=text_col, **options).where("size(spans) > 0")
    found = found.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), F.col("cuts").alias("_s")).dropDuplicates(["_d", "_h"])
    text = F.col(text_col).cast("string")
    met = docs.join(found, F.col(id_col).cast("long").eqNullSafe(F.col("_d")) & (F.xxhash64(text) == F.col("_h")), "left")
    return met.withColumn(text_col, F.when(F.col("_s").isNull(), text).otherwise(sanitised(text, F.col("_s")))).select(docs.columns)
