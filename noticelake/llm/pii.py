"""Personal data: pattern spans, and terms that the corpus shows to reveal what was found.

Base spans are e-mail addresses, IP addresses, card and phone numbers. Every distinct value is a
protected entity. Terms are the words of the documents that mention it. Over the whole corpus a
term's disclosure of an entity is their pointwise mutual information in documents, divided by the
entity's information content, PMI(e; t) / IC(e): 1 if the term occurs only with the entity, 0 if it
says nothing about it (after Sanchez and Batet, C-sanitized). Terms seen with an entity in enough
different contexts and over the threshold become spans in the documents that hold the entity, to be
generalised or, if they tell it for certain, removed.

Everything is DataFrame functions. Patterns are written so that Java's regular expressions neither
recurse nor start anew inside a run: possessive loops, and a start only where the previous match
ended or no character of the run stands before. They match what the plain patterns match.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noticelake.llm.columns import aside
from noticelake.storage import cut, drop

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BLANKS, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"
#: Terms up to which they are sent to every task: at most some MB, as a term is one word.
BROADCAST_TERMS = 100_000
#: Spans, 20 bytes each, up to which they are sent to every task.
BROADCAST_SPANS = 1_000_000
#: Documents with disclosing terms up to which their ids, 8 bytes each, are sent to every task.
BROADCAST_IDS = 1_000_000
_SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def term(i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), term), F.lit(0), lambda a, x: a + x) % 10 == 0


def _octet(c: Column) -> Column:
    bare = F.ltrim(c, F.lit("0"))
    return F.when(F.length(bare) > 3, False).when(bare == "", True).otherwise(bare.try_cast("int") <= 255)


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), _octet)
    if kind == "card":
        digits = _digits(match)
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


def _may_hold(kind: str, text: Column) -> Column:
    """A cheap look that no text with a match fails."""
    return {"email": text.contains("@"), "phone": text.contains("+")}.get(kind, text.rlike("[0-9]"))


def entity(kind: str, match: Column) -> Column:
    """One name for all ways to write a value."""
    return F.concat(F.lit(f"{kind}:"), F.lower(match) if kind == "email" else match if kind == "ip" else _digits(match))


def _fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once per row.

    The optimiser would otherwise copy their expressions into every lambda that mentions them, and
    evaluate them for every element. It doesn't look through a generator.
    """
    held = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.withColumn("__held", held).select(*df.columns, *[F.col(f"__held.{n}").alias(n) for n in columns])


def _located(df: DataFrame, text: str, looks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Adds for every name of ``looks`` the spans of a pattern, in code points and in order.

    ``looks`` maps a name to the pattern and to a cheap condition that every text with a match meets.
    Places are running sums over matches and the text between them, in steps of the square root of
    their number.
    """
    none = lambda kind: F.array().cast(f"array<{kind}>")
    add = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    cut_up = {}
    for name, (pattern, may) in looks.items():
        cut_up[f"__m_{name}"] = F.when(may, F.regexp_extract_all(F.col(text), pattern, F.lit(0))).otherwise(none("string"))
        cut_up[f"__g_{name}"] = F.when(may, F.transform(F.split(F.col(text), pattern, -1), lambda x: F.length(x))).otherwise(none("int"))
    first = _fixed(df, **cut_up)
    steps = {}
    for name in looks:
        steps[f"__s_{name}"] = F.zip_with(f"__m_{name}", F.slice(f"__g_{name}", F.lit(1), F.size(f"__m_{name}")), lambda x, gap: F.length(x) + gap)
        steps[f"__b_{name}"] = F.ceil(F.sqrt(F.greatest(F.size(f"__m_{name}"), F.lit(1)))).cast("int")
    second = _fixed(first, **steps)
    heads = {}
    for name in looks:
        heads[f"__h_{name}"] = _block_sums(F.col(f"__s_{name}"), F.col(f"__b_{name}"), add)
    third = _fixed(second, **heads)
    ends = {f"__e_{name}": _running(F.col(f"__s_{name}"), F.col(f"__b_{name}"), F.col(f"__h_{name}"), add) for name in looks}
    fourth = _fixed(third, **ends)
    spans = {name: F.zip_with(f"__m_{name}", f"__e_{name}", lambda x, end: F.struct((end - F.length(x)).alias("start"), end.alias("end"), x.alias("value"))) for name in looks}
    return _fixed(fourth, **spans).select(*df.columns, *looks)


def _block_sums(steps: Column, block: Column, add) -> Column:
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(steps) / block).cast("int")), lambda k: add(F.slice(steps, k * block + 1, block)))


def _running(steps: Column, block: Column, sums: Column, add, both=lambda a, b: a + b) -> Column:
    """Of every step what ``add`` makes of it and all before, from what it made of the blocks."""
    def end(_: Column, i: Column) -> Column:
        k = F.floor(i / block).cast("int")
        return both(add(F.slice(sums, F.lit(1), k)), add(F.slice(steps, k * block + 1, i - k * block + 1)))

    return F.transform(steps, end)


def _named(spans: Column, kind: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(kind.alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))


def _valid_spans(kind: str) -> Column:
    return _named(F.filter(f"__{kind}", lambda x: valid(kind, x["value"])), F.lit(kind))


def with_base(docs: DataFrame, text: str = "text", out: str = "base") -> DataFrame:
    """Adds ``out``: the base spans, by kind as listed, then by start. Null counts as empty."""
    df = docs.withColumn("__text", F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    df = _located(df, "__text", {f"__{k}": (F.lit(PATTERNS[k]), _may_hold(k, F.col("__text"))) for k in KINDS})
    return _fixed(df, **{out: F.concat(*[_valid_spans(k) for k in KINDS])}).select(*docs.columns, out)


def _blanked(c: Column) -> Column:
    return reduce(lambda x, k: F.regexp_replace(x, PATTERNS[k], " "), KINDS, c)


def _contexts(rows: DataFrame, reach: int) -> DataFrame:
    """A row per mention: ``id``, its entity, the words within reach as far as the next mention of its kind."""
    text = F.col("text")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    held = rows.where(reduce(lambda a, b: a | b, [_may_hold(k, text) for k in ("email", "ip")]))
    parts = []
    for kind in KINDS:
        cut_up = _fixed(
            held,
            found=F.when(_may_hold(kind, text), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))).otherwise(none("string")),
            pieces=F.when(_may_hold(kind, text), F.transform(F.split(text, PATTERNS[kind], -1), lambda p: F.filter(F.split(_blanked(p), BLANKS), lambda w: w != ""))).otherwise(none("array<string>")),
        )
        left = F.transform(F.slice("pieces", F.lit(1), F.size("found")), lambda p: F.slice(p, F.greatest(F.size(p) - reach + 1, F.lit(1)), F.lit(reach)))
        right = F.transform(F.slice("pieces", F.lit(2), F.size("found")), lambda p: F.slice(p, F.lit(1), F.lit(reach)))
        each = cut_up.select("id", F.explode(F.arrays_zip(F.col("found").alias("value"), F.zip_with(left, right, lambda a, b: F.concat(a, b)).alias("words"))).alias("m"))
        parts.append(each.where(valid(kind, F.col("m.value"))).select("id", entity(kind, F.col("m.value")).alias("entity"), "m.words"))
    return reduce(DataFrame.unionByName, parts)


def _documents_with(rows: DataFrame, terms: DataFrame, out: str) -> DataFrame:
    """In how many documents every one of ``terms`` occurs."""
    if terms.count() <= BROADCAST_TERMS:
        terms = F.broadcast(terms)
    return rows.select(F.explode(F.array_distinct(F.split("text", BLANKS))).alias("term")).join(terms, "term").groupBy("term").agg(F.count("*").alias(out))


def _held(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of some documents, once each."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return rows.join(ids, "id", "left_semi").dropDuplicates(["id"])


def _words_of(held: DataFrame, reach: int) -> DataFrame:
    """Once per document and word: ``id``, ``term``, and ``own``, one context of the word."""
    split = _fixed(held, words=F.filter(F.split("text", BLANKS), lambda w: w != ""))
    each = F.transform("words", lambda w, i: F.struct(w.alias("term"), F.xxhash64(F.slice("words", F.greatest(i - reach + 1, F.lit(1)), F.lit(2 * reach + 1))).alias("own")))
    return split.select("id", F.explode(each).alias("w")).groupBy("id", F.col("w.term").alias("term")).agg(F.min("w.own").alias("own"))


def _disclosing(rows: DataFrame, reach: int, support: int, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored tables: ``entity``, ``class``; ``id``, ``class`` of the documents of a class; ``class``, ``term``, ``disclosure``.

    Entities that the same documents mention are one class: a term discloses all of them alike. So a document
    with thousands of addresses that stand nowhere else has one class, not thousands times its words.
    """
    mentions = _contexts(rows, reach)
    near = cut(mentions.select("id", "entity", F.xxhash64("words").alias("context"), F.array_distinct("words").alias("words")), "mentions")
    total = rows.count()
    named = cut(near.groupBy("id", "entity").agg(F.min("context").alias("mention")), "named")
    name = F.concat_ws("-", F.count("*"), F.hex(F.bit_xor(F.xxhash64("id"))), F.hex(F.bit_xor(F.xxhash64(F.lit(1), "id"))))
    entities = cut(named.groupBy("entity").agg(name.alias("class"), F.count("*").alias("mentioned"), F.countDistinct("mention").alias("apart")), "entities")
    pairs = near.select("id", "entity", "context", F.explode("words").alias("term"))
    close = cut(pairs.groupBy("entity", "term").agg(F.countDistinct("context").alias("contexts")).where(f"contexts >= {support}").join(entities, "entity").select("entity", "class", "term"), "close")
    near_terms = close.select("class", "term").distinct().withColumn("close", F.lit(True))
    # a class of fewer documents has other contexts only near its mentions
    classes = entities.groupBy("class").agg(F.first("mentioned").alias("mentioned"), F.max("apart").alias("apart"))
    classes = classes.where(f"mentioned >= {support}").unionByName(classes.where(f"mentioned < {support}").join(close.select("class").distinct(), "class", "left_semi"))
    members = cut(named.join(entities.select("entity", "class"), "entity").select("id", "class").distinct().join(classes, "class"), "members")
    found = cut(_words_of(_held(rows, members.select("id").distinct()), reach), "words")
    # Disclosure is at most ln(total / max(mentioned, held)) / ln(total / mentioned), where a term is in ``held`` of these
    # documents: that spares the common words, exactly, before any pair is made.
    most = F.pow(F.lit(float(max(total, 1))), F.lit(1 - threshold)) * F.pow("mentioned", F.lit(threshold)) * (1 + 1e-9)
    held = found.groupBy("term").agg(F.count("*").alias("held")).join(close.select("term").distinct().withColumn("near", F.lit(True)), "term", "left").where((F.col("held") >= support) | F.col("near")).drop("near")
    rare = cut(found.join(held, "term"), "rare-words")
    # a word stuck to a mention stands in no text by itself
    stuck = pairs.join(close.select("entity", "class", "term"), ["entity", "term"]).select("id", "class", "term").distinct().join(found, ["id", "term"], "left_anti")
    together = rare.join(members, "id").where(F.col("held") <= most).groupBy("class", "term").agg(F.count("*").alias("n"), F.countDistinct("own").alias("own"))
    counted = together.unionByName(stuck.groupBy("class", "term").agg(F.count("*").alias("n")).withColumn("own", F.lit(0).cast("long"))).groupBy("class", "term").agg(F.sum("n").alias("together"), F.sum("own").alias("own"))
    rated = counted.join(near_terms, ["class", "term"], "left").where(F.col("close") | (F.col("together") >= support)).join(classes, "class")
    content = F.log(F.lit(float(total)) / F.col("mentioned"))

    def disclosure(count: str) -> Column:
        info = F.log(F.lit(float(total)) * F.col("together") / (F.col("mentioned") * F.greatest(count, "together")))
        return F.when(content > 0, info / content)

    likely = cut(rated.join(held, "term", "left").where(disclosure("held") >= threshold).drop("held"), "likely")
    sure = F.col("close") | (F.col("own") >= support) | ((F.col("together") == F.col("mentioned")) & (F.col("apart") >= support))
    # where a term is in some of a class's documents only, its entities' contexts are counted there one by one
    open_ = likely.where(~F.coalesce(sure, F.lit(False)) & (F.col("apart") >= support)).select("class", "term")
    each = open_.join(entities.where(f"apart >= {support}").select("entity", "class"), "class").join(named, "entity").join(rare.select("id", "term"), ["id", "term"])
    settled = each.groupBy("class", "entity", "term").agg(F.countDistinct("mention").alias("n")).where(f"n >= {support}").select("class", "term").distinct()
    known = cut(likely.where(sure).unionByName(likely.join(settled, ["class", "term"], "left_semi")), "disclosing")
    anywhere = _documents_with(rows, known.select("term").distinct(), "anywhere")
    # a term stuck to a mention is a word of its own there; it never occurs less often than together
    final = known.join(anywhere, "term", "left").withColumn("disclosure", disclosure("anywhere"))
    out = cut(final.where(F.col("disclosure") >= threshold).select("class", "term", "disclosure"), "disclosures")
    drop(near, named, close, found, rare, likely, known)
    return entities.select("entity", "class"), members.select("id", "class"), out


def disclosures(rows: DataFrame, reach: int = 8, support: int = 3, threshold: float = 0.8) -> DataFrame:
    """A table of ``entity``, ``term``, ``disclosure`` of the terms over the threshold.

    ``rows`` has ``id`` and ``text``. A term and an entity occur together wherever a document holds
    both. ``support`` counts different contexts, ``reach`` words to either side: of the mentions that
    have the term near, or one a document of its mentions or of the term, so that copies of a
    document prove nothing. Entities of the same documents have the terms of each other.
    """
    entities, _, told = _disclosing(rows, reach, support, threshold)
    return entities.join(told, "class").select("entity", "term", "disclosure")


def _identity(key: str, text: str) -> Column:
    named = F.concat_ws("\1", F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("\0")), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("\0")))
    return F.unhex(F.md5(named))


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = 8, support: int = 3, threshold: float = 0.8) -> DataFrame:
    """A stored table of ``key``, ``id``, ``base`` and ``terms``, a row per row of ``docs``.

    ``base`` and ``terms`` are arrays of spans (kind, start, end, value): code points, ends exclusive;
    terms that touch a base span are left to it. ``id`` is a hash of key and text in 128 bits, so that
    no document is taken for another. Null text is empty;
    rows with a null key count as documents of their own text. Repeated rows are kept.
    """
    named = docs.select(F.col(f"`{key}`").alias("key"), _identity(key, text).alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    rows = named.select("id", "text")
    based = cut(with_base(named).select("key", "id", "base"), "base-spans")
    _, members, told = _disclosing(rows, reach, support, threshold)
    if told.isEmpty():
        return based.withColumn("terms", F.array().cast(_SPANS))
    # what tells an entity for certain is removed, the rest generalised
    wanted = cut(members.join(told, "class").groupBy("id", "term").agg(F.max("disclosure").alias("d")), "told")
    hits = _held(rows, wanted.select("id").distinct())
    placed = _located(hits, "text", {"found": (F.lit(WORD), F.lit(True))}).select("id", F.explode("found").alias("w"))
    met = placed.select("id", "w.start", "w.end", "w.value").join(wanted.withColumnRenamed("term", "value"), ["id", "value"])
    kind = F.when(F.col("d") >= 1 - 1e-9, "removed").otherwise("term")
    free = _clear(met.select("id", kind.alias("kind"), "start", "end", "value"), based.where(F.size("base") > 0).dropDuplicates(["id"]).select("id", F.explode("base").alias("b")).select("id", "b.start", "b.end"))
    terms = free.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "value", "kind"))).alias("found"))
    terms = terms.select("id", F.transform("found", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"))).alias("terms"))
    out = cut(based.join(terms, "id", "left").select("key", "id", "base", F.coalesce("terms", F.array().cast(_SPANS)).alias("terms")), "spans")
    drop(based, told, wanted)
    return out


def _clear(spans: DataFrame, others: DataFrame) -> DataFrame:
    """``spans`` that touch none of ``others``, in the order of their starts within each ``id``."""
    both = spans.join(others.select("id").distinct(), "id", "left_semi").withColumn("own", F.lit(True)).unionByName(others.withColumn("own", F.lit(False)), allowMissingColumns=True)
    line = W.partitionBy("id").orderBy("start", "own")
    before = F.max(F.when(~F.col("own"), F.col("end"))).over(line.rowsBetween(W.unboundedPreceding, -1))
    after = F.first(F.when(~F.col("own"), F.col("start")), ignorenulls=True).over(line.rowsBetween(1, W.unboundedFollowing))
    clear = both.withColumn("before", before).withColumn("after", after).where("own and (before is null or before <= start) and (after is null or after >= end)")
    return clear.select(*spans.columns).unionByName(spans.join(others.select("id").distinct(), "id", "left_anti"))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with every span of ``text`` masked; all other columns and all rows stay.

    Only documents with spans are moved to them, unless these are few enough to be sent to every task.
    """
    found = spans(docs, key, text, **options)
    some = found.where("size(base) > 0 or size(terms) > 0").dropDuplicates(["id"]).select(F.col("id").alias("__id"), F.transform(F.concat("base", "terms"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))).alias("__spans"))
    some = cut(some, "masks")
    inner = aside(docs, key, text)
    named = inner.withColumn("__id", _identity(key, text))
    if (some.agg(F.sum(F.size("__spans") + 1)).first()[0] or 0) <= BROADCAST_SPANS:
        return masked(named.join(F.broadcast(some), "__id", "left"), text, "__spans").select(*inner.columns).toDF(*docs.columns)
    # spans are at base spans or in documents that hold one: the others stay where they are
    based = with_base(named, text, "__base")
    with_spans = based.where(F.size("__base") > 0).drop("__base").join(some, "__id", "left")
    done = masked(with_spans, text, "__spans").select(*inner.columns).unionByName(based.where(F.size("__base") == 0).select(*inner.columns))
    return done.toDF(*docs.columns)


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long")


def listed(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    name = lambda x: F.when(x["kind"].isin("term", "removed"), "term").otherwise(x["kind"])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", name(x), x["start"].cast("string"), x["end"].cast("string"))), ",")


def masked(df: DataFrame, text: str, found: str) -> DataFrame:
    """``df`` with every span of ``found`` in ``text`` replaced by its kind in brackets; ``removed`` spans leave nothing.

    Spans that touch are one, of the kind that starts first. Ends so far are running maxima in blocks, and
    the text is cut in blocks before it is cut at spans, both of the square root of their number: places in a
    text are counted from its start, or from a block's.
    """
    span = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("kind"))
    none = F.slice(F.array(span), 1, 0)
    top = lambda part: F.coalesce(F.array_max(part), F.lit(0))
    root = lambda a: F.ceil(F.sqrt(F.greatest(F.size(a), F.lit(1)))).cast("int")
    held = _fixed(df, __o=F.coalesce(F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))), none))
    held = _fixed(held, __n=root("__o"), __x=F.transform("__o", lambda x: x["end"]))
    held = _fixed(held, __h=_block_sums(F.col("__x"), F.col("__n"), top))
    held = _fixed(held, __e=_running(F.col("__x"), F.col("__n"), F.col("__h"), lambda part: top(part), F.greatest))
    # spans that start something, with the end of what was before
    begun = F.zip_with("__o", F.concat(F.array(F.lit(0)), F.slice("__e", F.lit(1), F.greatest(F.size("__e") - 1, F.lit(0)))), lambda x, at: F.struct(at.alias("at"), x["start"].alias("start"), x["kind"].alias("kind")))
    held = _fixed(held, __g=F.when(F.size("__o") > 0, F.filter(begun, lambda x: x["start"] >= x["at"])).otherwise(F.slice(F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("start"), F.lit("").alias("kind"))), 1, 0)))
    held = _fixed(held, __m=root("__g"))
    first = lambda k: F.get("__g", k * F.col("__m"))["at"]
    block = lambda k: F.substring(F.col(f"`{text}`"), first(k) + 1, F.coalesce(first(k + 1), F.length(F.col(f"`{text}`"))) - first(k))
    held = _fixed(held, __b=F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size("__g") / F.col("__m")).cast("int") - 1, F.lit(0))), block))

    def piece(x: Column, i: Column) -> Column:
        k = F.floor(i / F.col("__m")).cast("int")
        mask = F.when(x["kind"] == "removed", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
        return F.concat(F.substring(F.get("__b", k), x["at"] - first(k) + 1, x["start"] - x["at"]), mask)

    whole = F.concat(F.array_join(F.transform("__g", piece), ""), F.substring(F.col(f"`{text}`"), F.element_at("__e", -1) + 1, F.length(F.col(f"`{text}`"))))
    return held.withColumn(text, F.when(F.size("__g") > 0, whole).otherwise(F.col(f"`{text}`"))).select(*df.columns)
