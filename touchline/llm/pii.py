"""PII sanitisation by information content: patterns find protected entities, the corpus tells which terms give them away.

A term near an entity discloses it by pmi(entity; term) = log2(p(entity | term) / p(entity)), in shares of the entity's
own information -log2 p(entity). Both come from counts over the whole corpus: how often the term stands within the
context of the entity's occurrences, and how often it stands anywhere. From GENERALISE on, a term that reveals an entity
is generalised, from REMOVE on removed, anywhere in the documents that hold the entity. A term must be seen in MIN_CONTEXTS different
contexts of the entity, so copies of one text prove nothing.

Null texts are empty. Repeated rows are counted and sanitised alike. Overlapping spans are replaced once. An empty
table gives an empty result. Other columns are carried untouched, but for names that start with _pii_. Patterns scan long
texts in linear time; places are prefix sums of n log n steps, and pieces are cut from chunks of CHUNK characters, so no
step walks a long text once for each of its entities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import join_small, key_hash, let, materialise, table

#: Possessive and anchored forms of the contract's patterns: the same matches, without backtracking.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"\p{L}{3,}+"
KINDS = ("email", "ip", "card", "phone", "term")
CONTEXT = 64
CHUNK = 1024
MIN_CONTEXTS = 3
GENERALISE = 0.75
REMOVE = 0.9
P = "_pii_"


def running(values: Column, join) -> Column:
    """Inclusive prefix results of an array under an associative `join`, by doubling steps."""
    steps = F.sequence(F.lit(0), F.length(F.bin(F.size(values).cast("long"))) - 1)
    step = lambda acc, k: F.transform(acc, lambda v, i: F.coalesce(join(F.get(acc, i - F.pow(F.lit(2), k).cast("int")), v), v))
    return F.aggregate(steps, values, step)


def found(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as struct(s, e, v): the gaps that split() leaves give the positions."""
    both = F.struct(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("h"))

    def placed(x):
        ends = running(F.transform(x["h"], lambda v, i: F.length(F.get(x["g"], i)) + F.length(v)), lambda a, b: a + b)
        return F.zip_with(ends, x["h"], lambda e, v: F.struct((e - F.length(v)).alias("s"), e.alias("e"), v.alias("v")))

    return let(both, placed)


def cut(chunks: Column, start: Column, stop: Column) -> Column:
    """Characters start to stop (exclusive) of a text that lies in chunks."""
    first = F.floor(start / CHUNK).cast("int")
    some = F.slice(chunks, first + 1, F.floor((stop - 1) / CHUNK).cast("int") - first + 1)
    return F.when(stop > start, F.substring(F.array_join(some, ""), start - first * CHUNK + 1, stop - start)).otherwise("")


def chunked(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}+"), F.lit(0))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    doubled = "0246813579"
    one = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.translate(c, "0123456789", doubled).cast("int"))
    parts = F.transform(F.split(F.reverse(digits), ""), one)
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10 == 0


def _is_ip(v: Column) -> Column:
    part = lambda p: let(F.ltrim(p, F.lit("0")), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255")))
    return F.forall(F.split(v, r"\."), part)


def base_spans(text: Column) -> Column:
    """array<struct(kind, s, e, v)> by kind as listed, then start; `kind` counts from 0."""
    none = F.expr("CAST(array() AS array<struct<s:int,e:int,v:string>>)")
    n = lambda v: F.length(_digits(v))
    digit = text.rlike("[0-9]")
    parts = [
        F.when(text.contains("@"), found(text, EMAIL)).otherwise(none),
        F.when(digit, F.filter(found(text, IP), lambda x: _is_ip(x["v"]))).otherwise(none),
        F.when(digit, F.filter(found(text, CARD), lambda x: (n(x["v"]) <= 19) & _luhn(_digits(x["v"])))).otherwise(none),
        F.when(text.contains("+"), F.filter(found(text, PHONE), lambda x: n(x["v"]).between(9, 15))).otherwise(none),
    ]
    typed = lambda k: lambda x: F.struct(F.lit(k).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"))
    return F.concat(*(F.transform(p, typed(k)) for k, p in enumerate(parts)))


def with_spans(docs: DataFrame) -> DataFrame:
    """docs with _pii_id, _pii_hash (which tell texts apart) and _pii_base."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({f"{P}id": F.col("doc_id"), f"{P}hash": key_hash(F.col("text")), f"{P}base": base_spans(text)})


def blanked(spanned: DataFrame) -> DataFrame:
    """Documents with entities, these blanked in _blank, so that no term overlaps an entity; _n is the text's length."""
    blank = replaced(F.col("text"), F.col(f"{P}base"), lambda x, at: F.repeat(F.lit(" "), x["e"] - F.greatest(at, x["s"])))
    return spanned.where(F.size(f"{P}base") > 0).select(f"{P}id", f"{P}hash", f"{P}base", blank.alias("_blank"), F.length("text").alias("_n"))


def entity_of(span: Column) -> Column:
    return F.concat_ws(":", span["kind"], F.lower(span["v"]))


def occurrences(spanned: DataFrame, told: DataFrame) -> DataFrame:
    """Document, s, e, kind: every place of a told term in each document that holds an entity it reveals. The join starts from
    the terms that a text holds: a term gives away few entities (their shares of its contexts are large), while an entity may
    be given away by any number of terms."""
    mine = [f"{P}id", f"{P}hash"]
    blank = blanked(spanned)
    holds = spanned.where(F.size(f"{P}base") > 0).select(F.col(f"{P}id").alias("_i"), F.col(f"{P}hash").alias("_h"), F.explode(F.array_distinct(F.transform(f"{P}base", entity_of))).alias("_entity"))
    terms = blank.select(*mine, F.explode(F.array_distinct(F.transform(F.regexp_extract_all("_blank", F.lit(TERM), F.lit(0)), F.lower))).alias("term"))
    kind = F.when(F.col("share") >= REMOVE, 5).otherwise(4).alias("kind")
    same = F.col(f"{P}id").eqNullSafe(F.col("_i")) & (F.col(f"{P}hash") == F.col("_h"))
    asked = join_small(terms, told.select("entity", "term", kind), "term", "inner").join(holds, same & (F.col("entity") == F.col("_entity")), "left_semi")
    asked = asked.groupBy(*mine, "term").agg(F.max("kind").alias("kind"))
    asked = asked.groupBy(F.col(f"{P}id").alias("_i"), F.col(f"{P}hash").alias("_h")).agg(F.map_from_entries(F.collect_list(F.struct("term", "kind"))).alias("kinds"))
    asked = materialise(asked, "asked")
    rows = join_small(blank, asked, same, "inner")
    rows = rows.select(*mine, "kinds", F.explode(found(F.col("_blank"), TERM)).alias("t"))
    return rows.select(*mine, F.col("t.s").alias("s"), F.col("t.e").alias("e"), F.col("kinds")[F.lower("t.v")].alias("kind")).where("kind is not null").distinct()


def contexts(spanned: DataFrame) -> DataFrame:
    """A row for each term within CONTEXT characters of an entity: document, entity, term, s, e, and the context's digest.
    Terms are sought in the text with all entities blanked."""
    c, n = F.col, F.col("_n")
    start, stop = lambda b: F.greatest(F.lit(0), b["s"] - CONTEXT), lambda b: F.least(n, b["e"] + CONTEXT)
    snips = lambda k: F.transform(f"{P}base", lambda b: F.struct(b.alias("b"), start(b).alias("start"), stop(b).alias("stop"), cut(k, start(b), stop(b)).alias("snip")))
    rows = blanked(spanned).select(f"{P}id", f"{P}hash", "_n", F.explode(let(chunked(c("_blank")), snips)).alias("x")).select(f"{P}id", f"{P}hash", "_n", "x.*")
    whole = lambda x: ((x["s"] > 0) | (c("start") == 0)) & ((x["e"] < c("stop") - c("start")) | (c("stop") == n))
    moved = lambda x: F.struct((x["s"] + c("start")).alias("s"), (x["e"] + c("start")).alias("e"), F.lower(x["v"]).alias("v"))
    rows = rows.select(f"{P}id", f"{P}hash", entity_of(c("b")).alias("entity"), F.transform(F.filter(found(c("snip"), TERM), whole), moved).alias("t"))
    rows = rows.select(f"{P}id", f"{P}hash", "entity", F.xxhash64(F.transform("t", lambda x: x["v"])).alias("ctx"), F.explode("t").alias("t"))
    return rows.select(f"{P}id", f"{P}hash", "entity", "ctx", F.col("t.v").alias("term"), F.col("t.s").alias("s"), F.col("t.e").alias("e"))


def disclosures(docs: DataFrame, near: DataFrame) -> DataFrame:
    """entity, term, share: the terms that reveal an entity, by how much of its information."""
    each = near.groupBy("entity", "term", "ctx").agg(F.count("*").alias("n"))
    pairs = materialise(each.groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("n_ctx")), "pairs")
    sizes = pairs.groupBy("entity").agg(F.sum("n_both").alias("n_entity"))
    pairs = materialise(pairs.where(F.col("n_ctx") >= MIN_CONTEXTS).join(sizes, "entity"), "pairs")
    asked = materialise(pairs.select("term", F.lit(True).alias("asked")).distinct(), "terms")
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0))).alias("term"))
    counts = materialise(join_small(words, asked, "term").groupBy(F.when(F.col("asked"), F.col("term")).alias("term")).agg(F.count("*").alias("c")), "terms")
    total = float(counts.agg(F.sum("c")).first()[0] or 1)
    rows = pairs.join(counts, "term")
    pmi = F.log2(F.col("n_both") / F.col("c") * total / F.col("n_entity"))
    share = pmi / F.log2(total / F.col("n_entity"))
    return rows.select("entity", "term", share.alias("share")).where(F.col("share") >= GENERALISE)


def replaced(text: Column, spans: Column, label) -> Column:
    """The text with label(span, at) in place of every span, `at` being where the spans before it end; what overlaps is
    replaced once."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))

    def pieces(x):
        ends = running(F.transform(x["o"], lambda y: y["e"]), lambda a, b: F.greatest(a, b))

        def piece(y, i, ends):
            at = F.coalesce(F.get(ends, i - 1), F.lit(0))
            return F.when(y["e"] > at, F.concat(cut(x["c"], at, y["s"]), label(y, at))).otherwise("")

        return let(ends, lambda e: F.concat(F.array_join(F.transform(x["o"], lambda y, i: piece(y, i, e)), ""), cut(x["c"], F.element_at(e, -1), F.length(text))))

    return F.when(F.size(spans) > 0, let(F.struct(ordered.alias("o"), chunked(text).alias("c")), pieces)).otherwise(text)


def sanitised(text: Column, spans: Column) -> Column:
    """Of overlapping spans the first is named."""
    labels = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS[:4]), F.lit("[TERM]"), F.lit(""))
    return replaced(text, spans, lambda x, at: F.when(x["s"] >= at, F.element_at(labels, x["kind"] + 1)).otherwise(""))


def sanitise(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The `carry` columns, text, _pii_base, _pii_terms and _pii_clean (the sanitised text; null stays null).

    _pii_terms is array<struct(kind, s, e)>; kind 4 is generalised, 5 removed."""
    keep = list(dict.fromkeys([*carry, "doc_id", "text"]))
    docs = docs.select(*keep)
    spanned = with_spans(docs)
    near = materialise(contexts(spanned), "contexts")
    told = materialise(disclosures(docs, near), "disclosures")
    mine = occurrences(spanned, told)
    mine = materialise(mine.groupBy(F.col(f"{P}id").alias(f"{P}i"), F.col(f"{P}hash").alias(f"{P}h")).agg(F.array_sort(F.collect_list(F.struct("kind", "s", "e"))).alias(f"{P}found")), "terms")
    out = spanned.join(mine, F.col(f"{P}id").eqNullSafe(F.col(f"{P}i")) & (F.col(f"{P}hash") == F.col(f"{P}h")), "left")
    out = out.withColumn(f"{P}terms", F.coalesce(f"{P}found", F.expr("CAST(array() AS array<struct<kind:int,s:int,e:int>>)")))
    every = F.concat(F.transform(f"{P}base", lambda x: F.struct(x["kind"], x["s"], x["e"])), f"{P}terms")
    return out.select(*keep, f"{P}base", f"{P}terms", sanitised(F.col("text"), every).alias(f"{P}clean"))


def op1_sanitise_pii(spark, sf_dir):
    out = sanitise(table(spark, sf_dir, "documents"), ["doc_id"])
    name = lambda k: F.element_at(F.array(*map(F.lit, [*KINDS, KINDS[-1]])), k + 1)
    told = lambda c: F.transform(F.array_sort(F.transform(c, lambda x: F.struct(F.least(x["kind"], F.lit(4)).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))), lambda x: F.concat_ws(":", name(x["kind"]), x["s"], x["e"]))
    n = lambda k: F.size(F.filter(f"{P}base", lambda x: x["kind"] == k)).cast("long")
    every = F.concat(told(F.col(f"{P}base")), told(F.col(f"{P}terms")))
    return out.select("doc_id", *(n(k).alias(f"n_{KINDS[k]}") for k in range(4)), F.sha2(F.array_join(told(F.col(f"{P}base")), ","), 256).alias("base_sha256"), F.array_join(every, ",").alias("spans"))
