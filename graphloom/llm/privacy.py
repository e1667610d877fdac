"""Personal data: patterns, and information-theoretic sanitisation of the terms around them.

Base patterns find e-mail addresses, IP addresses, payment cards and phone numbers; each distinct value is a
protected entity. What the corpus says about an entity is estimated from co-occurrence: a term that
stands within CONTEXT words of the entity reveals log2(p(t, e) / (p(t) p(e))) bits about it, where the
probabilities are document frequencies and p(t, e) is smoothed: of the k different contexts that a term and an entity share (so
copies of one passage are one piece of evidence) DISCOUNT is taken off. A term is disclosive if it reveals at least THRESHOLD
of the entity's own information -log2 p(e). Disclosive terms become spans in every document that holds them; sanitising
replaces spans by their kind (generalised) or drops them (removed).

Everything is SQL: no Python runs on the executors. Offsets come from splitting a text by the pattern: lengths of the
pieces and matches, one after another, are code points. The patterns below match what the plain ones match, with
possessive runs and guards so that long runs of digits or letters take linear time and no stack.

The document frequencies need one 8-byte hash and count per distinct word of a task. Up to BROADCAST_TERMS disclosive terms
are broadcast to find the documents that hold them, more are joined by a shuffle; texts are shuffled once to meet theirs.

Edges: null and empty texts have no spans; repeated rows are documents like any other; a document's
id may be null; terms are words of SHORTEST characters or more that aren't numbers; very long texts are worked on whole, in time of their length and the
matches' number to the power 1.5 (sanitising: matches times length, at the speed of skipping characters); spans of different kinds that start together stand in the kinds' order; an empty table gives an
empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, table

KINDS = ("email", "ip", "card", "phone", "term")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that a text without a match mostly fails.
MAYBE = {"email": "contains({t}, '@')", "ip": r"{t} rlike '[0-9]\\.[0-9]'", "card": r"{t} rlike '[0-9][\\x20-]?[0-9][\\x20-]?[0-9]'", "phone": r"{t} rlike '\\+[0-9]'"}
CONTEXT, DISCOUNT, THRESHOLD, SHORTEST = 6, 0.5, 0.8, 4
NEAR = 200
BROADCAST_TERMS = 200_000
TERM = r"[\p{L}\p{N}]+"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL of the body with a name for a value that is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _scan(rows: str, none: str, step: str, out: str) -> str:
    """SQL of the array (empty: none) of what `out` makes of each row x and the state a (an int, 0 at first), which `step` then makes the next one.

    Runs of about the square root of the rows are scanned one by one, as every append copies an array: n rows cost n ** 1.5 copies of a pointer."""
    k = "cast(ceil(sqrt(size(v))) as int)"
    inner = f"aggregate(slice(v, c * k + 1, k), struct(o.at as at, {none} as out), (i, x) -> {_let('a', 'i.at', f'struct({step} as at, concat(i.out, array({out})) as out)')})"
    outer = f"aggregate(sequence(0, cast(ceil(size(v) / k) as int) - 1), struct(0 as at, cast(array() as array<{{kind}}>) as out), (o, c) -> {_let('r', inner, 'struct(r.at as at, concat(o.out, array(r.out)) as out)')}, o -> flatten(o.out))"
    outer = outer.replace("{kind}", none[len("cast(array() as ") : -1])
    return _let("v", rows, f"case when size(v) = 0 then {none} else {_let('k', k, outer)} end")


NONE = "cast(array() as array<struct<start:int,rank:int,stop:int,value:string>>)"


def _found(text: str, pattern: str, rank: int) -> str:
    """SQL of array<struct<start, rank, stop, value>> of all matches of the pattern (SQL) in the text, in code points."""
    pairs = f"arrays_zip(slice(split({text}, {pattern}, -1), 1, size(regexp_extract_all({text}, {pattern}, 0))), regexp_extract_all({text}, {pattern}, 0))"
    return _scan(pairs, NONE, "a + length(x.`0`) + length(x.`1`)", f"struct(a + length(x.`0`) as start, {rank} as rank, a + length(x.`0`) + length(x.`1`) as stop, x.`1` as value)")


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


CHECKS = {
    "email": "true",
    "ip": "forall(split(x.value, '[.]'), p -> length(ltrim('0', p)) <= 3 and coalesce(try_cast(ltrim('0', p) as int), 0) <= 255)",
    "card": f"length({_digits('x.value')}) between 12 and 19 and luhn_check({_digits('x.value')})",
    "phone": f"length({_digits('x.value')}) between 9 and 15",
}


def base_spans(text: str) -> Column:
    """array<struct<start, rank, stop, value>> of the base spans, in order of start and kind; null texts have none."""
    t = f"coalesce({text}, '')"
    lists = [f"case when {MAYBE[kind].format(t=t)} then filter({_found(t, _quoted(PATTERNS[kind]), rank)}, x -> {CHECKS[kind]}) else {NONE} end" for rank, kind in enumerate(PATTERNS)]
    return F.expr(f"array_sort(concat({', '.join(lists)}))")


def entity(value: str, rank: str) -> str:
    """SQL of an entity's normal form."""
    return f"concat({rank}, ':', case {rank} when 0 then lower({value}) when 1 then {value} else {_digits(value)} end)"


def disclosive(docs: DataFrame, held: DataFrame, *, context: int = CONTEXT, discount: float = DISCOUNT, threshold: float = THRESHOLD) -> DataFrame:
    """(entity, term): the terms that reveal an entity. docs: all (text); held: (home, text, spans) of those with entities."""
    words = lambda part: f"regexp_extract_all({part}, {_quoted(TERM)}, 0)"
    # Up to CONTEXT whole words on either side, whatever their length: from the NEAR characters beside a span if they hold one word more
    # (the outermost may be cut off), else from the whole part.
    some = lambda near, part: _let("w", words(near), f"case when size(w) > {context} or length({near}) < {NEAR} then w else {words(part)} end")
    before = some(f"substring(text, greatest(s.start - {NEAR}, 0) + 1, least(s.start, {NEAR}))", "substring(text, 1, s.start)")
    after = some(f"substring(text, s.stop + 1, {NEAR})", "substring(text, s.stop + 1)")
    sides = f"concat({_let('b', before, f'reverse(slice(reverse(b), 1, {context}))')}, array('|'), slice({after}, 1, {context}))"
    contexts = held.select("home", F.expr(f"explode(transform(spans, s -> struct({entity('s.value', 's.rank')} as entity, {sides} as words)))").alias("c")).select("home", "c.entity", "c.words")
    per_entity = contexts.groupBy("entity", "home").agg(F.lit(1).alias("one")).groupBy("entity").agg(F.count("*").alias("df_entity"))
    terms = contexts.select("entity", "home", F.xxhash64("words").alias("context"), F.explode(F.expr("array_distinct(transform(words, w -> lower(w)))")).alias("term"))
    terms = terms.where(f"length(term) >= {SHORTEST} and not term rlike '^[0-9]+$'")
    together = terms.groupBy("entity", "term", "context", "home").agg(F.lit(1).alias("one"))
    contexts_of = together.groupBy("entity", "term", "context").agg(F.lit(1).alias("one")).groupBy("entity", "term").agg(F.count("*").alias("contexts"))
    both = together.groupBy("entity", "term", "home").agg(F.lit(1).alias("one")).groupBy("entity", "term").agg(F.count("*").alias("df_both"))
    candidates = saved(contexts_of.join(both, ["entity", "term"]).join(per_entity, "entity"))
    hashed = F.expr(f"explode(array_distinct(transform({words('text')}, w -> xxhash64(lower(w)))))")
    df = docs.where("text is not null").select(hashed.alias("hash")).groupBy("hash").agg(F.count("*").alias("df_term"))
    n = docs.agg(F.count("*").alias("n")).scalar()
    joined = candidates.withColumn("hash", F.xxhash64("term")).join(df, "hash").withColumn("n", n)
    bits, own = F.expr(f"log2(df_both * (1 - {discount}D / contexts) * double(n) / (double(df_term) * df_entity))"), F.expr("log2(double(n) / df_entity)")
    return joined.where((own > 0) & (bits >= threshold * own)).select("entity", "term")


def personal_spans(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, text, spans): all spans of every document, array<struct<start, rank, stop, value>> in order of start and kind."""
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("spans", base_spans("text")).withColumn("home", F.xxhash64("key", "text"))
    held = saved(source.where("size(spans) > 0").select("home", "text", "spans"))
    terms = saved(disclosive(source.select("text"), held, **options).select("term", F.xxhash64("term").alias("hash")).distinct())
    few = F.broadcast if terms.count() <= BROADCAST_TERMS else lambda rows: rows
    hashes = F.expr(f"explode(array_distinct(transform(regexp_extract_all(text, {_quoted(TERM)}, 0), w -> xxhash64(lower(w)))))")
    wanted = source.where("text is not null").select("home", hashes.alias("hash")).join(few(terms), "hash").groupBy("home").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    pattern = r"concat('(?iu)(?<![\\p{L}\\p{N}])(?:', array_join(transform(terms, t -> concat('\\Q', t, '\\E')), '|'), ')(?![\\p{L}\\p{N}])')"
    found = source.join(wanted, "home", "left").withColumn("pattern", F.expr(f"case when terms is not null then {pattern} end"))
    extra = F.expr(f"case when pattern is null then array() else filter({_found('text', 'pattern', KINDS.index('term'))}, x -> not exists(spans, b -> b.start < x.stop and x.start < b.stop)) end")
    with_terms = found.select("key", "text", F.array_sort(F.concat("spans", extra)).alias("spans"))
    return with_terms.select(F.col("key").alias(key), F.col("text").alias(text), "spans")


def sanitise(docs: DataFrame, *, key: str = "doc_id", text: str = "text", generalise: bool = True, **options) -> DataFrame:
    """(key, text): spans generalised to `[KIND]`, or removed; where spans overlap, the first covers."""
    mark = "concat('[', element_at(array(" + ", ".join(f"'{k.upper()}'" for k in KINDS) + "), s.rank + 1), ']')" if generalise else "''"
    # The kept text before each span that no earlier one covers, and its mark; then the text behind the last.
    part = f"case when x.start < a then '' else concat(substring(`{text}`, a + 1, x.start - a), {mark.replace('s.rank', 'x.rank')}) end"
    parts = _scan("spans", "cast(array() as array<string>)", "greatest(a, x.stop)", part)
    clear = F.expr(f"case when size(spans) = 0 then `{text}` else concat(array_join({parts}, ''), substring(`{text}`, array_max(transform(spans, s -> s.stop)) + 1)) end")
    return personal_spans(docs, key=key, text=text, **options).select(key, clear.alias(text))


def op6_pii_sanitisation(spark, sf_dir: str) -> DataFrame:
    found = personal_spans(table(spark, sf_dir, "documents"))
    count = lambda rank: F.expr(f"cast(size(filter(spans, s -> s.rank = {rank})) as bigint)")
    names = "element_at(array(" + ", ".join(f"'{k}'" for k in KINDS) + "), s.rank + 1)"
    text = lambda spans: F.expr(f"array_join(transform({spans}, s -> concat({names}, ':', s.start, ':', s.stop)), ',')")
    return found.select("doc_id", *(count(r).alias(f"n_{KINDS[r]}") for r in range(4)), F.sha2(text("filter(spans, s -> s.rank < 4)").cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"))
