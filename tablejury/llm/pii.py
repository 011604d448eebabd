"""Personal data: base patterns, then information-theoretic sanitisation of terms that reveal them. Built-in functions only.

The base kinds protect entities: e-mail and IP addresses, card and phone numbers.
A term reveals an entity as far as it raises the entity's probability: over the
corpus, PMI(e; t) = log2(n(e,t) N / (n(e) n(t))), which is at most the entity's
information content IC(e) = log2(N / n(e)), reached when t never occurs without e.
Their ratio is the disclosed share of the entity. In a document that names e,
terms of share `GENERALISE` or more are generalised to a tag, and of share
`REMOVE` or more removed. Counts are over all documents. A pair needs `SUPPORT`
distinct texts, or from `LEAST` texts on `EVIDENCE` bits against chance: the Chernoff
bound on a term of its frequency meeting the entity that often. Copies of one text
prove nothing. Rare entities add up in groups: e-mail owner and domain, network of
an address, issuer of a card, exchange of a phone number.

Offsets come from splitting a text by the pattern that found the matches: the
lengths of pieces and matches alternate, and their running sums are the spans.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablejury.llm.common import stored

GENERALISE, REMOVE, SUPPORT, LEAST, EVIDENCE, MIN_TERM = 0.9, 0.99, 5, 2, 10, 4
BLOCK = 256
BUCKETS = 1 << 18  # of terms by hash: at most so many whole numbers are broadcast

# The patterns find the same leftmost matches as the plain forms in the comments, without their backtracking.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ of 16 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
WORD = r"[\p{L}\p{N}]+"
# Words of MIN_TERM characters, and shorter ones with a capital, a digit or a letter of a script without case
TERM = rf"(?<![\p{{L}}\p{{N}}])(?=[\p{{L}}\p{{N}}]{{{MIN_TERM}}}|[\p{{L}}\p{{N}}]*[\p{{Lu}}\p{{Lo}}\p{{N}}])[\p{{L}}\p{{N}}]++"
SPAN = "array<struct<kind:string,s:bigint,e:bigint,value:string,tag:string>>"


def let(value: Column, body) -> Column:
    """Evaluate once, use many times (an expression inlined into a lambda would run per element)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, op) -> Column:
    """The fold of all earlier elements for each element (0 first), in blocks, so long arrays stay near linear."""
    def fold(array):
        return F.aggregate(array, F.lit(0).cast("long"), op)

    def blocks(v):
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / BLOCK).cast("int") - 1), lambda b: fold(F.slice(v, b * BLOCK + 1, F.lit(BLOCK))))

    def out(v, bases):
        return F.transform(v, lambda _, i: op(F.get(bases, F.floor(i / BLOCK).cast("int")),
                                              fold(F.slice(v, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK))))

    full = let(values, lambda v: let(blocks(v), lambda s: let(
        F.transform(s, lambda _, i: fold(F.slice(s, F.lit(1), i))), lambda bases: out(v, bases))))
    return F.when(F.size(values) > 0, full).otherwise(F.array().cast("array<bigint>"))


def located(text: Column, pattern: str) -> Column:
    """Every match with its span in code points: array of (value, s, e)."""
    def spans(matches, pieces):
        lengths = F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda p, m: (F.length(p) + F.length(m)).cast("long"))
        return let(running(lengths, lambda a, b: a + b), lambda before: F.transform(matches, lambda m, i: F.struct(
            m.alias("value"), (F.get(before, i) + F.length(F.get(pieces, i))).cast("long").alias("s"),
            (F.get(before, i) + F.length(F.get(pieces, i)) + F.length(m)).cast("long").alias("e"))))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(
        F.size(m) > 0, let(F.split(text, F.lit(pattern), F.lit(-1)), lambda p: spans(m, p))).otherwise(
        F.array().cast("array<struct<value:string,s:bigint,e:bigint>>")))


def _luhn(match):
    digits = F.reverse(F.regexp_replace(match, "[^0-9]", ""))

    def add(total, i):
        d = F.substring(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind, match):
    if kind == "ip":
        return match.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$")
    if kind == "card":
        return _luhn(match)
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """The four base kinds in their order, each by start."""
    none = F.array().cast(SPAN)

    def of(kind):
        def span(x):
            return F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["value"].alias("value"),
                            F.lit(f"<{kind.upper()}>").alias("tag"))

        found = F.transform(F.filter(located(text, PATTERNS[kind]), lambda x: _valid(kind, x["value"])), span)
        need = {"email": "@", "phone": "+", "ip": "."}.get(kind)
        return F.when(F.contains(text, F.lit(need)), found).otherwise(none) if need else found

    return F.concat(*[of(kind) for kind in PATTERNS])


def _with_spans(documents: DataFrame) -> DataFrame:
    """(row, base, key): all columns in one struct, so that no name can clash."""
    text = F.coalesce("text", F.lit(""))
    return documents.select(F.struct("*").alias("row"), base_spans(text).alias("base"),
                            F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("key"))


def _entities(span):
    """The entity of a span and the groups it belongs to."""
    kind = span["kind"]
    plain = F.when(kind.isin("card", "phone"), F.regexp_replace(span["value"], "[^0-9]", "")).otherwise(F.lower(span["value"]))

    def name(group, value):
        return F.concat_ws(":", F.lit(group), value)

    groups = (F.when(kind == "email", F.array(name("owner", F.substring_index(plain, "@", 1)), name("domain", F.substring_index(plain, "@", -1))))
              .when(kind == "ip", F.array(name("network", F.substring_index(plain, ".", 3))))
              .when(kind == "card", F.array(name("issuer", F.substring(plain, 1, 6))))
              .otherwise(F.array(name("exchange", F.substring(plain, F.lit(1), F.length(plain) - 4)))))
    return F.concat(F.array(F.concat_ws(":", kind, plain)), groups)


def _words(text: Column, pattern=WORD) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lower))


def _bucket(term):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).alias("bucket")


def _evidence(texts, n_et, n_e, n_t, total):
    """Bits against chance: texts / x trials of which a share x meets an entity of probability p."""
    x, p = n_et / n_t, n_e / total
    rest = F.when(x < 1, (1 - x) * F.log2((1 - x) / (1 - p))).otherwise(0.0)
    return F.when(x > p, texts / x * (x * F.log2(x / p) + rest)).otherwise(0.0)


def revealing_terms(documents: DataFrame, share=GENERALISE, support=SUPPORT) -> DataFrame:
    """(text key, term, share): terms of texts that disclose at least `share` of an entity named in the same text."""
    text = F.coalesce("text", F.lit(""))
    held = stored(_with_spans(documents.select("text")).where(F.size("base") > 0).groupBy("key").agg(
        F.count("*").alias("docs"), F.first(F.struct(
            F.array_distinct(F.flatten(F.transform("base", _entities))).alias("entities"), _words(F.col("row.text"), TERM).alias("terms"))).alias("of"))
        .select("key", "docs", "of.*"), "pii-texts")  # one row per distinct text that holds a base span
    named = held.select("key", "docs", F.explode("entities").alias("entity"))
    known = (named.groupBy("entity").agg(F.sum("docs").alias("n_e"), F.count("*").alias("texts"))
             .where(F.col("texts") >= min(support, LEAST)).select("entity", "n_e"))
    known = stored(known, "pii-known")
    named = named.join(known, "entity")
    met = stored(held.select("key", "terms").join(named, "key").select("key", "entity", F.explode("terms").alias("term"), "docs", "n_e"), "pii-met")
    together = (met.groupBy("entity", "term").agg(
        F.sum("docs").alias("n_et"), F.count("*").alias("texts"), F.first("n_e").alias("n_e"))
        .where(F.col("texts") >= min(support, LEAST)))
    together = stored(together, "pii-together")
    # A bounded filter first: however many terms there are, few words of other buckets than theirs are shuffled.
    terms = stored(together.select("term").distinct(), "pii-terms")
    buckets = F.broadcast(terms.select(_bucket("term")).distinct())
    words = documents.select(F.explode(_words(text)).alias("term")).withColumn("bucket", _bucket("term"))
    occurring = words.join(buckets, "bucket", "left_semi").groupBy("term").agg(F.count("*").alias("n_t"))
    occurring = occurring.join(terms, "term", "left_semi")
    total = documents.count()
    disclosed = F.log2(F.col("n_et") * total / (F.col("n_e") * F.col("n_t"))) / F.log2(F.lit(float(max(total, 1))) / F.col("n_e"))
    enough = (F.col("texts") >= support) | (_evidence(*map(F.col, ("texts", "n_et", "n_e", "n_t")), total) >= EVIDENCE)
    strong = stored(together.join(occurring, "term").where(F.col("n_e") < total).withColumn("share", disclosed)
                    .where((F.col("share") >= share) & enough).select("entity", "term", "share"), "pii-strong")
    return met.select("key", "entity", "term").join(strong, ["entity", "term"]).groupBy("key", "term").agg(F.max("share").alias("share"))


def _found(documents: DataFrame, share, remove, support) -> DataFrame:
    """(row, text, pii) for every row."""
    terms = revealing_terms(documents, share, support).groupBy("key").agg(
        F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("terms"))  # at most the words of one text
    terms = stored(terms, "pii-text-terms")
    rows, some = _with_spans(documents), F.size("base") > 0  # without a base span a text names no entity, so it has no terms
    rows = (rows.where(some).join(terms.hint("shuffle_merge"), "key", "left")
            .unionByName(rows.where(~some).withColumn("terms", F.lit(None).cast(terms.schema["terms"].dataType)))
            .withColumn("text", F.coalesce("row.text", F.lit(""))))

    def term(x):
        p = F.element_at(F.col("terms"), F.lower(x["value"]))
        return F.struct(F.lit("term").alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["value"].alias("value"),
                        F.when(p >= remove, "").otherwise("<TERM>").alias("tag"))

    found = F.transform(F.filter(
        located(F.col("text"), WORD),
        lambda x: F.map_contains_key(F.col("terms"), F.lower(x["value"]))
        & ~F.exists(F.col("base"), lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))), term)
    extra = F.when(F.col("terms").isNotNull(), found).otherwise(F.array().cast(SPAN))
    return rows.select("row", "text", F.concat("base", extra).alias("pii"))


def detect(documents: DataFrame, share=GENERALISE, remove=REMOVE, support=SUPPORT) -> DataFrame:
    """All columns of `documents` plus `pii`, the base and term spans: array of (kind, s, e, value, tag).

    Base spans come first, by kind (email, ip, card, phone) and start; then `term`
    spans, which never overlap a base span. Offsets are code points of the whole
    text, end exclusive. NULL and empty texts have none. Equal texts have equal
    spans; repeated rows and NULL ids are kept as they are. A column that is
    called `pii` already gives way to the spans; other extra columns pass through.
    """
    names = [c for c in documents.columns if c != "pii"]
    return _found(documents, share, remove, support).select(*[F.col("row").getField(c).alias(c) for c in names], "pii")


def sanitised(documents: DataFrame, share=GENERALISE, remove=REMOVE, support=SUPPORT) -> DataFrame:
    """The columns of `documents` with every span of `text` replaced by its tag (removed terms by nothing).

    A column `n_chars` follows the new text. NULL texts stay NULL; all else is as in `detect`.
    """
    def rewritten(text, spans):
        ends = F.transform(spans, lambda x: x["e"])
        after = F.array_max(ends)
        return let(running(ends, lambda a, b: F.greatest(a, b)), lambda done: F.concat(F.array_join(F.transform(spans, lambda x, i: F.concat(
            F.when(x["s"] > F.get(done, i), F.substring(text, (F.get(done, i) + 1).cast("int"), (x["s"] - F.get(done, i)).cast("int")))
            .otherwise(""), F.when(x["e"] > F.get(done, i), x["tag"]).otherwise(""))), ""),
            F.substring(text, (after + 1).cast("int"), F.length(text))))

    ordered = F.array_sort(F.transform("pii", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["tag"].alias("tag"))))
    text = F.when(F.size("pii") > 0, let(ordered, lambda spans: rewritten(F.col("text"), spans))).otherwise(F.col("row.text"))
    rows = _found(documents, share, remove, support).select("row", text.alias("text"))
    new = {"text": F.col("text"), "n_chars": F.coalesce(F.length("text"), F.lit(0))}
    return rows.select(*[(new[c].cast(kind) if c in new else F.col("row").getField(c)).alias(c) for c, kind in documents.dtypes])


def digest(found: DataFrame) -> DataFrame:
    """Counts and checksums of the spans."""
    def written(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in PATTERNS]
    base = F.filter("pii", lambda x: x["kind"] != "term")
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("pii")).alias("spans"))
