"""Personal data: patterns, and terms whose co-occurrence gives protected values away.

Native: DataFrame and SQL functions only. The patterns find e-mail addresses,
IP addresses, card and phone numbers, and secrets, long strings of high
information. Each place stands for several protected entities: the value, what
recurs of it (account, domain, network, issuer, area) and its class. The words
of an entity's documents, and again those near each place of it, are counted
over distinct contexts, so copies add no evidence. With the counts of those
words over the whole corpus this estimates how probable the entity is once a
word is seen, shrunk towards the entity's own probability, and how much of the
entity's information the word gives away. Words over both thresholds become
spans wherever they stand in a document that holds the entity: ``redact``
removes them when they reveal the entity nearly surely and generalises them otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, keep

# The base patterns. Possessive quantifiers and the look-behind
# leave the matches as they are and keep long texts linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A run of letters and digits this long is a secret if it has several of both and many different characters.
SECRET = r"(?:\G|(?<![A-Za-z0-9_-]))[A-Za-z0-9_-]{24,}+"
KINDS = ("email", "ip", "card", "phone")
#: Further kinds: a term that is generalised, one that is removed since it gives the entity away, a secret.
GENERAL, GONE, SECRETS = 4, 5, 6
NAMES = (*KINDS, "term", "removed", "secret")
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: Words on each side of a protected value that make up a context.
WINDOW = 6
#: Contexts that the estimate of an entity's probability after a word borrows from the corpus.
PRIOR = 3.0
#: Share of the entity's information that a term may give away, and its probability after the term; over the last, the term goes.
DISCLOSURE, LIKELY, SURE = 0.8, 0.5, 0.9
#: Candidate terms up to this many are sent to all tasks; more are joined by a shuffle.
SMALL_TERMS = 200_000
#: Names with this many rows and a thousandth of all are dealt over so many salts.
HOT, SALTS = 10_000, 64


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the Luhn sum of a digit string is a multiple of ten."""
    back = F.split(F.reverse(digits), "")
    value = F.transform(back, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.get(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int"))))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        n = F.length(_digits(value))
        return F.when(n.between(14, 19), _luhn(_digits(value))).otherwise(False)
    if kind == "secret":
        n = F.length(_digits(value))
        return (n >= 4) & (F.length(F.regexp_replace(value, "[^A-Za-z]", "")) >= 4) & (F.size(F.array_distinct(F.split(F.lower(value), ""))) >= 10)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def matches(text: Column, kind: str, pattern: str) -> Column:
    """array<struct<start, kind, end, value>>: leftmost non-overlapping matches that pass, in code points.

    A text split by the pattern has one more piece than it has matches; the
    lengths of both, summed up, give the positions.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>").alias("out"))
    both = F.arrays_zip(pieces.alias("p"), found.alias("m"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["p"])
        e = s + F.length(x["m"])
        one = F.array(F.struct(s.alias("start"), F.lit(NAMES.index(kind)).alias("kind"), e.alias("end"), x["m"].alias("value")))
        return F.struct(F.coalesce(e, s).alias("at"), F.when(x["m"].isNotNull() & _passes(kind, x["m"]), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    walked = F.aggregate(both, start, step)["out"]
    probe = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "ip": text.rlike("[0-9]"), "card": text.rlike("[0-9]"), "secret": text.rlike("[A-Za-z0-9_-]{24}")}[kind]
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    return F.when(probe & (F.size(found) > 0), walked).otherwise(none)


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start, then kind."""
    return F.array_sort(F.concat(*(matches(text, k, p) for k, p in zip(KINDS, (EMAIL, IP, CARD, PHONE)))))


_WORD = r"[\p{L}\p{M}]+"
_SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


#: Stands for a place of a protected value in a blanked text.
_MARK = "\x01"


def _blanked(text: Column, spans: Column) -> Column:
    """struct<rest, marks>: ``text`` with a mark and spaces in place of the spans, so that other places stay where they are;
    and for each span the number of its mark, which overlapping spans share."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), F.lit(-1).alias("k"), F.array().cast("array<int>").alias("marks"))

    def step(acc: Column, b: Column) -> Column:
        fresh = b["start"] >= acc["at"]
        lo = F.greatest(b["start"], acc["at"])
        blank = F.repeat(F.lit(" "), F.greatest(b["end"] - lo - F.when(fresh, 1).otherwise(0), F.lit(0)))
        k = acc["k"] + F.when(fresh, 1).otherwise(0)
        grown = F.concat(acc["out"], F.substring(text, acc["at"] + 1, lo - acc["at"]), F.when(fresh, F.lit(_MARK)).otherwise(""), blank)
        return F.struct(F.greatest(acc["at"], b["end"]).alias("at"), F.when(b["end"] > acc["at"], grown).otherwise(acc["out"]).alias("out"), k.alias("k"), F.concat(acc["marks"], F.array(k)).alias("marks"))

    return F.aggregate(spans, start, step, lambda a: F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))).alias("rest"), a["marks"].alias("marks")))


def words_of(text: Column) -> Column:
    """The words of a text, lower-cased, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def signature(words: Column) -> Column:
    """Tells documents apart as contexts: the smallest hash of three words in a row, which near copies mostly share."""
    two = F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.xxhash64(a, b))
    return F.array_min(F.zip_with(two, F.slice(words, F.lit(3), F.size(words)), lambda a, b: F.xxhash64(a, b)))


def entities_of(kind: Column, value: Column) -> Column:
    """What a place protects: the value, what recurs of it, and its class."""
    v, digits = ascii_lower(value), _digits(value)
    name = F.get(F.array(*map(F.lit, NAMES)), kind)
    part = F.when(kind == KINDS.index("ip"), F.concat(F.lit("network:"), F.substring_index(v, ".", 2)))
    part = part.when(kind == KINDS.index("card"), F.concat(F.lit("issuer:"), F.substring(digits, 1, 6))).when(kind == KINDS.index("phone"), F.concat(F.lit("area:"), F.substring(digits, 1, 5)))
    mail = kind == KINDS.index("email")
    name_of = F.nullif(F.regexp_extract(v, r"^([^@0-9]*[^@0-9._%+-])?", 0), F.lit(""))
    account = F.when(mail, F.concat(F.lit("account:"), name_of))
    domain = F.when(mail, F.concat(F.lit("domain:"), F.substring_index(v, "@", -1)))
    return F.array_compact(F.array(F.concat_ws(":", name, v), F.concat(F.lit("class:"), name), part, account, domain))


def _places(text: Column, told: Column) -> Column:
    """The words of ``text`` that ``told`` names: array<struct<pos, kind>>, number of the word and its kind, in order."""
    found = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    start = F.struct(*(F.lit(0).alias(c) for c in ("at", "k", "next")), F.array().cast(_SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        b = acc["at"] + F.length(x["p"])
        e = b + F.length(x["m"])
        hit = F.coalesce(F.get(told, acc["next"])["pos"] == acc["k"], F.lit(False))
        one = F.array(F.struct(b.alias("start"), F.get(told, acc["next"])["kind"].alias("kind"), e.alias("end"), F.lower(x["m"]).alias("value")))
        return F.struct(F.coalesce(e, b).alias("at"), (acc["k"] + 1).alias("k"), (acc["next"] + F.when(hit, 1).otherwise(0)).alias("next"), F.when(hit, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(F.arrays_zip(F.split(text, _WORD, -1).alias("p"), found.alias("m")), start, step)["out"]


def _joined(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Joined by document and text; ids may be null."""
    right = right.withColumnsRenamed({"doc_id": "__d", "text_hash": "__t"})
    return left.join(right, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("text_hash") == F.col("__t")), how).drop("__d", "__t")


def _set_of(name: str) -> tuple[Column, Column]:
    """128 bits that tell sets of documents apart, whatever the order of the rows; they are combined before the shuffle."""
    return F.bit_xor(F.xxhash64("doc_id", "text_hash")).alias(f"{name}1"), F.bit_xor(F.xxhash64(F.lit(1), "doc_id", "text_hash")).alias(f"{name}2")


def _dealt(rows: DataFrame, by: DataFrame, name: str, size: str, total: int) -> DataFrame:
    """``rows`` joined with ``by`` on ``name``; names whose ``size`` is a thousandth of ``total`` and more are dealt over salts.

    Sizes add up to ``total`` at most, so 1,000 names at most are so frequent and are sent to all tasks.
    """
    hot = (F.col(size) * 1000 >= total) & (F.col(size) >= HOT)
    few = F.broadcast(by.where(hot).select(name, F.lit(True).alias("__hot")))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    rows = rows.join(few, name, "left").withColumn("__salt", salt).drop("__hot")
    salts = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return rows.join(by.withColumn("__salt", F.explode(salts)), [name, "__salt"]).drop("__salt")


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, base and disclosed spans, each array<struct<start, kind, end, value>>.

    Null texts are empty. Rows that repeat an id are told apart by a hash of
    their texts; equal rows get equal spans, once each. Null ids are kept. An
    empty table gives no rows, texts of any length take part whole, extra
    columns are ignored, and ties cannot arise, as thresholds decide.
    Disclosed spans have kind 4 (generalised), 5 (removed) or 6 (a secret);
    their value is the term or the secret.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = src.select("doc_id", F.xxhash64("text").alias("text_hash"), "text", base_spans(F.col("text")).alias("base"), matches(F.col("text"), "secret", SECRET).alias("secrets"))
    # Texts go on only where there are values.
    base = keep(found.select("doc_id", "text_hash", "base", "secrets", F.when((F.size("base") > 0) | (F.size("secrets") > 0), F.col("text")).alias("text")))
    total = base.count()
    key = ["doc_id", "text_hash"]
    some = base.where("text is not null").dropDuplicates(key).select(*key, F.translate("text", _MARK, " ").alias("text"), F.array_sort(F.concat("base", "secrets")).alias("held"))
    some = some.select(*key, "held", _blanked(F.col("text"), F.col("held")).alias("b"))
    some = keep(some.select(*key, "held", F.col("b.rest").alias("rest"), F.col("b.marks").alias("marks"), F.regexp_extract_all(F.lower("b.rest"), F.lit(rf"{_MARK}|{_WORD}"), F.lit(0)).alias("tokens")))
    # Before the k-th mark stand as many words as tokens, less k.
    marked = F.transform(F.filter(F.transform("tokens", lambda t, i: F.when(t == _MARK, i)), lambda i: i.isNotNull()), lambda i, k: i - k)
    spoken = keep(some.select(*key, "held", "marks", marked.alias("at"), F.filter("tokens", lambda t: t != _MARK).alias("words")).withColumn("distinct", F.array_distinct("words")).withColumn("context", signature(F.col("words"))))

    at = F.get(F.col("at"), F.col("mark"))
    before = F.greatest(at - WINDOW, F.lit(0))
    places = spoken.select(*key, "context", "at", "words", F.explode(F.arrays_zip("held", "marks")).alias("x")).select(*key, "context", "at", "words", F.col("x.held").alias("span"), F.col("x.marks").alias("mark"))
    near = places.select(*key, "context", F.col("span.start").alias("start"), entities_of(F.col("span.kind"), F.col("span.value")).alias("entities"), F.array_distinct(F.slice("words", before + 1, at - before + WINDOW)).alias("words"))
    near = near.withColumn("window", F.xxhash64("words")).select(*key, F.explode("entities").alias("entity"), "context", "window", "start", "words")
    near = keep(near)
    # Copies have the same signature or the same words near the value: a place counts for each signature, and of these one for each window.
    place = F.struct(*key, "start", "window", "words")
    first = near.groupBy("entity", "context").agg(F.min_by(place, F.struct("start", "window")).alias("p"))
    told_by = first.groupBy("entity", F.col("p.window").alias("window")).agg(F.min_by("p", "context").alias("p"))
    counted = keep(told_by.select("entity", "p.doc_id", "p.text_hash", "p.words"))
    # Entities counted in the same documents have the same figures with every word, and so have words of the same
    # documents: one of each class goes on, so a text is not multiplied by the number of its values.
    entities = keep(counted.groupBy("entity").agg(F.count(F.lit(1)).alias("entity_n"), *_set_of("c")).where("entity_n >= 2"))
    classes = entities.groupBy("c1", "c2", "entity_n").agg(F.min("entity").alias("entity"))
    spread = counted.count()

    n = F.lit(float(max(total, 2)))
    p = F.col("entity_n") / n

    def after(joint: Column) -> Column:
        return (F.least(joint, "term_n") + PRIOR * p) / (F.col("term_n") + PRIOR)

    share = F.log2(after(F.col("joint")) / p) / F.greatest(-F.log2(p), F.lit(1e-9))
    told = (after(F.col("joint")) >= LIKELY) & (share >= DISCLOSURE)
    # A term stands in at least as many contexts as in the ones counted here; terms that cannot
    # reach the thresholds even so need no count over the whole corpus. One context never suffices.
    at_once = spoken.select(*key, "context", F.explode("distinct").alias("word")).groupBy("word", "context").agg(*_set_of("w"))
    words = keep(at_once.groupBy("word").agg(F.count(F.lit(1)).alias("term_n"), *(F.bit_xor(c).alias(c) for c in ("w1", "w2"))).where("term_n >= 2"))
    said = words.agg(F.sum("term_n")).first()[0] or 0
    word_classes = words.groupBy("w1", "w2", "term_n").agg(F.min("word").alias("word"))

    held = _dealt(counted.select("entity", *key), classes, "entity", "entity_n", spread).drop("entity")
    stand = _dealt(spoken.select(*key, F.explode("distinct").alias("word")), word_classes, "word", "term_n", said).drop("word")
    # A pair goes on only if the thresholds could be reached with the entity in all contexts of the word.
    met = _joined(held, stand).where(after(F.col("entity_n")) >= LIKELY).groupBy("c1", "c2", "w1", "w2").agg(F.count(F.lit(1)).alias("joint"), F.min("entity_n").alias("entity_n"), F.min("term_n").alias("term_n"))
    pairs = keep(met.where("joint >= 2").where(told).drop("term_n"))
    candidates = keep(words.join(pairs.select("w1", "w2").distinct(), ["w1", "w2"]))
    n_terms = candidates.count()
    none = F.array().cast(_SPANS)
    if n_terms == 0:
        return base.select(*key, "base", F.col("secrets").alias("disclosed"))

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if n_terms <= SMALL_TERMS else df

    # The documents without values, whose words are looked up among the candidates.
    split = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{M}]+"), lambda w: w != "")
    elsewhere = src.select("doc_id", F.xxhash64("text").alias("text_hash"), split.alias("words"))
    elsewhere = elsewhere.select(*key, signature(F.col("words")).alias("context"), F.array_distinct("words").alias("distinct")).select(*key, "context", F.explode("distinct").alias("word"))
    # Kept, or else the anti join would be made before the words are looked up, with all texts.
    elsewhere = keep(elsewhere.join(small(candidates.select("word")), "word"))
    elsewhere = _joined(elsewhere, spoken.select(*key), "left_anti").groupBy("word").agg(F.count_distinct("context").alias("more"))
    term_df = keep(candidates.join(elsewhere, "word", "left").select("word", "w1", "w2", (F.col("term_n") + F.coalesce("more", F.lit(0))).alias("term_n")))

    alike = ["w1", "w2", "term_n"]
    gone = F.when(after(F.col("joint")) >= SURE, GONE).otherwise(GENERAL)
    reveal = pairs.join(term_df.select(*alike).distinct(), ["w1", "w2"]).where(told).select("c1", "c2", *alike, gone.alias("kind"))
    # Looked up among a document's own words: the classes of its entities with the classes of its candidate terms.
    holds = _dealt(near.select("entity", *key).distinct(), entities, "entity", "entity_n", spread).select(*key, "c1", "c2").distinct()
    own = keep(spoken.select(*key, F.posexplode("words").alias("pos", "word")).join(small(term_df), "word").select(*key, "pos", *alike))
    kinds = _joined(own.select(*key, *alike).distinct(), holds).join(reveal, ["c1", "c2", *alike]).groupBy(*key, *alike).agg(F.max("kind").alias("kind"))
    kinds = kinds.withColumnsRenamed({c: f"__{c}" for c in alike})
    per_word = _joined(own, kinds).where(" and ".join(f"{c} = __{c}" for c in alike))
    wanted = per_word.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "kind"))).alias("wanted"))
    terms = _joined(some.select(*key, "rest"), wanted).select(*key, _places(F.col("rest"), F.col("wanted")).alias("terms"))
    return _joined(base, terms, "left").select(*key, "base", F.array_sort(F.concat("secrets", F.coalesce("terms", none))).alias("disclosed"))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order given."""
    names = F.array(*map(F.lit, NAMES))
    return F.array_join(F.transform(spans, lambda b: F.concat_ws(":", F.get(names, b["kind"]), b["start"], b["end"])), ",")


def redact(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``sanitised``: base values become [EMAIL] and so on, disclosed terms become [TERM] or go.

    Null texts become empty ones. Rows without spans in ``spans``, null ids included, keep their text; rows that
    repeat an id are told apart by their texts, and equal rows stay as often as they are. Of overlapping spans the one
    that starts first is replaced and the rest of the later ones goes. Other columns stay, whatever their names, but
    for one called ``sanitised``, which is replaced. An empty table stays empty.
    """
    src = docs.withColumn("__h", F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    found = spans.dropDuplicates(["doc_id", "text_hash"]).select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__t"), F.array_sort(F.concat("base", "disclosed")).alias("__s"))
    joined = src.join(found, F.col(id_col).cast("long").eqNullSafe(F.col("__d")) & (F.col("__h") == F.col("__t")), "left")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    names = F.array(*map(F.lit, ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]", "", "[SECRET]")))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, b: Column) -> Column:
        fresh = b["start"] >= acc["at"]
        grown = F.concat(acc["out"], F.substring(text, acc["at"] + 1, b["start"] - acc["at"]), F.get(names, b["kind"]))
        return F.struct(F.greatest(acc["at"], b["end"]).alias("at"), F.when(fresh, grown).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate(F.coalesce("__s", F.array().cast(_SPANS)), start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return joined.withColumn("sanitised", clean).drop("__h", "__d", "__t", "__s")
