"""Personal data by fixed patterns and bootstrapped contextual extraction, in SQL functions only.

Base entities (e-mail, IP address, card, phone) are matched by regular expressions that
cannot backtrack over a run twice, so a text is read in linear time. They and labelled
secrets are the seeds of the bootstrap:

1. A mention is a run of identifier characters that has a digit in it or follows a colon or an
   equals sign. Its lexical patterns are the two words before it, the word after it, and its shape.
2. The pattern-instance graph holds each (pattern, token) pair once, with its count. In each
   round a pattern scores the mean of its instances' scores, damped by ``doubt`` imaginary
   instances of score 0, and a token that is no seed gets the noisy-or of its patterns that
   score at least ``least_pattern``, if there are two of different kinds among them, or two
   different contexts: a token of a shape that no seed has is found by its contexts alone.
3. Mentions outside the base spans whose token reaches ``least_token`` become spans of kind
   ``id``; patterns that only they support discover further ones in the next round.

Documents stay rows from first to last: only mentions are exploded, and spans come back as
one array a document. Joins on a pattern or a token are salted, so that a frequent one is dealt
over several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import WORD_GAP, let, written

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns, with possessive repeats; a match starts where a run does or the last match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A test that every text with a match passes, cheaper than the pattern.
HINTS = {"email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"), "phone": lambda t: t.rlike(r"\+[0-9]")}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Labels that introduce a secret: seeds of the bootstrap beside the base entities.
SECRET_LABEL = r"(?i)(?:^|[^a-z])(?:token|secret|password|passwd|api[_-]?key)['\x22]?\x20?[=:]$"
MENTION = r"(?<![A-Za-z0-9._%+@:/-])[A-Za-z._%+@:/-]*+[0-9][A-Za-z0-9._%+@:/-]*+|(?<=[:=]\x20?['\x22]?)(?<![A-Za-z0-9._%+@/-])[A-Za-z][A-Za-z0-9._%+@/-]*+"
_SPACE, _WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
#: From the end of a text before a mention, reversed: quotes and white space, then the word or two before it.
LEFT = rf"^(?:{_SPACE}|[\x22'`])*+({_WORD}++(?:{_SPACE}++{_WORD}++)?)"
RIGHT = rf"^{_SPACE}*+({_WORD}++)"
SALTS = 16
CHUNK = 256


def _cut(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m, gap, after>> of the leftmost non-overlapping matches, in code points;
    gap is the text before the match, after the text up to the next one. Offsets add up in two
    levels of chunks, so that many matches don't make it quadratic."""
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(F.zip_with(pieces, found, lambda p, m: F.struct(p.alias("gap"), m.alias("m"))), _offsets)


def _offsets(both: Column) -> Column:
    def run(start: Column, items: Column) -> Column:
        zero = F.struct(start.cast("int").alias("at"), F.expr("CAST(array() AS array<struct<s:int,e:int,m:string,gap:string>>)").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            s = acc["at"] + F.length(x["gap"])
            e = s + F.coalesce(F.length(x["m"]), F.lit(0))
            item = F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"), x["gap"].alias("gap"))
            return F.struct(e.alias("at"), F.concat(acc["out"], F.array(item)).alias("out"))

        return F.aggregate(items, zero, step)

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(both) - 1) / CHUNK).cast("int")), lambda c: F.slice(both, c * CHUNK + 1, CHUNK))
    zero = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<array<struct<s:int,e:int,m:string,gap:string>>>)").alias("out"))

    def chunk(acc: Column, items: Column) -> Column:
        return let(run(acc["at"], items), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    return F.flatten(F.aggregate(chunks, zero, chunk)["out"])


def _luhn(digits: Column) -> Column:
    back = F.split(F.reverse(digits), "")

    def add(acc: Column, d: Column) -> Column:
        v = d.cast("int")
        twice = F.when(v > 4, 2 * v - 9).otherwise(2 * v)
        return F.struct((acc["sum"] + F.when(acc["odd"], twice).otherwise(v)).alias("sum"), (~acc["odd"]).alias("odd"))

    start = F.struct(F.lit(0).alias("sum"), F.lit(False).alias("odd"))
    return F.aggregate(F.filter(back, lambda d: d != ""), start, add)["sum"] % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    digits = F.translate(m, "+(). -", "")
    n = F.length(digits)
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.when(n.between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


_SPANS = "array<struct<s:int,e:int,kind:string>>"


def base_spans(text: Column) -> Column:
    """array<struct<s, e, kind>> of the fixed patterns, by start, then kind in the order of KINDS."""

    def spans(i: int, kind: str) -> Column:
        found = F.filter(_cut(text, PATTERNS[kind]), lambda x: x["m"].isNotNull() & _valid(kind, x["m"]))
        ordered = F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("i"), x["e"].alias("e"), F.lit(kind).alias("kind")))
        return F.when(HINTS[kind](text), ordered).otherwise(F.expr("CAST(array() AS array<struct<s:int,i:int,e:int,kind:string>>)"))

    return F.transform(F.sort_array(F.concat(*(spans(i, k) for i, k in enumerate(KINDS)))), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def _shape(token: Column) -> Column:
    """Digits as 9, runs of letters as a; a hexadecimal run as x and its length."""
    hexa = token.rlike("^[0-9a-f]*[a-f][0-9a-f]*$") & (F.length(token) >= 16)
    return F.when(hexa, F.concat(F.lit("x"), F.length(token))).otherwise(F.regexp_replace(F.regexp_replace(token, "[0-9]", "9"), "[a-z]++", "a"))


def _mentions(text: Column) -> Column:
    """array<struct<s, e, token, left, right>>; contexts are the two words before, the word after,
    lower-cased and whole, however long, with one blank between them."""
    left = lambda t: F.lower(F.regexp_replace(F.reverse(F.regexp_extract(F.reverse(t), LEFT, 1)), WORD_GAP, " "))
    right = lambda t: F.lower(F.regexp_extract(t, RIGHT, 1))

    def one(cut: Column, x: Column, i: Column) -> Column:
        token = F.rtrim(x["m"], F.lit(".:-/%"))
        return F.struct(x["s"].alias("s"), (x["s"] + F.length(token)).alias("e"), F.lower(token).alias("token"), left(x["gap"]).alias("left"), right(F.coalesce(F.get(cut, i + 1)["gap"], F.lit(""))).alias("right"))

    found = let(_cut(text, MENTION), lambda cut: F.transform(F.filter(F.transform(cut, lambda x, i: F.when(x["m"].isNotNull(), one(cut, x, i))), lambda x: x.isNotNull()), lambda x: x))
    return F.when(text.rlike("[0-9:=]"), found).otherwise(F.expr("CAST(array() AS array<struct<s:int,e:int,token:string,left:string,right:string>>)"))


def _salted(many: DataFrame, few: DataFrame, key: str, by: list[str], how: str) -> DataFrame:
    """many joined with few, which has one row a key, on key: each row of few is there SALTS times, and
    the rows of many that share a key part by a hash of the columns by."""
    salted = many.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))
    copies = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies.hint("merge"), [key, "salt"], how).drop("salt")  # not to be broadcast, SALTS times its size


def discovered(narrow: DataFrame, rounds: int = 3, least_pattern: float = 0.6, least_token: float = 0.75, doubt: float = 2.0) -> DataFrame:
    """doc_id, th, more (sorted array of spans of kind id) of the documents that get any.

    narrow: doc_id, th, base (spans), mentions.
    """
    m = narrow.where(F.size("mentions") > 0).select("doc_id", "th", "base", F.explode("mentions").alias("m")).select("doc_id", "th", "m.*", "base")
    inside = F.exists("base", lambda b: (b["s"] < F.col("e")) & (F.col("s") < b["e"]))
    m = m.withColumn("in_base", inside).withColumn("seed", F.col("in_base") | F.col("left").rlike(SECRET_LABEL) & (F.length("token") >= 16))
    m = written(m.drop("base"), "mentions")
    patterns = F.array(F.concat(F.lit("L "), "left"), F.concat(F.lit("R "), "right"), F.concat(F.lit("S "), _shape(F.col("token"))))
    graph = m.withColumn("pattern", F.explode(patterns)).where(~F.col("pattern").isin("L ", "R "))
    graph = written(graph.groupBy("pattern", "token").agg(F.count("*").alias("n"), F.max("seed").alias("seed")), "graph")
    score = F.when(F.col("seed"), 1.0).otherwise(F.coalesce("score", F.lit(0.0)))
    tokens = None
    for _ in range(rounds):
        scored = graph.withColumn("score", F.lit(None).cast("double")) if tokens is None else _salted(graph, tokens, "token", ["pattern"], "left")
        rated = scored.groupBy("pattern").agg((F.sum(score) / (F.count("*") + doubt)).alias("p")).where(F.col("p") >= least_pattern)
        shape = F.col("pattern").startswith("S ")
        by_token = _salted(graph, rated, "pattern", ["token"], "inner").groupBy("token").agg(F.sum(F.ln(1 - F.least("p", F.lit(0.999)))).alias("l"), F.max(shape).alias("shape"), F.count_if(~shape).alias("contexts"))
        # a shape alone, or one context alone, is no evidence
        tokens = written(by_token.where("contexts > 1 OR shape AND contexts > 0").select("token", (1 - F.exp("l")).alias("score")), "tokens")
    good = tokens.where(F.col("score") >= least_token).select("token")
    new = _salted(m.where(~F.col("in_base")), good, "token", ["doc_id", "th", "s"], "left_semi").unionByName(m.where("seed AND NOT in_base")).select("doc_id", "th", F.struct("s", "e", F.lit("id").alias("kind")).alias("x"))
    return new.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("x")).alias("more"))


def _narrow(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return written(rows.select("doc_id", F.xxhash64("text").alias("th"), base_spans(F.col("text")).alias("base"), _mentions(F.col("text")).alias("mentions")), "spans")


def _merged(base: Column, more: Column) -> Column:
    order = lambda x: F.struct(x["s"].alias("s"), F.array_position(F.array(*map(F.lit, (*KINDS, "id"))), x["kind"]).alias("i"), x["e"].alias("e"), x["kind"].alias("kind"))
    every = F.sort_array(F.transform(F.concat(base, more), order))
    return F.when(more.isNull(), base).otherwise(F.transform(every, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))


def _with_more(rows: DataFrame, more: DataFrame) -> DataFrame:
    """rows (with columns doc_id and _th) and the discovered spans of each, null for none."""
    m = more.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), F.col("more").alias("_more"))
    return rows.join(m, F.col("doc_id").cast("long").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_t")), "left").drop("_d", "_t")


def find(docs: DataFrame, **options) -> DataFrame:
    """doc_id, base and spans (arrays of s, e, kind) of every row of docs (doc_id, text).
    Offsets are code points, e exclusive. A null or empty text has no spans, a null doc_id is an
    id like any other, repeated rows give repeated rows, an empty table gives an empty one;
    other columns are not carried."""
    narrow = _narrow(docs)
    out = _with_more(narrow.drop("mentions").withColumnRenamed("th", "_th"), discovered(narrow, **options))
    return out.select("doc_id", "base", _merged(F.col("base"), F.col("_more")).alias("spans"))


def redacted(docs: DataFrame, **options) -> DataFrame:
    """docs with every span of find() replaced by its kind in brackets, all columns kept; where
    there is a column n_chars it becomes the new length. A null text stays null, an empty one
    empty; spans that overlap are replaced together, by the kind that starts first; null ids and
    repeated rows are rows like any other; an empty table gives an empty one."""
    more = discovered(_narrow(docs), **options)
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id"), F.col("text"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_th"))
    rows = _with_more(keyed, more)
    clean = F.when(F.col("text").isNotNull(), let(_merged(base_spans(F.col("text")), F.col("_more")), lambda spans: redact(F.col("text"), spans)))
    out = rows.withColumn("clean", clean)
    kinds = {f.name: f.dataType for f in docs.schema}
    new = {"text": F.col("clean"), "n_chars": F.length("clean").cast(kinds.get("n_chars", "long"))}
    return out.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def digest(found: DataFrame) -> DataFrame:
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with each span as its kind in brackets; spans that overlap an earlier one add to it."""
    start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<string>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh = x["s"] >= acc["at"]
        piece = F.concat(F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"))

    done = let(F.aggregate(spans, start, step), lambda r: F.concat(F.array_join(r["out"], ""), F.substring(text, r["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(done)
